"""Compactors and heaps against exact answers; nulls in every statistic and sketch."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tallywell.functions.hashing import integer_key
from tallywell.model import Unsupported
from tallywell.operators import compactors as K
from tallywell.operators import exact as X
from tallywell.operators import heaps as H
from tallywell.operators import scoring as C
from tallywell.operators import sketches as S
from tallywell.operators import stream_sketches as T
from tallywell.operators import windows as V


@pytest.fixture(scope="module")
def stream(spark):
    r = random.Random(8)
    rows = [(int(r.paretovariate(1.1)) % 5000, r.gauss(0, 100), r.choice("ab"), i % 8) for i in range(30_000)]
    rows += [(None, None, "a", 1), (None, float("nan"), None, 2)] * 20
    return spark.createDataFrame(rows, "k long, v double, g string, shard long").repartition(6).cache()


@pytest.mark.parametrize("order", ["as it is", "ascending", "descending"])
def test_compactors(spark, stream, order):
    df = stream if order == "as it is" else stream.orderBy(F.asc("v") if order == "ascending" else F.desc("v"))
    qs = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    state = K.merge(K.sketch(df, "v", 200), 200)
    r = K.kept(state).first()
    values = sorted(x.v for x in stream.collect() if x.v is not None and x.v == x.v)
    assert (r.n, r.least, r.largest) == (len(values), values[0], values[-1]) and r.held < 4 * 200 and r.levels >= 4
    clean = stream.filter("NOT isnan(v)")
    errors = C.rank_errors(clean, "v", K.quantiles(state, qs)).collect()
    assert len(errors) == len(qs) and max(e.rank_error for e in errors) <= 2 * K.rank_error(200)
    shares = {x.x: x.share for x in K.ranks(state, [-100, 0, 1000]).collect()}
    assert shares[1000] == 1.0 and abs(shares[0] - sum(v <= 0 for v in values) / len(values)) <= 2 * K.rank_error(200)


def test_compactors_by_group_and_shard(spark, stream):
    a = K.merge(K.sketch(stream, "v", 100, ["g"], shard="shard"), 100, ["g"], shards=8)
    b = K.merge(K.sketch(stream.orderBy("shard", "v"), "v", 100, ["g"], shard="shard"), 100, ["g"], shards=8)
    counts = {r.g: r.n for r in stream.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.count("*").alias("n")).collect()}
    for state in (a, b):
        assert {r.g: r.n for r in K.kept(state, ["g"]).collect()} == counts
    assert K.quantiles(a, [0.5], ["g"]).count() == 2
    few = spark.createDataFrame([(3.0, "x"), (1.0, "x"), (None, "y")], "v double, g string")
    assert sorted(map(tuple, K.quantiles(K.merge(K.sketch(few, "v", 50, ["g"]), 50, ["g"]), [0.5, 1.0], ["g"]).collect())) == [("x", 0.5, 1.0), ("x", 1.0, 3.0)]
    none = K.merge(K.sketch(few.filter("false"), "v", 50), 50)
    assert K.quantiles(none, [0.5]).count() == 0 and K.ranks(none, [1]).count() == 0


@pytest.mark.parametrize("signed", [False, True])
def test_heaps_in_one_pass(stream, signed):
    key = integer_key(F.col("k"))
    cells, keys = H.heaped(stream, "k", key, 3, 512, 64, signed)
    plain = S.matrix(stream, key, 3, 512, signed)
    nonzero = lambda m: {(r.r, r.c): r.n for r in m.collect() if r.n}
    assert nonzero(cells) == nonzero(plain) == nonzero(H.filled(stream, key, 3, 512, signed))
    weighted = S.matrix(stream, key, 3, 512, signed, F.col("shard"))
    assert nonzero(weighted) == nonzero(H.filled(stream, key, 3, 512, signed, F.col("shard")))
    held = {r.k for r in keys.collect()}
    truth = collections.Counter(r.k for r in stream.collect() if r.k is not None)
    assert None not in held and len(held) <= 6 * 64 and {k for k, _ in truth.most_common(16)} <= held
    top = S.top(S.estimate(cells, keys, key, 3, 512, signed), "k", 8).collect()
    assert len({r.k for r in top} & {k for k, _ in truth.most_common(8)}) >= 7


def test_second_pass_misses_none(stream):
    key = integer_key(F.col("k"))
    state = H.filled(stream, key, 3, 256)
    every = S.estimate(state, stream.select("k").filter("k IS NOT NULL"), key, 3, 256)
    want = every.distinct().orderBy(F.desc("estimate"), "k").limit(20).collect()
    assert H.greatest(every, "k", 20).collect() == want
    assert H.greatest(every.filter("false"), "k", 5).count() == 0
    with pytest.raises(Unsupported):
        H.filled(stream, key, 1 << 11, 1 << 12)


def test_univmon_in_one_pass(spark, stream):
    """Its cells are those of all rows in every layer, and with room for all keys it is what the relational one is."""
    df = stream.withColumn("w", F.when(F.col("shard") == 3, None).otherwise(F.col("shard")).cast("long"))
    of = dict(layers=6, rows=3, cols=256)
    cells, held = H.univmon_pass(df, "k", F.col("w"), heap=10_000, **of)
    sums = df.filter("k IS NOT NULL").groupBy("k").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    state, estimates = S.layered(sums, weight="w", **of)
    nonzero = lambda m: {(r.layer, r.r, r.c): r.n for r in m.collect() if r.n}
    assert nonzero(cells) == nonzero(state)
    want = S.heaviest(estimates, 10_000)
    key = lambda d: {(r.layer, r.k, r.deep): r.estimate for r in d.collect()}
    assert key(held) == key(want)
    few = S.univmon_statistics(H.univmon_pass(df, "k", F.col("w"), heap=64, **of)[1], 6).first()
    whole = S.univmon_statistics(want, 6).first()
    assert abs(few.l2 / whole.l2 - 1) < 0.1 and abs(few.entropy / whole.entropy - 1) < 0.3
    assert H.univmon_pass(df.filter("false"), "k", F.col("w"), heap=4, **of)[1].count() == 0


def test_string_keys_in_heaps(spark):
    df = spark.createDataFrame([(w,) for w in ["a"] * 50 + ["b"] * 30 + [None] * 40 + [f"w{i}" for i in range(100)]], "w string").repartition(3)
    key = integer_key(F.col("w"), text=True)
    cells, keys = H.heaped(df, "w", key, 3, 256, 4)
    assert {"a", "b"} <= {r.w for r in keys.collect()} and cells.filter("r = 0").agg(F.sum("n")).first()[0] == 180


# -- nulls ---------------------------------------------------------------------------------------------------------


def test_nulls_are_no_values(spark):
    df = spark.createDataFrame([(None, "a"), (1.0, "a"), (2.0, "a"), (3.0, "a"), (None, "b")], "v double, g string")
    for rule in ("linear", "order", "floor"):
        assert [r.value for r in X.quantiles(df, "v", [0.5], rule).collect()] == [2.0]
        assert [(r.g, r.value) for r in X.quantiles(df, "v", [0.5], rule, ["g"]).collect()] == [("a", 2.0)]
    assert [r.rank_error for r in C.rank_errors(df, "v", X.quantiles(df, "v", [0.5])).collect()] == [0.0]
    assert [(r.g, r.share) for r in X.group_cdf(df, ["g"], "v", [2]).collect()] == [("a", 2 / 3)]
    s = df.withColumn("ts_ms", F.lit(5).cast("long"))
    assert [r.value for r in V.quantile_over_time(s, V.Grid(10, 10, 10), 10, 0.5, [], value="v").collect()] == [2.0]
    vector = s.withColumnRenamed("ts_ms", "t").withColumnRenamed("v", "value")
    assert [r.value for r in V.aggregate(vector, "quantile", [], 0.5).collect()] == [2.0]
    got = S.dd_quantiles(S.dd_buckets(df, "v", 0.01), 0.01, [0.5]).first().value
    assert abs(got / 2 - 1) <= 0.01


def test_nulls_are_no_keys(spark):
    df = spark.createDataFrame([(None,), (None,), (5,)], "k long").repartition(2)
    key = integer_key(F.col("k"))
    assert round(S.hll_estimate(S.registers(df, key, 9), 9).first()[0]) == round(S.hll_ertl(S.registers(df, key, 9), 9).first()[0]) == 1
    assert S.kmv_estimate(S.least_hashes(df, key, 64), 64).first()[0] == 1.0
    assert S.bloom(df, key, 3, 64).count() == 3
    assert [tuple(r) for r in T.space_saving(df, "k", 4).collect()] == [(5, 1, 0)]
    assert [tuple(r) for r in T.elastic(df, "k", 8, 2, 64).collect()] == [(5, 1)]
    assert [tuple(r) for r in T.coco(df, "k", 2, 8).collect()] == [(5, 1)]
    assert round(T.hll_hip(df.withColumn("i", F.monotonically_increasing_id()), key, ["i"], 9).first()[0]) == 1
    assert T.nitro(df.withColumn("i", F.monotonically_increasing_id()), F.col("i"), key, 1.0, 2, 16, False).agg(F.sum("n")).first()[0] == 2
    w = df.withColumn("w", F.lit(3).cast("long"))
    assert round(S.univmon(w, "k", "w", 4, 3, 64, 8).first().cardinality) == 1
    assert round(S.univmon_two_tier(w, "k", "w", 1, layers=4, rows=3, cols=64, heap=8).first().cardinality) == 1
    nothing = df.filter("k IS NULL")
    assert T.space_saving(nothing, "k", 4).count() == 0 and T.coco(nothing, "k", 2, 8).count() == 0 and T.elastic(nothing, "k", 8, 2, 64).count() == 0
