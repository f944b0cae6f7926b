"""Exact statistics as DataFrame plans: counts, distincts, quantiles, norms, and the same within groups.

Null is a key like any other in frequencies and groups, as in GROUP BY; it is no
value for distinct counts, sums, extremes and quantiles, as in SQL's aggregates.

Everything is hash aggregation with partial sums, so a hot key or group leaves
one row for each task before it is shuffled. Where the whole order matters
(ranks, the floor-index quantile) the sort is over distinct values with counts,
not over rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Unsupported, counting_key


def frequency(df: DataFrame, value: str) -> DataFrame:
    """(key, n): occurrences of each value."""
    return df.groupBy(counting_key(df, value).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, k: int | None = None) -> DataFrame:
    """counts(key, n) in the total order: n descending, then key. With k, the first k, as rows with their rank.

    With k this is a top-k by task and then of those, however many keys; ranks
    are given to the k rows alone.
    """
    order = [F.desc("n"), F.asc("key")]
    top = counts if k is None else counts.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def heavy_hitters(df: DataFrame, value: str, phi: float) -> DataFrame:
    """Values with more than phi times all rows."""
    total = df.agg((F.count(F.lit(1)) * phi).alias("least"))
    return frequency(df, value).join(F.broadcast(total), F.col("n") > F.col("least")).select("key", "n")


def cardinality(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.countDistinct(counting_key(df, value)).alias("distinct_values"))


def stream_stats(counts: DataFrame) -> DataFrame:
    """Items, distinct keys and l2 norm of a table of counts."""
    return counts.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("distinct_keys"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("l2"))


#: Equal slices of the bucket that holds a rank.
_SLICES = 4096
#: Different values from which on a group is not sorted in one task.
HOT_VALUES = 5_000_000


def at_ranks(counts: DataFrame, asked: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """counts(by, v, n) -> (by, name, v, all): the value at each asked rank of a group, which is a function of the number of all its rows, counted from 0.

    Values are put into buckets of a thousandth of their size, which keep their
    order. The running count is over a group's buckets, whose number is bounded. The
    bucket that holds a rank is cut into equal slices between its least and
    largest value, so that values of a narrow range don't stay together, and only the slice that holds the rank is sorted.
    """
    v = F.col("v").cast("double")
    size = (F.floor(F.log(F.abs(v)) / math.log(1.001)) + 1_000_000).cast("long")
    infinite = F.abs(v) == float("inf")
    bucket = F.when(v.isNull(), -(10**9)).when(F.isnan(v), 10**9).when(infinite, F.signum(v).cast("long") * 10**8).when(v == 0, 0).otherwise(F.signum(v).cast("long") * size)
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("one"))  # structs of nulls are equal
    rows = counts.select(group.alias("g"), "v", "n", bucket.alias("bucket"))
    few = (lambda df: df) if by else F.broadcast  # without groups a row for each asked rank
    sums = rows.groupBy("g", "bucket").agg(F.sum("n").alias("here"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
    sums = sums.withColumn("upto", F.sum("here").over(W.partitionBy("g").orderBy("bucket"))).withColumn("all", F.sum("here").over(W.partitionBy("g")))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("all")).cast("long").alias("at")) for name, at in asked.items()])).alias("x")
    wanted = sums.select("g", "bucket", "low", "high", "all", (F.col("upto") - F.col("here")).alias("before"), "upto", ranks).filter("x.at >= before AND x.at < upto")
    wanted = wanted.select("g", "bucket", "low", "high", "all", "x.name", (F.col("x.at") - F.col("before")).alias("at"))
    near = rows.join(few(wanted), ["g", "bucket"])
    # infinities and NaN are alone in their buckets; a wide one's range may not be finite
    part = F.floor(F.try_divide(v - F.col("low"), F.col("high") - F.col("low")) * _SLICES)
    near = near.withColumn("slice", F.when(part.isNull() | F.isnan(part.cast("double")), 0).otherwise(F.least(part, F.lit(_SLICES - 1))).cast("long"))
    cuts = near.groupBy("g", "name", "at", "slice").agg(F.sum("n").alias("here"))
    cuts = cuts.withColumn("upto", F.sum("here").over(W.partitionBy("g", "name").orderBy("slice"))).filter("at >= upto - here AND at < upto").select("g", "name", "slice", (F.col("upto") - F.col("here")).alias("below"))
    near = near.join(few(cuts), ["g", "name", "slice"])
    near = near.withColumn("upto", F.sum("n").over(W.partitionBy("g", "name").orderBy("v")) + F.col("below"))
    return near.filter("at >= upto - n AND at < upto").select(*[F.col(f"g.{c}").alias(c) for c in by], "name", "v", "all")


def quantiles(df: DataFrame, value: str, qs: Sequence[float], rule: str = "linear", by: Sequence[str] = ()) -> DataFrame:
    """(by, q, value). Rules: linear (between neighbours at q(n-1)), order (the ceil(qn)-th), floor (index floor(qn), the last at most).

    All three run over (value, count) and its running counts. A group is sorted
    in one task, in a sort that spills, while it has at most HOT_VALUES different
    values; larger groups, and whole columns, are cut to buckets, of which only parts are
    sorted. Nulls are no values: a group of nulls
    alone, and an empty table, have no row. NaN is above every number.
    """
    df = df.filter(F.col(value).isNotNull())
    if rule not in ("linear", "order", "floor"):
        raise Unsupported(f"quantile rule {rule}", "not one of linear, order, floor")
    counts = df.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if not isinstance(df.schema[value].dataType, T.NumericType):
        return _sorted_quantiles(counts, qs, rule, by)
    if not by:
        return _cut_quantiles(counts, qs, rule)
    group = F.struct(*[F.col(c) for c in by])
    hot = F.broadcast(counts.groupBy(group.alias("_hot")).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > HOT_VALUES).select("_hot"))  # a row for each HOT_VALUES of counts at most
    cold = counts.join(hot, group == F.col("_hot"), "left_anti")
    return _sorted_quantiles(cold, qs, rule, by).unionByName(_cut_quantiles(counts.join(hot, group == F.col("_hot"), "left_semi"), qs, rule, by))


def _sorted_quantiles(counts: DataFrame, qs: Sequence[float], rule: str, by: Sequence[str]) -> DataFrame:
    """quantiles() from counts(by, v, n), each group in one task."""
    keys = list(by)
    w = W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("more", F.lead("v").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    run = run.select(*keys, "v", "n", "upto", "more", "all", asked)
    if rule == "linear":
        at = F.col("q") * (F.col("all") - 1)
        low = F.floor(at)
        mine = (low >= F.col("upto") - F.col("n")) & (low < F.col("upto"))
        next_v = F.when(low + 1 < F.col("upto"), F.col("v")).otherwise(F.coalesce("more", "v"))
        answer = F.col("v") + (next_v - F.col("v")) * (at - low)
    else:
        at = F.greatest(F.ceil(F.col("q") * F.col("all")) - 1, F.lit(0)) if rule == "order" else F.least(F.floor(F.col("q") * F.col("all")), F.col("all") - 1)
        mine = (at >= F.col("upto") - F.col("n")) & (at < F.col("upto"))
        answer = F.col("v")
    return run.filter(mine).select(*keys, "q", answer.alias("value"))


def _cut_quantiles(counts: DataFrame, qs: Sequence[float], rule: str, by: Sequence[str] = ()) -> DataFrame:
    """quantiles() from counts(by, v, n): no task sorts more than the values near a rank."""
    rank = {
        "linear": lambda q, n: F.floor(q * (n - 1)), "order": lambda q, n: F.greatest(F.ceil(q * n) - 1, F.lit(0)), "floor": lambda q, n: F.least(F.floor(q * n), n - 1),
    }[rule]
    asked = {f"{i} low": lambda n, q=float(q): rank(F.lit(q), n) for i, q in enumerate(qs)}
    asked |= {f"{i} high": lambda n, q=float(q): F.least(rank(F.lit(q), n) + 1, n - 1) for i, q in enumerate(qs)} if rule == "linear" else {}
    found = at_ranks(counts, asked, by)
    i = F.split("name", " ")
    q = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), i[0].cast("int") + 1)
    end = lambda which: F.max(F.when(i[1] == which, F.col("v")))
    found = found.groupBy(*by, q.alias("q"), i[0].alias("i"), "all").agg(end("low").alias("low"), end("high").alias("high"))
    at = F.col("q") * (F.col("all") - 1)
    answer = F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at)) if rule == "linear" else F.col("low")
    return found.select(*by, "q", answer.alias("value"))


def membership(members: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """(key, member) for each distinct probe."""
    return probes.select(key).distinct().join(members.select(key).distinct().withColumn("member", F.lit(True)), key, "left").select(key, F.coalesce("member", F.lit(False)).alias("member"))


def entropy(n: Column, total: Column) -> Column:
    """One term of the base-2 entropy of shares n / total."""
    return -(n / total) * F.log2(n / total)


def keyed(df: DataFrame, key: str, weight: str) -> DataFrame:
    """Over the sums of weights by key: how many aren't zero, l1, l2, and the entropy of their sizes."""
    sums = df.groupBy(counting_key(df, key).alias("key")).agg(F.sum(weight).cast("double").alias("t"))
    sums = sums.withColumn("a", F.abs("t"))
    # sum(a log a) and sum(a) give the entropy in the same pass: log2(s) - sum(a log2 a) / s
    alog = F.sum(F.when(F.col("a") > 0, F.col("a") * F.log2("a")).otherwise(0.0))
    s = F.sum("a")
    return sums.agg(
        F.count(F.when(F.col("t") != 0, 1)).alias("cardinality"), s.alias("l1"), F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("l2"),
        F.when(s > 0, F.log2(s) - alog / s).otherwise(0.0).alias("entropy"),
    )


def subsets(df: DataFrame, labels: Sequence[str], *aggs: Column) -> DataFrame:
    """aggs by every non-empty subset of the labels, and subset: a bit for each label, 1 where it is not constrained."""
    free = (1 << len(labels)) - 1
    return df.cube(*labels).agg(F.grouping_id().alias("subset"), *aggs).filter(F.col("subset") != free)


def fan_out(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Each row once for each non-empty subset of its labels, others null, with subset: as subsets() has it."""
    n = len(labels)
    sets = [F.struct(F.lit(m).alias("subset"), *[(F.lit(None).cast(df.schema[c].dataType) if m >> (n - 1 - i) & 1 else F.col(c)).alias(c) for i, c in enumerate(labels)]) for m in range((1 << n) - 1)]
    return df.select(F.explode(F.array(*sets)).alias("g"), *[c for c in df.columns if c not in labels]).select("g.*", *[c for c in df.columns if c not in labels])


def group_frequency(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def group_shape(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """By group: distinct values, l1, l2 and entropy of its vector of value frequencies."""
    n = F.col("n").cast("double")
    s = F.sum(n)
    return group_frequency(df, by, value).groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("l1"), F.sqrt(F.sum(n * n)).alias("l2"), (F.log2(s) - F.sum(n * F.log2(n)) / s).alias("entropy")
    )


def group_cdf(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(by, x, share): the share of a group's values that are x at most; nulls are none."""
    df = df.filter(F.col(value).isNotNull())
    shares = [F.struct(F.lit(float(x)).alias("x"), F.avg(F.when(F.col(value) <= x, 1.0).otherwise(0.0)).alias("share")) for x in at]
    return df.groupBy(*by).agg(F.array(*shares).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.x", "s.share")


def group_sum(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sums of an integer column that must not be negative; a negative value is an error, not a smaller sum."""
    checked = F.when(F.col(value) < 0, F.raise_error(F.lit(f"{value} is negative")).cast("long")).otherwise(F.col(value))
    return df.groupBy(*by).agg(F.sum(checked).alias("total"))


def accumulate(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sum, count, least and largest value by full label combination."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.sum(v).alias("total"), F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"))


def increase(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Of a counter, by group: last - first + what stood before each drop. A single value increases by 0."""
    w = W.partitionBy(*by).orderBy(*order)
    stepped = df.withColumn("_before", F.lag(value).over(w))
    place = F.struct(*order)
    resets = F.sum(F.when(F.col(value) < F.col("_before"), F.col("_before")).otherwise(0.0))
    return stepped.groupBy(*by).agg((F.max_by(value, place) - F.min_by(value, place) + resets).alias("increase"))


def key_set(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.select(*labels).distinct()
