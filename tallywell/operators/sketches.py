"""Mergeable sketches as relational plans: a state is a table of cells.

Inserting is an aggregation into cells with partial sums, so each task shuffles
no more than the sketch's cells, however long the stream; merging is the same
aggregation over the states of shards; reading is a join of probes with the
state, which is small by definition and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import P, cw, leading, level, sign
from ..model import Unsupported


def _rows(n: int, of) -> Column:
    return F.explode(F.array(*[of(r) for r in range(n)]))


# -- counting matrices ---------------------------------------------------------------------------------------------


def matrix(df: DataFrame, key: Column, rows: int, cols: int, signed: bool = False, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, r, c, n): a Count-Min matrix, or a Count Sketch one. Null keys are not counted.

    A row of df becomes one number for each matrix row, the cell with the sign in
    the lowest bit, which Spark's expand makes without arrays; tasks add up by cell.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    names = [f"_x{r}" for r in range(rows)]
    bit = lambda r: F.when(sign(F.col("_k"), r) < 0, 1).otherwise(0) if signed else F.lit(0)
    cells = [((F.lit(r * cols).cast("long") + cw(F.col("_k"), r) % cols) * 2 + bit(r)).alias(n) for r, n in enumerate(names)]
    wide = df.withColumn("_k", key).filter(F.col("_k").isNotNull()).select(*by, w.alias("_w"), *cells)
    long = wide.unpivot([*by, "_w"], names, "_of", "_x").groupBy(*by, F.shiftright("_x", 1).alias("_at"))
    return long.agg(F.sum(F.when(F.col("_x") % 2 == 1, -F.col("_w")).otherwise(F.col("_w")) if signed else "_w").alias("n")).select(*by, F.expr(f"int(_at div {cols})").alias("r"), F.expr(f"int(_at % {cols})").alias("c"), "n")


def merge_cells(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by, "r", "c").agg(F.sum("n").alias("n"))


def fold(state: DataFrame, full_cols: int, fold_level: int, by: Sequence[str] = ()) -> DataFrame:
    """The matrix with columns c and c + w, c + 2 w ... added up, w = full_cols >> fold_level."""
    return state.withColumn("c", F.col("c") % (full_cols >> fold_level)).groupBy(*by, "r", "c").agg(F.sum("n").alias("n"))


def estimate(state: DataFrame, probes: DataFrame, key: Column, rows: int, cols: int, signed: bool = False, by: Sequence[str] = (), folded: int | None = None) -> DataFrame:
    """probes with estimate: the least cell of Count-Min, the median of Count Sketch's. Cells that aren't stored are 0.

    A matrix is handed to the probes as one array of rows * cols numbers, so probes
    are read where they lie; of matrices by group, one array for each group is broadcast.
    """
    own = list(probes.columns)
    width = folded or cols
    column = lambda r: (cw(F.col("_k"), r) % cols % width).cast("int")
    of = lambda r: sign(F.col("_k"), r) if signed else F.lit(1).cast("long")
    read = lambda dense: F.array(*[F.coalesce(F.get(dense, F.lit(r * width) + column(r)), F.lit(0)) * F.coalesce(of(r), F.lit(1)) for r in range(rows)])
    one = lambda x: (F.sort_array(x)[rows // 2] if signed else F.array_min(x)).alias("estimate")
    at = (F.col("r").cast("long") * width + F.col("c")).alias("_at")
    if not by:
        every = state.sparkSession.range(0, rows * width, 1, 1).select(F.col("id").alias("_at"), F.lit(0).alias("_own"), F.lit(0).cast("long").alias("n"))
        cells = state.select(at, F.lit(1).alias("_own"), "n").union(every).agg(F.sort_array(F.collect_list(F.struct("_at", "_own", "n"))).alias("_a"))
        last = lambda x, i: F.coalesce(F.get("_a", i + 1)["_at"] != x["_at"], F.lit(True))
        dense = cells.select(F.transform(F.filter("_a", last), lambda x: x["n"])).scalar()
        return probes.withColumn("_k", key).select(*own, one(read(dense)))
    # as many rows as groups, of rows * width numbers each
    held = state.groupBy(*by).agg(F.collect_list(F.struct(at, F.col("n").alias("_n"))).alias("_a"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(rows * width - 1).cast("long")), lambda i: F.struct(i.alias("_at"), F.lit(0).cast("long").alias("_n")))
    cells = held.select(*by, F.explode(F.concat("_a", every)).alias("_x")).groupBy(*by, "_x._at").agg(F.sum("_x._n").alias("_n"))
    dense = cells.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_n"))), lambda x: x["_n"]).alias("_a"))
    return probes.withColumn("_k", key).join(F.broadcast(dense), [*by], "left").select(*own, one(read(F.col("_a"))))


def l2_norm(state: DataFrame, rows: int) -> DataFrame:
    """The square root of the median over rows of the cells' squares."""
    per = state.groupBy("r").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s"))
    return per.agg(F.sqrt(F.element_at(F.sort_array(F.collect_list("s")), rows // 2 + 1)).alias("l2"))


def top(estimates: DataFrame, key: str, k: int) -> DataFrame:
    return estimates.orderBy(F.desc("estimate"), F.asc(key)).limit(k)


# -- distinct counts -----------------------------------------------------------------------------------------------


def registers(df: DataFrame, key: Column, lg: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, b, m): HyperLogLog registers; merged by taking the larger. Null is no key: a group of nulls alone has no registers."""
    k = df.withColumn("_k", key).filter(F.col("_k").isNotNull())
    return k.groupBy(*by, (cw(F.col("_k"), 0, 20) % (1 << lg)).cast("int").alias("b")).agg(F.max(leading(cw(F.col("_k"), 1, 20))).alias("m"))


def hll_estimate(regs: DataFrame, lg: int, by: Sequence[str] = ()) -> DataFrame:
    """The classic estimator with linear counting while registers are empty and the estimate is small."""
    m = 1 << lg
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(lg, 0.7213 / (1 + 1.079 / m))
    s = regs.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("m"))).alias("s"), F.count(F.lit(1)).alias("n"))
    raw = alpha * m * m / (F.col("s") + (m - F.col("n")))
    return s.select(*by, F.when((raw <= 2.5 * m) & (F.col("n") < m), m * F.log(m / (m - F.col("n")).cast("double"))).otherwise(raw).alias("estimate"))


def hll_ertl(regs: DataFrame, lg: int, by: Sequence[str] = (), q: int = 31) -> DataFrame:
    """Ertl's estimator from the histogram of register values, with its corrections for empty and for full registers."""
    m = float(1 << lg)
    s = regs.groupBy(*by).agg(F.sum(F.when(F.col("m") <= q, F.pow(F.lit(2.0), -F.col("m"))).otherwise(0.0)).alias("mid"), (m - F.count(F.lit(1))).alias("empty"), F.sum(F.when(F.col("m") > q, 1.0).otherwise(0.0)).alias("full"))
    x, y = F.col("empty") / m, 1 - F.col("full") / m
    sigma = x + sum((F.pow(x, F.lit(2.0**k)) * 2.0 ** (k - 1) for k in range(1, 24)), F.lit(0.0))
    tau = (1 - y - sum((F.pow(1 - F.pow(y, F.lit(2.0**-k)), F.lit(2.0)) * 2.0**-k for k in range(1, 24)), F.lit(0.0))) / 3
    z = m * tau * 2.0**-q + F.col("mid") + m * sigma
    return s.select(*by, F.when(F.col("empty") >= m, 0.0).otherwise(m * m / (2 * math.log(2)) / z).alias("estimate"))


def least_hashes(df: DataFrame, key: Column, k: int) -> DataFrame:
    """(h): the k least distinct hashes, by task and then of those. Null has none."""
    return df.select(cw(key, 0, 30).alias("h")).filter("h IS NOT NULL").distinct().orderBy("h").limit(k)


def kmv_estimate(state: DataFrame, k: int) -> DataFrame:
    n, h = F.count(F.lit(1)), F.max("h")
    return state.agg(F.when(n < k, n.cast("double")).otherwise((k - 1) * float(P) / h).alias("estimate"))


def bloom(df: DataFrame, key: Column, slices: int, bits: int) -> DataFrame:
    """(r, c): the bits set, one row each. Null sets none."""
    return df.withColumn("_k", key).filter(F.col("_k").isNotNull()).select(_rows(slices, lambda r: F.struct(F.lit(r).alias("r"), (cw(F.col("_k"), r, 40) % bits).cast("int").alias("c"))).alias("x")).select("x.r", "x.c").distinct()


def bloom_member(state: DataFrame, probes: DataFrame, key: Column, slices: int, bits: int) -> DataFrame:
    """probes with member: whether all of a probe's bits are set; a null probe is no member."""
    own = list(probes.columns)
    asked = probes.withColumn("_k", key).withColumn("x", _rows(slices, lambda r: F.struct(F.lit(r).alias("r"), (cw(F.col("_k"), r, 40) % bits).cast("int").alias("c"))))
    hit = asked.select(*own, F.col("x.r").alias("r"), F.col("x.c").alias("c")).join(F.broadcast(state.withColumn("_hit", F.lit(1))), ["r", "c"], "left")
    return hit.groupBy(*own).agg((F.count("_hit") == slices).alias("member"))


# -- quantiles -----------------------------------------------------------------------------------------------------


def dd_buckets(df: DataFrame, value: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, n): counts of positive values by ceil(log_gamma(value)); values of 0 in bucket null. Null and NaN aren't counted."""
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not 0 < alpha < 1:
        raise Unsupported(f"alpha {alpha}", "not between 0 and 1")
    gamma = (1 + alpha) / (1 - alpha)
    return df.groupBy(*by, F.when(F.col(value) > 0, F.ceil(F.log(value) / math.log(gamma))).alias("i")).agg(F.count(F.lit(1)).alias("n"))


def dd_quantiles(state: DataFrame, alpha: float, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q, value): the middle of the bucket that holds the ceil(qn)-th value."""
    gamma = (1 + alpha) / (1 - alpha)
    part = W.partitionBy(*[F.col(b) for b in by] or [F.lit(0)])
    run = state.withColumn("upto", F.sum("n").over(part.orderBy(F.col("i").asc_nulls_first()))).withColumn("all", F.sum("n").over(part))
    run = run.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = F.greatest(F.ceil(F.col("q") * F.col("all")), F.lit(1))
    return run.filter((at > F.col("upto") - F.col("n")) & (at <= F.col("upto"))).select(*by, "q", F.when(F.col("i").isNull(), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("i")) / (gamma + 1)).alias("value"))


# -- universal monitoring ------------------------------------------------------------------------------------------


def layered(keys: DataFrame, layers: int, rows: int, cols: int, weight: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(by, layer, r, c, n), a Count Sketch for each layer, and (by, layer, k, deep, estimate) of every key in every layer it is sampled to.

    keys(by, k, weight) has each key once; layer j has the keys that are sampled j times over, about two layers a key.
    """
    spread = keys.withColumn("deep", level(F.col("k"), layers)).withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("deep"))))
    state = matrix(spread, F.col("k"), rows, cols, True, F.col(weight), by=[*by, "layer"])
    return state, estimate(state, spread.select(*by, "layer", "k", "deep"), F.col("k"), rows, cols, True, by=[*by, "layer"])


def heaviest(estimates: DataFrame, heap: int, by: Sequence[str] = ()) -> DataFrame:
    """What the layers' heaps hold. Spark limits the ranks in every task, before any shuffle."""
    heavy = W.partitionBy(*by, "layer").orderBy(F.desc("estimate"), F.asc("k"))
    return estimates.filter("estimate > 0").withColumn("_i", F.row_number().over(heavy)).filter(F.col("_i") <= heap).drop("_i")


def _share(layers: int) -> Column:
    """By how much a heavy key of a layer counts in a sum over all keys."""
    return F.pow(F.lit(2.0), F.col("layer")) * F.when((F.col("layer") < layers - 1) & (F.col("deep") > F.col("layer")), -1.0).otherwise(1.0)


def univmon(df: DataFrame, key: str, weight: str, layers: int, rows: int, cols: int, heap: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, cardinality, l1, l2, entropy) of the sums of weights by key.

    Layer j has the keys sampled j times over, a Count Sketch of their weights
    and the ``heap`` heaviest by its estimates. The recursive sum over layers,
    unrolled, adds g of the heavy keys of each, twofold for every layer further
    down, and takes back those of the next layer that this one has counted. Null keys are not counted.
    """
    df = df.filter(F.col(key).isNotNull())
    sums = df.groupBy(*by, F.col(key).alias("k")).agg(F.sum(weight).alias("w"))
    return univmon_statistics(heaviest(layered(sums, layers, rows, cols, "w", by)[1], heap, by), layers, by)


def univmon_statistics(got: DataFrame, layers: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, cardinality, l1, l2, entropy) from what the layers' heaps hold: (by, layer, k, deep, estimate)."""
    e, factor = F.col("estimate").cast("double"), _share(layers)
    total = lambda g: F.greatest(F.sum(factor * g), F.lit(0.0))
    y = got.groupBy(*by).agg(total(F.lit(1.0)).alias("cardinality"), total(e).alias("l1"), total(e * e).alias("s2"), total(e * F.log2(e)).alias("slog"))
    return y.select(*by, "cardinality", "l1", F.sqrt("s2").alias("l2"), F.when(F.col("l1") > 0, F.greatest(F.log2("l1") - F.col("slog") / F.col("l1"), F.lit(0.0))).otherwise(0.0).alias("entropy"))


def univmon_q(df: DataFrame, key: str, layers: int, rows: int, cols: int, heap: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """UnivMon with ordered samples: its cells, and (layer, k, deep, estimate, heavy, sampled), the keys that its layers hold.

    Beside its heap, a layer keeps the ``samples`` + 1 keys of least hash, so a
    layer of no more than ``samples`` keys is held whole. At most layers *
    (heap + samples + 1) keys, whatever the stream. Sums over all keys need a deepest
    layer that its heap can hold: heap * 2**(layers - 1) keys. Null keys are not counted.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("w"))
    cells, got = layered(counts, layers, rows, cols, "w")
    least = W.partitionBy("layer").orderBy(cw(F.col("k"), 0, 95), "k")
    kept = got.withColumn("_i", F.row_number().over(least)).filter(F.col("_i") <= samples + 1).drop("_i")
    both = heaviest(got, heap).withColumn("heavy", F.lit(True)).withColumn("sampled", F.lit(False)).unionByName(kept.withColumn("heavy", F.lit(False)).withColumn("sampled", F.lit(True)))
    return cells, both.groupBy("layer", "k", "deep", "estimate").agg(F.bool_or("heavy").alias("heavy"), F.bool_or("sampled").alias("sampled"))


def univmon_q_cardinality(held: DataFrame, layers: int) -> DataFrame:
    return held.filter("heavy").agg(F.greatest(F.coalesce(F.sum(_share(layers)), F.lit(0.0)), F.lit(0.0)).alias("estimate"))


def univmon_q_frequency(cells: DataFrame, probes: DataFrame, key: str, layers: int, rows: int, cols: int) -> DataFrame:
    """probes with estimate, read from the deepest layer that a key is sampled to, where it meets the fewest others."""
    asked = probes.withColumn("layer", level(F.col(key), layers))
    return estimate(cells, asked, F.col(key), rows, cols, True, by=["layer"]).drop("layer")


def univmon_q_topk(held: DataFrame, key: str, k: int) -> DataFrame:
    """(key, estimate) of the keys in any heap, by the estimate of the deepest layer whose heap they are in."""
    one = held.filter("heavy").groupBy("k").agg(F.max_by("estimate", "layer").alias("estimate"))
    return top(one.withColumnRenamed("k", key), key, k)


def univmon_q_quantiles(held: DataFrame, layers: int, samples: int, qs: Sequence[float]) -> DataFrame:
    """(q, value): the key at rank ceil(qn), null if there are none.

    The first layer's heap counts as estimated. All other keys are counted by the
    shallowest layer that is held whole, each for the 2**layer keys that it is
    drawn from. What is ranked is no longer than a heap and a sample.
    """
    whole = held.filter("sampled").groupBy("layer").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") <= samples) | (F.col("layer") == layers - 1)).agg(F.min("layer").alias("at"))
    heavy = held.filter("heavy and layer = 0").select("k", F.col("estimate").cast("double").alias("n"))
    light = held.filter("sampled").join(F.broadcast(whole), F.col("layer") == F.col("at")).join(F.broadcast(heavy.select("k")), "k", "left_anti")
    light = light.filter("estimate > 0").select("k", (F.col("estimate") * F.pow(F.lit(2.0), F.col("layer"))).alias("n"))
    return weighted_quantiles(heavy.union(light), qs)


def weighted_quantiles(held: DataFrame, qs: Sequence[float]) -> DataFrame:
    """(q, value) of a bounded table (k, n) of values with weights: the first whose running weight reaches ceil(q * total)."""
    one = W.orderBy("k")
    run = held.withColumn("upto", F.sum("n").over(one)).withColumn("all", F.sum("n").over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rank = lambda q: F.greatest(F.ceil(F.lit(float(q)) * F.col("all")), F.lit(1))
    first = run.agg(*[F.min(F.when(F.col("upto") >= rank(q), F.col("k"))).alias(f"_q{i}") for i, q in enumerate(qs)])
    return first.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"_q{i}").alias("value")) for i, q in enumerate(qs)])).alias("x")).select("x.*")


def univmon_two_tier(df: DataFrame, key: str, weight: str, elephants: int, **of) -> DataFrame:
    """As univmon, with the ``elephants`` heaviest keys counted apart, exactly, and the sketch for the rest."""
    df = df.filter(F.col(key).isNotNull())
    sums = df.groupBy(F.col(key).alias("k")).agg(F.sum(weight).alias("w"))
    big = sums.orderBy(F.desc("w"), F.asc("k")).limit(elephants)
    e = F.col("w").cast("double")
    apart = big.agg(F.count(F.lit(1)).cast("double").alias("c"), F.coalesce(F.sum(e), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("s2"), F.coalesce(F.sum(F.when(e > 0, e * F.log2(e)).otherwise(0.0)), F.lit(0.0)).alias("sl"))
    mice = univmon(sums.join(F.broadcast(big.select("k")), "k", "left_anti"), "k", "w", **of)
    back = mice.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("cardinality", "l1", "l2", "entropy")])
    both = apart.crossJoin(back)  # one row each
    l1 = F.col("s1") + F.col("l1")
    slog = F.col("sl") + F.when(F.col("l1") > 0, F.col("l1") * (F.log2("l1") - F.col("entropy"))).otherwise(0.0)
    return both.select((F.col("c") + F.col("cardinality")).alias("cardinality"), l1.alias("l1"), F.sqrt(F.col("s2") + F.col("l2") * F.col("l2")).alias("l2"), F.when(l1 > 0, F.log2(l1) - slog / l1).otherwise(0.0).alias("entropy"))


# -- grids over label subsets --------------------------------------------------------------------------------------


def grid_cells(df: DataFrame, group: Column, rows: int, cols: int) -> DataFrame:
    """Each row once for each grid row, with gr and gc: the grid cell of its group there. The inner sketch is kept by (gr, gc)."""
    cell = lambda r: F.struct(F.lit(r).alias("gr"), (cw(F.col("_g"), r, 60) % cols).cast("int").alias("gc"))
    own = df.columns
    return df.withColumn("_g", group).withColumn("x", _rows(rows, cell)).select(*own, "x.gr", "x.gc")
