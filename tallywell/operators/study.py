"""Measurements as tables: cost fits, gates, crossover points, saturation, and the choice of a sketch for a target."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Unsupported


def summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, runs, median, mean, stddev, ci95) of repeated measurements; the deviation is of a sample."""
    n = F.count(value)
    return runs.groupBy(*by).agg(n.alias("runs"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), (1.96 * F.stddev_samp(value) / F.sqrt(n)).alias("ci95"))


def noise_band(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, low, high): two measurements tie when their bands overlap. The number of runs must be odd."""
    odd = F.when(F.count(value) % 2 == 0, F.raise_error(F.lit("an even number of runs")).cast("double")).otherwise(F.percentile(value, 0.5))
    return runs.groupBy(*by).agg(odd.alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def cost_fit(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, slope, intercept, residual, flagged): least squares of relative errors y = slope x + intercept, neither below 0.

    residual is the largest relative error; above 10% is flagged. The normal
    equations are sums, so points may be many.
    """
    w = 1 / (F.col(y) * F.col(y))
    s = points.groupBy(*by).agg(*[F.sum(w * e).alias(n) for n, e in (("sw", F.lit(1.0)), ("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("sxy", F.col(x) * F.col(y)))])
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(det != 0, (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(F.col("sxy") / F.col("sxx"))
    s = s.withColumn("free", slope).withColumn("base", (F.col("sy") - F.col("free") * F.col("sx")) / F.col("sw"))
    s = s.withColumn("slope", F.when(F.col("base") < 0, F.col("sxy") / F.col("sxx")).when(F.col("free") < 0, 0.0).otherwise(F.col("free")))
    s = s.withColumn("intercept", F.when(F.col("base") < 0, 0.0).when(F.col("free") < 0, F.col("sy") / F.col("sw")).otherwise(F.col("base"))).select(*by, "slope", "intercept")
    e = F.max(F.abs((F.col("slope") * F.col(x) + F.col("intercept")) / F.col(y) - 1))
    return points.join(s, by).groupBy(*by, "slope", "intercept").agg(e.alias("residual")).withColumn("flagged", F.col("residual") > 0.1)


def gate(exact: DataFrame, arms: DataFrame, keys: list[str], target: float, most: float = 1.05) -> DataFrame:
    """exact(keys, cost), arms(keys, cost, error) -> (keys, verdict): pass, cost, error, missing or extra."""
    both = exact.select(*keys, F.col("cost").alias("base")).join(arms.select(*keys, "cost", "error"), keys, "full")
    verdict = F.when(F.col("cost").isNull(), "missing").when(F.col("base").isNull(), "extra").when(F.col("cost") > most * F.col("base"), "cost").when(F.col("error") > target, "error").otherwise("pass")
    return both.select(*keys, verdict.alias("verdict"))


def error_quantiles(errors: DataFrame, by: list[str], deltas: list[float]) -> DataFrame:
    """(by, delta, error): the nearest-rank (1 - delta) quantile over trials; deltas below 3 / trials have none."""
    w = W.partitionBy(*by)
    r = errors.withColumn("i", F.row_number().over(w.orderBy("error"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    # 1e-9: (1 - 0.57) * 100 must be 43
    return r.filter((F.col("delta") >= 3 / F.col("n")) & (F.col("i") == F.greatest(F.lit(1), F.ceil((1 - F.col("delta")) * F.col("n") - 1e-9)))).select(*by, "delta", "error")


def crossover(costs: DataFrame, by: list[str], factor: float) -> DataFrame:
    """costs(by, n, exact, sketch) -> (by, n_star): the least n from which exact / sketch stays at factor or more; null if it never does."""
    later = W.partitionBy(*by).orderBy("n").rowsBetween(0, W.unboundedFollowing)
    holds = F.min(F.col("exact") >= factor * F.col("sketch")).over(later)
    return costs.withColumn("holds", holds).groupBy(*by).agg(F.min(F.when(F.col("holds"), F.col("n"))).alias("n_star"))


def saturation(errors: DataFrame, by: list[str], band: float = 0.1) -> DataFrame:
    """errors(by, n, error) -> (by, n_sat): the least n from which every error is within ``band`` of the last one."""
    last = F.last("error").over(W.partitionBy(*by).orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    e = errors.withColumn("level", last)
    later = W.partitionBy(*by).orderBy("n").rowsBetween(0, W.unboundedFollowing)
    e = e.withColumn("holds", F.min(F.abs(F.col("error") - F.col("level")) <= band * F.abs("level")).over(later))
    return e.groupBy(*by).agg(F.min(F.when(F.col("holds"), F.col("n"))).alias("n_sat"))


def recommend(measured: DataFrame, by: list[str], target: float) -> DataFrame:
    """measured(by, config, bytes, error, worst case over the grid) -> (by, config): the smallest that meets the target; null if none does."""
    worst = measured.groupBy(*by, "config", "bytes").agg(F.max("error").alias("error"))
    fit = F.when(F.col("error") <= target, F.struct("bytes", "config"))
    return worst.groupBy(*by).agg(F.min(fit)["config"].alias("config"))


def regret(measured: DataFrame, by: list[str]) -> DataFrame:
    """measured(by, arm, cost, selected) -> (by, regret): the cost of the selected arm over the least."""
    return measured.groupBy(*by).agg((F.max(F.when(F.col("selected"), F.col("cost"))) / F.min("cost")).alias("regret"))


def data_statistics(samples: DataFrame, labels: list[str]) -> DataFrame:
    """One row: series, samples, label values, span, least gap, magnitude and sign of the values."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(W.partitionBy(*labels).orderBy("ts_ms"))
    s = samples.withColumn("_gap", gap)
    return s.agg(
        F.countDistinct(*labels).alias("series"), F.count(F.lit(1)).alias("samples"), *[F.countDistinct(c).alias(f"values_{c}") for c in labels], F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("interval_ms"), F.max(F.abs("value")).alias("magnitude"), (F.min("value") < 0).alias("negative"),
    )


def choose(capability: str, epsilon: float, delta: float = 0.01, merges: int = 1, distinct: int = 1 << 20, spread: float = 1e6) -> dict:
    """The smallest sketch whose published bound meets the target, or the exact plan: {sketch, parameters, bytes, bound}.

    frequency: epsilon is a share of the stream; cardinality: relative standard
    errors, three of them within epsilon; quantile: rank error, or with
    ``relative-quantile`` the relative error of values over ``spread``.
    """
    if not 0 < epsilon < 1:
        raise Unsupported(f"error target {epsilon}", "not between 0 and 1")
    if capability == "frequency":
        rows, cols = max(1, math.ceil(math.log(1 / delta))), 1 << max(1, math.ceil(math.log2(math.e / epsilon)))
        return {"sketch": "cms", "parameters": {"rows": rows, "cols": cols}, "bytes": 8 * rows * cols, "bound": math.e / cols}
    if capability == "cardinality":
        lg = max(4, math.ceil(2 * math.log2(3 * 1.04 / epsilon)))
        if lg > 18:
            return {"sketch": "exact", "parameters": {}, "bytes": 8 * distinct, "bound": 0.0}
        return {"sketch": "hll", "parameters": {"lg_k": lg}, "bytes": 1 << lg, "bound": 3 * 1.04 / math.sqrt(1 << lg)}
    if capability == "quantile":
        k = max(8, math.ceil(2.3 / epsilon * (1.3 if merges > 1 else 1.0)))
        if k > 26602:
            return {"sketch": "exact", "parameters": {}, "bytes": 8 * distinct, "bound": 0.0}
        return {"sketch": "kll", "parameters": {"k": k}, "bytes": 32 * k, "bound": 2.3 / k * (1.3 if merges > 1 else 1.0)}
    if capability == "relative-quantile":
        gamma = (1 + epsilon) / (1 - epsilon)
        return {"sketch": "dd", "parameters": {"alpha": epsilon}, "bytes": 16 * math.ceil(math.log(spread) / math.log(gamma)), "bound": epsilon}
    raise Unsupported(capability, "no sketch is kept for it; use the exact plan")


# -- fits of several terms -----------------------------------------------------------------------------------------


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares with no coefficient below 0: of all subsets of terms whose free solution is not negative, the one that explains most.

    The others are 0. A subset without a solution of its own is no candidate.
    """
    best, most = np.zeros(len(right)), 0.0
    for chosen in range(1, 1 << len(right)):
        at = [i for i in range(len(right)) if chosen >> i & 1]
        g = gram[np.ix_(at, at)]
        if np.linalg.matrix_rank(g) < len(at):
            continue
        x = np.linalg.solve(g, right[at])
        gain = float(right[at] @ x)  # how much the squares fall
        if (x >= 0).all() and gain > most * (1 + 1e-12):
            best, most = np.zeros(len(right)), gain
            best[at] = x
    return best


def constrained_fit(points: DataFrame, setting: str, terms: Sequence[str], y: str) -> DataFrame:
    """(left_out, coefficients, points, worst): y = sum of coefficient x term, none below 0, by least squares of relative errors.

    left_out null: fitted to all points; worst is the largest relative error over
    them. Else fitted without that setting's points, and worst is over just those: how
    far the fit is off where it hasn't been. The normal equations are sums by
    setting, and a setting is left out by subtracting its own, so points are
    read twice however many settings there are. Points whose y is 0, or null, or a term null, can't be
    weighed and are left out; with at most 8 terms all subsets of them are tried.
    """
    terms = list(terms)
    if not 0 < len(terms) <= 8:
        raise Unsupported(f"{len(terms)} terms", "between 1 and 8")
    p = len(terms)
    fine = points.filter(F.col(y) != 0).dropna(subset=terms).select(F.col(setting).alias("setting"), *[(F.col(c) / F.col(y)).alias(f"t{i}") for i, c in enumerate(terms)])
    t = [F.col(f"t{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = fine.groupBy(F.col("setting").alias("left_out")).agg(F.array(*[F.sum(t[i] * t[j]) for i, j in pairs]).alias("gram"), F.array(*[F.sum(x) for x in t]).alias("right"), F.count(F.lit(1)).alias("n"))
    added = lambda c, size: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)])
    total = sums.agg(added("gram", len(pairs)).alias("all_gram"), added("right", p).alias("all_right"), F.sum("n").alias("all_n"))
    less = lambda a, b: F.zip_with(a, b, lambda x, z: x - z)
    without = sums.crossJoin(F.broadcast(total)).select("left_out", F.lit(True).alias("one"), less("all_gram", "gram").alias("gram"), less("all_right", "right").alias("right"), (F.col("all_n") - F.col("n")).alias("n"))  # one row
    every = total.filter("all_n > 0").select(F.lit(None).cast(points.schema[setting].dataType).alias("left_out"), F.lit(False).alias("one"), F.col("all_gram").alias("gram"), F.col("all_right").alias("right"), F.col("all_n").alias("n"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for gram, right in zip(f["gram"], f["right"]):
                g = np.zeros((p, p))
                for (i, j), v in zip(pairs, gram):
                    g[i, j] = g[j, i] = v
                out.append(_solved(g, np.asarray(right, float)).tolist())
            yield f.assign(coefficients=out)[["left_out", "one", "coefficients", "n"]]

    kind = points.schema[setting].dataType.simpleString()
    fits = without.unionByName(every).mapInPandas(solve, f"left_out {kind}, one boolean, coefficients array<double>, n long")
    said = sum((F.get("coefficients", F.lit(i)) * t[i] for i in range(p)), F.lit(0.0))
    own = fine.join(fits.filter("one"), F.col("setting").eqNullSafe(F.col("left_out")))
    whole = fine.crossJoin(F.broadcast(fits.filter("NOT one")))  # one row
    cols = ["left_out", "coefficients", F.col("n").alias("points"), F.abs(said - 1).alias("off")]
    both = own.select(*cols).union(whole.select(*cols))
    return both.groupBy("left_out", "coefficients", "points").agg(F.max("off").alias("worst"))


def rank_agreement(pairs: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """(by, n, tau): Kendall's tau-b of two measures over the same configurations, from counts of agreeing and tied pairs.

    Configurations of a group are few (a sweep's grid); pairs are within a group.
    """
    numbered = pairs.select(*by, F.col(left).alias("x"), F.col(right).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = numbered.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("rows"), F.count(F.lit(1)).alias("n"))
    at = F.posexplode("rows").alias("i", "a")
    each = rows.select(*by, "n", "rows", at).select(*by, "n", "a", F.slice("rows", F.col("i") + 2, F.col("n").cast("int")).alias("later"))
    s = lambda b: F.signum(b["x"] - F.col("a.x")) * F.signum(b["y"] - F.col("a.y"))
    part = lambda f: F.sum(F.aggregate("later", F.lit(0.0), lambda acc, b: acc + f(b)))
    got = each.groupBy(*by, "n").agg(part(s).alias("s"), part(lambda b: F.abs(F.signum(b["x"] - F.col("a.x")))).alias("nx"), part(lambda b: F.abs(F.signum(b["y"] - F.col("a.y")))).alias("ny"))
    return got.select(*by, "n", F.try_divide("s", F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))
