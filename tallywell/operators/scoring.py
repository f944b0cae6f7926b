"""How far approximate answers are from exact ones, as joins and aggregates of two answer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Unsupported
from ..storage import bounded, save
from .exact import at_ranks

#: Answers that are held against every value of a table.
MOST_ANSWERS = 10_000
PREFIXES = (1, 10, 100, 1000)


def relative(estimate: Column, truth: Column) -> Column:
    """0 where the truth isn't positive."""
    return F.when(truth > 0, F.abs(estimate - truth) / truth).otherwise(0.0)


def scalar(exact: DataFrame, truth: str, answer: DataFrame, estimate: str) -> DataFrame:
    """One row each: truth, estimate, absolute and relative error."""
    both = exact.select(F.col(truth).cast("double").alias("truth")).crossJoin(F.broadcast(answer.select(F.col(estimate).cast("double").alias("estimate"))))
    return both.select("truth", "estimate", F.abs(F.col("estimate") - F.col("truth")).alias("absolute_error"), relative(F.col("estimate"), F.col("truth")).alias("relative_error"))


def aligned(exact: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """exact(keys, truth) with estimate; keys that weren't answered have 0."""
    return exact.join(answers, list(keys), "left").withColumn("estimate", F.coalesce("estimate", F.lit(0)))


def curve(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(population, are, aae, probes, l1, l2) over the heaviest 1, 10, 100, 1000 keys, as far as there are so many, and all.

    Ranks are given to the heaviest 1000 alone; a zero truth counts in aae and not in are.
    """
    d, t = F.abs(F.col("estimate") - F.col("truth")), F.col("truth")
    sums = [F.coalesce(F.avg(F.when(t > 0, d / t)), F.lit(0.0)).alias("are"), F.avg(d).alias("aae"), F.count(F.lit(1)).alias("probes"), F.sum(d).cast("double").alias("l1"), F.sqrt(F.sum(d.cast("double") * d)).alias("l2")]
    order = [F.desc("truth"), *[F.asc(k) for k in keys]]
    head = pairs.orderBy(*order).limit(max(PREFIXES)).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    tops = head.withColumn("k", F.explode(F.array(*[F.lit(k) for k in PREFIXES]))).filter("rank <= k").groupBy("k").agg(*sums).filter("probes = k")
    return tops.select(F.concat(F.lit("top"), F.col("k").cast("string")).alias("population"), "are", "aae", "probes", F.lit(None).cast("double").alias("l1"), F.lit(None).cast("double").alias("l2")).union(pairs.agg(*sums).select(F.lit("all"), "are", "aae", "probes", "l1", "l2"))


def error_percentile(pairs: DataFrame, q: float) -> DataFrame:
    """The nearest-rank percentile round((n - 1) q) of relative errors, over positive truths."""
    e = pairs.filter("truth > 0").select((F.abs(F.col("estimate") - F.col("truth")) / F.col("truth")).alias("e"))
    counts = e.groupBy(F.col("e").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return at_ranks(counts, {"": lambda n: F.round((n - 1) * q)}).select(F.col("v").alias("relative_error"))


def top_sets(exact: DataFrame, answer: DataFrame, key: str) -> DataFrame:
    """exact(key, truth), the true top; answer(key, estimate): precision, recall, sizes and count errors of the common keys."""
    both = exact.join(answer, key, "full")
    hit = F.col("truth").isNotNull() & F.col("estimate").isNotNull()
    true_n, est_n = F.count("truth"), F.count("estimate")
    d = F.when(hit, F.abs(F.col("estimate") - F.col("truth")).cast("double"))
    return both.agg(
        F.when(est_n > 0, F.count_if(hit) / est_n).otherwise(0.0).alias("precision_at_k"), F.when(true_n > 0, F.count_if(hit) / true_n).otherwise(0.0).alias("recall_at_k"),
        true_n.alias("true_count"), est_n.alias("est_count"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_count_err"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_count_err"),
    )


def rank_errors(values: DataFrame, value: str, answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """answers(by, q, value) with rank_error: 0 if q n is among the ranks of equal values, else the distance in shares of n.

    The values are read once, as counts by value. Without groups at most MOST_ANSWERS answers are broadcast; more are refused. By
    group they are broadcast if they are few in all, and else joined. Null values have no rank.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    asked = save(answers.withColumnRenamed("value", "x"), "asked")
    if not by and (many := asked.count()) > MOST_ANSWERS:
        raise Unsupported(f"rank errors of {many} answers over one table", f"at most {MOST_ANSWERS}: each is held against every value")
    pairs = counts.join(bounded(asked), list(by)) if by else counts.crossJoin(F.broadcast(asked))
    r = pairs.groupBy(*by, "q", "x").agg(F.sum(F.when(F.col("v") < F.col("x"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("x"), F.col("n")).otherwise(0)).alias("upto"), F.sum("n").alias("n"))
    at = F.col("q") * F.col("n")
    gap = F.when(at < F.col("below"), F.col("below") - at).when(at > F.col("upto"), at - F.col("upto")).otherwise(0.0)
    return r.select(*by, "q", F.col("x").alias("value"), (gap / F.col("n")).alias("rank_error"))


def value_errors(exact: DataFrame, answers: DataFrame) -> DataFrame:
    """exact(q, truth), answers(q, value): scored, unanswered, mean and largest relative value error; zeros aren't scored."""
    both = exact.join(answers, "q", "left")
    e = F.when((F.col("truth") != 0) & F.col("value").isNotNull() & ~F.isnan("value"), F.abs(F.col("value") - F.col("truth")) / F.abs(F.col("truth")))
    return both.agg(F.count(e).alias("scored_points"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("unanswered_points"), F.avg(e).alias("mean_relative_value_error"), F.max(e).alias("max_relative_value_error"))


def cdf_errors(exact: DataFrame, answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mean_cdf_err, max_cdf_err) of two tables (by, x, share)."""
    both = exact.join(answers.withColumnRenamed("share", "estimate"), [*by, "x"])
    e = F.abs(F.col("estimate") - F.col("share"))
    return both.groupBy(*by).agg(F.avg(e).alias("mean_cdf_err"), F.max(e).alias("max_cdf_err"))


def group_summary(pairs: DataFrame) -> DataFrame:
    """Over groups with truth and estimate: groups scored (positive truth), unscored, and mean, largest relative error."""
    e = F.when(F.col("truth") > 0, F.abs(F.col("estimate") - F.col("truth")) / F.col("truth"))
    return pairs.agg(F.count(e).alias("groups_scored"), F.count_if(~(F.col("truth") > 0)).alias("groups_unscored"), F.avg(e).alias("err_mean"), F.max(e).alias("err_max"))


def aggregate_errors(exact: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst and mean error over groups: absolute where the exact value is 0, infinite for a missing group."""
    both = exact.join(answers, list(keys), "left")
    e = F.when(F.col("estimate").isNull(), F.lit(float("inf"))).when(F.col("truth") == 0, F.abs("estimate")).otherwise(F.abs(F.col("estimate") - F.col("truth")) / F.abs(F.col("truth")))
    return both.agg(F.max(e).alias("relative_error"), F.avg(e).alias("relative_error_mean"), F.count(F.lit(1)).alias("groups_per_instance"), F.count_if(F.col("estimate").isNull()).alias("missing_groups"))
