"""Exact statistics of the order and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact as X
from . import query, table

LABELS = ["l_returnflag", "l_linestatus"]
FIVE = [0.05, 0.25, 0.5, 0.75, 0.95]
_FIVE = "[0.05, 0.25, 0.5, 0.75, 0.95]"


@query("SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1")
def freq_partkey(spark, sf):
    return X.frequency(table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT l_extendedprice::VARCHAR AS key, count(*) AS n FROM lineitem GROUP BY 1", name="freq_double_bits")
def freq_double_bits(spark, sf):
    return X.frequency(table(spark, sf, "lineitem"), "l_extendedprice")


@query("SELECT value::VARCHAR AS key, count(*) AS n FROM events GROUP BY 1")
def freq_double_bits_whole(spark, sf):
    return X.frequency(table(spark, sf, "events"), "value")


@query("SELECT count(DISTINCT o_custkey) AS distinct_values FROM orders")
def card_custkey(spark, sf):
    return X.cardinality(table(spark, sf, "orders"), "o_custkey")


@query("SELECT sum(n)::BIGINT AS items, count(*) AS distinct_keys, round(sqrt(sum(n::DOUBLE * n)), 6) AS l2 FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def stream_stats_partkey(spark, sf):
    return X.stream_stats(X.frequency(table(spark, sf, "lineitem"), "l_partkey")).withColumn("l2", F.round("l2", 6))




def _linear(t: str, v: str, by: str = "") -> str:
    by = f"{by}, " if by else ""
    return " UNION ALL ".join(f"SELECT {by}{q}::DOUBLE AS q, round(quantile_cont({v}, {q}), 6) AS value FROM {t} {'GROUP BY ' + by.rstrip(', ') if by else ''}" for q in FIVE)


@query(_linear("lineitem", "l_extendedprice"))
def quantile_grid_price(spark, sf):
    return X.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", FIVE).withColumn("value", F.round("value", 6))


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, quantile_disc(l_extendedprice, {q}) AS value FROM lineitem" for q in FIVE))
def quantile_disc_price(spark, sf):
    return X.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", FIVE, "order")


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, list_sort(list(l_extendedprice))[least(floor({q}::DOUBLE * count(*))::BIGINT, count(*) - 1) + 1] AS value FROM lineitem" for q in FIVE))
def quantile_floor_index(spark, sf):
    return X.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", FIVE, "floor")


@query("SELECT l_partkey AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 32")
def topk_partkey(spark, sf):
    return X.ranked(X.frequency(table(spark, sf, "lineitem"), "l_partkey"), 32)


@query("SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT 0.011::DOUBLE * count(*) FROM lineitem)")
def heavy_hitters_phi(spark, sf):
    return X.heavy_hitters(table(spark, sf, "lineitem"), "l_suppkey", 0.011)


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS member FROM (SELECT DISTINCT c_custkey FROM customer)")
def membership_probe(spark, sf):
    return X.membership(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf, "customer"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def non_members(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
    WITH s AS (SELECT l_partkey, abs(sum(l_quantity::BIGINT))::DOUBLE AS t FROM lineitem GROUP BY 1)
    SELECT count(*) FILTER (t <> 0) AS cardinality, sum(t) AS l1, round(sqrt(sum(t * t)), 6) AS l2,
           round((SELECT -sum(t / a * log2(t / a)) FROM s, (SELECT sum(t) AS a FROM s) WHERE t > 0), 6) AS entropy FROM s
""")
def keyed_card_l1_l2_entropy(spark, sf):
    return X.keyed(table(spark, sf, "lineitem").withColumn("w", F.col("l_quantity").cast("long")), "l_partkey", "w").withColumn("l2", F.round("l2", 6)).withColumn("entropy", F.round("entropy", 6))


@query("SELECT l_returnflag, l_linestatus, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def subpop_freq(spark, sf):
    return X.group_frequency(table(spark, sf, "lineitem"), LABELS, "l_quantity")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS distinct_values, sum(n)::BIGINT AS l1, round(sqrt(sum(n::DOUBLE * n)), 6) AS l2,
           round(-sum(n / s * log2(n / s)), 6) AS entropy
    FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus)::DOUBLE AS s FROM lineitem GROUP BY 1, 2, 3)
    GROUP BY 1, 2
""")
def subpop_shape(spark, sf):
    return X.group_shape(table(spark, sf, "lineitem"), LABELS, "l_quantity").withColumn("l2", F.round("l2", 6)).withColumn("entropy", F.round("entropy", 6))


@query(_linear("lineitem", "l_extendedprice", "l_returnflag, l_linestatus"))
def subpop_quantile(spark, sf):
    return X.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", FIVE, by=LABELS).withColumn("value", F.round("value", 6))


@query("""
    SELECT l_returnflag, l_linestatus, x, round(avg(CASE WHEN l_quantity <= x THEN 1.0::DOUBLE ELSE 0 END), 9) AS share
    FROM lineitem, (SELECT unnest([5, 10, 20, 30, 40])::DOUBLE AS x) GROUP BY ALL
""")
def subpop_cdf(spark, sf):
    return X.group_cdf(table(spark, sf, "lineitem"), LABELS, "l_quantity", [5, 10, 20, 30, 40]).withColumn("share", F.round("share", 9))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY ALL")
def subpop_sum(spark, sf):
    return X.group_sum(table(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long")), LABELS, "l_quantity")


_CUBE = """
    SELECT l_returnflag, l_linestatus, {subset} AS subset, {agg} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    HAVING NOT (grouping(l_returnflag) = 1 AND grouping(l_linestatus) = 1)
"""
_SUBSET = "(2 * grouping(l_returnflag) + grouping(l_linestatus))::BIGINT"


@query(_CUBE.format(subset=_SUBSET, agg="count(*) AS n"))
def cube_fanout_count(spark, sf):
    return X.subsets(table(spark, sf, "lineitem"), LABELS, F.count(F.lit(1)).alias("n"))


@query(_CUBE.format(subset=_SUBSET, agg="count(DISTINCT l_suppkey) AS n"))
def cube_fanout_distinct(spark, sf):
    return X.subsets(table(spark, sf, "lineitem"), LABELS, F.countDistinct("l_suppkey").alias("n"))


@query(_CUBE.format(subset=_SUBSET, agg="sum(l_quantity::BIGINT)::BIGINT AS n"))
def fan_out_sum(spark, sf):
    rows = X.fan_out(table(spark, sf, "lineitem").select(*LABELS, F.col("l_quantity").cast("long").alias("v")), LABELS)
    return rows.groupBy("subset", *LABELS).agg(F.sum("v").alias("n")).withColumn("subset", F.col("subset").cast("long"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def key_set(spark, sf):
    return X.key_set(table(spark, sf, "lineitem"), LABELS)


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders GROUP BY ALL")
def agg_sum_count_min_max(spark, sf):
    return X.accumulate(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("total", F.round("total", 2))


@query("""
    WITH s AS (SELECT event_type, user_id, ts, event_id, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT event_type, user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) + sum(CASE WHEN value < b THEN b ELSE 0 END), 6) AS increase FROM s GROUP BY ALL
""")
def agg_increase(spark, sf):
    return X.increase(table(spark, sf, "events"), ["event_type", "user_id"], ["ts", "event_id"], "value").withColumn("increase", F.round("increase", 6))
