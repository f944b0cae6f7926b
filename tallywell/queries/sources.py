"""Columns generated for the orders of the test tables, whose values SQL can make too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import P
from ..sources import generate as G
from . import query, table
from .sketches import cw


def uniform(row: str, seed: int) -> str:
    inner = f"xor({cw(f'{row} + 1', seed % 40, 7)}, {cw(f'{row} + 1', seed % 40 + 1, 8)} >> 9)"
    return f"(({cw(inner, seed % 40 + 2, 9)} + 0.5::DOUBLE) / {float(P)!r}::DOUBLE)"


_IDS = "(SELECT o_orderkey AS id FROM orders) t"


def _ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


@query(f"SELECT id, round({uniform('id', 1)}, 9) AS u, round(-5 + {uniform('id', 2)} * 10, 9) AS between_, round(10 * pow(1 - {uniform('id', 3)}, {-1 / 1.5!r}::DOUBLE), 6) AS pareto FROM {_IDS}")
def generate_values(spark, sf):
    i = F.col("id")
    t = G.table(spark, _ids(spark, sf), u=G.uniform(i, 1), between_=G.between(i, 2, -5, 5), pareto=G.pareto(i, 3, 10, 1.5))
    return t.select("id", F.round("u", 9).alias("u"), F.round("between_", 9).alias("between_"), F.round("pareto", 6).alias("pareto"))


@query(f"WITH d AS (SELECT id, floor({uniform('id', 4)} * 4)::BIGINT AS region FROM {_IDS}) SELECT region, region || '.' || floor({uniform('id', 5)} * 5)::BIGINT AS service, count(*) AS n FROM d GROUP BY ALL")
def generate_hierarchy(spark, sf):
    i = F.col("id")
    t = G.table(spark, _ids(spark, sf), region=F.floor(G.uniform(i, 4) * 4))
    return t.withColumn("service", G.child(F.col("region"), i, 5, 5)).groupBy("region", "service").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH d AS (SELECT o_custkey, o_orderkey AS id, {uniform('o_orderkey', 6)} * 3 - 1 AS x FROM orders) SELECT o_custkey, id, round(100 + sum(greatest(x, 0)) OVER (PARTITION BY o_custkey ORDER BY id) - first(greatest(x, 0)) OVER (PARTITION BY o_custkey ORDER BY id), 6) AS counter FROM d")
def generate_counter(spark, sf):
    t = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), G.between(F.col("o_orderkey"), 6, -1, 2).alias("counter"))
    return G.monotone(t, "counter", "id", ["o_custkey"], 100.0).select("o_custkey", "id", F.round("counter", 6).alias("counter"))


@query("SELECT id, " + " || ".join(f"chr(97 + (id // {26**i} % 26)::INT)" for i in range(5)) + f" AS name FROM {_IDS}")
def generate_strings(spark, sf):
    return G.table(spark, _ids(spark, sf), name=G.text(F.col("id"), 5))


@query(f"WITH d AS (SELECT id, {cw(cw('id + 1', 7, 11), 8, 12)} AS x FROM {_IDS}) SELECT x % 3 AS a, x // 3 % 5 AS b, count(*) AS n FROM d GROUP BY ALL")
def generate_connected(spark, sf):
    a, b = G.connected(F.col("id"), 7, [3, 5])
    return G.table(spark, _ids(spark, sf), a=a, b=b).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH u AS (SELECT {uniform('id', 8)} AS u FROM {_IDS}), w AS (SELECT rank, sum(pow(rank, -1.1::DOUBLE)) OVER (ORDER BY rank) / sum(pow(rank, -1.1::DOUBLE)) OVER () AS upto, coalesce(sum(pow(rank, -1.1::DOUBLE)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(pow(rank, -1.1::DOUBLE)) OVER () AS above FROM range(1, 101) t(rank))
    SELECT rank, count(*) AS n FROM u JOIN w ON u >= above AND u < upto GROUP BY rank""")
def generate_zipf(spark, sf):
    """A rank of 1 to 100 for each order."""
    return G.table(spark, _ids(spark, sf), rank=G.zipf(F.col("id"), 8, 100, 1.1)).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT floor(id / 1000)::BIGINT AS interval_, count(*)::BIGINT + count(*) FILTER (floor(id / 1000) IN (3, 7) AND {uniform('id', 9)} < 0.5) AS n FROM {_IDS} GROUP BY 1")
def generate_bursts(spark, sf):
    return G.with_bursts(G.table(spark, _ids(spark, sf)), "id", 1000, [3, 7], 0.5, 9).groupBy(F.floor(F.col("id") / 1000).alias("interval_")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_name, 1000000 + step * 10000 AS ts_ms, (step * 2)::DOUBLE AS value FROM customer, (SELECT unnest(range(1, 7)) AS step)")
def generate_series(spark, sf):
    """A counter for each customer."""
    return G.series(spark, table(spark, sf, "customer").select("c_name"), 1_000_000, 60_000, 10_000, lambda s, i: F.lit(2.0), counter=True)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def generate_claimed(spark, sf):
    """Names whose number is claimed from the orders, and holds."""
    ids = _ids(spark, sf)
    return G.claimed(G.table(spark, ids, name=G.text(F.col("id"), 5)), name=ids.distinct().count()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("ids"))
