"""Studies over measurements of the test tables: prices, yearly totals, and the sizes and errors of sketches beside exact states."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import P, coefficients, integer_key
from ..operators import exact as X
from ..operators import sketches as S
from ..operators import study as D
from ..operators import trials as A
from . import query, table
from .sketches import _KEYS, cells_sql, classic_sql, estimate_sql, registers_sql
from .windows import _S, SERIES, samples

_POINTS = "(SELECT l_returnflag AS what, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_extendedprice > 0)"


@query(f"""
    WITH p AS {_POINTS}, s AS (SELECT what, sum(1 / (y * y)) AS sw, sum(x / (y * y)) AS sx, sum(1 / y) AS sy, sum(x * x / (y * y)) AS sxx, sum(x / y) AS sxy FROM p GROUP BY 1),
    f AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS free FROM s), b AS (SELECT *, (sy - free * sx) / sw AS base FROM f),
    g AS (SELECT what, CASE WHEN base < 0 THEN sxy / sxx WHEN free < 0 THEN 0 ELSE free END AS slope, CASE WHEN base < 0 THEN 0 WHEN free < 0 THEN sy / sw ELSE base END AS intercept FROM b)
    SELECT what, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(max(abs((slope * x + intercept) / y - 1)), 6) AS residual, max(abs((slope * x + intercept) / y - 1)) > 0.1 AS flagged FROM g JOIN p USING (what) GROUP BY what, slope, intercept
""")
def cost_fit(spark, sf):
    """Price by quantity, by return flag."""
    points = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("what"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")).filter("y > 0")
    return D.cost_fit(points, ["what"]).withColumn("slope", F.round("slope", 6)).withColumn("intercept", F.round("intercept", 3)).withColumn("residual", F.round("residual", 6))


#: The orders of seven years are seven runs of each priority.
_RUNS = "(SELECT o_orderpriority AS arm, year(o_orderdate) AS y, count(*)::DOUBLE AS v FROM orders GROUP BY ALL)"


def _runs(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("v"))


@query(f"SELECT arm, median(v) AS median, min(v) AS low, max(v) AS high FROM {_RUNS} GROUP BY 1")
def noise_band(spark, sf):
    return D.noise_band(_runs(spark, sf), ["arm"], "v")


@query(f"SELECT arm, count(*) AS runs, median(v) AS median, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS ci95 FROM {_RUNS} GROUP BY 1")
def run_summary(spark, sf):
    return D.summary(_runs(spark, sf), ["arm"], "v").withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "ci95")})


#: Customers met until a year's end: what an exact set of them takes, in bytes, beside 64 registers.
_BYTES = 64
_SETS = "(SELECT status, y AS n, (8 * sum(new) OVER (PARTITION BY status ORDER BY y))::DOUBLE AS exact FROM (SELECT status, y, count(*) AS new FROM (SELECT o_orderstatus AS status, o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY ALL) GROUP BY ALL))"


@query(f"SELECT status, coalesce(min(n) FILTER (ok), -1) AS n_star FROM (SELECT *, min(exact >= 10 * {_BYTES}) OVER (PARTITION BY status ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok FROM {_SETS}) GROUP BY 1")
def n_star(spark, sf):
    """From which year on the exact set of customers takes ten times the sketch's bytes or more."""
    first = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), "o_custkey").agg(F.min(F.year("o_orderdate")).alias("n"))
    new = first.groupBy("status", "n").agg(F.count(F.lit(1)).alias("new"))
    sets = new.select("status", F.col("n").cast("long").alias("n"), (8 * F.sum("new").over(W.partitionBy("status").orderBy("n"))).cast("double").alias("exact"), F.lit(float(_BYTES)).alias("sketch"))
    return D.crossover(sets, ["status"], 10).select("status", F.coalesce("n_star", F.lit(-1)).alias("n_star"))


#: Distinct customers of each status: the exact set, and 2**6 registers, with their costs in bytes and the error.
_STATUS_ARMS = f"""WITH {registers_sql('g', 'orders', 'o_custkey', 6, 'o_orderstatus')}, h AS ({classic_sql('g', 6, 'o_orderstatus')}),
    x AS (SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1), j AS (SELECT o_orderstatus, 8.0::DOUBLE * n AS base, {_BYTES}.0::DOUBLE AS cost, abs(estimate - n) / n AS error FROM x JOIN h USING (o_orderstatus))"""


def _arms(spark, sf):
    df = table(spark, sf, "orders")
    exact = df.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n"))
    read = S.hll_estimate(S.registers(df, integer_key(F.col("o_custkey")), 6, ["o_orderstatus"]), 6, ["o_orderstatus"])
    both = exact.join(read, "o_orderstatus")
    return both.select("o_orderstatus", (8.0 * F.col("n")).alias("base"), F.lit(float(_BYTES)).alias("cost"), (F.abs(F.col("estimate") - F.col("n")) / F.col("n")).alias("error"))


@query(f"{_STATUS_ARMS} SELECT o_orderstatus, CASE WHEN cost > 1.05::DOUBLE * base THEN 'cost' WHEN error > 0.05 THEN 'error' ELSE 'pass' END AS verdict FROM j")
def gate(spark, sf):
    """Whether the sketch's set of customers is smaller than the exact one, and within 5 %."""
    arms = _arms(spark, sf)
    return D.gate(arms.select("o_orderstatus", F.col("base").alias("cost")), arms.select("o_orderstatus", "cost", "error"), ["o_orderstatus"], 0.05)


def _cms_errors_sql(cols: int, tag: str) -> str:
    c, e = cells_sql(f"m{tag}", "lineitem", "l_partkey", 3, cols), estimate_sql(f"e{tag}", f"m{tag}", "k", "l_partkey", 3, cols)
    return f"{c}, {e}, x{tag} AS (SELECT {cols} AS config, {24 * cols}::BIGINT AS bytes, (estimate - n) / (SELECT count(*) FROM lineitem)::DOUBLE AS error FROM e{tag} JOIN f USING (l_partkey))"


_GRID = (64, 256, 1024)
_SWEEP = f"WITH {_KEYS}, f AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), " + ", ".join(_cms_errors_sql(c, str(c)) for c in _GRID) + ", x AS (" + " UNION ALL ".join(f"SELECT * FROM x{c}" for c in _GRID) + ")"


def _sweep(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey")
    key, n = integer_key(F.col("l_partkey")), df.count()
    truth = X.frequency(df, "l_partkey").toDF("l_partkey", "n")
    rows = None
    for cols in _GRID:
        e = S.estimate(S.matrix(df, key, 3, cols), truth, key, 3, cols)
        e = e.select(F.lit(cols).alias("config"), F.lit(24 * cols).cast("long").alias("bytes"), ((F.col("estimate") - F.col("n")) / float(n)).alias("error"))
        rows = e if rows is None else rows.union(e)
    return rows


@query(f"{_SWEEP}, w AS (SELECT config, bytes, max(error) AS error FROM x GROUP BY ALL) SELECT 'cms' AS sketch, arg_min(config, bytes) FILTER (error <= 0.005) AS config FROM w")
def recommend(spark, sf):
    return D.recommend(_sweep(spark, sf).withColumn("sketch", F.lit("cms")), ["sketch"], 0.005)


@query(f"{_SWEEP}, r AS (SELECT config, error, row_number() OVER (PARTITION BY config ORDER BY error) AS i, count(*) OVER (PARTITION BY config) AS n FROM x) SELECT config, delta, round(error, 9) AS error FROM r, (SELECT unnest([0.01, 0.1, 0.5])::DOUBLE AS delta) WHERE delta >= 3.0::DOUBLE / n AND i = greatest(1, ceil((1 - delta) * n - 1e-9))")
def error_quantiles(spark, sf):
    return D.error_quantiles(_sweep(spark, sf), ["config"], [0.01, 0.1, 0.5]).withColumn("error", F.round("error", 9))


@query(f"{_SWEEP}, g AS (SELECT config AS n, round(avg(error), 9) AS error FROM x GROUP BY 1), l AS (SELECT *, last_value(error) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM g), h AS (SELECT *, min(abs(error - level) <= 0.5 * abs(level)) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok FROM l) SELECT 'cms' AS sketch, min(n) FILTER (ok) AS n_sat FROM h")
def n_sat(spark, sf):
    mean = _sweep(spark, sf).groupBy(F.col("config").alias("n")).agg(F.round(F.avg("error"), 9).alias("error"))
    return D.saturation(mean.withColumn("sketch", F.lit("cms")), ["sketch"], 0.5)


@query(f"{_STATUS_ARMS} SELECT o_orderstatus, CASE WHEN error <= 0.05 THEN cost ELSE base END / least(base, cost) AS regret FROM j")
def regret(spark, sf):
    """Of choosing the sketch where it is within 5 %, and the exact set elsewhere: the bytes over the least."""
    arms = _arms(spark, sf)
    sketch = F.col("error") <= 0.05
    rows = arms.select("o_orderstatus", F.explode(F.array(F.struct(F.lit("exact").alias("arm"), F.col("base").alias("cost"), (~sketch).alias("selected")), F.struct(F.lit("hll").alias("arm"), F.col("cost").alias("cost"), sketch.alias("selected")))).alias("x")).select("o_orderstatus", "x.*")
    return D.regret(rows, ["o_orderstatus"])


@query(f"WITH {_S}, g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY event_type, user_id ORDER BY ts_ms) AS gap FROM s) SELECT count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples, count(DISTINCT event_type) AS values_event_type, count(DISTINCT user_id) AS values_user_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, min(gap) FILTER (gap > 0) AS interval_ms, max(abs(value)) AS magnitude, min(value) < 0 AS negative FROM g")
def data_statistics(spark, sf):
    return D.data_statistics(samples(spark, sf), SERIES)


_TARGETS = (0.1, 0.01, 0.001)


@query("WITH d AS (SELECT 'o_custkey' AS key, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey) FROM orders), t AS (SELECT unnest([0.1, 0.01, 0.001])::DOUBLE AS target), l AS (SELECT *, greatest(4, ceil(2 * log2(3 * 1.04::DOUBLE / target)))::INT AS lg FROM d, t) SELECT key, target, CASE WHEN lg > 18 THEN 'exact' ELSE 'hll' END AS sketch, CASE WHEN lg > 18 THEN 8 * n ELSE 1 << lg END::BIGINT AS bytes, (8 * n)::BIGINT AS exact_bytes FROM l")
def choose_sketch(spark, sf):
    """For distinct keys of the orders, at a few targets: what is chosen, and its bytes beside those of the exact set."""
    n = table(spark, sf, "orders").agg(F.countDistinct("o_custkey").alias("o_custkey"), F.countDistinct("o_orderkey").alias("o_orderkey")).first()
    chosen = [(key, e, n[key], D.choose("cardinality", e, distinct=n[key])) for key in ("o_custkey", "o_orderkey") for e in _TARGETS]
    return spark.createDataFrame([(key, e, x["sketch"], x["bytes"], 8 * d) for key, e, d, x in chosen], "key string, target double, sketch string, bytes long, exact_bytes long")


# -- trials --------------------------------------------------------------------------------------------------------

TRIALS, _DELTAS = 32, [0.1, 0.25, 0.5]


def _key_sql(key: str, mode: str) -> str:
    if mode == "relabel":
        return f"(({key} % {P}) + trial * {A.OFFSET % P}) % {P}"
    a, b = ("[" + ", ".join(str(coefficients(t, 77)[i]) for t in range(TRIALS)) + "]::BIGINT[]" for i in (0, 1))
    return f"(({a})[trial + 1] * ({key} % {P}) + ({b})[trial + 1]) % {P}"


def _trials_sql(mode: str, signed: bool) -> str:
    return f"""WITH f AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT trial, n, {_key_sql('l_partkey', mode)} AS k FROM f, (SELECT unnest(range({TRIALS})) AS trial)),
        {cells_sql('m', 's', 'k', 3, 256, signed, 'n', 'trial')}, {estimate_sql('e', 'm', 's', 'k', 3, 256, signed, 'trial', 'n')},
        x AS (SELECT trial, round(avg(abs(estimate - n)) / sum(n), 12) AS error FROM e GROUP BY trial),
        r AS (SELECT error, row_number() OVER (ORDER BY error) AS i, count(*) OVER () AS c FROM x)"""


_READ = " SELECT '{name}' AS sketch, delta, error FROM r, (SELECT unnest([0.1, 0.25, 0.5])::DOUBLE AS delta) WHERE i = greatest(1, ceil((1 - delta) * c - 1e-9))"


def _trials(spark, sf, mode, signed):
    counts = X.frequency(table(spark, sf, "lineitem"), "l_partkey").withColumnRenamed("key", "l_partkey")
    errors = A.frequency_errors(counts, F.col("l_partkey"), "n", TRIALS, mode, 3, 256, signed).withColumn("error", F.round("error", 12))
    return D.error_quantiles(errors.withColumn("sketch", F.lit("cs" if signed else "cms")), ["sketch"], _DELTAS)


@query(_trials_sql("relabel", False) + _READ.format(name="cms"))
def trials_cms_relabel(spark, sf):
    """Quantiles over 32 trials of Count-Min's mean error, keys under other labels in each."""
    return _trials(spark, sf, "relabel", False)


@query(_trials_sql("reseed", True) + _READ.format(name="cs"))
def trials_cs_reseed(spark, sf):
    return _trials(spark, sf, "reseed", True)


@query(f"""WITH s AS (SELECT trial, {_key_sql('o_custkey', 'reseed')} AS k FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest(range({TRIALS})) AS trial)), {registers_sql('g', 's', 'k', 7, 'trial')}, h AS ({classic_sql('g', 7, 'trial')}),
    x AS (SELECT round(abs(estimate - n) / n, 9) AS error FROM h JOIN (SELECT trial, count(DISTINCT k) AS n FROM s GROUP BY 1) USING (trial)), r AS (SELECT error, row_number() OVER (ORDER BY error) AS i, count(*) OVER () AS c FROM x)""" + _READ.format(name="hll"))
def trials_hll_reseed(spark, sf):
    """Quantiles over 32 trials of HyperLogLog's relative error."""
    errors = A.cardinality_errors(table(spark, sf, "orders").select("o_custkey").distinct(), F.col("o_custkey"), TRIALS, "reseed", 7).withColumn("error", F.round("error", 9))
    return D.error_quantiles(errors.withColumn("sketch", F.lit("hll")), ["sketch"], _DELTAS)


# -- fits of measured errors ---------------------------------------------------------------------------------------

_WIDTHS = (32, 64, 128, 256, 512)
_FLAGS = "(SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY 1)"


def _by_width_sql() -> str:
    parts = []
    for c in _WIDTHS:
        parts.append(f"{cells_sql(f'm{c}', 'lineitem', 'l_suppkey', 3, c, by='l_returnflag')}, {estimate_sql(f'e{c}', f'm{c}', 'f', 'l_suppkey', 3, c, by='l_returnflag', keep='n')}")
    rows = " UNION ALL ".join(f"SELECT {c} AS cols, l_returnflag, avg(estimate - n) AS y FROM e{c} GROUP BY ALL" for c in _WIDTHS)
    return f"WITH f AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), {', '.join(parts)}, p AS (SELECT cols, total / cols::DOUBLE AS a, 1.0::DOUBLE AS b, y FROM ({rows}) JOIN {_FLAGS} USING (l_returnflag) WHERE y <> 0)"


def _by_width(spark, sf):
    """(cols, a, b, y): Count-Min's mean error in counts, by width and return flag; a: rows for each column, b: 1."""
    df, out = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey"), None
    key, by = integer_key(F.col("l_suppkey")), ["l_returnflag"]
    truth = df.groupBy(*by, "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    for c in _WIDTHS:
        e = S.estimate(S.matrix(df, key, 3, c, by=by), truth, key, 3, c, by=by)
        row = e.groupBy(*by).agg(F.avg(F.col("estimate") - F.col("n")).alias("y"), F.sum("n").alias("total")).select(F.lit(c).alias("cols"), (F.col("total") / F.lit(float(c))).alias("a"), F.lit(1.0).alias("b"), "y")
        out = row if out is None else out.union(row)
    return out


_FIT = """, w AS (SELECT *, a / y AS ta, b / y AS tb FROM p), s AS (SELECT cols, sum(ta * ta) AS aa, sum(ta * tb) AS ab, sum(tb * tb) AS bb, sum(ta) AS ya, sum(tb) AS yb, count(*) AS n FROM w GROUP BY cols),
    o AS (SELECT cols AS left_out, sum(aa) OVER () - aa AS aa, sum(ab) OVER () - ab AS ab, sum(bb) OVER () - bb AS bb, sum(ya) OVER () - ya AS ya, sum(yb) OVER () - yb AS yb, sum(n) OVER () - n AS n FROM s UNION ALL SELECT NULL, sum(aa), sum(ab), sum(bb), sum(ya), sum(yb), sum(n) FROM s),
    d AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS fa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS fb FROM o),
    c AS (SELECT left_out, n, CASE WHEN fa >= 0 AND fb >= 0 THEN fa WHEN ya * ya / aa >= yb * yb / bb THEN ya / aa ELSE 0 END AS a, CASE WHEN fa >= 0 AND fb >= 0 THEN fb WHEN ya * ya / aa >= yb * yb / bb THEN 0 ELSE yb / bb END AS b FROM d)
    SELECT coalesce(c.left_out, -1)::INT AS left_out, c.n::BIGINT AS points, round(c.a, 6) AS per_column, round(c.b, 6) AS fixed, round(max(abs(c.a * ta + c.b * tb - 1)), 6) AS worst FROM c JOIN w ON c.left_out IS NULL OR w.cols = c.left_out GROUP BY ALL"""


@query(_by_width_sql() + _FIT)
def constrained_fit(spark, sf):
    """Count-Min's measured error as a share of rows for each column plus a constant, and how far it is off at a width that it wasn't fitted to; -1: fitted to all."""
    fits = D.constrained_fit(_by_width(spark, sf), "cols", ["a", "b"], "y")
    c = lambda i, n: F.round(F.get("coefficients", F.lit(i)), 6).alias(n)
    return fits.select(F.coalesce("left_out", F.lit(-1)).alias("left_out"), "points", c(0, "per_column"), c(1, "fixed"), F.round("worst", 6).alias("worst"))


@query(f"{_by_width_sql()}, q AS (SELECT a.cols AS c, sign(b.a - a.a) * sign(b.y - a.y) AS s, abs(sign(b.a - a.a)) AS nx, abs(sign(b.y - a.y)) AS ny FROM (SELECT *, row_number() OVER (ORDER BY a, y) AS i FROM p) a JOIN (SELECT *, row_number() OVER (ORDER BY a, y) AS i FROM p) b ON a.i < b.i) SELECT (SELECT count(*) FROM p) AS n, round(sum(s) / sqrt(sum(nx) * sum(ny)), 9) AS tau FROM q HAVING (SELECT count(*) FROM p) > 0")
def ranking_agreement(spark, sf):
    """Kendall's tau of the error that the bound promises (rows for each column) and the measured one, over widths and flags."""
    return D.rank_agreement(_by_width(spark, sf).filter("y <> 0"), [], "a", "y").withColumn("tau", F.round("tau", 9))
