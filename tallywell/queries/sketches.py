"""Sketches of the order tables, read out for every key, with the same cells in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import P, coefficients, integer_key
from ..model import subset_key
from ..operators import exact as X
from ..operators import heaps as H
from ..operators import sketches as S
from . import query, table

LABELS = ["l_returnflag", "l_linestatus"]
ROWS, COLS = 3, 256


# -- the hash family in SQL ----------------------------------------------------------------------------------------


def cw(x: str, row: str | int, salt: int = 0, rows: int = 8) -> str:
    """row: a number, or an expression over rows, for which a list of coefficients is indexed."""
    def one(x: str, salt: int) -> str:
        if isinstance(row, int):
            a, b = coefficients(row, salt)
            return f"(({a}::BIGINT * (({x}) % {P}) + {b}) % {P})"
        a, b = ("(CAST([" + ", ".join(str(coefficients(r, salt)[i]) for r in range(rows)) + f"] AS BIGINT[]))[({row}) + 1]" for i in (0, 1))
        return f"(({a} * (({x}) % {P}) + {b}) % {P})"

    h = one(x, salt)
    return one(f"xor({h}, {h} >> 13)", salt + 37)


def sign(x: str, row: str | int) -> str:
    return f"(1 - 2 * (({cw(x, row, 51)} >> 7) % 2))"


def leading(h: str) -> str:
    return f"(CASE WHEN {h} = 0 THEN 32 ELSE 32 - length(bin({h})) END)"


def rows_of(n: int, name: str = "r") -> str:
    return f"(SELECT unnest(range({n}))::INT AS {name})"


# -- counting matrices ---------------------------------------------------------------------------------------------


def cells_sql(name: str, source: str, key: str, rows: int, cols: int, signed: bool = False, weight: str = "1", by: str = "", folded: int | None = None) -> str:
    by = f"{by}, " if by else ""
    return f"{name} AS (SELECT {by}r, {cw(key, 'r')} % {cols} % {folded or cols} AS c, sum({f'{sign(key, chr(114))} * ' if signed else ''}({weight}))::BIGINT AS n FROM {source}, {rows_of(rows)} GROUP BY ALL)"


def estimate_sql(name: str, cells: str, probes: str, key: str, rows: int, cols: int, signed: bool = False, by: str = "", keep: str = "", folded: int | None = None) -> str:
    own = ", ".join(x for x in (by, keep, key) if x)
    on = " AND ".join([f"p.{b.strip()} = m.{b.strip()}" for b in by.split(",") if b] + ["p.r = m.r", "p.c = m.c"])
    agg = f"list_sort(list(coalesce(m.n, 0) * p.s))[{rows // 2 + 1}]" if signed else "min(coalesce(m.n, 0))"
    return f"""{name}_p AS (SELECT {own}, r, {cw(key, 'r')} % {cols} % {folded or cols} AS c, {sign(key, 'r') if signed else 1} AS s FROM {probes}, {rows_of(rows)}),
        {name} AS (SELECT {', '.join(f'p.{x.strip()}' for x in own.split(','))}, {agg} AS estimate FROM {name}_p p LEFT JOIN {cells} m ON {on} GROUP BY ALL)"""


_KEYS = "k AS (SELECT DISTINCT l_partkey FROM lineitem)"


def _matrix(spark, sf, signed=False, cols=COLS):
    df = table(spark, sf, "lineitem").select("l_partkey")
    return df, H.filled(df, integer_key(F.col("l_partkey")), ROWS, cols, signed)


def _read(df, state, signed=False, cols=COLS, folded=None):
    return S.estimate(state, df.distinct(), integer_key(F.col("l_partkey")), ROWS, cols, signed, folded=folded)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, COLS)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, COLS)} SELECT * FROM e")
def cms_estimate(spark, sf):
    df, state = _matrix(spark, sf)
    return _read(df, state)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, COLS)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, COLS)} SELECT * FROM e")
def cms_merge_shards(spark, sf):
    """The states of four shards, merged, are the state of all rows."""
    df = table(spark, sf, "lineitem")
    states = S.matrix(df.withColumn("shard", F.col("l_orderkey") % 4), integer_key(F.col("l_partkey")), ROWS, COLS, by=["shard"])
    return _read(df.select("l_partkey"), S.merge_cells(states))


_HEX = "('0x' || substr(md5(o_orderpriority || o_custkey), 1, 8))::BIGINT"


@query(f"WITH o AS (SELECT o_orderpriority || o_custkey AS name, {_HEX} AS h FROM orders), {cells_sql('m', 'o', 'h', ROWS, COLS)}, k AS (SELECT DISTINCT name, h FROM o), {estimate_sql('e', 'm', 'k', 'h', ROWS, COLS, keep='name')} SELECT name, estimate FROM e")
def cms_string_keys(spark, sf):
    df = table(spark, sf, "orders").select(F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("name"))
    key = integer_key(F.col("name"), text=True)
    return S.estimate(S.matrix(df, key, ROWS, COLS), df.distinct(), key, ROWS, COLS)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, 1024, folded=256)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, 1024, folded=256)} SELECT * FROM e")
def cms_fold(spark, sf):
    df, state = _matrix(spark, sf, cols=1024)
    return _read(df, S.fold(state, 1024, 2), cols=1024, folded=256)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, 1024, True, folded=256)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, 1024, True, folded=256)} SELECT * FROM e")
def cs_fold(spark, sf):
    df, state = _matrix(spark, sf, True, 1024)
    return _read(df, S.fold(state, 1024, 2), True, 1024, 256)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, COLS, True)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, COLS, True)} SELECT * FROM e")
def cs_estimate(spark, sf):
    df, state = _matrix(spark, sf, True)
    return _read(df, state, True)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, COLS, True)}, s AS (SELECT r, sum(n::DOUBLE * n) AS s FROM m GROUP BY r) SELECT round(sqrt(list_sort(list(s))[2]), 6) AS l2 FROM s")
def cs_l2(spark, sf):
    return S.l2_norm(_matrix(spark, sf, True)[1], ROWS).withColumn("l2", F.round("l2", 6))


def _top_sql(signed: bool, cols: int = COLS, folded: int | None = None) -> str:
    return f"WITH {cells_sql('m', 'lineitem', 'l_partkey', ROWS, cols, signed, folded=folded)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, cols, signed, folded=folded)} SELECT * FROM e ORDER BY estimate DESC, l_partkey LIMIT 32"


def _top(spark, sf, signed, cols=COLS, folded=None):
    """Two passes, neither of which groups by key: the cells, and the greatest estimates that the cells give."""
    df, state = _matrix(spark, sf, signed, cols)
    state = S.fold(state, cols, 2) if folded else state
    return H.greatest(S.estimate(state, df, integer_key(F.col("l_partkey")), ROWS, cols, signed, folded=folded), "l_partkey", 32)


@query(_top_sql(False))
def cms_topk(spark, sf):
    return _top(spark, sf, False)


@query(_top_sql(True))
def cs_topk(spark, sf):
    return _top(spark, sf, True)


@query(_top_sql(False, 1024, 256))
def cms_fold_topk(spark, sf):
    return _top(spark, sf, False, 1024, 256)


@query(_top_sql(True, 1024, 256))
def cs_fold_topk(spark, sf):
    return _top(spark, sf, True, 1024, 256)


# -- distinct counts -----------------------------------------------------------------------------------------------


def registers_sql(name: str, source: str, key: str, lg: int, by: str = "") -> str:
    by = f"{by}, " if by else ""
    return f"{name} AS (SELECT {by}{cw(key, 0, 20)} % {1 << lg} AS b, max({leading(cw(key, 1, 20))})::BIGINT AS m FROM {source} GROUP BY ALL)"


def classic_sql(regs: str, lg: int, by: str = "") -> str:
    m = 1 << lg
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(lg, 0.7213 / (1 + 1.079 / m))
    raw = f"({alpha * m * m}::DOUBLE / (s + ({m} - n)))"
    sel = f"{by}, " if by else ""
    return f"SELECT {sel}CASE WHEN {raw} <= {2.5 * m} AND n < {m} THEN {m} * ln({m} / ({m} - n)::DOUBLE) ELSE {raw} END AS estimate FROM (SELECT {sel}sum(pow(2.0::DOUBLE, -m)) AS s, count(*) AS n FROM {regs} {'GROUP BY ALL' if by else ''})"


@query(f"WITH {registers_sql('g', 'orders', 'o_custkey', 9)} SELECT * FROM g")
def hll_registers(spark, sf):
    return S.registers(table(spark, sf, "orders"), integer_key(F.col("o_custkey")), 9).withColumn("m", F.col("m").cast("long"))


@query(f"WITH {registers_sql('g', 'orders', 'o_custkey', 9)} SELECT round(estimate, 6) AS estimate FROM ({classic_sql('g', 9)})")
def hll_estimate(spark, sf):
    df = table(spark, sf, "orders")
    shards = S.registers(df.withColumn("shard", F.col("o_orderkey") % 4), integer_key(F.col("o_custkey")), 9, by=["shard"])
    merged = shards.groupBy("b").agg(F.max("m").alias("m"))
    return S.hll_estimate(merged, 9).withColumn("estimate", F.round("estimate", 6))


@query(f"""
    WITH {registers_sql('g', 'orders', 'o_custkey', 9)}, s AS (SELECT sum(CASE WHEN m <= 31 THEN pow(2.0::DOUBLE, -m) ELSE 0 END) AS mid, (512.0::DOUBLE - count(*)) / 512 AS x, 1 - count(*) FILTER (m > 31) / 512.0::DOUBLE AS y FROM g)
    SELECT round(512.0::DOUBLE * 512 / {2 * math.log(2)!r}::DOUBLE / (512 * (1 - y - {' - '.join(f'pow(1 - pow(y, {2.0**-k!r}::DOUBLE), 2) * {2.0**-k!r}::DOUBLE' for k in range(1, 24))}) / 3 * {2.0**-31!r}::DOUBLE + mid
        + 512 * (x + {' + '.join(f'pow(x, {2.0**k!r}::DOUBLE) * {2.0 ** (k - 1)!r}::DOUBLE' for k in range(1, 24))})), 6) AS estimate FROM s
""")
def hll_ertl(spark, sf):
    return S.hll_ertl(S.registers(table(spark, sf, "orders"), integer_key(F.col("o_custkey")), 9), 9).withColumn("estimate", F.round("estimate", 6))


@query(f"SELECT CASE WHEN count(*) < 256 THEN count(*)::DOUBLE ELSE round(255 * {P}.0::DOUBLE / max(h), 6) END AS estimate FROM (SELECT DISTINCT {cw('o_custkey', 0, 30)} AS h FROM orders ORDER BY h LIMIT 256)")
def kmv_estimate(spark, sf):
    return S.kmv_estimate(S.least_hashes(table(spark, sf, "orders"), integer_key(F.col("o_custkey")), 256), 256).withColumn("estimate", F.round("estimate", 6))


@query(f"""
    WITH s AS (SELECT DISTINCT r, {cw('l_partkey', 'r', 40)} % 8192 AS c FROM lineitem, {rows_of(4)} WHERE l_partkey % 2 = 0),
    k AS (SELECT DISTINCT l_partkey FROM lineitem), q AS (SELECT l_partkey, r, {cw('l_partkey', 'r', 40)} % 8192 AS c FROM k, {rows_of(4)}),
    m AS (SELECT l_partkey, count(s.c) = 4 AS member FROM q LEFT JOIN s USING (r, c) GROUP BY 1)
    SELECT count(*) FILTER (l_partkey % 2 = 1) AS absent, count(*) FILTER (l_partkey % 2 = 1 AND member) AS false_positive, count(*) FILTER (l_partkey % 2 = 0 AND NOT member) AS false_negative FROM m
""")
def bloom_fpr(spark, sf):
    """Even part keys are inserted, all are asked for."""
    df = table(spark, sf, "lineitem").select("l_partkey")
    key, odd = integer_key(F.col("l_partkey")), F.col("l_partkey") % 2 == 1
    got = S.bloom_member(S.bloom(df.filter(~odd), key, 4, 8192), df.distinct(), key, 4, 8192)
    return got.agg(F.count_if(odd).alias("absent"), F.count_if(odd & F.col("member")).alias("false_positive"), F.count_if(~odd & ~F.col("member")).alias("false_negative"))


# -- quantiles -----------------------------------------------------------------------------------------------------

_GAMMA = 1.02 / 0.98
_DD = f"b AS (SELECT CASE WHEN l_extendedprice > 0 THEN ceil(ln(l_extendedprice) / {math.log(_GAMMA)!r}::DOUBLE)::BIGINT END AS i, count(*) AS n FROM lineitem GROUP BY 1)"


@query(f"WITH {_DD} SELECT i, n FROM b")
def dd_buckets(spark, sf):
    return S.dd_buckets(table(spark, sf, "lineitem"), "l_extendedprice", 0.02)


@query(f"""
    WITH {_DD}, r AS (SELECT i, n, sum(n) OVER (ORDER BY i NULLS FIRST) AS u, sum(n) OVER () AS a FROM b)
    SELECT q, round(CASE WHEN i IS NULL THEN 0 ELSE 2 * pow({_GAMMA!r}::DOUBLE, i) / {_GAMMA + 1!r}::DOUBLE END, 6) AS value FROM r, (SELECT unnest([0.01, 0.5, 0.9, 0.99])::DOUBLE AS q)
    WHERE greatest(ceil(q * a), 1) > u - n AND greatest(ceil(q * a), 1) <= u
""")
def dd_quantile(spark, sf):
    state = S.dd_buckets(table(spark, sf, "lineitem").withColumn("shard", F.col("l_orderkey") % 4), "l_extendedprice", 0.02, by=["shard"])
    merged = state.groupBy("i").agg(F.sum("n").alias("n"))
    return S.dd_quantiles(merged, 0.02, [0.01, 0.5, 0.9, 0.99]).withColumn("value", F.round("value", 6))


# -- universal monitoring ------------------------------------------------------------------------------------------

_UM = dict(layers=6, rows=3, cols=128, heap=48)


def univmon_sql(source: str, key: str, weight: str, by: str = "", layers: int = 6, rows: int = 3, cols: int = 128, heap: int = 48) -> str:
    b = f"{by}, " if by else ""
    h = f"({cw('k', 0, 90)} % {1 << (layers - 1)})"
    return f"""u_s AS (SELECT {b}{key} AS k, sum({weight})::BIGINT AS w FROM {source} GROUP BY ALL),
        u_d AS (SELECT *, CASE WHEN {h} = 0 THEN {layers - 1} ELSE length(bin({h} & -{h})) - 1 END AS deep FROM u_s),
        u_k AS (SELECT {b}k, w, deep, unnest(range(deep + 1)) AS layer FROM u_d),
        {cells_sql('u_m', 'u_k', 'k', rows, cols, True, 'w', f'{b}layer')},
        {estimate_sql('u_e', 'u_m', 'u_k', 'k', rows, cols, True, f'{b}layer', 'deep')},
        u_h AS (SELECT *, pow(2.0::DOUBLE, layer) * CASE WHEN layer < {layers - 1} AND deep > layer THEN -1 ELSE 1 END AS f, estimate::DOUBLE AS e FROM u_e WHERE estimate > 0
                QUALIFY row_number() OVER (PARTITION BY {b}layer ORDER BY estimate DESC, k) <= {heap}),
        u_y AS (SELECT {b}greatest(sum(f), 0) AS cardinality, greatest(sum(f * e), 0) AS l1, greatest(sum(f * e * e), 0) AS s2, greatest(sum(f * e * log2(e)), 0) AS sl FROM u_h GROUP BY ALL),
        u AS (SELECT {b}cardinality, l1, sqrt(s2) AS l2, CASE WHEN l1 > 0 THEN greatest(log2(l1) - sl / l1, 0) ELSE 0 END AS entropy FROM u_y)"""


_READ = "round(cardinality, 6) AS cardinality, round(l1, 6) AS l1, round(l2, 6) AS l2, round(entropy, 6) AS entropy"


def _rounded(df):
    for c in ("cardinality", "l1", "l2", "entropy"):
        df = df.withColumn(c, F.round(c, 6))
    return df


def _weights(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", *LABELS, F.col("l_quantity").cast("long").alias("w"))


@query(f"WITH {univmon_sql('lineitem', 'l_partkey', 'l_quantity::BIGINT')} SELECT {_READ} FROM u")
def univmon_card_l1_l2_entropy(spark, sf):
    return _rounded(S.univmon(_weights(spark, sf), "l_partkey", "w", **_UM))


@query(f"""
    WITH e_s AS (SELECT l_partkey AS k, sum(l_quantity::BIGINT)::BIGINT AS w FROM lineitem GROUP BY 1), e_b AS (SELECT * FROM e_s ORDER BY w DESC, k LIMIT 40),
    e_m AS (SELECT * FROM e_s WHERE k NOT IN (SELECT k FROM e_b)), {univmon_sql('e_m', 'k', 'w')},
    b AS (SELECT count(*) AS c, sum(w)::DOUBLE AS s1, sum(w::DOUBLE * w) AS s2, sum(w * log2(w)) AS sl FROM e_b)
    SELECT round(c + cardinality, 6) AS cardinality, round(s1 + l1, 6) AS l1, round(sqrt(s2 + l2 * l2), 6) AS l2, round(log2(s1 + l1) - (sl + l1 * (log2(l1) - entropy)) / (s1 + l1), 6) AS entropy FROM b, u
""")
def univmon_two_tier(spark, sf):
    return _rounded(S.univmon_two_tier(_weights(spark, sf), "l_partkey", "w", 40, **_UM))


@query(f"WITH w AS (SELECT l_partkey AS k, l_quantity::BIGINT AS w FROM lineitem), {cells_sql('m', 'w', 'k', 3, 128, True, 'w')}, k AS (SELECT DISTINCT k FROM w), {estimate_sql('e', 'm', 'k', 'k', 3, 128, True)} SELECT k AS l_partkey, estimate FROM e ORDER BY estimate DESC, k LIMIT 32")
def univmon_topk(spark, sf):
    """The first layer alone: the heaviest keys by its Count Sketch."""
    df = _weights(spark, sf)
    key = integer_key(F.col("l_partkey"))
    return S.top(S.estimate(S.matrix(df, key, 3, 128, True, F.col("w")), df.select("l_partkey").distinct(), key, 3, 128, True), "l_partkey", 32)


# -- grids over label subsets --------------------------------------------------------------------------------------

_GROUP = "coalesce('l_returnflag:' || f || CASE WHEN s IS NULL THEN '' ELSE ';l_linestatus:' || s END, 'l_linestatus:' || s)"
_FAN = f"fan AS (SELECT {_GROUP} AS grp, ('0x' || substr(md5({_GROUP}), 1, 8))::BIGINT AS g, l_suppkey, l_partkey, w FROM (SELECT unnest([l_returnflag, NULL, l_returnflag]) AS f, unnest([l_linestatus, l_linestatus, NULL]) AS s, l_suppkey, l_partkey, l_quantity::BIGINT AS w FROM lineitem))"
_GRID = _FAN + f", gridded AS (SELECT fan.*, gr, {cw('g', 'gr', 60)} % 16 AS gc FROM fan, {rows_of(3, 'gr')}), asked AS (SELECT DISTINCT grp, gr, gc FROM gridded)"


def _by_labels(spark, sf):
    return table(spark, sf, "lineitem").select(*LABELS, "l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("w"))


def _fanned(states):
    """States kept by labels, once for each label subset that they count in, by grp. The few states are fanned out, not the rows."""
    rows = X.fan_out(states, LABELS)
    return rows.select(subset_key({c: F.col(c) for c in LABELS}).alias("grp"), *[c for c in states.columns if c not in LABELS])


def _gridded(states, rows=3, cols=16):
    """(grp, gr, gc, ...): fanned states in their grid cells, where states of the same cell are merged."""
    return S.grid_cells(_fanned(states), integer_key(F.col("grp"), text=True), rows, cols)


def _asked(spark, sf, *keys, rows=3, cols=16):
    """The grid cells that each label subset, or each key in it, is read from."""
    return _gridded(_by_labels(spark, sf).select(*LABELS, *keys).distinct(), rows, cols).distinct()


def _hydra_frequency_sql(signed: bool) -> str:
    agg = "list_sort(list(estimate))[2]" if signed else "min(estimate)"
    return f"WITH {_GRID}, {cells_sql('m', 'gridded', 'l_suppkey', 3, 64, signed, by='gr, gc')}, k AS (SELECT DISTINCT grp, gr, gc, l_suppkey FROM gridded), {estimate_sql('e', 'm', 'k', 'l_suppkey', 3, 64, signed, 'gr, gc', 'grp')} SELECT grp, l_suppkey, {agg} AS estimate FROM e GROUP BY 1, 2"


def _hydra_frequency(spark, sf, signed):
    key = integer_key(F.col("l_suppkey"))
    state = S.merge_cells(_gridded(S.matrix(_by_labels(spark, sf), key, 3, 64, signed, by=LABELS)), ["gr", "gc"])
    e = S.estimate(state, _asked(spark, sf, "l_suppkey"), key, 3, 64, signed, by=["gr", "gc"])
    return e.groupBy("grp", "l_suppkey").agg((F.element_at(F.sort_array(F.collect_list("estimate")), 2) if signed else F.min("estimate")).alias("estimate"))


@query(_hydra_frequency_sql(False))
def hydra_cms(spark, sf):
    return _hydra_frequency(spark, sf, False)


@query(_hydra_frequency_sql(True))
def hydra_cs(spark, sf):
    return _hydra_frequency(spark, sf, True)


@query(f"WITH {_GRID}, {registers_sql('g1', 'gridded', 'l_suppkey', 6, 'gr, gc')}, e AS ({classic_sql('g1', 6, 'gr, gc')}) SELECT grp, round(min(estimate), 6) AS estimate FROM asked JOIN e USING (gr, gc) GROUP BY 1")
def hydra_hll(spark, sf):
    regs = _gridded(S.registers(_by_labels(spark, sf), integer_key(F.col("l_suppkey")), 6, by=LABELS)).groupBy("gr", "gc", "b").agg(F.max("m").alias("m"))
    e = S.hll_estimate(regs, 6, by=["gr", "gc"])
    return _asked(spark, sf).join(e, ["gr", "gc"]).groupBy("grp").agg(F.round(F.min("estimate"), 6).alias("estimate"))


@query(f"WITH {_GRID}, {univmon_sql('gridded', 'l_partkey', 'w', 'gr, gc')} SELECT grp, {', '.join(f'round(list_sort(list({c}))[2], 6) AS {c}' for c in ('cardinality', 'l1', 'l2', 'entropy'))} FROM asked JOIN u USING (gr, gc) GROUP BY 1")
def hydra_univmon(spark, sf):
    """Cardinality, l1 (the sum), l2 and entropy of each subset's keyed weights: the median over the grid's rows."""
    sums = _by_labels(spark, sf).groupBy(*LABELS, "l_partkey").agg(F.sum("w").alias("w"))
    # dealt by key before they are fanned out, so that grid cells add up where they are
    u = S.univmon(_gridded(sums.repartition("l_partkey")), "l_partkey", "w", **_UM, by=["gr", "gc"])
    median = lambda c: F.round(F.element_at(F.sort_array(F.collect_list(c)), 2), 6).alias(c)
    return _asked(spark, sf).join(u, ["gr", "gc"]).groupBy("grp").agg(*[median(c) for c in ("cardinality", "l1", "l2", "entropy")])


@query(f"WITH {_FAN}, c AS (SELECT fan.*, r, {cw('g', 'r', 60)} % 32 AS c FROM fan, {rows_of(3)}), {registers_sql('g1', 'c', 'l_suppkey', 6, 'r, c')}, e AS ({classic_sql('g1', 6, 'r, c')}) SELECT grp, round(min(estimate), 6) AS estimate FROM (SELECT DISTINCT grp, r, c FROM c) JOIN e USING (r, c) GROUP BY 1")
def count_min_hll(spark, sf):
    """A Count-Min matrix whose cells are HyperLogLog registers."""
    regs = _gridded(S.registers(_by_labels(spark, sf), integer_key(F.col("l_suppkey")), 6, by=LABELS), 3, 32).groupBy("gr", "gc", "b").agg(F.max("m").alias("m"))
    e = S.hll_estimate(regs, 6, by=["gr", "gc"])
    return _asked(spark, sf, rows=3, cols=32).join(e, ["gr", "gc"]).groupBy("grp").agg(F.round(F.min("estimate"), 6).alias("estimate"))


# -- heaps in one pass ---------------------------------------------------------------------------------------------

_WORDS = "(SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents)"


@query(f"SELECT word, count(*) AS n, true AS bounded FROM {_WORDS} GROUP BY word ORDER BY n DESC, word LIMIT 32")
def heap_topk_words(spark, sf):
    """The 32 most frequent words of all texts: heaps of 256 beside 3 x 4,096 cells in one pass, then a count of the words held by some task alone.

    bounded: the estimate is no less than the count, and more by 3 e / 4096 of all words at most.
    """
    words = table(spark, sf, "documents").select(F.explode(F.expr("regexp_extract_all(lower(coalesce(text, '')), '[a-z]+', 0)")).alias("word"))
    key = integer_key(F.col("word"), text=True)
    cells, held = H.heaped(words, "word", key, 3, 4096, 256)
    estimates = S.estimate(cells, held, key, 3, 4096)
    # at most 256 words from each task
    n = words.join(F.broadcast(held), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = cells.filter("r = 0").agg(F.sum("n").alias("_all"))
    both = n.join(estimates, "word").crossJoin(F.broadcast(total))  # one row
    over = F.col("estimate") - F.col("n")
    return both.select("word", "n", ((over >= 0) & (over <= 3 * 2.718281828 / 4096 * F.col("_all"))).alias("bounded")).orderBy(F.desc("n"), "word").limit(32)


@query(f"WITH {cells_sql('m', 'lineitem', 'l_suppkey', 5, 1024, True)} SELECT r, c::INT AS c, n FROM m WHERE n <> 0")
def heap_cells(spark, sf):
    """The cells that the one pass leaves are those of the whole stream."""
    df = table(spark, sf, "lineitem").select("l_suppkey")
    return H.heaped(df, "l_suppkey", integer_key(F.col("l_suppkey")), 5, 1024, 64, True)[0].filter("n <> 0")
