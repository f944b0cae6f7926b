"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import bounded, save

#: A word: what separates words is space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """sizes(source, source_size) -> with weight and target, one row for each source.

    Weights repeat along the sources in code point order, null last. The
    targets share ``budget`` times all sizes by weight; none exceeds ``cap``
    times its source's size: the excess is shared by weight among the others
    until none is above. That end state is found at once: with sources in
    ascending order of cap / weight, those before the first one whose cap is
    not reached are at their caps. The windows run over one row for each
    source, not over documents.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    everywhere = W.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap))
    s = s.withColumn("total", F.least(F.sum("source_size").over(everywhere) * float(budget), F.sum("most").over(everywhere)))
    by_fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("below", F.coalesce(F.sum("most").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
    # the level at the first source that stays under its cap; if all are at their caps, any level above them
    s = s.withColumn("fill", F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everywhere)["level"])
    return s.select("source", "source_size", "weight", F.least(F.col("most"), F.coalesce(F.col("fill") * F.col("weight"), F.col("most"))).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, digits: int) -> list[Column]:
    """Light columns: the document's order within its source, and its size."""
    text = docs[text_col].cast("string")
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    # documents without an id are in the order of their texts, so that they are no bucket of their own
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("-"), F.xxhash64(text).cast("string"))))
    # a source and bucket is one string key, so that the null source joins as any other
    source = F.when(docs[source_col].isNull(), "-").otherwise(F.concat(F.lit("+"), docs[source_col].cast("string")))
    size = F.when(docs[text_col].isNull(), F.lit(0)).otherwise(words).cast("long")
    return [c.alias(n) for n, c in {"__id": docs[id_col], "__source": docs[source_col], "__named": source, "__key": key, "__bucket": F.substring(key, 1, digits), "__size": size}.items()]


def _assigned(rows: DataFrame, weights: Sequence[float], budget: float, cap: float, ramp: Sequence[float]) -> DataFrame:
    """rows, which have the columns of _sized, with __source_size, __target, __taken, __at (words of the source before
    it) and __a (the slope of its source's schedule)."""
    buckets = rows.groupBy(F.col("__source").alias("source"), "__named", "__bucket").agg(F.sum("__size").alias("words"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in ramp]), ((order - 1) % len(ramp) + 1).cast("int"))
    named = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("__named")
    targets = targets.select(named, F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), slope.alias("__a"))
    before = F.sum("words").over(W.partitionBy("__named").orderBy("__bucket")) - F.col("words")
    starts = buckets.select("__named", "__bucket", before.alias("__before")).join(targets, "__named")
    within = F.sum("__size").over(W.partitionBy("__named", "__bucket").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")
    rows = rows.withColumn("__within", within).join(starts, ["__named", "__bucket"]).withColumn("__at", F.col("__before") + F.col("__within"))
    goal, whole = F.floor("__target"), F.col("__source_size")
    # full rounds over the source, then what is left of the last round reaches up to goal % source_size
    rounds = F.when(whole > 0, F.floor(goal / whole)).otherwise(0)
    rest = goal - rounds * whole
    return rows.withColumn("__taken", (rounds * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__at")))).cast("long"))


def _position(demand: Column) -> Column:
    """The training time 0..1 at which the source's schedule has asked for ``demand`` words.

    The schedule's integral up to t is the share a * t + (1 - a) * t * t of the target.
    """
    a, share = F.col("__a"), F.when(F.col("__target") > 0, F.least(F.lit(1.0), demand / F.col("__target"))).otherwise(0.0)
    return F.when(a == 1.0, share).otherwise((F.sqrt(a * a + 4 * (1 - a) * share) - a) / (2 * (1 - a)))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, ramp: Sequence[float] = (0.5, 1.5, 1.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_digits: int = 3) -> DataFrame:
    """One row for each row of ``docs``, range-sorted by training position.

    Columns: id, size (words), source, source_size, target, taken (words the
    mix takes, repeats counted), position (0 to 1; null when nothing is taken).

    A source's weight runs linearly from w * a to w * (2 - a) over training
    time 0..1, with ``a`` from ``ramp``, repeating along the sources; its
    integral is w, so shares are those of the weights. The source's documents,
    in the order of md5(id), are laid end to end, again and again, up to the
    target; a document takes what lies below it, so taken words add up to the
    target rounded down, and only one document of a source is taken in part. The
    words of a source before a document are its demand; the inverse of the
    integrated schedule at that demand is the document's position.

    The running sums never gather a source in one task: documents are summed
    by the first ``bucket_digits`` hex digits of md5(id), those sums run over at
    most 16 ** bucket_digits rows for each source, and the documents run only
    within their bucket. Null text: size 0, taken 0. A null source is a source,
    the last. Null ids are in the order of a hash of their texts; rows that tie in
    all of this share the outcome in either order. An empty table gives an empty
    result. Other columns are not looked at.
    """
    sized = save(docs.select(*_sized(docs, id_col, text_col, source_col, bucket_digits)), "mix-sizes")
    rows = _assigned(sized, weights, budget, cap, ramp)
    out = rows.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source").alias("source"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), F.when(F.col("__taken") > 0, _position(F.col("__at"))).alias("position"))
    out = save(out, "mix-taken")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col(id_col)).sortWithinPartitions(F.col("position").asc_nulls_last(), id_col)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, ramp: Sequence[float] = (0.5, 1.5, 1.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_digits: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs``, with their columns, in training order, each as often as it is taken.

    As mix_sources, but in whole documents: the one of each source that is taken
    in part is there if half of it or more is taken. The running sums are over
    light columns; what they assign goes back to rows by two hashes of all
    columns, as a broadcast while rows are few (``BROADCAST_ROWS``). Rows that
    repeat in all columns share what is assigned to any of them. Texts move once,
    for the order, and once more where the assignment is too large to broadcast.

    Null and empty texts have no words and are never taken. A null source is a
    source, the last; null ids are in the order of their texts. An empty table
    gives an empty result. Columns of any name and type are kept as they are.
    """
    light = _sized(docs, id_col, text_col, source_col, bucket_digits)
    values = [docs[c] for c in docs.columns]
    # maps have no hash of their own
    plain = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields]
    marked = [*plain, *[c.isNull() for c in values]]
    row = F.struct(F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)).alias("__row")
    plan = _assigned(save(docs.select(row, *light), "mix-sizes"), weights, budget, cap, ramp)
    copies = F.floor(F.col("__taken") / F.col("__size") + 0.5).cast("int")
    plan = plan.filter("__taken > 0").withColumn("__copies", copies).filter("__copies > 0")
    plan = save(plan.select("__row", "__key", "__copies", "__source_size", "__target", "__at", "__a"), "mix-plan")
    again = save(plan.groupBy("__row").count().filter("count > 1").select("__row"), "mix-repeats")
    whole = docs.select(row, F.struct(*values).alias("__doc"))
    if not again.isEmpty():
        again = bounded(again)
        whole = whole.join(again, "__row", "left_anti").union(whole.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    rows = whole.join(bounded(plan), "__row").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    rows = rows.select("__doc", "__key", _position(F.col("__copy") * F.col("__source_size") + F.col("__at")).alias("__position"))
    return rows.repartitionByRange("__position", "__key").sortWithinPartitions("__position", "__key").select("__doc.*")
