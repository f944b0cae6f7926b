"""The thin queries over the operators of this subpackage, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import audit, damaged, digests, repaired
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .lm_score import score_documents
from .mixing import mix_sources
from .prefix_tree import join_components
from .secrets import scan_secrets
from .session import fresh_path, save
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .token_files import describe_token_files, write_token_files
from .top_search import search
from .toxicity import score_toxicity, train
from .vector_codes import books_digest, compress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("sha256", "text_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    # the ledger adds no kinds of its own, so all spans are base spans
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer())
    return describe_token_files(spark, path)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    report = save(audit(rows), "conversation-report")
    texts = digests(repaired(rows, report)).withColumnRenamed("conv_id", "of")
    return report.join(texts, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*report.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_toxicity, op3_token_counts, op4_mix_sources, op5_exact_dedup, op6_jaccard_join,
        op7_secret_scan, op8_token_files, op9_decontaminate, op10_substring_dedup, op11_vector_codes, op12_repair_conversations,
        op13_top_search,
    )
}

ORACLES = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d
    """,
    "op4_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, [0.5, 1.5, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS a, source_size * 2.0::DOUBLE AS most FROM s),
        t AS (SELECT *, least(sum(source_size) OVER () * 1.5::DOUBLE, sum(most) OVER ()) AS total,
                     coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                     sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
        u AS (SELECT *, (total - below) / open AS level FROM t),
        v AS (SELECT *, (SELECT level FROM u WHERE level * weight < most ORDER BY most / weight, source NULLS LAST LIMIT 1) AS fill FROM u),
        g AS (SELECT source, source_size, a, least(most, coalesce(fill * weight, most)) AS target FROM v),
        r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.a, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS ahead
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS rounds FROM r),
        p AS (SELECT *, (rounds * size + greatest(0, least(size, floor(target)::BIGINT - rounds * source_size - ahead)))::BIGINT AS taken, CASE WHEN target > 0 THEN least(1.0::DOUBLE, ahead / target) ELSE 0 END AS share FROM q)
        SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE WHEN a = 1 THEN share ELSE (sqrt(a * a + 4 * (1 - a) * share) - a) / (2 * (1 - a)) END, 6) + 0.0::DOUBLE END AS position FROM p
    """,
    "op9_decontaminate": r"""
        WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x20\x09-\x0D]+') AS w FROM documents, low),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x20\x09-\x0D]+') AS w FROM benchmark, low),
        ds AS (SELECT DISTINCT doc_id, unnest([list_aggregate(w[i:i + 4], 'string_agg', ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM d WHERE len(w) > 0),
        bs AS (SELECT DISTINCT item_id, unnest([list_aggregate(w[i:i + 4], 'string_agg', ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM b WHERE len(w) > 0),
        n AS (SELECT item_id, count(*)::INT AS n_shingles FROM bs GROUP BY item_id),
        f AS (SELECT doc_id, item_id, count(*)::INT AS n_found FROM ds JOIN bs USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
        FROM f JOIN n USING (item_id) WHERE n_found >= 0.75 * n_shingles
    """,
    "op11_vector_codes": r"""
        WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT max(len(e)) // 16 AS w FROM k),
        x AS (SELECT id, vec_id, part, e[part * w + 1 : part * w + w] AS v FROM k, s, range(16) t(part)),
        b0 AS (SELECT part, id - 1 AS entry, v FROM x WHERE id <= 64),
        d0 AS (SELECT x.id, x.vec_id, x.part, b.entry, x.v, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b0 b USING (part)),
        a0 AS (SELECT * FROM d0 QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1),
        m0 AS (SELECT part, entry, place, floor(sum(v[place])::DOUBLE / count(*))::BIGINT AS c FROM a0, range(1, (SELECT w FROM s) + 1) t(place) GROUP BY ALL),
        b1 AS (SELECT part, entry, coalesce(n.v, b.v) AS v FROM b0 b LEFT JOIN (SELECT part, entry, list(c ORDER BY place) AS v FROM m0 GROUP BY ALL) n USING (part, entry)),
        d1 AS (SELECT x.id, x.vec_id, x.part, b.entry, x.v, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b1 b USING (part)),
        a1 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1),
        m1 AS (SELECT part, entry, place, floor(sum(v[place])::DOUBLE / count(*))::BIGINT AS c FROM a1, range(1, (SELECT w FROM s) + 1) t(place) GROUP BY ALL),
        b2 AS (SELECT part, entry, coalesce(n.v, b.v) AS v FROM b1 b LEFT JOIN (SELECT part, entry, list(c ORDER BY place) AS v FROM m1 GROUP BY ALL) n USING (part, entry)),
        d2 AS (SELECT x.id, x.vec_id, x.part, b.entry, x.v, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b2 b USING (part)),
        a2 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1),
        r AS (SELECT id, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY id),
        h AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (id), h
    """,
    "op13_top_search": """
        WITH k AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM k q JOIN k c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
}
