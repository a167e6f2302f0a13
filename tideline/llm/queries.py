"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, caps, decontam, jaccard, lang_id, main_text, pii, repeats, secret_scan, shards


def tokenizer() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_spans(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(docs: DataFrame, *more: str) -> DataFrame:
    """Ids, decoded again, as digests; more columns of the documents follow."""
    path, pattern = tokenizer()
    out = bpe.encode(docs, path, pattern, keys=("doc_id", *more), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hashed(F.col("decoded")).alias("decoded_sha256"), *more)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"), *tokenizer())
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("assign", "access", "hex")), hashed(written_spans("base_spans")).alias("base_sha256"), written_spans("spans").alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = lang_id.fit(docs, ~held_out)
    return lang_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", hashed(F.array_join("items", ",")).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), hashed(F.col("kept")).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.links(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("email", "ip", "card", "phone")), hashed(written_spans("base_spans")).alias("base_sha256"), written_spans("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_secret_scan, op3_decontamination, op4_ngram_jaccard, op5_sharding, op6_language_id, op7_main_text, op8_suffix_dedup, op9_embedding_dedup, op10_pii)}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
_REACH = "r(a, b) AS (SELECT {id}, {id} FROM {t} UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"

#: SQL for what SQL can say; tests/llm holds the other queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM i, LATERAL unnest(range(1, len(w) - n + 2)) AS t(p)),
places AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM windows) AS k, LATERAL unnest(range(1, len(w) - n + 2)) AS t(p)),
hits AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, LATERAL unnest(range(p, p + n)) AS t(q) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_ngram_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_REACH.format(id="doc_id", t="documents")}
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)""",
    "op9_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH.format(id="vec_id", t="v")},
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (vec_id)""",
}
