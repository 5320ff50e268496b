"""The registered queries of the operators in this folder: opN_<name>, and their SQL counterparts where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.llm import conversations, decontaminate, html_text, langid, lines, minhash, packing, quality, sharding, substrings, topk, toxicity, whitening
from stepframe.plans.catalog import table
from stepframe.sizing import cut_lineage


def tokenizer_file() -> str:
    """The byte-level BPE file; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedupe_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_lineage(packing.pieces(table(spark, folder, "documents"), tokenizer_file()))
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(slim, "length", ["doc_id", "piece", "start", "ids_crc32"])


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH sound AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(table(spark, folder, "documents"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.fit(docs, learn=_fold(4) != 2))
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs, labels, learn=_fold(5) != 0)
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit(vectors)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = whitening.whiten(vectors, model)
    error = whitening.identity_error(out, len(model.eigenvalues))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    long = out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "value"))
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
                       F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, folder, "conversations"))


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLES: dict[str, str] = {"op5_exact_top_k": OP5_SQL}
