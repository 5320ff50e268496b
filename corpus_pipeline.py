"""A training corpus from raw documents: quality, line dedup, near-duplicate documents, benchmark leaks, packing.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the docs of the next. All stages but the last return the columns of `documents`. No stage can be stated in SQL
over the raw tables (a trained model, tokenizer ids, a chain of decisions), so there is no ORACLE_SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.llm import decontaminate, lines, minhash, packing, quality
from stepframe.llm.queries import tokenizer_file
from stepframe.plans.catalog import table
from stepframe.sizing import cut_lineage, delete_scratch, scratch_paths

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left_behind: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the stage before it, whose result has been written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_scratch(spark, _left_behind)
        before = len(scratch_paths())
        result = stage(spark, docs, sf_dir)
        _left_behind[:] = scratch_paths()[before:]
        return result

    return run_stage


def row_key(docs: DataFrame) -> Column:
    """Tells documents apart: the id, or where any id has different texts, a hash of id and text. Null where the id is."""
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    if not texts.where("low < high").limit(1).count():
        return F.col("doc_id").cast("long")
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))


def free_name(docs: DataFrame) -> str:
    """A column name that no input column has."""
    return "row_" + "_" * max(len(c) for c in docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; equal rows share a decision."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    key = free_name(docs)
    rejected = judged.where(~F.col("kept")).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, quality.row_key()).join(rejected, key, "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document that loses all its words goes, an empty one stays.

    Rows that repeat an id with another text are documents of their own, in the order of their keys.
    """
    key = free_name(docs)
    apart = {c: key + c for c in ("n_lines", "n_removed")}
    left = lines.dedupe_lines(docs.withColumn(key, row_key(docs)).withColumnsRenamed(apart), id_column=key)
    left = left.where((F.col("n_removed") == 0) | (F.trim("text") != "")).drop(*apart).withColumnsRenamed({b: a for a, b in apart.items()})
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one of rows equal in id and text. Null ids stay.

    Rows that repeat an id with another text are documents of their own and go only for their own text.
    """
    key = free_name(docs)
    keyed = docs.withColumn(key, row_key(docs))
    found = cut_lineage(minhash.near_duplicates(keyed, id_column=key).where("doc_id is not null").select(F.col("doc_id").alias(key), "kept"))
    left = keyed.join(found.where("not kept").select(key).distinct(), key, "left_anti")
    if found.groupBy(key).count().where("count > 1").limit(1).count():
        left = left.where(F.col(key).isNull()).unionByName(left.where(F.col(key).isNotNull()).dropDuplicates([key]))
    return left.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item, edited or not."""
    key, name = F.xxhash64("doc_id", "text"), free_name(docs)
    leaks = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.withColumn(name, key).join(leaks.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place: (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset)."""
    pieces = packing.pieces(docs, tokenizer_file()).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(cut_lineage(pieces), "length", ["doc_id", "piece", "start", "ids_crc32"])


STAGES = [
    ("quality", tidy(keep_good)),
    ("line_dedup", tidy(drop_repeated_lines)),
    ("near_dedup", tidy(drop_near_duplicates)),
    ("decontamination", tidy(drop_benchmark_leaks)),
    ("packing", tidy(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
