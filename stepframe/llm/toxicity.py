"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.llm.words import hash_words, join_hashes, word_windows
from stepframe.sizing import cut_lineage

# Forms of address in the second person.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vos vosotros os"
)

_byte = np.arange(256)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_UPPER = (_byte >= 65) & (_byte <= 90)
_ASCII_LETTER = _UPPER | ((_byte >= 97) & (_byte <= 122))
LETTERS = _ASCII_LETTER | (_byte >= 128)
_MASKING = np.isin(_byte, list(b"@$*#0123456789_"))
_MARK = np.isin(_byte, list(b"!?"))
STEMS = (None, 4, 5, 6)
FEATURES = (
    "lexicon_rate", "lexicon_weight_rate", "lexicon_most", "lexicon_count", "near_second_person_rate", "second_person_rate", "capital_rate", "shouted_word_rate",
    "exclamation_rate", "question_rate", "mark_run_rate", "masked_rate", "digit_rate", "log_words", "word_length",
)


def _pronouns() -> np.ndarray:
    words = pa.array([" ".join(SECOND_PERSON.split())])
    return np.unique(np.concatenate([w.hashes() for w in word_windows(words, LETTERS)]))


def _member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value among the keys, -1 if it is none of them."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (toxic, text): in how many toxic and other texts each word or word stem occurs."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        pairs = []
        for w in word_windows(batch.column(1), LETTERS):
            owner = np.repeat(np.arange(w.first, w.end), np.diff(w.bounds))
            for longest in STEMS:
                pairs.append(np.stack([owner.astype(np.uint64), w.hashes(longest) ^ np.uint64(longest or 0)]))
        if not pairs:
            continue
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        terms, where = np.unique(both[1], return_inverse=True)
        bad = np.bincount(where, weights=toxic[both[0].astype(np.int64)], minlength=len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(np.bincount(where, minlength=len(terms)) - bad)], names=["term", "bad", "good"])


def _features(lexicon: list[tuple[int, float]]):
    keys = np.array([k for k, _ in lexicon], np.int64).view(np.uint64)
    weights = np.array([v for _, v in lexicon])
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pronouns = _pronouns()
        for batch in batches:
            n = batch.num_rows
            sums = {k: np.zeros(n) for k in ("words", "hits", "weight", "most", "near", "you", "upper", "letters", "shout", "excl", "ques", "runs", "masked", "digits", "bytes")}
            for w in word_windows(batch.column(1), LETTERS):
                rows = w.end - w.first
                owner = np.repeat(np.arange(rows), np.diff(w.bounds))

                def add(name: str, values: np.ndarray) -> None:
                    sums[name][w.first:w.end] += np.bincount(owner, weights=values, minlength=rows)

                value = np.zeros(len(owner))
                for longest in STEMS:
                    at = _member(keys, w.hashes(longest) ^ np.uint64(longest or 0))
                    value = np.maximum(value, np.where(at >= 0, weights[at] if len(weights) else 0.0, 0.0))
                hit, you = value > 0, _member(pronouns, w.hashes()) >= 0
                spots = np.flatnonzero(you)
                gap = np.full(len(owner), 99)
                if len(spots):
                    k = np.searchsorted(spots, np.arange(len(owner)))
                    for side in (np.clip(k - 1, 0, None), np.clip(k, None, len(spots) - 1)):
                        other = spots[side]
                        gap = np.minimum(gap, np.where(owner[other] == owner, np.abs(other - np.arange(len(owner))), 99))
                length = w.stop - w.start
                upper = np.concatenate([[0], np.cumsum(_UPPER[w.raw])])
                shout = (upper[w.stop] - upper[w.start] == length) & (length > 2)
                for name, values in (("words", np.ones(len(owner))), ("hits", hit), ("weight", value), ("near", hit & (gap <= 5)), ("you", you), ("shout", shout), ("letters", length)):
                    add(name, values)
                np.maximum.at(sums["most"], owner + w.first, value)
                left, right = np.zeros(len(w.raw), bool), np.zeros(len(w.raw), bool)
                if len(w.raw) > 2:
                    left[1:], right[:-1] = LETTERS[w.raw[:-1]], LETTERS[w.raw[1:]]
                mark = _MARK[w.raw]
                repeated = mark.copy()
                repeated[1:] &= mark[:-1]
                repeated[:1] = False
                for name, flags in (("upper", _UPPER[w.raw]), ("excl", w.raw == 33), ("ques", w.raw == 63), ("runs", repeated), ("masked", _MASKING[w.raw] & left & right), ("digits", _DIGIT[w.raw]), ("bytes", np.ones(len(w.raw), bool))):
                    total = np.concatenate([[0], np.cumsum(flags)])
                    sums[name][w.first:w.end] += np.diff(total[w.edges])
            words, size = np.maximum(sums["words"], 1), np.maximum(sums["bytes"], 1)
            letters = np.maximum(sums["letters"], 1)
            table = np.stack([
                sums["hits"] / words, sums["weight"] / words, sums["most"], np.log1p(sums["hits"]), sums["near"] / words, sums["you"] / words, sums["upper"] / letters, sums["shout"] / words,
                sums["excl"] / size, sums["ques"] / size, sums["runs"] / size, sums["masked"] / words, sums["digits"] / size, np.log1p(sums["words"]), sums["letters"] / words], axis=1)
            flat = pa.array(table.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(FEATURES)), flat)], names=["doc_id", "features"])

    return run


def _first_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a run of five words, which most near copies have in common."""
    for batch in batches:
        words, counts = hash_words(batch.column(2))
        ends = np.cumsum(counts)
        low = [int(join_hashes(words[e - n:e], min(5, int(n))).min().view(np.int64)) if n else None for n, e in zip(counts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64())], names=[*batch.schema.names, "group"])


def sample_labels(labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, toxic): of each class at most `per_class` documents for which `learn` holds, those with the smallest hashes."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    return picked[0].unionByName(picked[1])


def score(
    docs: DataFrame, labels: DataFrame, learn: Column, text_column: str = "text", per_class: int = 20_000, lexicon_size: int = 4_000, trees: int = 20, depth: int = 3,
) -> DataFrame:
    """(doc_id, score, predicted): how likely each whole text has label 1.

    Learning takes at most `per_class` labelled documents of each class (a bound of the fit, not of the scores). Half
    of them give a lexicon: words and word stems of 4, 5 and 6 bytes that are much more frequent in toxic texts,
    counted once per group of near copies. A quarter fits the trees and a quarter the calibration, so neither sees the
    texts the lexicon is from. Features: densities of the lexicon, its hits near the second person, capitals, marks and
    signs inside words. Null and empty texts have all rates 0 and get a score. A null id is scored; a repeated id in
    `labels` counts once, toxic if one row says so. Without labels of both classes every score is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sample = cut_lineage(sample_labels(labels.select("doc_id", "toxic"), learn, per_class).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4))))
    if sample.select("toxic").distinct().count() < 2:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    # The sample has at most 2 * per_class rows of two numbers.
    texts = rows.join(F.broadcast(sample.where("part < 2")), "doc_id").select("doc_id", "toxic", "text")
    texts = texts.mapInArrow(_first_shingle, "doc_id long, toxic int, text string, group long")
    one = Window.partitionBy("group", "toxic").orderBy("doc_id")
    texts = texts.withColumn("copy", F.row_number().over(one)).where("copy = 1")
    texts = cut_lineage(texts.select(F.col("toxic").cast("boolean").alias("toxic"), "text"))
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    counts = texts.mapInArrow(_terms, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    lexicon = counts.where(F.col("bad") >= max(4, bad // 200)).withColumn("odds", odds).where("odds > 2").orderBy(F.desc("odds"), "term").limit(lexicon_size)
    features = cut_lineage(rows.mapInArrow(_features([(r.term, r.odds) for r in lexicon.collect()]), "doc_id long, features array<double>"))

    labelled = features.join(F.broadcast(sample.where("part >= 2")), "doc_id").select(F.col("toxic").cast("double").alias("label"), "part", array_to_vector("features").alias("features"))
    labelled = cut_lineage(labelled)
    fit = labelled.where("part = 2")
    if fit.select("label").distinct().count() < 2:
        fit = labelled
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, minInstancesPerNode=5, cacheNodeIds=False).fit(fit)

    def raw(frame: DataFrame, *keep: str) -> DataFrame:
        return model.transform(frame).select(*keep, F.round(vector_to_array("probability")[1], 3).alias("raw"))

    # Raw scores are rounded to thousandths: at most 1001 points for the calibration.
    points = raw(labelled.where("part = 3"), "label").groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight")).coalesce(1)
    if points.limit(1).count():
        steps = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(points)
        scored = steps.transform(raw(features.select("doc_id", array_to_vector("features").alias("features")), "doc_id")).withColumnRenamed("prediction", "value")
    else:
        scored = raw(features.select("doc_id", array_to_vector("features").alias("features")), "doc_id").withColumnRenamed("raw", "value")
    value = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
