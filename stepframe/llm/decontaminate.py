"""Benchmark decontamination: rare n-gram seeds pair passages with test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.words import join_hashes, word_windows
from stepframe.sizing import cut_lineage

_byte = np.arange(256)
IN_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
MATCH, MISMATCH, GAP = 2, -1, -1
SCHEMA = "doc_id long, item_id long, first_word long, end_word long, score double"


def _values(column: pa.Array) -> list[np.ndarray]:
    """The word hashes of each value; punctuation separates words, A-Z count as a-z."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for w in word_windows(column, IN_WORD):
        hashes = w.hashes()
        for i in range(w.first, w.end):
            out[i].append(hashes[w.bounds[i - w.first]:w.bounds[i - w.first + 1]])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score of a against b, and where it ends in each (exclusive).

    One pass per word of a; gaps along b follow from a running maximum.
    """
    n = len(b)
    steps = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, at, end = 0, 0, 0
    for i, word in enumerate(a):
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        top = int(new.argmax())
        if new[top] > best:
            best, at, end = int(new[top]), i + 1, top
        row = new
    return best, at, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score over that of an exact copy, first word, end word in the passage) of the best local alignment."""
    best, at, end = _best_end(item, passage)
    if not best:
        return 0.0, 0, 0
    _, _, back = _best_end(item[:at][::-1], passage[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def _occurrences(vocabulary: np.ndarray):
    """How often each word of the benchmark, and any word, occurs in a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for w in word_windows(batch.column(0), IN_WORD):
                hashes = w.hashes()
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                counts[:-1] += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
                counts[-1] += len(hashes)
                words += len(hashes)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["word", "n"])

    return run


def _search(ids: list[int], items: list[np.ndarray], seeds: np.ndarray, owner: np.ndarray, place: np.ndarray, width: int, least: float):
    """seeds: sorted hashes of n-grams, each with its item and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, int, float]] = []
            for i, words in enumerate(_values(batch.column(1))):
                grams = join_hashes(words, width)
                low, high = np.searchsorted(seeds, grams, "left"), np.searchsorted(seeds, grams, "right")
                hits = np.flatnonzero(high > low)
                if not len(hits):
                    continue
                n = (high - low)[hits]
                at = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                start, item = np.repeat(hits, n) - place[at], owner[at]
                order = np.lexsort((start, item))
                start, item = start[order], item[order]
                sizes = np.array([len(items[k]) for k in item.tolist()])
                # Hits whose diagonals lie within an item's length of each other are one passage.
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] > sizes[1:])
                best: dict[int, tuple[float, int, int]] = {}
                edges = np.append(np.flatnonzero(new), len(item))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    k, size = int(item[a]), int(sizes[a])
                    left = max(0, int(start[a]) - size // 2)
                    passage = words[left:int(start[b - 1]) + size + size // 2 + 1]
                    score, first, end = align(items[k], passage)
                    if score >= least and (k not in best or (score, -left - first) > (best[k][0], -best[k][1])):
                        best[k] = (score, left + first, left + end)
                found += [(i, ids[k], first, end, score) for k, (score, first, end) in sorted(best.items())]
            rows = [list(x) for x in zip(*found)] if found else [[]] * 5
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(x, pa.int64()) for x in rows[1:4]], pa.array(rows[4], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "end_word", "score"])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", width: int = 4, least: float = 0.5, by_chance: float = 0.1, seeds_kept: int = 8, words_per_block: int = 1 << 19,
) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, score): passages of documents that copy a test item, edited or not.

    Every document is searched for the n-grams of `width` words of every item that are rare: those that its words'
    frequencies in all documents would bring about fewer than `by_chance` times in the whole corpus, and in any case
    the item's `seeds_kept` rarest. How often the n-gram itself occurs says nothing here, for a leaked item may be in a
    third of all documents. Around the seeds the passage is aligned with the item; kept are alignments with at least
    `least` of the score of an exact copy, the best one per document and item (the first of equals).

    The benchmark goes to the tasks in blocks of about `words_per_block` words, one search per block, so what is sent to
    a task has a fixed size. Items with fewer than `width` words, null or empty ones have no seeds and match nothing.
    Null and empty documents match nothing; null ids are returned as they are; items with equal texts all match.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("text is not null")
    given = cut_lineage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null"))
    size = given.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = -(-size // words_per_block)
    found = [spark.createDataFrame([], SCHEMA)]
    for block in range(blocks):
        own = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        items = _values(own.column("text").combine_chunks()) if own.num_rows else []
        rows = [(k, p) for k, x in enumerate(items) for p in range(len(x) - width + 1)]
        if not rows:
            continue
        vocabulary = np.unique(np.concatenate(items))
        counts = texts.select("text").mapInArrow(_occurrences(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        seen = np.zeros(len(vocabulary) + 1)
        for r in counts.collect():
            seen[r.word] = r.n
        total = max(seen[-1], 1.0)
        log_chance = np.log(np.maximum(seen[:-1], 0.5) / total)
        keep, keys = [], []
        for k, x in enumerate(items):
            if len(x) < width:
                continue
            each = log_chance[np.searchsorted(vocabulary, x)]
            expected = np.log(total) + np.convolve(each, np.ones(width), "valid")
            rank = np.empty(len(expected), int)
            rank[np.argsort(expected, kind="stable")] = np.arange(len(expected))
            chosen = np.flatnonzero((expected < np.log(by_chance)) | (rank < seeds_kept))
            keep += [(k, int(p)) for p in chosen]
            keys.append(join_hashes(x, width)[chosen])
        seeds = np.concatenate(keys)
        order = np.argsort(seeds, kind="stable")
        owner, place = np.array(keep)[order].T
        search = _search(own.column("item_id").to_pylist(), items, seeds[order], owner, place, width, least)
        found.append(texts.mapInArrow(search, SCHEMA))
    return reduce(DataFrame.unionByName, found)
