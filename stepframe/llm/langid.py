"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.sizing import cut_lineage

ORDER = 4
WINDOW = 1 << 19
UNKNOWN = "und"


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """The last `length` bytes up to each place as a number; earlier bytes count as 0."""
    key = data.astype(np.int64)
    for back in range(1, length):
        key[back:] += data[:-back].astype(np.int64) << (8 * back) if len(data) > back else 0
    return key


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ORDER zero bytes before each, and the places of the real bytes' ends."""
    gap = b"\0" * ORDER
    data = np.frombuffer(b"".join(gap + x for x in texts), np.uint8)
    return data, np.cumsum([len(x) + ORDER for x in texts])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language how often each string of 1 to ORDER + 1 bytes occurs in (lang, text)."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = [(x or "").lower().encode() for x in batch.column(1).to_pylist()]
        for lang in sorted(set(langs)):
            data, ends = _padded([x for x, own in zip(texts, langs) if own == lang])
            real = np.ones(len(data), bool)
            for start in [0, *ends[:-1].tolist()]:
                real[start:start + ORDER] = False
            for length in range(1, ORDER + 2):
                keys, counts = np.unique(_grams(data, length)[real], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), pa.array(counts)], names=["lang", "length", "gram", "n"])


class _Table:
    """Rows of numbers by a 64-bit key, found for many keys at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._slots, self._row = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.rows = rows
        left, at = np.arange(len(keys)), self._spot(keys)
        while len(left):
            free = self._slots[at] < 0
            self._slots[at[free]] = keys[left[free]]
            done = self._slots[at] == keys[left]
            self._row[at[done]] = left[done]
            left, at = left[~done], (at[~done] + 1) & (len(self._slots) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._spot(keys)
        seen = self._slots[at]
        found = np.where(seen == keys, self._row[at], -1)
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self._slots) - 1)
            seen = self._slots[at]
            hit = seen == keys[rest]
            found[rest[hit]] = self._row[at[hit]]
            go = ~hit & (seen >= 0)
            rest, at = rest[go], at[go]
        return found


class Model:
    """Code lengths in bits per language of a byte after its context of up to ORDER bytes (escape method C).

    A byte seen after the longest known context costs -log2(n / (total + distinct)); an unseen one costs the escape
    -log2(distinct / (total + distinct)) and is coded after the context without its first byte; after none, 8 bits.
    An unknown context costs nothing. The statistics don't change while a text is coded.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, length: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        width = len(langs)
        self._coded: list[_Table] = []
        self._escape: list[_Table] = []
        for k in range(1, ORDER + 2):
            own = length == k
            keys, row = np.unique(gram[own], return_inverse=True)
            counts = np.zeros((len(keys), width))
            np.add.at(counts, (row, lang[own]), n[own])
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, counts)
            np.add.at(distinct, of, counts > 0)
            whole = np.maximum(total + distinct, 1)
            escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / whole), 0.0)
            shorter = self._shorter(keys, k)
            bits = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / whole[of]), escape[of] + shorter)
            self._coded.append(_Table(keys, bits.astype(np.float32)))
            self._escape.append(_Table(contexts, escape.astype(np.float32)))

    def _shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last byte of k-byte grams after contexts of at most k - 2 bytes."""
        if k == 1:
            return np.full((len(keys), len(self.langs)), 8.0)
        return self.bits(self._drop_first(keys, k), k - 1)

    @staticmethod
    def _drop_first(keys: np.ndarray, k: int) -> np.ndarray:
        return keys & ((1 << (8 * (k - 1))) - 1)

    def bits(self, keys: np.ndarray, k: int = ORDER + 1) -> np.ndarray:
        """One row per k-byte gram: the cost of its last byte in each language."""
        if k == 0 or not self._coded:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        table = self._coded[k - 1]
        at = table.find(keys)
        out = table.rows[at] if len(table.rows) else np.zeros((len(keys), len(self.langs)), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = keys[missing]
            escapes = self._escape[k - 1]
            context = escapes.find(lost >> 8)
            cost = np.where((context >= 0)[:, None], escapes.rows[context] if len(escapes.rows) else 0.0, 0.0)
            out[missing] = cost + (self.bits(self._drop_first(lost, k), k - 1) if k > 1 else 8.0)
        return out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total = np.zeros((len(texts), len(model.langs)))
            letters = np.array([any(map(str.isalpha, x or "")) for x in texts], bool)
            parts: list[tuple[int, bytes, bytes]] = []
            size = 0

            def flush() -> None:
                data = np.frombuffer(b"".join(before + x for _, before, x in parts), np.uint8)
                costs = model.bits(_grams(data, ORDER + 1))
                at = 0
                for i, before, x in parts:
                    total[i] += costs[at + len(before):at + len(before) + len(x)].sum(axis=0, dtype=np.float64)
                    at += len(before) + len(x)
                parts.clear()

            for i, text in enumerate(texts):
                if not letters[i]:
                    continue
                data, before = text.lower().encode(), b"\0" * ORDER
                for low in range(0, len(data), WINDOW):
                    part = data[low:low + WINDOW]
                    parts.append((i, before, part))
                    before = (before + part)[-ORDER:]
                    size += len(part)
                    if size >= WINDOW:
                        flush()
                        size = 0
            if parts:
                flush()
            if model.langs:
                best = total.argmin(axis=1)
                more = np.minimum(total - total.min(axis=1, keepdims=True), 1000.0)
                sure = 1 / np.exp2(-more).sum(axis=1)
                known = letters
            else:
                best, sure, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, sure, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, learn: Column, per_language: int = 300) -> Model:
    """Counts from whole texts of at most `per_language` documents of each language for which `learn` holds.

    Which ones follows from the hash of the id, so the model, its strings and its size depend on the languages and the
    bound alone and not on the number of documents.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    slim = known.select(F.col("lang").alias("language"), "doc_id", F.xxhash64("doc_id").alias("h"))
    # The smallest hashes of each language: a ranked filter that every task applies before rows are sent on.
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy("h", "doc_id"))).where(F.col("r") <= per_language)
    picked = cut_lineage(ranked.select("language", "doc_id").distinct())
    texts = known.join(F.broadcast(picked), "doc_id").where(F.col("lang") == F.col("language")).select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").unique().to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    own = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
    return Model(langs, own, *[table.column(c).to_numpy().astype(np.int64) for c in ("length", "gram", "n")])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the language whose model codes the whole text shortest; its probability among them all.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to the first language by
    name. Ids may be null or repeated; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
