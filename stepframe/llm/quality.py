"""Document quality: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.words import _BASE, _BASE_INVERSE, _JOIN, LOWER, mix, powers, utf8, windows
from stepframe.sizing import cut_bucketed, cut_lineage, delete_scratch, scratch_paths

_byte = np.arange(256)
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
KIND = np.full(256, _SIGN, np.uint8)
KIND[(_byte == 32) | ((_byte >= 9) & (_byte <= 13))] = _SPACE
KIND[((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)] = _LETTER
KIND[(_byte >= 48) & (_byte <= 57)] = _DIGIT
_UPPER = (_byte >= 65) & (_byte <= 90)

# Token numbers: start of text, end of text, the k-th word in a row that repeats the one before it (k from 2 to 9, 9 for all
# later ones), then shapes, then 3 per known string.
START, END, AGAIN, SHAPES, KNOWN = 0, 1, 2, 12, 64
# Tokens that never occur share what unigrams leave evenly, with at least 1 << BITS tokens.
BITS = 16
# Bits of a key that requests leave out; they tell its shard.
_CUT = np.uint64(16)
_LOW = np.uint64((1 << 16) - 1)
# Bytes of text that are asked for at once, unless the documents have more than _PASSES times as many.
_PASS_BYTES, _PASSES = 1 << 26, 5
# Two token numbers make one pair.
WIDE = 32

# What the model tells: the share of a unigram, what it leaves as a context and how often it is one; the discounted count of a
# bigram, and the same two as a context; the discounted count of a trigram.
P1, REST2, WHOLE2, CUT2, REST3, WHOLE3, CUT3 = range(7)
_SLOTS = ((P1, REST2, WHOLE2), (CUT2, REST3, WHOLE3), (CUT3,))


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of letters, digits or signs per window: first and end value, bounds, hash, kind, case (0 low, 1 capital, 2 all), length."""
    data, offsets = utf8(column)
    for i, j, low, high in windows(data, offsets):
        raw = data[low:high]
        kind = KIND[raw]
        edges = np.clip(offsets[i:j + 1] - low, 0, high - low)
        new = np.ones(len(raw), bool)
        new[1:] = kind[1:] != kind[:-1]
        inner = edges[1:-1]
        new[inner[inner < len(raw)]] = True
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(raw))
        real = kind[at] != _SPACE
        start, stop = at[real], stop[real]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=total[1:])
        upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        many = upper[stop] - upper[start]
        case = np.where((many > 1) & (many * 2 > stop - start), 2, np.where(many > 0, 1, 0))
        yield i, j, np.searchsorted(start, edges), mix((total[stop] - total[start]) * powers(_BASE_INVERSE, len(raw))[start]), kind[start], case, stop - start


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [r[3] for r in _runs(batch.column(0))]
        if hashes:
            keys, n = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["string", "n"])


def _tokens(column: pa.Array, known: np.ndarray) -> list[np.ndarray]:
    """Token numbers of each value, with two starts and an end: known strings by name and case, others by shape."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for i, j, bounds, hashes, kind, case, length in _runs(column):
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        found = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        size = np.searchsorted([3, 7, 12], length)
        ids = np.where(found, KNOWN + 3 * at + case, SHAPES + kind.astype(np.int64) * 12 + case * 4 + size).astype(np.uint32)
        words = np.flatnonzero(kind == _LETTER)
        owner = np.searchsorted(bounds, words, side="right")
        same = np.zeros(len(words), bool)
        same[1:] = (hashes[words[1:]] == hashes[words[:-1]]) & (owner[1:] == owner[:-1])
        places = np.arange(len(words))
        run = places - np.maximum.accumulate(np.where(same, -1, places)) if len(words) else places
        long = run >= 2
        ids[words[long]] = AGAIN + np.minimum(run[long], 9) - 2
        for k in range(i, j):
            out[k].append(ids[bounds[k - i]:bounds[k - i + 1]])
    return [np.concatenate([np.array([START, START], np.uint32), *x, np.array([END], np.uint32)]) for x in out]


def _token_runs(column: pa.Array, known: np.ndarray) -> Iterator[np.ndarray]:
    """`_tokens`, of some values at a time."""
    for at in range(0, len(column), 512):
        yield from _tokens(column.slice(at, 512), known)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two token numbers as one number."""
    return (first.astype(np.uint64) << np.uint64(WIDE)) | second.astype(np.uint64)


def _join(pair: np.ndarray, word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of a trigram from those of its first two tokens and of its last two, which gives the bits that tell the shard."""
    return (mix(pair * _JOIN + word.astype(np.uint64)) & ~_LOW) | (last & _LOW)


def _grams(ids: np.ndarray) -> list[np.ndarray]:
    """Keys of the unigrams, bigrams and trigrams of a text; those of unigrams and bigrams are one to one."""
    pair = mix(_pairs(ids[:-1], ids[1:]))
    return [mix(ids.astype(np.uint64)), pair, _join(pair[:-1], ids[2:], pair[1:])]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys & _LOW) % np.uint64(shards)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where equal rows of sorted columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, [x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start) if len(start) else values[:0]


def _write(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, none negative: as many bytes as the largest one needs, all lowest bytes first, and so on."""
    out = []
    for x in columns:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        packed = zlib.compress(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)
        out.append(width.to_bytes(1, "little") + len(x).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed)
    return b"".join(out)


def _read(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        width, n, size = packed[at], int.from_bytes(packed[at + 1:at + 9], "little"), int.from_bytes(packed[at + 9:at + 17], "little")
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(zlib.decompress(packed[at + 17:at + 17 + size]), np.uint8).reshape(width, n).T
        out.append(full.view(np.uint64).ravel())
        at += 17 + size
    return out


def _write_ascending(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    return _write(np.diff(keys, prepend=np.uint64(0)), *columns)


def _read_ascending(packed: Iterable[bytes], columns: int) -> list[np.ndarray]:
    """What `_write_ascending` wrote, several of them after each other."""
    parts = [[np.cumsum(x[0], dtype=np.uint64), *x[1:]] for x in map(_read, packed)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64) for _ in range(columns)]


def _classes(n: np.ndarray) -> list[np.ndarray]:
    """1 where the count is 1, 2, and 3 or more."""
    return [(n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n > 2).astype(np.uint64)]


def _seldom(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in range(1, 5)]


def _trigram_counts(last: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Each trigram once, in the order of its last two tokens (one number), then of the first."""
    # Two sorts of numbers take less time than one of rows.
    order = np.argsort(last)
    rank = np.zeros(len(last), np.uint64)
    rank[1:] = np.cumsum(last[order[1:]] != last[order[:-1]])
    order = order[np.argsort(_pairs(rank, first[order]))]
    last, first = last[order], first[order]
    start = _starts(last, first) if len(last) else np.zeros(0, np.int64)
    return [last[start], first[start], _sums(n[order], start)]


def _count_trigrams(known: np.ndarray, shards: int):
    """Trigrams of a stretch of texts with their counts, a row per shard."""

    def counted(texts: list[np.ndarray]) -> pa.RecordBatch:
        a, b, c = (np.concatenate([x[k:len(x) - 2 + k] for x in texts]) for k in range(3))
        last, first, n = _trigram_counts(_pairs(b, c), a.astype(np.uint64), np.ones(len(a), np.uint64))
        order, edges = _by_shard(mix(last), shards)
        slices = [order[edges[k]:edges[k + 1]] for k in range(shards)]
        packed = [_write_ascending(last[x], first[x], n[x]) for x in slices]
        return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(packed, pa.binary())], names=["shard", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for batch in batches:
            for x in _token_runs(batch.column(0), known):
                texts.append(x)
                size += len(x)
                if size > 1 << 20:
                    yield counted(texts)
                    texts, size = [], 0
        if texts:
            yield counted(texts)

    return run


def _merge_trigrams(parts: pd.DataFrame) -> pd.DataFrame:
    """All trigrams of a shard, and how many of them, and of the bigrams at their end, have small counts."""
    last, first, n = _trigram_counts(*_read_ascending(parts.grams, 3))
    many = np.diff(np.append(_starts(last), len(last)))
    return pd.DataFrame({"shard": parts.shard[:1], "grams": [_write_ascending(last, first, n)], "seldom3": [_seldom(n)], "seldom2": [_seldom(many)]})


def _added(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Ascending distinct keys and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = _starts(keys) if len(keys) else np.zeros(0, np.int64)
    return [keys[start], *[_sums(x[order], start) for x in columns]]


def _contexts(shards: int):
    """What trigrams tell of the shorter n-grams before their ends, a row per shard of those.

    pairs: of the first two tokens the count, and how many counts of 1, 2 and more follow. words: the same of the middle
    token, from the bigrams at the end of trigrams; and how many such bigrams a token ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                last, first, n = _read_ascending([packed], 3)
                start = _starts(last)
                ends, many = last[start], np.diff(np.append(start, len(last))).astype(np.uint64)
                middle, word, none = ends >> np.uint64(WIDE), ends & np.uint64((1 << WIDE) - 1), np.zeros(len(ends), np.uint64)
                pairs = _added(mix(_pairs(first, last >> np.uint64(WIDE))), [n, *_classes(n)])
                both = [np.concatenate(x) for x in zip([many, *_classes(many), none], [none] * 4 + [none + np.uint64(1)])]
                words = _added(mix(np.concatenate([middle, word])), both)
                rows = []
                for keys, *columns in (pairs, words):
                    order, edges = _by_shard(keys, shards)
                    rows.append([_write_ascending(*[x[order[edges[k]:edges[k + 1]]] for x in (keys, *columns)]) for k in range(shards)])
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), *[pa.array(x, pa.binary()) for x in rows]], names=["shard", "pairs", "words"])

    return run


def _merge_contexts(parts: pd.DataFrame) -> pd.DataFrame:
    pairs, words = (_added(x[0], x[1:]) for x in (_read_ascending(parts.pairs, 5), _read_ascending(parts.words, 6)))
    ended = words[5][words[5] > 0]
    return pd.DataFrame({"shard": parts.shard[:1], "pairs": [_write_ascending(*pairs)], "words": [_write_ascending(*words)],
                         "seldom1": [_seldom(ended)], "whole1": [int(ended.sum())], "kinds1": [len(ended)]})


def _pack(ids: np.ndarray) -> bytes:
    """Token numbers, all their lowest bytes first, and so on."""
    return zlib.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _encode(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_pack(x) for x in _token_runs(batch.column(4), known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["block", "key", "doc_id", "lang", "ids"])

    return run


def _unique(keys: np.ndarray) -> np.ndarray:
    """The keys, which are sorted in place, each once: in a tenth of the time that np.unique takes for its hash table."""
    keys.sort()
    return keys[_starts(keys)] if len(keys) else keys


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted keys are among sorted ones; looked for in ascending order, which is much faster."""
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(keys, wanted[order])
    return np.minimum(at, max(len(keys) - 1, 0))


def _distinct(texts: Iterable[np.ndarray]) -> list[np.ndarray]:
    """The sorted distinct keys of all unigrams, bigrams and trigrams of some texts."""
    seen, size = [[np.zeros(0, np.uint64)] for _ in range(3)], 0
    for ids in texts:
        for keys, more in zip(seen, _grams(ids)):
            keys.append(more)
        size += len(ids)
        if size > 1 << 20:
            for keys in seen:
                keys[:] = [_unique(np.concatenate(keys))]
            size = 0
    return [_unique(np.concatenate(keys)) for keys in seen]


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the order of their shards, and where each shard begins and ends."""
    shard = _shard(keys, shards)
    return np.argsort(shard.astype(np.uint16), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _squeeze(keys: np.ndarray) -> bytes:
    """The upper 48 bits of ascending keys, by their differences: four lower bytes as they are, two upper ones packed.

    Within a shard, whose number the lower bits give, a strange key is taken for one of m others with probability m / 2**48.
    """
    steps = np.diff(keys >> _CUT, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return len(keys).to_bytes(8, "little") + steps[:, :4].tobytes() + zlib.compress(steps[:, 4:6].T.tobytes(), 1)


def _stretch(packed: bytes) -> np.ndarray:
    """What `_squeeze` packed: upper 48 bits, ascending."""
    n = int.from_bytes(packed[:8], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :4] = np.frombuffer(packed, np.uint8, 4 * n, 8).reshape(n, 4)
    steps[:, 4:6] = np.frombuffer(zlib.decompress(packed[8 + 4 * n:]), np.uint8).reshape(2, n).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _ask(known: np.ndarray, shards: int):
    """The distinct n-grams of all texts of a task, which is one block: as many as occur in it, each once, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None

        def texts() -> Iterator[np.ndarray]:
            nonlocal block
            for batch in batches:
                if batch.num_rows:
                    block = batch.column(0)[0].as_py()
                    yield from _token_runs(batch.column(1), known)

        keys = _distinct(texts())
        dealt = [_by_shard(x, shards) for x in keys]
        for at in range(0, shards if block is not None else 0, 64):
            numbers = range(at, min(at + 64, shards))
            packed = [pa.array([_squeeze(x[order[edges[k]:edges[k + 1]]]) for k in numbers], pa.binary()) for x, (order, edges) in zip(keys, dealt)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(numbers), pa.int32()), pa.array(numbers, pa.int32()), *packed], names=["block", "shard", "k1", "k2", "k3"])

    return run


def _held(grams: Iterable[bytes], pairs: Iterable[bytes], words: Iterable[bytes], cuts: list[list[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys, ascending and without their lowest bits, and the model's numbers of a shard, slot by slot."""

    def discount(n: np.ndarray, cut: list[float]) -> np.ndarray:
        return np.where(n == 1, cut[0], np.where(n == 2, cut[1], cut[2]))

    def sorted_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order] >> _CUT, values[order].astype(np.float32)

    cut1, cut2, cut3 = cuts
    last, first, n = _read_ascending(grams, 3)
    ends = mix(last)
    keys = _join(mix(_pairs(first, last >> np.uint64(WIDE))), last & np.uint64((1 << WIDE) - 1), ends)
    start = _starts(last) if len(last) else np.zeros(0, np.int64)
    many = np.diff(np.append(start, len(last)))
    pair, whole3, *classes3 = _read_ascending(pairs, 5)
    word, whole2, *classes2, count = _read_ascending(words, 6)
    is_word, is_context = count > 0, whole2 > 0
    rest3 = sum(x * y for x, y in zip(classes3, cut3)) / np.maximum(whole3, 1)
    rest2 = sum(x * y for x, y in zip(classes2, cut2)) / np.maximum(whole2, 1)
    context = word[is_context]
    # Pairs and words are in the order of their keys.
    rows = [(word[is_word], count[is_word] - discount(count[is_word], cut1)), (context, rest2[is_context]), (context, whole2[is_context])]
    rows = [(k >> _CUT, x.astype(np.float32)) for k, x in [*rows, (pair, rest3), (pair, whole3)]]
    return [*rows[:3], sorted_by(ends[start], many - discount(many, cut2)), *rows[3:], sorted_by(keys, n - discount(n, cut3))]


def _answer(cuts: list[list[float]]):
    def run(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        """To each block, for the keys in its order: which the model has (bits), then its numbers for those, slot by slot."""
        if not len(asked):
            return pd.DataFrame({"block": [], "shard": [], "told": []})
        held, told = _held(model.grams, model.pairs, model.words, cuts), []
        for row in asked.itertuples(index=False):
            out = []
            for packed, slots in zip((row.k1, row.k2, row.k3), _SLOTS):
                want = _stretch(packed)
                out.append(np.bitwise_xor.reduce(want).tobytes())
                for slot in slots:
                    keys, shares = held[slot]
                    at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
                    has = keys[at] == want if len(keys) else np.zeros(len(want), bool)
                    out += [np.packbits(has).tobytes(), shares[at[has]].tobytes()]
            told.append(b"".join(out))
        return pd.DataFrame({"block": asked.block, "shard": asked.shard, "told": told})

    return run


def _hear(keys: list[np.ndarray], told: pd.DataFrame, shards: int) -> list[np.ndarray]:
    """The model's numbers for sorted keys, slot by slot; 0 for what it has not."""
    dealt = [_by_shard(x, shards) for x in keys]
    values = [np.zeros(len(keys[n]), np.float32) for n, slots in enumerate(_SLOTS) for _ in slots]
    if len(told) != shards:
        raise RuntimeError("the documents were read in other parts than before")
    for shard, packed in zip(told.shard, told.told):
        raw, at = np.frombuffer(packed, np.uint8), 0
        for x, (order, edges), slots in zip(keys, dealt, _SLOTS):
            places = order[edges[shard]:edges[shard + 1]]
            if raw[at:at + 8].tobytes() != np.bitwise_xor.reduce(x[places] >> _CUT).tobytes():
                raise RuntimeError("the documents were read in other parts than before")
            at += 8
            for slot in slots:
                size = (len(places) + 7) // 8
                has = np.unpackbits(raw[at:at + size], count=len(places)).astype(bool)
                at += size
                end = at + 4 * int(has.sum())
                values[slot][places[has]] = np.frombuffer(raw[at:end].tobytes(), np.float32)
                at = end
    return values


def _cuts(seldom: list[int]) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    n = [max(float(k or 0), 1.0) for k in seldom]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.1), (k + 1) * 0.9) for k in range(3)]


def train(texts: DataFrame, known: np.ndarray, shards: int) -> tuple[DataFrame, list[list[float]], float, float]:
    """((shard, grams, pairs, words) of the model, discounts of uni-, bi- and trigrams, count of unigrams, what they leave).

    Counts of the shorter n-grams are continuation counts. A shard holds the trigrams whose last two tokens fall to it, so
    it counts those pairs, too; what trigrams tell of their first two tokens and of single ones is added up in a second
    exchange. `texts` has `text`. The tables are written in buckets of the shard: to answer moves the questions only.
    """

    def added(name: str) -> list[Column]:
        return [F.sum(F.col(name)[k]).alias(f"{name}_{k}") for k in range(4)]

    parts = texts.select("text").mapInArrow(_count_trigrams(known, shards), "shard int, grams binary")
    grams = cut_bucketed(parts.groupBy("shard").applyInPandas(_merge_trigrams, "shard int, grams binary, seldom3 array<long>, seldom2 array<long>"), "shard")
    parts = grams.select("grams").mapInArrow(_contexts(shards), "shard int, pairs binary, words binary")
    shorter = cut_bucketed(parts.groupBy("shard").applyInPandas(
        _merge_contexts, "shard int, pairs binary, words binary, seldom1 array<long>, whole1 long, kinds1 long"), "shard")
    long = grams.agg(*added("seldom2"), *added("seldom3")).first()
    short = shorter.agg(*added("seldom1"), F.sum("whole1"), F.sum("kinds1")).first()
    cuts = [_cuts(x) for x in (short[:4], long[:4], long[4:])]
    whole, kinds, few = short[4] or 0, short[5] or 0, [x or 0 for x in short[:2]]
    left = sum(x * y for x, y in zip(cuts[0], [*few, kinds - sum(few)])) / whole if whole else 1.0
    return grams.select("shard", "grams").join(shorter.select("shard", "pairs", "words"), "shard"), cuts, float(whole or 1), left


def perplexities(docs: DataFrame, trusted: DataFrame, least: int = 2) -> DataFrame:
    """(key, doc_id, lang, perplexity) of `docs`, per token under a model of all texts of `trusted` (column text); key: `row_key`.

    Strings that occur at least `least` times in the trusted text are tokens by name, however many there are, others by
    shape; from the third equal word in a row on the token is the length of the run. The list of named strings goes to each
    task, 8 bytes a string. Counts are distributed tables. Each task's part of the documents is a block, which asks once
    for each distinct n-gram in it; requests and counts meet by the shard of their keys (64-bit hashes), and the answers
    go back to their block, where they are added up per document. No task needs the whole model. Blocks are asked for in
    up to `_PASSES` turns, each of which is written before the next, so that their questions need less room. Null texts count as
    empty: two starts and an end. `docs` must come straight from files, for it is read twice in the same parts
    (`sizing.cut_lineage` writes what doesn't); else this is an error.
    """
    counts = trusted.select("text").mapInArrow(_count_strings, "string long, n long").groupBy("string").agg(F.sum("n").alias("n"))
    named = counts.where(F.col("n") >= least).select("string").toArrow().column(0)
    known = np.sort(named.to_numpy().astype(np.int64).view(np.uint64))
    shards = min(max(2 * docs.rdd.getNumPartitions(), 1), 1 << 16)
    before = len(scratch_paths())
    model, cuts, whole1, left = train(trusted, known, shards)
    tables = scratch_paths()[before:]
    even = left / max(1 << BITS, KNOWN + 3 * len(known))
    passes = min(max((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _PASS_BYTES, 1), _PASSES)

    placed = docs.select(F.spark_partition_id().alias("block"), "doc_id", "lang", "text")

    def add_up(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        keys = _distinct(map(_unpack, mine.ids))
        p1, rest2, whole2, cut2, rest3, whole3, cut3 = _hear(keys, told, shards)
        for x in (rest2, whole2, rest3, whole3):
            x[x == 0] = 1
        # Tokens are few and small numbers: their places are looked up once.
        tokens = _unique(np.concatenate([np.zeros(0, np.uint32), *map(_unpack, mine.ids)]))
        place = np.zeros(int(tokens[-1]) + 1 if len(tokens) else 0, np.int64)
        place[tokens] = _places(keys[0], mix(tokens.astype(np.uint64)))
        mean = []
        for at in range(0, len(mine), 256):
            texts = [_unpack(x) for x in mine.ids[at:at + 256]]
            end = np.cumsum([len(x) for x in texts])
            inside = np.ones(end[-1], bool)
            inside[end - 1] = inside[end - 2] = False
            here = np.flatnonzero(inside)
            ids = np.concatenate(texts)
            one, (two, three) = place[ids], (_places(x, g) for x, g in zip(keys[1:], _grams(ids)[1:]))
            three, pair, first, second, last = three[here], two[here + 1], two[here], one[here + 1], one[here + 2]
            c3, w3, r3, c2, w2, r2, c1 = (x[i].astype(float) for x, i in ((cut3, three), (whole3, first), (rest3, first), (cut2, pair), (whole2, second), (rest2, second), (p1, last)))
            p = c3 / w3 + r3 * (c2 / w2 + r2 * (c1 / whole1 + even))
            count = np.diff(end, prepend=0) - 2
            mean.append(np.add.reduceat(np.log(p), np.cumsum(count) - count) / count)
        return pd.DataFrame({"key": mine.key, "doc_id": mine.doc_id, "lang": mine.lang, "perplexity": np.exp(-np.concatenate([np.zeros(0), *mean]))})

    def scored(turn: int) -> DataFrame:
        mine = placed.where(F.pmod("block", F.lit(passes)) == turn)
        asked = mine.select("block", "text").mapInArrow(_ask(known, shards), "block int, shard int, k1 binary, k2 binary, k3 binary")
        answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(_answer(cuts), "block int, shard int, told binary")
        encoded = mine.select("block", row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        encoded = encoded.mapInArrow(_encode(known), "block int, key long, doc_id long, lang string, ids binary")
        return cut_lineage(encoded.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add_up, "key long, doc_id long, lang string, perplexity double"))

    found = reduce(DataFrame.unionAll, [scored(turn) for turn in range(passes)])
    delete_scratch(docs.sparkSession, tables)
    return found


def row_key() -> Column:
    """Tells documents apart by what the decision rests on; equal rows get equal decisions."""
    return F.xxhash64("doc_id", "lang", "text")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, margin: float = 1.5, held_out: int = 5, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(key, doc_id, lang, perplexity, threshold, kept): documents whose perplexity is at most their language's threshold.

    Trusted are the documents with quality 1 (in all their label rows). The model is trained on all of them but one in
    `held_out`, by the hash of the id; those set the thresholds: `margin` times the `quantile` of their perplexity in each
    language, or in all together where a language has fewer than 50. Unlabelled and null-language documents are scored in
    the same way. Null or empty texts are kept: there is nothing that speaks against them. Without trusted documents all
    are kept. The ids of trusted documents are broadcast up to `broadcast_ids` of them, a few bytes each; beyond that
    the join shuffles both sides.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = cut_lineage(good.select("doc_id", (F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(held_out)) == 0).alias("apart")))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if good.count() <= broadcast_ids else df

    scored = perplexities(docs, docs.join(side(good.where("not apart")), "doc_id", "left_semi").select("text").where("text is not null"))
    sure = scored.join(good.where("apart"), "doc_id", "left_semi")
    whole = sure.agg(F.percentile_approx("perplexity", quantile, 100_000)).first()[0]
    by_lang = sure.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("limit"), F.count("*").alias("n")).where("n >= 50")
    limits = by_lang.select(F.col("lang").alias("of"), (F.col("limit") * margin).alias("limit"))
    limit = F.coalesce("limit", F.lit(whole * margin if whole is not None else None).cast("double"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").select("key", "doc_id", "lang", "perplexity", limit.alias("threshold"))
    empty = F.xxhash64("doc_id", "lang", F.lit(None).cast("string")), F.xxhash64("doc_id", "lang", F.lit(""))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) | F.col("key").isin(*empty))
