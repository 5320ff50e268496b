"""Removal of repeated passages by suffix automata of reference shards and matching statistics.

The reference is the corpus itself. Sent to all documents, every shard would meet every text; here a shard's automaton goes
where it can match: a window of `width` words is known by its least run of SEED words (in the order of their hashes), equal
windows have the same one, so the stretches of text around a seed that occurs twice go to the shard of that seed. There the
automaton of all stretches is built, with the number of places at which each state's strings end, and each stretch streams
through the states that end at two places or more: the longest match at each word, and with `width` words or more its span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.llm import words
from stepframe.sizing import cut_lineage, delete_scratch, scratch_path

WIDTH = 35
SEED = 10
_AS_IS = np.arange(256, dtype=np.uint8)
# Words in a shard's automaton, about; and the different stretches at one seed from which they are taken window by window.
SHARD_WORDS = 40_000
STRETCHES_PER_SEED = 2_000


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values the place of its least one, the first of equals; by doubling."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, least, have = np.arange(len(values)), values, 1
    while have < span:
        step = min(have, span - have)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        have += step
    return place


def seeds(column: pa.Array, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, seed hash, first window, number of windows) for each run of windows with the same least seed."""
    hashes, counts = words.hash_words(column, _AS_IS)
    begins = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    grams = words.join_hashes(hashes, seed)
    place = least_places(grams, width - seed + 1)
    inside = np.flatnonzero(row[:len(place)] == row[width - 1:width - 1 + len(place)])
    if not len(inside):
        return row[:0], np.zeros(0, np.int64), row[:0], row[:0]
    least = place[inside]
    new = np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1] + 1))
    first = inside[new]
    length = np.diff(np.append(np.flatnonzero(new), len(inside)))
    return row[first], grams[least[new]].view(np.int64), first - begins[row[first]], length


def _seeded(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, first, length = seeds(batch.column(1), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key, pa.int64()), pa.array(first * width + length - 1, pa.int64())], names=["digest", "seed", "at"])

    return run


class Automaton:
    """The suffix automaton of some word sequences, each of which stands for `weight` places."""

    def __init__(self, sequences: Sequence[Sequence[int]], weights: Sequence[int]):
        self.link, self.length, self.next, self.count = [-1], [0], [{}], [0]
        for sequence, weight in zip(sequences, weights):
            self._add(sequence, weight)
        count, link = self.count, self.link
        for state in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            count[link[state]] += count[state]

    def _add(self, sequence: Sequence[int], weight: int) -> None:
        link, length, following, count = self.link, self.length, self.next, self.count
        last = 0
        for word in sequence:
            have = following[last].get(word)
            if have is not None:
                last = have if length[have] == length[last] + 1 else self._split(last, word, have)
                count[last] += weight
                continue
            state = len(length)
            length.append(length[last] + 1)
            following.append({})
            count.append(weight)
            link.append(0)
            p = last
            while p >= 0 and word not in following[p]:
                following[p][word] = state
                p = link[p]
            if p >= 0:
                q = following[p][word]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = state

    def _split(self, p: int, word: int, q: int) -> int:
        """A state of its own for the strings of q that are at most one word longer than those of p."""
        link, following = self.link, self.next
        state = len(self.length)
        self.length.append(self.length[p] + 1)
        following.append(following[q].copy())
        self.count.append(0)
        link.append(link[q])
        link[q] = state
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = state
            p = link[p]
        return state

    def repeated_spans(self, sequence: Sequence[int], width: int) -> list[tuple[int, int]]:
        """Maximal spans of matches of `width` words or more that end at two places or more; overlapping ones are joined."""
        link, length, following, count = self.link, self.length, self.next, self.count
        spans: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(sequence, start=1):
            there = following[state].get(word)
            while state and (there is None or count[there] < 2):
                state = link[state]
                matched = length[state]
                there = following[state].get(word)
            if there is None or count[there] < 2:
                continue
            state = there
            matched += 1
            if matched >= width:
                if spans and i - matched <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], i - matched), i)
                else:
                    spans.append((i - matched, i))
        return spans


_STRETCHES = "seed long, name binary, digest binary, first int, n int, stretch binary"


def _stretches(width: int):
    """One row for each stretch of a text; its words, and the number of times it was met, with the first of a batch only."""
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            known: dict[bytes, list] = {}
            for digest, text, found in zip(*[batch.column(c) for c in range(3)]):
                parts = text.as_buffer().to_pybytes().split()
                mine = digest.as_py()
                for x in found.as_py():
                    first, more = divmod(x["at"], width)
                    stretch = b" ".join(parts[first:first + more + width])
                    name = hashlib.md5(stretch).digest()
                    row = [x["seed"], name, mine, first, 0, None]
                    head = known.setdefault(name, row)
                    if head is row:
                        row[5] = stretch
                    head[4] += 1
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=["seed", "name", "digest", "first", "n", "stretch"])

    return run


def _matched(width: int):
    """Spans of the stretches of each shard, in order of shard: (name, low, high) in words."""
    def spans(known: dict[bytes, list]) -> Iterator[tuple[bytes, int, int]]:
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in s.split()] for s, _ in known.values()]
        automaton = Automaton(sequences, [n for _, n in known.values()])
        for name, sequence in zip(known, sequences):
            for low, high in automaton.repeated_spans(sequence, width):
                yield name, low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, known = None, {}

        def done() -> pa.RecordBatch:
            found = list(spans(known))
            names, low, high = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["name", "low", "high"])

        for batch in batches:
            for mine, name, n, stretch in zip(*[c.to_pylist() for c in batch.columns]):
                if mine != shard:
                    if known:
                        yield done()
                    shard, known = mine, {}
                have = known.get(name)
                if have is None:
                    known[name] = [stretch, n]
                else:
                    have[1] += n
        if known:
            yield done()

    return run


def _by_window(width: int):
    """The windows of stretches as stretches of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, n, stretch in zip(*[c.to_pylist() for c in batch.columns]):
                parts = stretch.split()
                for at in range(len(parts) - width + 1):
                    window = b" ".join(parts[at:at + width])
                    out.append((hashlib.md5(window).digest(), n, window, name, at))
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=["name", "n", "stretch", "of", "at"])

    return run


def _match(stretches: DataFrame, shard, shards: int, width: int) -> DataFrame:
    tasks = max(int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stretches.select(F.pmod(F.xxhash64(shard), F.lit(shards)).alias("shard"), "name", "n", "stretch")
    return dealt.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_matched(width), "name binary, low int, high int")


def repeated_spans(texts: DataFrame, width: int = WIDTH, seed: int = SEED, shard_words: int = SHARD_WORDS, stretches_per_seed: int = STRETCHES_PER_SEED) -> DataFrame:
    """(digest, spans array<struct<low, high>>) of the texts that hold repeated windows; `texts` has digest and text, with no null text.

    Spans count words and may overlap. A seed with very many different stretches around it is worked off window by
    window, each in the shard of its own words, so no shard grows with one seed.
    """
    spark = texts.sparkSession
    mine: list[str] = []

    def written(frame: DataFrame) -> DataFrame:
        mine.append(scratch_path(spark, "seeds"))
        frame.write.parquet(mine[-1])
        return spark.read.schema(frame.schema).parquet(mine[-1])

    found = written(texts.mapInArrow(_seeded(width, seed), "digest binary, seed long, at long"))
    # Written as well: Spark splits a very frequent seed only where both sides of the join are read from shuffles.
    twice = written(found.groupBy("seed").count().where("count > 1").select(F.col("seed").alias("again")))
    wanted = found.join(twice, F.col("seed") == F.col("again")).groupBy("digest").agg(F.collect_set(F.struct("at", "seed")).alias("found"))
    with_text = texts.join(wanted.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of")).select("digest", F.col("text").cast("binary").alias("text"), "found")
    stretches = cut_lineage(with_text.mapInArrow(_stretches(width), _STRETCHES))
    delete_scratch(spark, mine)
    shipped = stretches.where("stretch IS NOT NULL").select("seed", "name", "n", "stretch")
    many = shipped.select("seed", "name").distinct().groupBy("seed").count().where(F.col("count") > stretches_per_seed).select(F.col("seed").alias("crowded"))
    marked = shipped.join(many, F.col("seed") == F.col("crowded"), "left")
    shards = shipped.count() * (2 * width) // shard_words + 1
    plain = _match(marked.where("crowded IS NULL"), F.col("seed"), shards, width)

    windows = cut_lineage(marked.where("crowded IS NOT NULL").select("name", "n", "stretch").mapInArrow(_by_window(width), "name binary, n int, stretch binary, of binary, at int"))
    own = _match(windows, F.col("name"), windows.count() * width // shard_words + 1, width).select(F.col("name").alias("window"))
    inner = windows.select("name", "of", "at").distinct().join(own, F.col("name") == F.col("window")).select(F.col("of").alias("name"), F.col("at").alias("low"), (F.col("at") + width).alias("high"))

    spans = plain.unionByName(inner).withColumnRenamed("name", "match")
    at = stretches.select("digest", "first", "name").join(spans, F.col("name") == F.col("match"))
    return at.groupBy("digest").agg(F.collect_set(F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, totals, removed = [], [], []
        for text, spans in zip(batch.column("__text"), batch.column("__spans")):
            parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
            stay = np.ones(len(parts), bool)
            for x in spans.as_py() or ():
                stay[x["low"]:x["high"]] = False
            texts.append(b" ".join(parts) if stay.all() else b" ".join([parts[i] for i in np.flatnonzero(stay)]))
            totals.append(len(parts))
            removed.append(len(parts) - int(stay.sum()))
        kept = [c for c in batch.schema.names if c not in ("__text", "__spans")]
        added = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], names=[*kept, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows with n_words, n_removed (longs) and kept_text: each word goes that a window of 35 consecutive words of its
    text covers whose words also start anywhere else, in the same text too; kept words are joined by one space.

    Words are runs of bytes other than `\\x20\\x09-\\x0D`, taken as they are. All windows are judged on the input. A null or empty text
    has no words; repeated rows repeat each other, so all of them lose their windows. Other columns stay as they are, but
    for one of the three names, which is replaced. Texts are told apart by their MD5.
    """
    digest = F.unhex(F.md5(F.col(text_column).cast("binary")))
    texts = docs.where(F.col(text_column).isNotNull()).select(digest.alias("digest"), F.col(text_column).alias("text"))
    spans = repeated_spans(texts, **options).select(F.col("digest").alias("__of"), F.col("spans").alias("__spans"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    # Bytes, so that the join hands the text on once, not with the column it came from.
    rows = docs.select(*kept, F.col(text_column).cast("binary").alias("__text"), digest.alias("__digest"))
    return _finish(rows.join(spans, F.col("__digest") == F.col("__of"), "left").drop("__digest", "__of"), kept)


def _finish(rows: DataFrame, kept: list[str]) -> DataFrame:
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.mapInArrow(_kept, schema)
