"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.components import components
from stepframe.llm.words import mix, shingle_sets
from stepframe.sizing import cut_lineage


@dataclass(frozen=True)
class Signature:
    """Sizes of a signature: `chunks` of `symbols` 16-bit MinHash values, of which `errors` may differ, and 64 * `longs` 1-bit values.

    By pigeonhole two signatures whose symbols differ in at most chunks * (errors + 1) - 1 places have a chunk with at
    most `errors` differences, and then agree in one of its keys, which leave out `errors` symbols each. With 10
    chunks of 4 that is a distance of 19 of 40, where 10 is expected at a similarity of 0.75; a pair at 0.75 has no
    such chunk with probability 2e-6. The 1-bit values sort out pairs that share a key but are far apart: at most
    `sigmas` standard deviations above the expected distance are allowed (1e-5 of the pairs at 0.75 are beyond).
    """

    chunks: int = 10
    symbols: int = 4
    errors: int = 1
    longs: int = 4
    sharp: int = 32
    sigmas: float = 4.3

    def columns(self) -> list[str]:
        return [f"c{k}" for k in range(self.chunks)] + [f"s{k}" for k in range(self.longs)]

    def far(self, percent: int, longs: int) -> int:
        """The largest distance of 1-bit parts that two sets with this similarity are given."""
        n, p = 64 * longs, (1 - percent / 100) / 2
        return ceil(n * p + self.sigmas * sqrt(n * p * (1 - p)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def _smallest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a set under each linear function modulo 2**32; long sets in parts."""
    out = None
    for at in range(0, len(values), 4096):
        low = (values[at:at + 4096] * a[:, None] + b[:, None]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def _fingerprints(sig: Signature, width: int):
    n = sig.chunks * sig.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(n + 64 * sig.longs)
        for batch in batches:
            rows = batch.num_rows
            size = np.zeros(rows, np.int64)
            digest = np.zeros((rows, 2), np.int64)
            chunks, bits = np.zeros((rows, sig.chunks), np.int64), np.zeros((rows, sig.longs), np.int64)
            for i, hashes in enumerate(shingle_sets(batch.column(1), width)):
                size[i] = len(hashes)
                if not len(hashes):
                    continue
                digest[i, 0] = int(hashes.sum().view(np.int64))
                digest[i, 1] = int(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64))
                low = mix(_smallest((hashes >> np.uint64(32)).astype(np.uint32), a, b).astype(np.uint64))
                chunks[i] = (low[:n] >> np.uint64(48)).astype("<u2").view("<i8")
                bits[i] = np.packbits((low[n:] >> np.uint64(63)).astype(np.uint8)).view(np.int64)
            columns = [batch.column(0), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            columns += [pa.array(chunks[:, k]) for k in range(sig.chunks)] + [pa.array(bits[:, k]) for k in range(sig.longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d0", "d1"] + sig.columns())

    return run


def _lane(sig: Signature, place: int) -> int:
    """The bits of one symbol in the long that holds a chunk, as a signed number."""
    mask = 0xFFFF << (16 * place)
    return mask - (1 << 64) if mask >> 63 else mask


def _key_rows(classes: DataFrame, sig: Signature) -> DataFrame:
    """(rep, key): every chunk with every allowed choice of left-out symbols."""
    keys = []
    for chunk in range(sig.chunks):
        for choice, places in enumerate(combinations(range(sig.symbols), sig.errors)):
            kept = F.col(f"c{chunk}")
            for place in places:
                kept = kept.bitwiseAND(~_lane(sig, place))
            keys.append(F.xxhash64(F.lit(chunk), F.lit(choice), kept))
    return classes.select("rep", F.explode(F.array(*keys)).alias("key"))


def _sketches(longs: int, width: int):
    """(rep, t0..): 64 * longs 1-bit MinHash values, from other functions than those of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (x[:64 * longs] for x in _coefficients(64 * longs + 4096))
        for batch in batches:
            bits = np.zeros((batch.num_rows, longs), np.int64)
            for i, hashes in enumerate(shingle_sets(batch.column(1), width)):
                if len(hashes):
                    low = mix(_smallest((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), a, b).astype(np.uint64))
                    bits[i] = np.packbits((low >> np.uint64(63)).astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(bits[:, k]) for k in range(longs)], names=["rep"] + [f"t{k}" for k in range(longs)])

    return run


def _confirm(width: int, percent: int):
    """Keeps the pairs whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)
            good = []
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int = 5, sig: Signature = Signature()) -> DataFrame:
    """(doc_id, n_shingles, d0, d1, c0.., s0..): set size, a 128-bit digest of the set, and its signature."""
    schema = "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"{c} long" for c in sig.columns())
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_fingerprints(sig, width), schema)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 75, sig: Signature = Signature(),
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept). Links: 100 * |A and B| >= percent * |A or B|.

    Documents with the same shingle set are one class and need one signature. Classes that share a key of a chunk are
    candidates. First every class is paired with the smallest class of each of its buckets, so that a group of near
    copies costs one pair per member and key; the pairs that hold on the whole sets are joined into components. Then
    the pairs of a bucket whose components differ are taken, without those too far apart by size, by the 1-bit parts
    or by a longer sketch that only classes in such buckets get, and confirmed in the same way. A pair within one component can't change the result and is never formed.

    Null and empty texts: no shingles, linked with nothing, kept. A null id: component null, kept. A repeated id is one
    node; all its rows are returned. Other columns, whatever their names, are not read.
    """
    prints = cut_lineage(fingerprints(docs, id_column, text_column, width, sig))
    member = prints.where("n_shingles > 0 and doc_id is not null")
    bits = [f"s{k}" for k in range(sig.longs)]
    classes = cut_lineage(member.groupBy("d0", "d1").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(s).alias(s) for s in sig.columns()]))

    keys = _key_rows(classes, sig)
    shared = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    buckets = cut_lineage(keys.join(shared, "key"))

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    looks = classes.select("rep", "n", *bits)

    def near(columns: list[str]) -> Column:
        distance = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in columns), F.lit(0))
        return distance <= sig.far(percent, len(columns))

    close = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & near(bits)

    def confirmed(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(texts.withColumnRenamed("text", "text_a"), F.col("a") == F.col("id")).drop("id")
        rows = rows.join(texts.withColumnRenamed("text", "text_b"), F.col("b") == F.col("id")).drop("id")
        return cut_lineage(rows.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a long, b long"))

    stars = buckets.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(looks.alias("x"), F.col("a") == F.col("x.rep")).join(looks.alias("y"), F.col("b") == F.col("y.rep"))
    links = confirmed(stars.where(close).select("a", "b"))
    joined = cut_lineage(components(links))

    # A key is open while its classes lie in different components.
    placed = buckets.select("key", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    opened = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = cut_lineage(placed.join(opened, "key", "left_semi"))
    sharp = [f"t{k}" for k in range(sig.sharp)]
    sketched = rest.select("rep").distinct().join(texts, F.col("rep") == F.col("id")).select("rep", "text")
    sketched = sketched.mapInArrow(_sketches(sig.sharp, width), "rep long, " + ", ".join(f"{t} long" for t in sharp))
    own_keys = rest.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    rest = cut_lineage(rest.join(looks, "rep").join(own_keys, "rep").join(sketched.dropDuplicates(["rep"]), "rep"))
    # A pair that shares many keys is formed at the smallest of them only.
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    pairs = rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))
                                 & (F.col("x.component") != F.col("y.component")) & close & near(sharp) & once)
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).join(
        stars.select("a", "b"), ["a", "b"], "left_anti")
    more = confirmed(pairs)

    same_set = member.select("doc_id", "d0", "d1").distinct().join(classes.select("d0", "d1", "rep"), ["d0", "d1"]).where("rep <> doc_id")
    edges = links.unionByName(more).unionByName(same_set.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    found = components(edges)
    result = prints.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
