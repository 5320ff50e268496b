"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepframe.llm.tokens import Encoder
from stepframe.sizing import cut_lineage

END_OF_DOCUMENT = 2
CAPACITY = 1024


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, counts = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                ends = np.cumsum(counts)
                rows, number, start, length, buffers = [], [], [], [], []
                for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
                    own = np.append(ids[end - n:end], end_id).astype("<u4")
                    low, high, k = 0, (n + 1) % capacity or capacity, 0
                    while low <= n:
                        rows.append(i)
                        number.append(k)
                        start.append(low)
                        length.append(high - low)
                        buffers.append(own[low:high].tobytes())
                        low, high, k = high, high + capacity, k + 1
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(buffers, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's token ids and `end_id`, cut only where they exceed the capacity.

    All pieces of a text but the first have exactly `capacity` ids. `ids` holds them as unsigned little-endian 32-bit
    numbers. A null text is an empty one and gives one piece that holds `end_id`; a null id is kept.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_cut(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids binary")


class OpenBins:
    """How many open bins have each remaining capacity, under a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._any = [False] * (2 * self._leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node = self._leaves + room
        self._any[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]

    def push(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least this: up to a right sibling, then down."""
        node = self._leaves + least
        if node < 2 * self._leaves and self._any[node]:
            return least
        while node > 1 and not (node % 2 == 0 and self._any[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self._leaves:
            node = 2 * node if self._any[2 * node] else 2 * node + 1
        return node - self._leaves


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: (length, first rank, end rank, sequence of the first rank, offset).

    Pieces of one length are interchangeable, so a run of bins with the same remaining capacity is filled at once: after
    a piece is put in, its bin is the tightest one for the next piece of that length, as long as that fits. The
    result is that of taking the pieces one by one, in a time that depends on the capacity and not on their number.
    """
    bins, moves, opened = OpenBins(capacity), [], 0

    def fill(length: int, rank: int, left: int, room: int, first: int, count: int) -> tuple[int, int]:
        """As many pieces as the run takes; the number placed in it, and the bins it used."""
        each = room // length
        whole = min(count, left // each)
        for k in range(each if whole else 0):
            moves.append((length, rank + k * whole, rank + (k + 1) * whole, first, capacity - room + k * length))
        bins.push(room - each * length, first, whole)
        placed, used = each * whole, whole
        if whole < count and (over := left - placed):
            for k in range(over):
                moves.append((length, rank + placed + k, rank + placed + k + 1, first + whole, capacity - room + k * length))
            bins.push(room - over * length, first + whole, 1)
            placed, used = placed + over, used + 1
        bins.push(room, first + used, count - used)
        return placed, used

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                first, count = opened, -(-left // (capacity // length))
                placed, used = fill(length, rank, left, capacity, first, count)
                opened += used
            else:
                placed, _ = fill(length, rank, left, room, *bins.pop(room))
            rank, left = rank + placed, left - placed
    return moves


def pack(items: DataFrame, length_column: str, order: list[str], capacity: int = CAPACITY, rows_per_block: int = 200_000) -> DataFrame:
    """The items with `sequence_id` and `offset`, packed best-fit decreasing over the whole table; no item is cut.

    The counts per length, at most `capacity` numbers, give the packing plan; the plan says for each run of ranks of a
    length where it goes. Items get their rank within their length from block counts and a window in blocks of
    about `rows_per_block` rows, so that a length which most items have is spread over many tasks. `order` must tell
    apart all items that are not alike. Lengths must lie in 1..capacity. An empty table gives an empty one.
    """
    spark = items.sparkSession
    size = F.col(length_column)
    rows = items.select(F.count("*"), F.min(size), F.max(size), F.count(size)).first()
    if rows[0] and (rows[3] < rows[0] or rows[1] < 1 or rows[2] > capacity):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    blocks = -(-rows[0] // rows_per_block) or 1
    dealt = items.withColumns({"_block": F.pmod(F.xxhash64(*order), F.lit(blocks))})
    counts = cut_lineage(dealt.groupBy(size.alias("_length"), "_block").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("count")).collect()}
    moves = spark.createDataFrame(plan(histogram, capacity), "_of long, _from long, _to long, _bin long, _at long")
    in_length = Window.partitionBy("_length").orderBy("_block")
    before = counts.withColumn("_before", F.sum("count").over(in_length) - F.col("count")).drop("count")
    in_block = Window.partitionBy(size, "_block").orderBy(*order)
    ranked = dealt.withColumn("_n", F.row_number().over(in_block)).join(
        before.withColumnRenamed("_block", "_of_block"), (size == F.col("_length")) & (F.col("_block") == F.col("_of_block")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_n") - 1)
    # The plan's size depends on the capacity alone.
    placed = ranked.join(F.broadcast(moves), (size == F.col("_of")) & F.col("_rank").between(F.col("_from"), F.col("_to") - 1))
    return placed.select(*[F.col(c) for c in items.columns], (F.col("_bin") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_at").alias("offset"))
