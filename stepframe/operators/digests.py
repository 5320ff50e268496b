"""Digests of two versions of a table that are compared instead of their rows.

Ranges of the key hash have a digest each that does not depend on the order of rows; only ranges whose digests differ are
opened. Without keys, a fixed number of cells of count and hash sums per side (an invertible Bloom lookup table) is
subtracted and peeled to the row hashes whose numbers of copies differ.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.sizing import cut_counting

# Bits of the key hash that name a range, level by level: at most 2**18 ranges are ever named, a broadcast of some MB.
RANGE_BITS = (9, 18)
# Cells of each of the three parts of a lookup table; a table gives back about as many hashes as a part has cells, twice over.
PART_CELLS = (2**14, 2**17)
_LOW = 0xFFFFFFFF


def _sums(value: str) -> list[Column]:
    """Signed sums of both halves of a hash; NULL, which equals nothing, if a long does not hold them."""
    return [F.try_sum(F.col("__sign") * F.shiftright(value, 32)).alias(f"{value}_high"), F.try_sum(F.col("__sign") * F.col(value).bitwiseAND(_LOW)).alias(f"{value}_low")]


def _signed(ref: DataFrame, actual: DataFrame) -> DataFrame:
    return ref.withColumn("__sign", F.lit(1).cast("long")).unionByName(actual.withColumn("__sign", F.lit(-1).cast("long")))


def range_of(key_hash: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - bits)


def differing_ranges(ref: DataFrame, actual: DataFrame, levels: Sequence[int] = RANGE_BITS) -> tuple[int, DataFrame]:
    """(bits, frame of `range`) of the ranges of key hashes `__k` whose row hashes `__r` differ between the sides.

    Each level is one aggregate over both sides with a row for each range that is open. Where more than half of the ranges
    differ, a deeper level would not save anything.
    """
    both, known = _signed(ref.select("__k", "__r"), actual.select("__k", "__r")), None
    for bits in levels:
        rows = both if known is None else both.join(F.broadcast(known[1]), range_of(F.col("__k"), known[0]) == F.col("range"), "left_semi")
        digests = rows.groupBy(range_of(F.col("__k"), bits).alias("range")).agg(F.sum("__sign").alias("rows"), *_sums("__r"))
        same = (F.col("rows") == 0) & (F.col("__r_high") == 0) & (F.col("__r_low") == 0)
        found, n = cut_counting(digests.where(~F.coalesce(same, F.lit(False))).select("range"), differ=F.lit(True))
        known = bits, found
        if not 0 < n["differ"] <= 2**bits // 2:
            break
    return known


def _check(value: int) -> int:
    """Spark's `xxhash64` of one long."""
    found = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed=42)
    return found - (1 << 64) if found >> 63 else found


def _places(value: int, cells: int) -> list[int]:
    return [part * cells + ((value >> (21 * part)) & (cells - 1)) for part in range(3)]


def peeled(table: dict[int, list[int]], cells: int) -> dict[int, int] | None:
    """{hash: copies on the first side less copies on the second} from {cell: [count, hash sum, check sum]}; None if it gets stuck."""
    found: dict[int, int] = {}
    waiting = list(table)
    while waiting:
        place = waiting.pop()
        count, total, checks = table[place]
        if not count or total % count:
            continue
        value = total // count
        if not -(1 << 63) <= value < 1 << 63 or checks != count * _check(value) or place not in _places(value, cells):
            continue
        found[value] = found.get(value, 0) + count
        for other in _places(value, cells):
            cell = table[other]
            cell[0] -= count
            cell[1] -= total
            cell[2] -= checks
            waiting.append(other)
    return None if any(any(cell) for cell in table.values()) else {h: n for h, n in found.items() if n}


def differing_hashes(ref: DataFrame, actual: DataFrame, sizes: Sequence[int] = PART_CELLS) -> dict[int, int] | None:
    """{row hash: copies in ref less copies in actual} of the hashes `__h` whose copies differ; None if they are too many.

    One pass over both sides for each size tried; what reaches the driver is three times the cells of a part at most,
    whatever the tables' sizes. A table that is full beyond hope is followed by one whose size the empty cells suggest.
    """
    both = _signed(ref.select("__h"), actual.select("__h")).withColumn("__c", F.xxhash64("__h"))
    least = 0.0
    for cells in sizes:
        if cells < least:
            continue
        places = F.array(*[F.lit(part * cells) + F.shiftright("__h", 21 * part).bitwiseAND(cells - 1) for part in range(3)])
        sums = both.select(F.explode(places).alias("cell"), "__sign", "__h", "__c").groupBy("cell").agg(F.sum("__sign").alias("n"), *_sums("__h"), *_sums("__c"))
        changed = sums.where(~F.coalesce((F.col("n") == 0) & (F.col("__h_high") == 0) & (F.col("__h_low") == 0) & (F.col("__c_high") == 0) & (F.col("__c_low") == 0), F.lit(False)))
        rows = changed.collect()
        if any(None in row for row in rows):
            return None
        table = {row.cell: [row.n, (row["__h_high"] << 32) + row["__h_low"], (row["__c_high"] << 32) + row["__c_low"]] for row in rows}
        found = peeled(table, cells)
        if found is not None:
            return found
        # Of so many cells hit by d hashes, about exp(-d / cells) stay empty.
        empty = 1 - len(rows) / (3 * cells)
        least = cells * max(2.0, 8.0 if empty <= 0.001 else -math.log(empty))
    return None
