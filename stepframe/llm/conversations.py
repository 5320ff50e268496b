"""Repair of conversations: a cost dynamic program, then prefix-doubling ranking of its optimal arcs.

After a conversation's first row a system turn, then user and assistant turns in turns, make it whole. The cheapest edits
are found by a minimum-plus product over four states (nothing yet, system, user, assistant said last); among equally
cheap edits the letter string that sorts first is taken: optimal arcs are ranked by their least continuations of 1, 2, 4 ...
letters, and the path is read off the doubled pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.ranges import plan_ranges
from stepframe.semantics import Key
from stepframe.sizing import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
_FAR = 1 << 60
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
# The state after an inserted turn, or after a row whose role is changed.
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])
_TURN = {_USER: "user", _ASSISTANT: "assistant"}
# The state after a kept row, by state and initial (s, u, a, other); -1 where it may not stand.
_KEPT = np.array([[_SYSTEM, _USER, -1, -1], [-1, _USER, -1, -1], [-1, -1, _ASSISTANT, -1], [-1, _USER, -1, -1]])
_AT_END = np.array([0, 4, 2, 0])
_CHUNK = 1 << 22


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls in role and text as one space, damaged by crc32(`conv_id:turn`) % 20.

    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets role user; a null in the hashed key is one space too.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hit = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
                      F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fault.alias("fault")).where("fault <> 0")
    return hit.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fault", "copy")


def judged(rows: DataFrame) -> DataFrame:
    """Each row with its order within the turn (role, text digest, copy) and its first fault: blank, duplicate, truncated or none.

    Equal rows are counted, not gathered, so one text that is repeated without end stays spread; text is null where the
    row must go anyway.
    """
    bare = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    alike = bare.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    seen = alike.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", F.lit(True).alias("again"))
    marked = alike.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    new = F.col("again").isNull() | F.col("turn").eqNullSafe(F.col("first.turn"))
    core = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(core == "", "blank").when((F.col("copy") > 1) | ~new, "duplicate")
             .when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none"))
    each = marked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("fault", fault)
    return each.select("conv_id", "turn", "role", "digest", "copy", "fault", F.when(F.col("fault").isin("truncated", "none"), F.col("text")).alias("text"))


def _steps() -> np.ndarray:
    """Cost from state to state of inserts and then one row, for each kind of row: 0 must go, 1 + 2 * initial + truncated."""
    inserts = np.full((4, 4), _FAR)
    for q in range(4):
        inserts[q, q] = 0
        inserts[q, _NEXT[q]] = 2
        inserts[q, _NEXT[_NEXT[q]]] = min(inserts[q, _NEXT[_NEXT[q]]], 4)
    tables = []
    for kind in range(9):
        row = np.full((4, 4), _FAR)
        for q in range(4):
            row[q, q] = 3
            if kind:
                initial, cut = divmod(kind - 1, 2)
                row[q, _NEXT[q]] = min(row[q, _NEXT[q]], 2 + cut)
                if _KEPT[q, initial] >= 0:
                    row[q, _KEPT[q, initial]] = min(row[q, _KEPT[q, initial]], cut)
        tables.append((inserts[:, :, None] + row[None, :, :]).min(axis=1))
    return np.minimum(np.array(tables), _FAR)


_STEP = _steps()


def suffix_products(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per row the minimum-plus product from it to the end of its segment (`ends`, exclusive), by doubling."""
    product, reach, places = _STEP[kinds], 1, np.arange(len(kinds))
    while reach < (ends - places).max(initial=0):
        inner = np.flatnonzero(places + reach < ends)
        right = product[inner + reach]
        left = product[inner]
        best = left[:, :, 0, None] + right[:, 0, None, :]
        for k in range(1, 4):
            np.minimum(best, left[:, :, k, None] + right[:, k, None, :], out=best)
        product[inner] = np.minimum(best, _FAR)
        reach *= 2
    return product


class Ranked:
    """Nodes (place, state) of some segments with their cost to the end, their least arc, and doubled pointers along it."""

    def __init__(self, kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: np.ndarray, last: np.ndarray):
        """`after`: cost to the end of the conversation, by state, behind each segment; `last`: nothing follows it."""
        n, segments = len(kinds), len(lengths)
        segment = np.repeat(np.arange(segments), lengths)
        product = suffix_products(kinds, (starts + lengths)[segment])
        # A segment of k rows has k + 1 places; row r lies between places r + segment and r + segment + 1.
        self.first = starts + np.arange(segments)
        self.end = self.first + lengths
        self.row = np.full(n + segments, -1)
        place = np.arange(n) + segment
        self.row[place] = np.arange(n)
        self.cost = np.zeros((n + segments, 4), np.int64)
        self.cost[self.end] = after
        self.cost[place] = (product + after[segment][:, None, :]).min(axis=2)
        self._arcs(kinds, place, last)
        self._double()

    def _arcs(self, kinds: np.ndarray, place: np.ndarray, last: np.ndarray) -> None:
        states = np.arange(4)
        cost, kind = self.cost[place], kinds[:, None]
        initial, cut = np.divmod(np.maximum(kinds - 1, 0), 2)
        kept = _KEPT[:, initial].T
        kept_cost = np.take_along_axis(self.cost[place + 1], np.maximum(kept, 0), axis=1)
        self.target = np.full((len(self.cost), 4, 4), -1)
        target, nodes = self.target, 4 * (place[:, None] + 1)
        target[place, :, 0] = np.where(3 + self.cost[place + 1] == cost, nodes + states, -1)
        target[place, :, 1] = np.where(2 + cost[:, _NEXT] == cost, 4 * place[:, None] + _NEXT, -1)
        target[place, :, 2] = np.where((kind > 0) & (kept >= 0) & (cut[:, None] + kept_cost == cost), nodes + kept, -1)
        target[place, :, 3] = np.where((kind > 0) & (2 + cut[:, None] + self.cost[place + 1][:, _NEXT] == cost), nodes + _NEXT, -1)
        # Behind the last row, turns that are missing are put in; between segments the next one does that.
        end = self.end[last]
        target[end, _SYSTEM, 1], target[end, _USER, 1] = 4 * end + _USER, 4 * end + _ASSISTANT
        self.target = target.reshape(-1, 4)

    def _double(self) -> None:
        """Rank arcs by their least strings of 1, 2, 4 ... letters. The arcs that leave a node have different letters, so
        the least arc of a node is known from its ranks at every length; a string that has ended sorts first."""
        is_arc = self.target >= 0
        rank = np.where(is_arc, np.arange(1, 5), _FAR)
        end = np.where(is_arc, self.target, 0)
        nodes = np.arange(len(rank))
        stops = ~is_arc.any(axis=1)
        self.jumps: list[np.ndarray] = []
        while True:
            best = rank.argmin(axis=1)
            self.jumps.append(np.where(stops, nodes, end[nodes, best]))
            if stops[self.jumps[-1]].all():
                break
            least = np.where(stops, 0, rank[nodes, best])
            pair = rank[is_arc] * (int(least.max()) + 1) + least[end[is_arc]]
            rank[is_arc] = np.unique(pair, return_inverse=True)[1] + 1
            end = np.where(is_arc, self.jumps[-1][end], 0)
        self.letter, self.stops = np.where(stops, -1, best), stops

    def paths(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes of all least paths one after the other without their ends, length of each, end of each)."""
        at, length = start.copy(), np.zeros(len(start), np.int64)
        for k in reversed(range(len(self.jumps))):
            goes = ~self.stops[self.jumps[k][at]]
            at[goes] = self.jumps[k][at[goes]]
            length += goes * (1 << k)
        length += ~self.stops[start]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        nodes = np.repeat(start, length)
        for k in range(len(self.jumps)):
            odd = (step >> k) & 1 == 1
            nodes[odd] = self.jumps[k][nodes[odd]]
        return nodes, length, self.jumps[-1][start]


def _kinds(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row kinds for the step table, and initials (s, u, a, other)."""
    roles = batch.column("role").to_pylist()
    initial = np.fromiter((("sua".find(r[0]) if r else -1) % 4 for r in roles), np.int64, len(roles))
    faults = np.array(batch.column("fault").to_pylist(), dtype=object)
    alive = (faults == "none") | (faults == "truncated")
    return np.where(alive, 1 + 2 * initial + (faults == "truncated"), 0), initial


def _whole_cells(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Some thousand rows at a time, cut where a cell (conversation and range) begins (n = 1)."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        begins = np.flatnonzero(batch.column("n").to_numpy() == 1)
        if rows + batch.num_rows >= least and len(begins) and (rows or begins[-1]):
            yield pa.Table.from_batches([*kept, batch.slice(0, int(begins[-1]))])
            kept, rows, batch = [], 0, batch.slice(int(begins[-1]))
        kept.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(kept)


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    starts = np.flatnonzero(table.column("n").to_numpy() == 1)
    lengths = np.diff(np.append(starts, table.num_rows))
    at = pa.array(starts)
    return starts, lengths, list(zip(table.column("conv_id").take(at).to_pylist(), table.column("cell").take(at).to_pylist()))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell of a conversation that lies across a border: its cost from state to state and its last initial."""
    for table in _whole_cells(batches):
        starts, lengths, keys = _cells(table)
        kinds, initial = _kinds(table)
        product = suffix_products(kinds, np.repeat(starts + lengths, lengths))[starts].reshape(len(starts), 16)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], table.schema.field("conv_id").type), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array(list(product), pa.list_(pa.int64())), pa.array(initial[starts + lengths - 1], pa.int64())],
                                         names=["conv_id", "cell", "product", "last"])


def _ranked(table: pa.Table, carried: dict) -> tuple[Ranked, np.ndarray, list[tuple], np.ndarray, np.ndarray]:
    starts, lengths, keys = _cells(table)
    kinds, initial = _kinds(table)
    known = [carried.get(k) for k in keys]
    after = np.array([_AT_END if x is None else x["after"] for x in known]).reshape(-1, 4)
    last = np.array([x is None or x["last"] for x in known], bool)
    return Ranked(kinds, starts, lengths, after, last), starts, keys, initial, lengths


def _exits(carried: dict):
    """Per cell the state at its end for each state at its beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            ranked, _, keys, _, _ = _ranked(table, carried)
            start = (4 * ranked.first[:, None] + np.arange(4)).ravel()
            exits = (ranked.paths(start)[2] % 4).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], table.schema.field("conv_id").type), pa.array([k[1] for k in keys], pa.int32()),
                                              pa.array(list(exits), pa.list_(pa.int64()))], names=["conv_id", "cell", "exits"])

    return run


_REPAIRED = "cell int, chunk int, illegal long, cost long, audit string, sha256 string, part binary"


def _repaired(carried: dict):
    """Per cell its audit letters and cost; the hash of the repaired conversation where the cell holds all of it, else its bytes."""
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            ranked, starts, keys, initial, lengths = _ranked(table, carried)
            known = [carried.get(k) for k in keys]
            begin = np.array([_START if x is None else x["begin"] for x in known])
            start = 4 * ranked.first + begin
            nodes, steps, _ = ranked.paths(start)
            letters = ranked.letter[nodes]
            audit = np.frombuffer(LETTERS.encode(), np.uint8)[letters].tobytes().decode()
            pair = np.append(~legal[initial[:-1], initial[1:]], False)
            pair[starts + lengths - 1] = False
            illegal = np.add.reduceat(pair, starts) if len(starts) else np.zeros(0, np.int64)
            roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
            rows, turns = ranked.row[nodes // 4].tolist(), _NEXT[nodes % 4].tolist()
            out: list[tuple] = []
            at = 0
            for k, (key, n) in enumerate(zip(keys, steps.tolist())):
                x = known[k]
                lines = []
                for letter, row, turn in zip(letters[at:at + n].tolist(), rows[at:at + n], turns[at:at + n]):
                    if letter == 1:
                        lines.append(_TURN[turn] + ":")
                    elif letter:
                        lines.append(f"{roles[row] if letter == 2 else _TURN[turn]}:{texts[row]}")
                wrong = int(illegal[k])
                cost = int(ranked.cost.reshape(-1)[start[k]])
                if x is None:
                    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
                    out.append((*key, 0, wrong, cost, audit[at:at + n], digest, None))
                else:
                    if x["before"] is not None:
                        wrong += int(not legal[x["before"], initial[starts[k]]])
                    # Each line with its own end; the last one of all is taken off when they are hashed.
                    data = "".join(line + "\n" for line in lines).encode()
                    out.append((*key, 0, wrong, cost if x["before"] is None else None, audit[at:at + n], None, data[:_CHUNK]))
                    out.extend((*key, c, 0, None, None, None, data[c * _CHUNK:(c + 1) * _CHUNK]) for c in range(1, -(-len(data) // _CHUNK)))
                at += n
            columns = list(zip(*out))
            kinds = [table.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "cell", "chunk", "illegal", "cost", "audit", "sha256", "part"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of parts that come one after the other, without the line end behind the last."""
    state, held, conv, kind = None, b"", None, None

    def done() -> pa.RecordBatch:
        state.update(held[:-1])
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if row["n"] == 1:
                if state is not None:
                    yield done()
                state, held, conv = hashlib.sha256(), b"", row["conv_id"]
            if row["part"]:
                state.update(held)
                held = row["part"]
    if state is not None:
        yield done()


def _carried(pieces: list, exits: Callable[[dict], list]) -> dict:
    """For cells of conversations across borders: cost behind them, state and initial they begin with. At most two for each range."""
    by_conv: dict = {}
    for row in sorted(pieces, key=lambda r: r.cell):
        by_conv.setdefault(row.conv_id, []).append(row)
    found: dict = {}
    for conv, cells in by_conv.items():
        after = _AT_END
        for i in reversed(range(len(cells))):
            found[conv, cells[i].cell] = {"after": after, "last": i == len(cells) - 1, "before": cells[i - 1].last if i else None, "begin": _START}
            after = (np.array(cells[i].product).reshape(4, 4) + after).min(axis=1)
    if any(len(cells) > 1 for cells in by_conv.values()):
        ways = {(r.conv_id, r.cell): r.exits for r in exits(found)}
        for conv, cells in by_conv.items():
            state = _START
            for cell in cells:
                found[conv, cell.cell]["begin"] = state
                state = ways[conv, cell.cell][state]
    # Those that lie in one range after all need nothing.
    return {k: x for k, x in found.items() if len(by_conv[k[0]]) > 1}


def repair(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256; needs conv_id, turn, role, text.

    Rows go by turn (nulls first), then role, then the SHA-256 of the text. A null role or text is one space; a null conv_id
    is a conversation of its own; other columns play no part. A role that is empty or begins with none of s, u, a may not be
    kept. A blank row has only `[\\x20\\x09-\\x0D]`, a duplicate has the role and text of an earlier row; both are deleted. Faults are
    counted once a row, in the order blank, duplicate, truncated. Gaps beyond a long count as the greatest long.

    Conversations are cut into ranges of rows, so one of any length is worked off in parts: what lies behind a part is its
    cost by state, what lies before it one state. Only the bytes for the SHA-256 of such a conversation go through one task
    one after the other, as that hash demands, and its letters form one string.
    """
    each = cut_lineage(judged(rows))
    keys = [Key("turn"), Key("role"), Key("digest"), Key("copy")]
    cut = plan_ranges(each, ["conv_id"], keys, count=ranges)
    in_cell = Window.partitionBy("conv_id", "cell").orderBy(*[k.column() for k in keys])
    slim = ["conv_id", "cell", "n", "role", "fault"]

    def numbered(frame: DataFrame) -> DataFrame:
        return cut.number(frame, "cell").withColumn("n", F.row_number().over(in_cell))

    across = numbered(cut.across_borders(each.drop("text"))).select(*slim)
    conv_type = each.schema["conv_id"].dataType.simpleString()
    # At most two cells for each range reach the driver, a few numbers each.
    pieces = across.mapInArrow(_products, f"conv_id {conv_type}, cell int, product array<long>, last long").collect()
    carried = _carried(pieces, lambda known: across.mapInArrow(_exits(known), f"conv_id {conv_type}, cell int, exits array<long>").collect())
    parts = numbered(each).select(*slim, "text").mapInArrow(_repaired(carried), f"conv_id {conv_type}, {_REPAIRED}")
    if carried:
        parts = cut_lineage(parts)
        line = Window.partitionBy("conv_id").orderBy("cell", "chunk")
        long = parts.where("part IS NOT NULL").select("conv_id", "part", F.row_number().over(line).alias("n"))
        hashes = long.mapInArrow(_hashed, f"conv_id {conv_type}, sha256 string")
        parts = parts.drop("part").unionByName(hashes, allowMissingColumns=True)
    decimal = "decimal(38,0)"
    span = F.max("turn").cast(decimal) - F.min("turn").cast(decimal) + 1 - F.count_distinct("turn")
    faults = each.groupBy("conv_id").agg(F.least(F.coalesce(span, F.lit(0).cast(decimal)), F.lit(2**63 - 1).cast(decimal)).cast("long").alias("gaps"),
                                         *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    whole = parts.select("conv_id", "cell", "illegal", "cost", "audit", "sha256").unionByName(faults, allowMissingColumns=True)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("cell", "audit")))), lambda x: x["audit"]), "")
    return _per_conversation(whole, letters)


def _per_conversation(rows: DataFrame, letters: Column) -> DataFrame:
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in longs], letters.alias("audit"),
                                       F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """All conversations, damaged and repaired; zeros, no letters and the hash of nothing where no row is left."""
    found = repair(damage(conversations), ranges)
    all_ids = conversations.select("conv_id").distinct().select(F.col("conv_id").alias("c"))
    joined = all_ids.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    defaults = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.select(F.col("c").alias("conv_id"), *[v.alias(c) for c, v in defaults.items()], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
