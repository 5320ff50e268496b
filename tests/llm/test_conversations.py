"""Repairs against all cheapest edits, found by a search over whole letter strings."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from stepframe.llm.conversations import damage, repair, repair_damaged

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows, faults):
    """The least (cost, letters, lines) over all edits whose role initials match the pattern."""
    after = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, said, inserted):
        found = [(0, "", ())] if i == len(rows) and said in ("", "a") else []

        def go(cost, letter, line, *state):
            rest = best(*state)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))

        if inserted < 3:
            for name in ("user", "assistant"):
                if (said, name[0]) in after:
                    go(2, "I", name + ":", i, name[0], inserted + 1)
        if i < len(rows):
            role, text = rows[i]
            go(3, "D", None, i + 1, said, 0)
            if faults[i] not in ("blank", "duplicate"):
                cut = int(faults[i] == "truncated")
                if (said, role[:1]) in after:
                    go(cut, "K", f"{role}:{text}", i + 1, role[:1], 0)
                for name in ("user", "assistant"):
                    if (said, name[0]) in after:
                        go(2 + cut, "R", f"{name}:{text}", i + 1, name[0], 0)
        return min(found, default=None)

    return best(0, "", 0)


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], hashlib.sha256((" " if r[2] is None else r[2]).encode()).digest()))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs, seen, faults = [(" " if r[1] is None else r[1], " " if r[2] is None else r[2]) for r in rows], set(), []
    for pair in pairs:
        core = re.findall(r"[^\x20\x09-\x0D]", pair[1])
        faults.append("blank" if not core else "duplicate" if pair in seen else "truncated" if core[-1] not in ".!?" else "none")
        seen.add(pair)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, lines = cheapest(pairs, faults)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _compare(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("mine")).repartition(5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair(df, **options).select(*COLUMNS).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[1:])
    assert set(got) == set(by_conv)
    for conv, mine in by_conv.items():
        assert got[conv] == expected(conv, mine), (conv, mine)


def _random_rows(rnd, conversations, longest):
    texts = ["Yes.", "No", "Why? ", "", " \t", "Fine!", "and ", "so. ", "Yes."]
    rows = []
    for c in range(conversations):
        for t in range(rnd.randrange(1, longest)):
            turn = None if rnd.random() < 0.05 else rnd.randrange(-2, longest)
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uma"])
            rows.append((c if c else None, turn, role, rnd.choice([*texts, None, f"t{t}.", f"t{t}"])))
    return rows


def test_same_as_all_edits(spark):
    _compare(spark, _random_rows(random.Random(5), 150, 9))


@pytest.mark.parametrize("ranges", [1, 30, 400])
def test_a_conversation_over_many_ranges(spark, ranges):
    rnd = random.Random(6)
    rows = _random_rows(rnd, 12, 8) + [(77, t, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b", "", f"c{t}!", f"d{t}"])) for t in range(120)]
    _compare(spark, rows, ranges=ranges)


def test_copies_without_end(spark):
    _compare(spark, [(1, 5, "user", "Same.")] * 60 + [(1, 6, "assistant", "So."), (2, None, None, None), (3, 2**63 - 1, "user", "Hi."), (3, 0, "assistant", "Ho.")], ranges=20)


def test_very_long_text(spark):
    words = "long words. " * 400_000
    _compare(spark, [(1, 0, "user", words), (1, 1, "assistant", words + "end"), (1, 2, "assistant", "a" * 5_000_000 + ".")], ranges=3)


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. Right?") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        kept.setdefault(c, []).extend([row[1:]] * (0 if fault == 0 else 2 if fault == 3 else 1))
    assert sorted(damage(df).collect(), key=str) == sorted(((c, *r) for c, mine in kept.items() for r in mine), key=str)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair_damaged(df).collect()}
    assert got == {c: expected(c, mine) for c, mine in kept.items()}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_empty_table(spark):
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
