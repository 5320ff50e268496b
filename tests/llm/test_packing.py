import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stepframe.llm import packing
from stepframe.llm.queries import tokenizer_file
from stepframe.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, length string, sequence_id int"


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


TEXTS = ["", None, "Don't  stop, they'll\n\n come 'at 10 ", "  ", "word " * 2000, "über die ẞ ²³\t\n x'", "a'sb 're x", "same", "same", "é" * 3000, "<|endoftext|>", "x" * 5000]


def test_encoder_gives_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr("stepframe.llm.tokens.CHUNK", 700)
    encoder = Encoder(tokenizer_file())
    for _ in range(2):
        ids, counts = encoder.encode([x or "" for x in TEXTS])
        at = 0
        for text, n in zip(TEXTS, counts.tolist()):
            assert ids[at:at + n].tolist() + [2] == reference_ids(text)
            at += n


def test_pieces_and_packing(spark):
    docs = spark.createDataFrame([(i if i else None, x, "en", "no", 1) for i, x in enumerate(TEXTS)], SCHEMA)
    cut = packing.pieces(docs, tokenizer_file())
    rows = cut.collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == (i or None)), key=lambda r: r.piece)
        ids = [y for r in own for y in struct.unpack(f"<{r.length}I", r.ids)]
        assert ids == reference_ids(text)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    packed = packing.pack(slim, "length", ["doc_id", "piece", "crc"], rows_per_block=3).collect()
    assert len(packed) == len(rows)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.crc == next(zlib.crc32(x.ids) for x in rows if (x.doc_id, x.piece) == (r.doc_id, r.piece))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def one_by_one(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        fitting = [(x, i) for i, x in enumerate(room) if x >= length]
        if fitting:
            room[min(fitting)[1]] -= length
        else:
            room.append(capacity - length)
    return sorted(room)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    import random

    rnd = random.Random(seed)
    capacity = rnd.choice([10, 37, 64])
    lengths = [rnd.randint(1, capacity) if seed % 2 else rnd.choice([3, 4, 7]) for _ in range(rnd.randint(1, 300))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    used, ranks = {}, {}
    for length, first, end, start, offset in packing.plan(histogram, capacity):
        for r in range(first, end):
            ranks.setdefault(length, []).append(r)
            used.setdefault(start + r - first, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for parts in used.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert sorted(capacity - sum(x[1] for x in parts) for parts in used.values()) == one_by_one(lengths, capacity)


def test_nothing_to_pack(spark):
    docs = spark.createDataFrame([], SCHEMA)
    cut = packing.pieces(docs, tokenizer_file())
    assert packing.pack(cut, "length", ["doc_id", "piece"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "a long, length long"), "length", ["a"])
