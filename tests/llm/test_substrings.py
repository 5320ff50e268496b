import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepframe.llm.substrings import Automaton, least_places, remove_repeats


def brute(texts, width):
    lists = [(t or "").encode().split() for t in texts]
    places = {}
    for d, ws in enumerate(lists):
        for i in range(len(ws) - width + 1):
            places.setdefault(tuple(ws[i:i + width]), []).append((d, i))
    gone = [set() for _ in lists]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + width))
    return [(len(ws), len(g), b" ".join(w for i, w in enumerate(ws) if i not in g).decode()) for ws, g in zip(lists, gone)]


def _compare(spark, texts, width=6, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("spans", F.lit(1)).repartition(4)
    out = remove_repeats(df, width=width, **({"seed": min(3, width)} | options))
    assert out.columns == ["doc_id", "text", "spans", "n_words", "n_removed", "kept_text"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()}
    want = dict(enumerate(brute(texts, width)))
    assert got == want


def _texts(rnd, n, vocabulary):
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]
    for _ in range(n // 2):
        a, b = rnd.choice(texts).split(), rnd.choice(texts).split()
        i, j = rnd.randrange(len(a) + 1), rnd.randrange(len(b) + 1)
        texts.append(" ".join(a[i:i + rnd.randrange(3, 25)] + b[:j]) + rnd.choice(["", "\n", "\t tail", " \x85end"]))
    return texts


@pytest.mark.parametrize("options", [{}, {"stretches_per_seed": 0}, {"stretches_per_seed": 3, "shard_words": 50}, {"seed": 1}, {"seed": 6}])
def test_same_as_all_windows(spark, options):
    rnd = random.Random(9)
    few, many = list("abc"), [f"w{i}" for i in range(60)] + ["W1", "wé", " "]
    _compare(spark, [*_texts(rnd, 30, few), *_texts(rnd, 60, many), None, "", " \n", "a a a a a a a a a a a", "W1 w2"], **options)


def test_full_width_and_boilerplate(spark):
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(5000)]
    boiler = [" ".join(rnd.choice(words) for _ in range(k)) for k in (12, 34, 35, 80)]
    texts = [" ".join([*rnd.choices(words, k=40), rnd.choice(boiler), *rnd.choices(words, k=40)]) for _ in range(80)]
    _compare(spark, [*texts, texts[0], texts[1] + " x", "  ".join(texts[2].split())], width=35, seed=10, stretches_per_seed=5, shard_words=500)


def test_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    long = " ".join(f"q{i}" for i in range(300_000))
    _compare(spark, [f"{long} {passage} end", f"start {passage}", "z " * 200_000], width=35, seed=10)


def test_nothing(spark):
    _compare(spark, [])
    _compare(spark, [None, "", "one"])


def test_automaton_counts_places():
    a = Automaton([[1, 2, 3, 1, 2], [2, 3, 4], [9, 9, 9]], [1, 1, 5])
    assert a.repeated_spans([1, 2, 3, 4], 2) == [(0, 3)]
    assert a.repeated_spans([1, 2, 3, 4], 3) == []
    assert a.repeated_spans([9, 9, 9, 9], 3) == [(0, 4)]
    rnd = np.random.default_rng(3)
    for span in (1, 2, 5, 8, 13):
        values = rnd.integers(0, 9, 50)
        assert least_places(values, span).tolist() == [i + int(values[i:i + span].argmin()) for i in range(50 - span + 1)]
