import random
from math import log2

import numpy as np

from pyspark.sql import functions as F

from stepframe.llm.langid import ORDER, fit, identify


def brute_bits(train, text):
    """Code length with escape method C, symbol by symbol, longest context first."""
    counts = {}
    for t in train:
        data = b"\0" * ORDER + t.lower().encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                own = counts.setdefault(data[i - k:i], {})
                own[data[i]] = own.get(data[i], 0) + 1
    data, total = b"\0" * ORDER + text.lower().encode(), 0.0
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            own = counts.get(data[i - k:i])
            if own is None:
                continue
            whole = sum(own.values()) + len(own)
            if data[i] in own:
                total -= log2(own[data[i]] / whole)
                break
            total -= log2(len(own) / whole)
        else:
            total += 8
    return total


def test_code_lengths_from_the_definition(spark):
    rnd = random.Random(1)
    make = lambda letters: "".join(rnd.choice(letters) for _ in range(60))
    train = {"aa": [make("abcd ") for _ in range(4)], "bb": [make("abxy é") for _ in range(4)]}
    rows = [(100 * k + i, t, lang) for k, (lang, texts) in enumerate(train.items()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, F.lit(True))
    tests = ["abab", "xyxé", "zzz", "a", "ABCD dcba", "é" * 20]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(tests):
        bits = {lang: brute_bits(texts, t) for lang, texts in train.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[i].lang_pred == best
        assert np.isclose(got[i].score, 1 / sum(2 ** (bits[best] - b) for b in bits.values()), rtol=1e-3)


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "der die das und " * 5 if i % 2 else "the of and to " * 5, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !? 34", "x"), (None, "the of", "x"), (5, "und der " * 200_000, "x"), (5, "to the", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    model = fit(train, F.col("doc_id") % 4 != 2)
    got = sorted(((r.doc_id or 0), r.lang_pred, r.score > 0) for r in identify(docs, model).collect())
    assert got == [(0, "en", True), (1, "und", False), (2, "und", False), (3, "und", False), (5, "de", True), (5, "en", True)]
    nothing = fit(train.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0
