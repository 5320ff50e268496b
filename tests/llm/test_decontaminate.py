import random

import numpy as np

from stepframe.llm.decontaminate import GAP, MATCH, MISMATCH, _best_end, contaminated


def brute_score(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = max(0, table[i][j] + (MATCH if a[i] == b[j] else MISMATCH), table[i][j + 1] + GAP, table[i + 1][j] + GAP)
    return table.max()


def test_alignment_score():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rnd.integers(0, 4, rnd.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert _best_end(a, b)[0] == brute_score(a, b)


def test_planted_copies(spark):
    rnd = random.Random(2)
    vocabulary = [f"word{k}" for k in range(2000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.randint(15, 50)) for _ in range(20)]
    docs, planted = [], set()
    for d in range(120):
        words = text(rnd.randint(0, 300))
        if d % 3 == 0:
            k = rnd.randrange(20)
            copy = [w for w in items[k] if rnd.random() > 0.04]
            copy = [rnd.choice(vocabulary) if rnd.random() < 0.1 else w for w in copy]
            words[len(words) // 2:len(words) // 2] = [w.upper() + rnd.choice(["", ",", "!"]) for w in copy]
            planted.add((d, k))
        docs.append((d, " ".join(words), 0))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None), (51, ""), (52, "too short")], "item_id long, text string")
    frame = spark.createDataFrame(docs + [(500, None, 1), (501, "", 1), (None, " ".join(items[3]), 1)], "doc_id long, text string, item_id int")
    for size in (1 << 19, 200):
        got = contaminated(frame, bench, words_per_block=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == planted | {(None, 3)}
        assert len(got) == len(planted) + 1
        for r in got:
            if r.doc_id is None:
                assert (r.first_word, r.end_word, r.score) == (0, len(items[3]), 1.0)
    assert contaminated(frame, bench.limit(0)).count() == 0 and contaminated(frame.limit(0), bench).count() == 0
