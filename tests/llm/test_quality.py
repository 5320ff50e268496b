import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stepframe.llm import quality
from stepframe.sizing import cut_lineage


def brute(train, docs, known):
    """Interpolated modified Kneser-Ney over token numbers, from the definition."""
    tri, bi, uni = Counter(), Counter(), Counter()
    for ids in train:
        for g in zip(ids, ids[1:], ids[2:]):
            tri[g] += 1
    for g in tri:
        bi[g[1:]] += 1
    for g in bi:
        uni[g[1:]] += 1

    def shares(counts):
        n = [max(sum(c == k for c in counts.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.1), (k + 1) * 0.9) for k in range(3)]
        whole, left = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            whole[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        return {g: (c - d[min(c, 3) - 1]) / whole[g[:-1]] for g, c in counts.items()}, {g: left[g] / whole[g] for g in whole}

    (p3, r3), (p2, r2), (p1, r1) = shares(tri), shares(bi), shares(uni)
    out = []
    for ids in docs:
        logs = [np.log(p3.get((a, b, c), 0) + r3.get((a, b), 1) * (p2.get((b, c), 0) + r2.get((b,), 1) * (p1.get((c,), 0) + r1[()] / (1 << quality.BITS)))) for a, b, c in zip(ids, ids[1:], ids[2:])]
        out.append(np.exp(-np.mean(logs)))
    return out


def test_perplexity_from_the_definition(spark):
    rnd = random.Random(3)
    words = ["the", "of", "in", "and", "House", "TREE,", "river.", "||"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    train, docs = [text(40) for _ in range(30)], [text(rnd.randint(1, 30)) for _ in range(20)] + ["", None, "zzz zzz zzz zzz", "the the the the the"]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality.perplexities(frame, spark.createDataFrame([(t,) for t in train], "text string")).collect()}
    hashes = np.concatenate([r[3] for r in quality._runs(pa.array(train))])
    keys, n = np.unique(hashes, return_counts=True)
    known = keys[n >= 2]
    tokens = lambda xs: [x.tolist() for x in quality._tokens(pa.array(xs, pa.string()), known)]
    want = brute(tokens(train), tokens(docs), known)
    assert np.allclose([got[i] for i in range(len(docs))], want, rtol=1e-4)


def test_decisions(spark):
    rnd = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    good = [(i, " ".join(rnd.choice(words) for _ in range(60)), "en", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "%%%" for w in rnd.choices(words, k=60)), "en", 0) for i in range(10)] + [(2000, "wab " * 300, "en", 0)]
    odd = [(None, "wab wcb", "en", None), (3000, None, "xx", None), (3001, "", None, None), (0, good[0][1], "en", 1)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, kept int")
    labels = docs.where("doc_id is not null and kept is not null").select("doc_id", F.col("kept").alias("quality"))
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(good + bad + odd)
    kept = {r.doc_id: r.kept for r in rows if r.doc_id is not None}
    assert not any(kept[x[0]] for x in bad) and kept[3000] and kept[3001]
    assert sum(not kept[x[0]] for x in good) <= 3
    assert all(r.kept for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_every_string_seen_twice_is_a_token(spark):
    rnd = random.Random(5)
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklmn" for b in "aeiou" for c in "bcdfghjklmnprst" for d in "aeiou"][:3000]
    chains = [" ".join(words[k:k + 20]) for k in range(0, 3000, 20)]
    frame = lambda texts: spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    mixed = " ".join(rnd.sample(words, 20))
    got = {r.doc_id: r.perplexity for r in quality.perplexities(frame([chains[0], mixed]), frame(chains * 3)).collect()}
    assert got[0] * 20 < got[1]


def test_more_names_than_sixteen_bits(spark):
    texts = [" ".join(f"{k:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(at, at + 500)) for at in range(0, 30_000, 500)]
    known = np.unique(np.concatenate([r[3] for r in quality._runs(pa.array(texts))]))
    ids = np.concatenate([x[2:-1] for x in quality._tokens(pa.array(texts), known)])
    assert len(set(ids.tolist())) == 30_000 and np.array_equal(quality._unpack(quality._pack(ids)), ids)


def test_packed_requests_are_whole():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.sort(rnd.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(quality._stretch(quality._squeeze(keys)), keys >> np.uint64(16))
    keys = rnd.integers(2**63, 2**64, 100_000, dtype=np.uint64)
    assert len(quality._squeeze(np.sort(keys))) < 5 * len(keys)


def test_turns_give_what_one_gives(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "of", "in", "House", "tree,"]) for _ in range(30)) for _ in range(40)]
    frame = cut_lineage(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(7))
    told = lambda: {r.doc_id: r.perplexity for r in quality.perplexities(frame, frame.select("text")).collect()}
    whole = told()
    monkeypatch.setattr(quality, "_PASS_BYTES", 1000)
    turns = told()
    assert len(whole) == 40 and turns.keys() == whole.keys() and all(np.isclose(turns[i], whole[i]) for i in whole)


def test_the_model_takes_few_bytes(spark):
    rnd = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnprst"]
    texts = [" ".join(rnd.choices(words, k=4000)) for _ in range(20)]
    known = np.unique(np.concatenate([r[3] for r in quality._runs(pa.array(texts))]))
    model, *_ = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), known, 4)
    size, n = 0, 0
    for row in model.collect():
        size += len(row.grams) + len(row.pairs) + len(row.words)
        n += len(quality._read(row.grams)[0])
    assert n > 70_000 and size < 10 * n


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {x for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    before = files()
    spark.range(1000).repartition(5).write.format("noop").mode("overwrite").save()
    assert files() - before
    before = files()
    assert sorted(r["count"] for r in cut_lineage(spark.range(1000).repartition(5).groupBy((F.col("id") % 10).alias("k")).count()).collect()) == [100] * 10
    assert not files() - before
