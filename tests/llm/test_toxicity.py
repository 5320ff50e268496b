import random

from pyspark.sql import functions as F

from stepframe.llm.toxicity import score


def test_held_out_accuracy_and_odd_rows(spark):
    rnd = random.Random(6)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rude = ["grobner", "zitterix", "mumpfel"]
    rows = []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic * rnd.randint(1, 4)):
            text.insert(rnd.randrange(len(text)), rnd.choice(rude) + rnd.choice(["", "s", "en", "!"]))
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    odd = spark.createDataFrame([(None, "worda", 0), (9001, None, 0), (9002, "", 1), (9003, "x" * 1_000_000, 0), (9004, "a b " * 100_000, 0)], docs.schema)
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(0, 0), (None, 1), (1, None)], "doc_id long, toxic int"))
    got = score(docs.drop("toxic").unionByName(odd.drop("toxic")).withColumn("score", F.lit("x")), labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    known = {r.doc_id: r.predicted for r in got}
    held = [(known[i], t) for i, _, t in rows if i % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert {r.score for r in score(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
