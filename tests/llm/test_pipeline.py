import random

from pyspark.sql import functions as F

import corpus_pipeline
from stepframe.sizing import cut_lineage


def test_stages_on_planted_rows(spark, tmp_path):
    rnd = random.Random(12)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, "\n".join(text(40) for _ in range(3)), "en", "s", 0) for i in range(150)]
    passage, item = text(60), text(40)
    copy = docs[1][1].split(" ")
    copy[5] = "changed"
    docs += [(200, passage + "\n" + text(50), "en", "s", 0), (201, text(50) + "\n" + passage, "en", "s", 0), (202, docs[0][1], "en", "s", 0), (203, docs[2][1].replace("\n", " "), "en", "s", 0),
             (204, text(20) + " " + item + " " + text(20), "en", "s", 0), (205, " ".join(w.upper() + "!!" for w in text(80).split()), "en", "s", 0)]
    docs += [(None, text(30), None, None, None), (300, None, "en", "s", 0), (301, "", "en", None, 0), (5, docs[5][1], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = cut_lineage(stage(spark, frame, str(tmp_path)))
        ids[name] = {r.doc_id for r in frame.select("doc_id").collect()}
        if name != "packing":
            assert frame.columns == columns
        if name == "line_dedup":
            kept = {r.doc_id: r.text for r in frame.collect()}
            assert passage in kept[200] and passage not in kept[201] and len(kept[201].split()) == 50
            assert 202 not in kept and 300 in kept and 301 in kept and None in kept
    assert 205 not in ids["quality"] and len(ids["quality"]) >= 152
    assert 203 in ids["line_dedup"] and 203 not in ids["near_dedup"] and 2 in ids["near_dedup"]
    assert 204 in ids["near_dedup"] and 204 not in ids["decontamination"]
    assert ids["packing"] == ids["decontamination"] >= {None, 300, 301, 200, 201}
    used = {}
    for r in frame.collect():
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(x[1] for x in parts) <= 1024 and min(parts)[0] == 0 for parts in used.values())


def _folder(spark, path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark, tmp_path):
    rnd = random.Random(21)
    text = lambda n: "\n".join(" ".join(f"w{rnd.randrange(5000)}" for _ in range(n)) for _ in range(4))
    one, two, three, four = (text(30) for _ in range(4))
    edited = one.replace("\n", " ")
    rows = [(1, one), (1, two), (1, three), (2, four), (2, edited), (2, four), (3, one.split("\n")[2] + "\n" + text(20)), (None, two), (4, None), (4, ""), (4, "")]
    docs = _folder(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in rows])
    stages = dict(corpus_pipeline.STAGES)
    near = [(r.doc_id, r.text) for r in stages["near_dedup"](spark, docs, str(tmp_path)).collect()]
    assert len(set(near)) == len(near)
    assert {(1, two), (1, three), (2, four), (None, two), (4, None), (4, "")} < set(near)
    assert ((1, one) in near) + ((2, edited) in near) == 1
    lines = [(r.doc_id, r.text) for r in stages["line_dedup"](spark, docs, str(tmp_path)).collect()]
    assert {(1, two), (1, three), (2, edited), (None, two), (4, None), (4, "")} < set(lines)
    kept = "\n".join(t or "" for _, t in lines)
    assert all(sum(line == x for x in kept.split("\n")) >= 1 for line in one.split("\n") + four.split("\n"))
    assert kept.split("\n").count(one.split("\n")[2]) == 1


def test_empty_tables_long_texts_and_other_columns(spark, tmp_path):
    frame = _folder(spark, tmp_path / "none", [])
    for name, stage in corpus_pipeline.STAGES:
        frame = cut_lineage(stage(spark, frame, str(tmp_path / "none")))
        assert frame.count() == 0
    rnd = random.Random(22)
    long = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(150_000))
    docs = _folder(spark, tmp_path / "long", [(1, long, "en", "s", 0), (2, long + " end", "en", "s", 0), (3, "a few plain words of another text", None, None, None)])
    for at, name in enumerate(["key", "kept", "n_removed", "row_key", "id"]):
        docs = docs.withColumn(name, F.lit(at))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, str(tmp_path / "long")))
        assert docs.columns == columns, name
    assert [(r.doc_id, r.key, r.kept, r.n_removed, r.row_key, r.id) for r in docs.orderBy("doc_id").collect()] == [(1, 0, 1, 2, 3, 4), (3, 0, 1, 2, 3, 4)]


def test_line_dedup_holds_no_tokens_and_moves_texts_once(spark, tmp_path, monkeypatch, capsys):
    rnd = random.Random(31)
    text = lambda: "\n".join(" ".join(f"w{rnd.randrange(5000)}" for _ in range(30)) for _ in range(3))
    texts = [text() for _ in range(20)]
    rows = [*enumerate(texts), (30, texts[3]), (31, texts[4].split("\n")[0] + "\nnew words"), (None, texts[5]), (32, None)]
    docs = _folder(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in rows])

    def held(self, *_):
        raise AssertionError("the tokens of all lines are held")

    monkeypatch.setattr(type(docs), "persist", held)
    left = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, str(tmp_path))
    assert {r.doc_id: r.text for r in left.collect()} == {**dict(enumerate(texts)), 31: "new words", None: texts[5], 32: None}
    # The texts are read where their buckets lie.
    capsys.readouterr()
    left.explain()
    assert "Bucketed: true" in capsys.readouterr().out
