"""Graphs against brute force, scripts, job analytics, files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stepframe.operators import corpus, graph, jobs, lineage
from stepframe.semantics import StepError
from stepframe.sizing import scratch_path
from stepframe.sources import files, manifest


def closure(edges, nodes):
    reach = {n: set() for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            at = stack.pop()
            for b in [b for a, b in edges if a == at]:
                if b not in reach[n]:
                    reach[n].add(b)
                    stack.append(b)
    return reach


def test_cycles_are_strong_components(spark):
    """Three random graphs side by side."""
    nodes, edges, want = [], [], {}
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        own = list(range(24))
        pairs = sorted({(rng.choice(own), rng.choice(own)) for _ in range(26)} | {(5, 5)})
        reach = closure(pairs, own)
        want |= {100 * seed + n: 100 * seed + min(m for m in own if m in reach[n] and n in reach[m]) for n in own if n in reach[n]}
        nodes += [100 * seed + n for n in own]
        edges += [(100 * seed + a, 100 * seed + b) for a, b in pairs]
    got = graph.cycles(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int"))
    assert {r.node: r.cycle for r in got.collect()} == want


def test_rings_tails_and_chains_take_few_rounds(spark):
    ring = [(i, (i + 1) % 2000) for i in range(2000)]
    tail = [(-i, -i - 1) for i in range(1, 700)] + [(5, -1)]
    # 3000 <-> a chain of 40 back to it; 4000 and 4001 joined by two chains one way and one back; a chain between two parts.
    loop = [(3000 + i, 3000 + (i + 1) % 41) for i in range(41)]
    double = [(4000, 4100), (4100, 4101), (4101, 4001), (4000, 4200), (4200, 4001), (4001, 4300), (4300, 4000), (3000, 4500), (4500, 4000)]
    edges = ring + tail + loop + double + [(9000, 9000)]
    nodes = sorted({n for e in edges for n in e} | {9999})
    got = {r.node: r.cycle for r in graph.cycles(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int")).collect()}
    want = {i: 0 for i in range(2000)} | {3000 + i: 3000 for i in range(41)} | {n: 4000 for n in (4000, 4001, 4100, 4101, 4200, 4300)} | {9000: 9000}
    assert got == want


def test_reach_and_distance(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (9, 1)], "src int, dst int")
    seed = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.distance for r in graph.reach(edges, seed).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r.node: r.distance for r in graph.reach(edges, seed, backwards=True).collect()} == {1: 0, 3: 1, 9: 1, 2: 2}


def test_long_chains(spark):
    n = 20
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    nodes = spark.range(n + 1).select(F.col("id").cast("int").alias("node"))
    taken, left, rest = graph.peel(nodes, edges)
    assert {r.node: r.level for r in taken.collect()} == {i: i for i in range(n + 1)} and left.isEmpty() and rest.isEmpty()
    parents = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 100)], (200, 999)], "node int, parent int")
    assert {r.node: (r.root, r.depth) for r in graph.roots(parents).collect()} == {**{i: (0, i) for i in range(100)}, 200: (200, 0)}


def test_a_parent_of_many_is_met_where_its_children_lie(spark):
    # All walks end at node 0; a shuffle on the root would send every row to one task.
    rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("node"), F.lit(-1).cast("long").alias("root"))
    met = graph._looked_up(rows, spark.createDataFrame([(-1, 7)], "root long, further long"), "root")
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 10_000 and met.where("further = 7").count() == 60_000


def test_roots_of_shared_parents(spark, monkeypatch):
    monkeypatch.setattr(graph, "_MANY", 3)
    parents = [(0, None), *[(i, 0) for i in range(1, 9)], *[(i, 8) for i in range(10, 30)], *[(i, 777) for i in range(40, 50)], (60, 29), (None, None)]
    expected = {0: (0, 0), **{i: (0, 1) for i in range(1, 9)}, **{i: (0, 2) for i in range(10, 30)}, **{i: (i, 0) for i in range(40, 50)}, 60: (0, 3), None: (None, 0)}
    got = graph.roots(spark.createDataFrame(parents, "node int, parent int")).collect()
    assert len(got) == len(parents) and {r.node: (r.root, r.depth) for r in got} == expected


STEPS = "node string, seq int, file string, inputs array<string>, outputs array<string>"


def test_flow_uses_the_last_producer(spark):
    steps = spark.createDataFrame([("a", 1, "f", [], ["x"]), ("b", 2, "f", ["x"], ["x", "y"]), ("c", 3, "g", ["x", "y", "raw"], ["z"])], STEPS)
    assert {(r.source, r.target, r.dataset) for r in lineage.flow_edges(steps).collect()} == {("b", "c", "x"), ("b", "c", "y")}
    assert {(r.source_file, r.target_file, r.shared_dataset) for r in lineage.cross_file_edges(steps).collect()} == {("f", "g", "x"), ("f", "g", "y")}
    assert {(r.dataset, r.state) for r in lineage.orphans(steps).collect()} == {("raw", "never_produced"), ("z", "never_consumed")}


def test_order_falls_back_on_cycles(spark):
    steps = spark.createDataFrame([("late", 1, "f", ["x"], ["z"]), ("early", 2, "f", [], ["x"])], STEPS)
    assert [r.node for r in lineage.dependency_order(steps).orderBy("level", "seq").collect()] == ["early", "late"]
    ring = spark.createDataFrame([("late", 1, "f", ["x"], ["z"]), ("early", 2, "f", ["z"], ["x"])], STEPS)
    assert [r.node for r in lineage.dependency_order(ring).orderBy("level", "seq").collect()] == ["late", "early"]
    assert {(r.node, r.cycle) for r in lineage.circular(ring).collect()} == {("late", "early"), ("early", "early")}


def test_related_names_both_directions(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (8, 9)], "src int, dst int")
    assert {r.node: r.relation for r in lineage.related(edges, 2).collect()} == {1: "ancestor", 2: "self", 3: "both", 4: "descendant"}


def test_risk_flows_down(spark):
    nodes = spark.createDataFrame([(i, i == 2) for i in range(1, 6)], "node int, bad boolean")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    assert {r.node: (r.risky, r.risk_propagated) for r in lineage.propagate_risk(nodes, edges, F.col("bad")).collect()} == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, True), 5: (False, False)}


SCRIPT = """%LET Cut = 100;
/* first */
DATA work.a (KEEP=x) b;
  SET raw.one two;
  IF x > &cut. THEN OUTPUT;
RUN;

PROC SORT DATA=Work.A; BY DESCENDING x; RUN;
proc sql;
  create table sums as
  select * from (select x from work.a) t left join Dim.d on 1 = 1 where x < &nope;
quit;
PROC FREQ DATA=sums; TABLES x; RUN; PROC TRANSPOSE DATA=sums OUT=wide; RUN;
PROC GLM DATA=wide; MODEL y = x; QUIT;
"""


@pytest.fixture(scope="module")
def scripts(spark):
    return spark.createDataFrame([("p/main.sas", SCRIPT), ("p/empty.sas", ""), ("a.sas", "%let CUT = 5;\ndata c; set b; run;\n")], "path string, text string")


def test_blocks(scripts):
    found = [(r.path, r.start_line, r.end_line, r.block_type) for r in corpus.blocks(scripts).orderBy("path", "ordinal").collect()]
    assert found == [("a.sas", 2, 2, "DATA_STEP"), ("p/main.sas", 3, 6, "DATA_STEP"), ("p/main.sas", 8, 8, "PROC_SORT"), ("p/main.sas", 9, 12, "PROC_SQL"),
                     ("p/main.sas", 13, 13, "PROC_FREQ"), ("p/main.sas", 13, 13, "PROC_TRANSPOSE"), ("p/main.sas", 14, 14, "PROC_UNKNOWN")]


def test_dataset_names(scripts):
    found = {r.block_type: (r.inputs, r.outputs) for r in corpus.with_datasets(corpus.blocks(scripts)).filter("path = 'p/main.sas'").collect()}
    assert found["DATA_STEP"] == (["raw.one", "two"], ["work.a", "b"])
    assert found["PROC_SORT"] == (["work.a"], ["work.a"])
    assert found["PROC_SQL"] == (["work.a", "dim.d"], ["sums"])
    assert found["PROC_FREQ"] == (["sums"], []) and found["PROC_TRANSPOSE"] == (["sums"], ["wide"])


def test_scripts_become_steps(scripts):
    flows = lineage.flow_edges(corpus.as_steps(scripts)).collect()
    assert ("p/main.sas:8", "p/main.sas:9", "work.a") in {(r.source, r.target, r.dataset) for r in flows}
    assert ("p/main.sas:3", "a.sas:2", "b") in {(r.source, r.target, r.dataset) for r in flows}


def test_macros(scripts):
    assert {(r.macro_name, r.macro_value, r.used_in_block_id) for r in corpus.macro_usages(scripts).collect()} == {("CUT", "100", "p/main.sas:3"), ("NOPE", None, "p/main.sas:9")}
    assert [(r.macro_name, r.used_in_block_id) for r in corpus.unresolved_macros(scripts).collect()] == [("NOPE", "p/main.sas:9")]
    assert {(r.path, r["name"], r.raw_value) for r in corpus.macro_variables(scripts).collect()} == {("p/main.sas", "Cut", "100"), ("a.sas", "CUT", "5")}


def test_risk(scripts):
    flags = {r.block_id: (r.risk, r.flags) for r in corpus.risk_flags(corpus.blocks(scripts)).collect()}
    assert flags["a.sas:2"] == ("low", "") and flags["p/main.sas:8"] == ("medium", "by group") and flags["p/main.sas:14"] == ("high", "unknown procedure")
    assert {r.path: r.overall_risk for r in corpus.overall_risk(corpus.risk_flags(corpus.blocks(scripts))).collect()} == {"a.sas": "low", "p/main.sas": "high"}


def test_logs(spark, scripts):
    folder = scratch_path(spark, "logs")
    spark.createDataFrame([("NOTE: ran p/main.sas",), ("WARNING: odd",), ("note: ERROR-free",)], "value string").coalesce(1).write.text(folder)
    row = corpus.log_links(files.read_lines(spark, folder), scripts.select(F.col("path").alias("file"))).first()
    assert (row.severity, row.related_file) == ("WARNING", "p/main.sas")


def test_trust_report(spark):
    plans = spark.createDataFrame([("f.sas:1", "f.sas", "translate", 0.9), ("g.sas:4", "g.sas", "manual", None)], "block_id string, source_file string, strategy string, confidence_score double")
    confidence = spark.createDataFrame([("f.sas:1", "high", None)], "block_id string, confidence string, verified_confidence string")
    revisions = spark.createDataFrame([("f.sas:1", 1, "pass"), ("f.sas:1", 2, "fail")], "block_id string, revision_number int, reconciliation_status string")
    rows = jobs.trust_rows(plans, confidence, jobs.latest_revision(revisions), None)
    total = jobs.trust_totals(rows).first()
    assert (total.total_blocks, total.auto_verified, total.needs_review, total.manual_todo, total.failed_reconciliation) == (2, 0, 1, 1, 1)
    calm = rows.withColumn("needs_attention", F.lit(False))
    assert jobs.review_order(calm).count() == 0
    assert [(r.block_id, r.needs_attention) for r in jobs.review_order(rows).orderBy("queue_position").collect()] == [("g.sas:4", True), ("f.sas:1", True)]
    assert jobs.overall_confidence(plans).first().overall_confidence == "high"


@pytest.mark.parametrize(("score", "band"), [(-1.0, "unknown"), (None, "unknown"), (0.9, "high"), (0.85, "high"), (0.70, "medium"), (0.50, "low"), (0.30, "very_low")])
def test_bands(spark, score, band):
    assert spark.range(1).select(jobs.confidence_band(F.lit(score).cast("double"))).first()[0] == band


@pytest.mark.parametrize(("score", "passed", "want"), [(0.9, True, 0.9), (0.5, True, 0.6), (0.84, True, 0.94), (0.9, False, 0.45), (0.1, False, 0.1), (0.9, None, None)])
def test_verified_score(spark, score, passed, want):
    found = spark.range(1).select(jobs.verified_score(F.lit(score), F.lit(passed).cast("boolean"))).first()[0]
    assert found == (pytest.approx(want) if want is not None else None)


def test_revision_diff_counts_repeated_lines(spark):
    revisions = spark.createDataFrame([("b", 0, "x\nx\ny"), ("b", 1, "x\nz"), ("b", 2, "x\nz")], "block string, n int, code string")
    assert {r.n: (r.added, r.removed) for r in jobs.revision_diff(revisions, "block", "n", "code").collect()} == {0: (3, 0), 1: (1, 2), 2: (0, 0)}


def test_version_history_and_hash(spark):
    table = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (9, None)], "id int, parent_job_id int")
    assert {r.id: r.is_current for r in jobs.version_history(table, 3).collect()} == {1: False, 2: False, 3: True, 4: False}
    upload = spark.createDataFrame([([("b.sas", "two"), ("a.sas", "one")],)], "files array<struct<path:string,content:string>>")
    assert upload.select(jobs.input_hash(F.col("files"))).first()[0] == hashlib.sha256(b"twoone").hexdigest()


def test_job_lists(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:00', map('a.sas', 'x', '__ref_csv_a__', 'y')), (2, TIMESTAMP'2024-01-02 00:00:00', NULL) AS t(id, created_at, files)""")
    assert [(r.id, r.file_count) for r in jobs.list_jobs(rows).collect()] == [(2, 0), (1, 1)]
    log = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 8, 5)], "id int, job_id int, created_at int")
    assert [r.id for r in jobs.changelog(log, 7).collect()] == [2, 1]


def test_overrides(spark):
    base, new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "block_id int, s string, v double"), spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0)], "block_id int, s string, v double")
    assert sorted(tuple(r) for r in jobs.merge_overrides(base, new).collect()) == [(1, "a", 1.0), (2, None, 5.0), (3, "c", 3.0)]


def test_column_flows(spark):
    catalogue = spark.createDataFrame([("in", "a"), ("in", "b"), ("in", "c"), ("out", "a"), ("out", "bb"), ("out", "d")], "dataset string, column string")
    step = spark.createDataFrame([("s", "in", "out")], "via_block_id string, source_dataset string, target_dataset string")
    renames = spark.createDataFrame([("s", "b", "bb")], "via_block_id string, old_column string, new_column string")
    assert {r.column: r.transformation for r in lineage.column_flows(catalogue, step, renames).collect()} == {"a": "passed", "bb": "renamed", "c": "dropped", "d": "derived"}
    assert {r.column: r.transformation for r in lineage.column_flows(catalogue, step).collect()} == {"a": "passed", "b": "dropped", "bb": "derived", "c": "dropped", "d": "derived"}


@pytest.mark.parametrize(("path", "status", "reason"), [
    ("src/a.SAS", "accepted", None), ("\\dir\\b.sas7bdat", "accepted", None), ("/abs/c.xlsx", "accepted", None), ("x/readme.md", "rejected", "Unsupported file type: .md"), ("Makefile", "rejected", "Unsupported file type: (none)"),
    (".sas", "rejected", "Unsupported file type: (none)"), ("__MACOSX/a.sas", "ignored", "resource fork"), ("a/._b.sas", "ignored", "resource fork"), ("a/../b.sas", "ignored", "path escapes the upload"), ("a/b/", "ignored", "directory")])
def test_manifest(spark, path, status, reason):
    row = manifest.classify(spark.createDataFrame([(path,)], "path string")).first()
    assert (row.status, row.reason) == (status, reason)


def test_files(spark):
    folder = scratch_path(spark, "files")
    df = spark.createDataFrame([(1, "x,y", 2.5), (2, None, None)], "Id int, Name string, Value double")
    files.proc_export(df, folder, "csv")
    with pytest.raises(Exception, match="(?i)exists"):
        files.proc_export(df, folder, "csv")
    files.proc_export(df, folder, "csv", replace=True)
    back = files.read_csv(spark, folder)
    assert back.columns == ["id", "name", "value"] and back.schema["id"].dataType.simpleString() == "bigint"
    assert sorted(tuple(r) for r in back.collect()) == [(1, "x,y", 2.5), (2, None, None)]
    listed = manifest.classify(manifest.list_files(spark, folder)).filter("status = 'accepted'")
    assert listed.count() >= 1 and files.choose_reference(spark) is None
    with pytest.raises(StepError, match="DBMS"):
        files.proc_import(spark, folder, "access")


def test_bad_rows_are_kept(spark):
    folder = scratch_path(spark, "bad")
    spark.createDataFrame([("a,b",), ("1,2",), ("3,oops",)], "value string").coalesce(1).write.text(folder)
    schema = spark.createDataFrame([], "a int, b int").schema
    assert sorted((r.a, r.b, r._corrupt_record) for r in files.proc_import(spark, folder, "csv", schema).collect()) == [(1, 2, None), (3, None, "3,oops")]


def test_special_missing_and_records(spark):
    df = files.split_special_missing(spark.createDataFrame([("1.5",), (".A",), (".",), ("._",), ("x",)], "v string"), ["v"])
    assert [(r.v, r.v_miss) for r in df.collect()] == [(1.5, None), (None, "A"), (None, None), (None, "_"), (None, None)]
    lines = spark.createDataFrame([("1,,'a'",), ("2, ,b",)], "line string")
    assert [r.k for r in files.read_records(lines, "line", "k int, m string, s string").collect()] == [1, 2]
    spaced = spark.createDataFrame([("1   x",)], "line string")
    assert tuple(files.read_records(spaced, "line", "k int, s string", delimiter=" ", dsd=False).first()) == (1, "x")


def test_code_in_comments_and_quotes_is_none(spark):
    text = "/* DATA old; SET x; RUN; */\nDATA a (KEEP=x) b;\n  SET s1 END=eof s2(WHERE=(x > 1)); y = 'proc print; run;';\nRUN;\n" \
           "PROC SQL; CREATE TABLE q AS SELECT * FROM t1, t2 b, (SELECT * FROM t3) c LEFT JOIN t4 ON 1 = 1; QUIT;\nPROC MEANS DATA=m; OUTPUT OUT=o1 MEAN=; OUTPUT OUT = o2; RUN;\n"
    scripts = spark.createDataFrame([("s.sas", text)], "path string, text string")
    rows = corpus.with_datasets(corpus.blocks(scripts)).orderBy("ordinal").collect()
    assert [(r.start_line, r.end_line, r.block_type, r.inputs, r.outputs) for r in rows] == [
        (2, 4, "DATA_STEP", ["s1", "s2"], ["a", "b"]), (5, 5, "PROC_SQL", ["t1", "t2", "t3", "t4"], ["q"]), (6, 6, "PROC_MEANS", ["m"], ["o1", "o2"])]


def test_scripts_of_one_file_are_scanned_by_many_tasks(spark):
    text = "%LET size = 1;\nDATA a; SET b; x = &size &other; RUN;\n"
    scripts = spark.range(0, 400, 1, 1).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(text).alias("text"))
    assert scripts.rdd.getNumPartitions() == 1
    for found, rows in ((corpus.blocks(scripts), 400), (corpus.dataset_usage(scripts), 800), (corpus.macro_variables(scripts), 400), (corpus.risk_flags(corpus.blocks(scripts)), 400)):
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == rows and len(sizes) == 8 and max(sizes) < rows / 4
    assert {(r.macro_name, r["count"]) for r in corpus.unresolved_macros(scripts).groupBy("macro_name").count().collect()} == {("OTHER", 400)}


def test_circle_of_parents_is_named(spark):
    with pytest.raises(StepError, match="circle"):
        graph.roots(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "node int, parent int"))


def _longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_against_the_whole_table():
    from stepframe.operators.linediff import _middle, common_lines

    rng = random.Random(4)
    for _ in range(1500):
        alphabet = "abcdefgh" * rng.choice([1, 4]) if rng.random() < 0.6 else [str(x) for x in range(40)]
        a, b = ([rng.choice(alphabet) for _ in range(rng.randrange(14))] for _ in range(2))
        found = common_lines(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        if a and b and a[0] != b[0]:
            x, y, u, v = _middle(a, b)
            assert u - x == v - y and a[x:u] == b[y:v] and _longest_common(a[:x], b[:y]) + u - x + _longest_common(a[u:], b[v:]) == _longest_common(a, b)
        # With lines that occur once on each side the anchors are the longest common sequence.
        a, b = rng.sample(range(20), 12), rng.sample(range(20), 12)
        assert len(common_lines(a, b)) == _longest_common(a, b)


def test_line_diff_over_gaps_in_the_numbers(spark):
    from stepframe.operators.linediff import change_counts, line_diff

    revisions = spark.createDataFrame([("b", 1, "x\ny\nz"), ("b", 4, "y\nz\nx\nnew"), ("b", 9, None), ("c", 2, "p\n\np")], "block string, n int, code string")
    changes = line_diff(revisions, "block", "n", "code")
    got = {(r.block, r.n): set() for r in changes.collect()}
    for r in changes.collect():
        got[r.block, r.n].add((r.change, r.old_line, r.new_line, r.line))
    assert got[("b", 4)] == {("moved", 1, 3, "x"), ("added", None, 4, "new")}
    assert got[("b", 9)] == {("removed", i, None, x) for i, x in enumerate(["y", "z", "x", "new"], 1)}
    assert got[("c", 2)] == {("added", None, 1, "p"), ("added", None, 2, ""), ("added", None, 3, "p")}
    assert {(r.block, r.n): (r.added, r.removed, r.moved) for r in change_counts(changes, "block", "n").collect()}[("b", 4)] == (1, 0, 1)


def test_stage_links_are_the_pairs_counted(spark):
    rng = random.Random(6)
    stages = [(f"s{i}", rng.choice([None, *range(12)]), rng.sample("abcd", rng.randrange(4)), rng.sample("abcd", rng.randrange(4))) for i in range(60)]
    df = spark.createDataFrame(stages, "step_id string, position int, inputs array<string>, outputs array<string>")
    got = {(r.dataset, r.target): r.n_sources for r in lineage.step_links(df).collect()}
    want = {}
    for target, q, reads, _ in stages:
        for x in reads:
            n = sum(q is not None and p is not None and p < q and x in writes for _, p, _, writes in stages)
            if n:
                want[x, target] = n
    assert got == want
    asked = spark.createDataFrame([("s7",), ("s8",)], "node string")
    assert {tuple(r) for r in lineage.step_edges(df, asked).collect()} == {tuple(r) for r in lineage.step_edges(df).collect() if r.target in ("s7", "s8")}
    many = spark.range(30_000).selectExpr("CAST(id AS STRING) AS step_id", "id AS position", "array('x') AS inputs", "array('x') AS outputs")
    assert lineage.step_links(many).selectExpr("sum(n_sources)", "count(*)").first()[:] == (30_000 * 29_999 // 2, 29_999)
