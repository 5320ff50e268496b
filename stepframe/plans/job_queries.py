"""Lineage, script corpus and job analytics on tables that SQL derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.operators import corpus, graph, jobs, lineage
from stepframe.operators.linediff import line_diff
from stepframe.operators.ordered import positions
from stepframe.operators.sql import run_sql
from stepframe.plans.catalog import query, table


def _ask(spark, d, sql, *tables):
    """Spark reads DuckDB's integer division as `div`; the rest of these texts is common to both."""
    return run_sql(spark, sql.replace("//", "div"), {t: table(spark, d, t) for t in tables})


# A step per part: it writes its own dataset and reads those of two earlier parts.
_STEPS = """
SELECT 'b' || p_partkey AS node, p_partkey AS seq, 'proj/' || p_brand || '.sas' AS file, array['d' || p_partkey] AS outputs,
  CASE WHEN p_partkey = 0 THEN array['raw'] ELSE array['d' || (p_partkey // 2), 'd' || (p_partkey // 3)] END AS inputs FROM part"""
# The same with datasets that many steps write and read, which also makes circles.
_SHARED = """
SELECT 'b' || p_partkey AS node, p_partkey AS seq, 'proj/' || p_brand || '.sas' AS file, array['d' || p_partkey, 'size_' || p_size] AS outputs,
  array['d' || (p_partkey // 2), 'size_' || (p_size // 2)] AS inputs FROM part"""


def _steps(spark, d, sql=_STEPS):
    return _ask(spark, d, sql.replace("array[", "array(").replace("]", ")"), "part")


def _flows(steps: str) -> str:
    return f"""steps AS ({steps}), w AS (SELECT seq, node, file, unnest(outputs) AS dataset FROM steps), r AS (SELECT node AS target, file AS target_file, unnest(inputs) AS dataset FROM steps),
  last AS (SELECT dataset, node AS source, file AS source_file FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq DESC, node DESC) AS rn FROM w) WHERE rn = 1),
  flow AS (SELECT source, target, dataset, source_file, target_file FROM last JOIN r USING (dataset) WHERE source <> target)"""


@query("ln_1_flow_edges", f"WITH {_flows(_SHARED)} SELECT source, target, dataset, false AS inferred FROM flow")
def ln_1(spark, d):
    return lineage.flow_edges(_steps(spark, d, _SHARED))


@query("ln_2_dependency_order", f"""
WITH RECURSIVE {_flows(_STEPS)}, walk AS (SELECT node, seq, 0 AS level FROM steps
  UNION SELECT s.node, s.seq, walk.level + 1 FROM walk JOIN flow ON flow.source = walk.node JOIN steps s ON s.node = flow.target)
SELECT node, level, row_number() OVER (ORDER BY level, seq) AS place FROM (SELECT node, seq, max(level) AS level FROM walk GROUP BY node, seq)""")
def ln_2(spark, d):
    return positions(lineage.dependency_order(_steps(spark, d)), "level seq", "place").select("node", "level", "place")


_TREE = "SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0"


@query("ln_3_related", f"""
WITH RECURSIVE e AS ({_TREE}), up AS (SELECT src AS node FROM e WHERE dst = 12 UNION SELECT e.src FROM e JOIN up ON e.dst = up.node),
  down AS (SELECT dst AS node FROM e WHERE src = 12 UNION SELECT e.dst FROM e JOIN down ON e.src = down.node)
SELECT node, 'ancestor' AS relation FROM up UNION ALL SELECT node, 'descendant' FROM down UNION ALL SELECT 12, 'self'""")
def ln_3(spark, d):
    return lineage.related(_ask(spark, d, _TREE, "part"), 12)


@query("ln_4_blast_radius", f"""
WITH {_flows(_SHARED)}, n AS (SELECT source_file AS file, count(*) AS n FROM flow WHERE source_file <> target_file GROUP BY 1)
SELECT file, coalesce(n, 0) AS blast_radius FROM (SELECT DISTINCT file FROM steps) LEFT JOIN n USING (file)""")
def ln_4(spark, d):
    steps = _steps(spark, d, _SHARED)
    return lineage.blast_radius(steps, lineage.cross_file_edges(steps))


@query("ln_5_cross_file_edges", f"""
WITH {_flows(_SHARED)} SELECT source AS source_block_id, target AS target_block_id, dataset AS shared_dataset, source_file, target_file FROM flow WHERE source_file <> target_file""")
def ln_5(spark, d):
    return lineage.cross_file_edges(_steps(spark, d, _SHARED))


@query("ln_6_degrees", f"""
WITH {_flows(_SHARED)}, ends AS (SELECT source_file AS file FROM flow WHERE source_file <> target_file UNION ALL SELECT target_file FROM flow WHERE source_file <> target_file),
  deg AS (SELECT file, count(*) AS n FROM ends GROUP BY file)
SELECT file, split_part(file, '/', 2) AS basename, count(*) AS block_count, coalesce(any_value(n), 0) AS connection_count FROM steps LEFT JOIN deg USING (file) GROUP BY file""")
def ln_6(spark, d):
    steps = _steps(spark, d, _SHARED)
    return lineage.file_nodes(steps, lineage.cross_file_edges(steps))


_FILE_EDGES = """
SELECT 'c' || o_custkey AS source_file, 'n' || c_nationkey AS target_file,
  CASE o_orderstatus WHEN 'F' THEN 'READS_DATASET' WHEN 'O' THEN 'MACRO_CALL' ELSE 'INCLUDE' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("ln_7_merge_parallel_edges", f"""
SELECT source_file, target_file, string_agg(DISTINCT lower(replace(reason, '_', ' ')), ', ' ORDER BY lower(replace(reason, '_', ' '))) AS label FROM ({_FILE_EDGES}) GROUP BY 1, 2""")
def ln_7(spark, d):
    return lineage.merge_parallel_edges(_ask(spark, d, _FILE_EDGES, "orders", "customer"))


_STAGES = """
SELECT 's' || p_partkey AS step_id, p_partkey AS position, array('d' || p_partkey, 'e' || (p_partkey // 4)) AS outputs,
  array('d' || (p_partkey // 2), 'e' || (p_partkey // 9), 'd' || (p_partkey + 1)) AS inputs FROM part"""


@query("ln_8_stage_edges", """
WITH o AS (SELECT p_partkey AS p, 'd' || p_partkey AS dataset FROM part UNION ALL SELECT p_partkey, 'e' || (p_partkey // 4) FROM part),
  i AS (SELECT DISTINCT p_partkey AS q, u.dataset FROM part, unnest(['d' || (p_partkey // 2), 'e' || (p_partkey // 9), 'd' || (p_partkey + 1)]) AS u(dataset))
SELECT 's' || p AS source, 's' || q AS target, string_agg(dataset, ', ' ORDER BY dataset) AS label FROM o JOIN i USING (dataset) WHERE p < q GROUP BY 1, 2""")
def ln_8(spark, d):
    return lineage.step_edges(_ask(spark, d, _STAGES, "part"))


@query("ln_8_stage_links", """
WITH o AS (SELECT p_partkey AS p, 'd' || p_partkey AS dataset FROM part UNION ALL SELECT p_partkey, 'brand ' || p_brand FROM part),
  i AS (SELECT p_partkey AS q, 'd' || (p_partkey // 2) AS dataset FROM part UNION ALL SELECT p_partkey, 'brand ' || p_brand FROM part)
SELECT dataset, 's' || q AS target, count(*) AS n_sources FROM o JOIN i USING (dataset) WHERE p < q GROUP BY 1, 2""")
def ln_8b(spark, d):
    """Every step reads and writes its brand's dataset: the pairs grow with the square, the links do not."""
    return lineage.step_links(_ask(spark, d, """
        SELECT 's' || p_partkey AS step_id, p_partkey AS position, array('d' || p_partkey, 'brand ' || p_brand) AS outputs,
          array('d' || (p_partkey // 2), 'brand ' || p_brand) AS inputs FROM part""", "part"))


@query("ln_9_flow_counts", f"""
WITH {_flows(_STEPS)}, c AS (SELECT 'b' || l_partkey AS source, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT source, target, dataset, false AS inferred, coalesce(n, 0) AS column_count FROM flow LEFT JOIN c USING (source)""")
def ln_9(spark, d):
    flows = lineage.flow_edges(_steps(spark, d))
    columns = _ask(spark, d, "SELECT 'b' || l_partkey AS via_block_id FROM lineitem WHERE l_returnflag = 'R'", "lineitem")
    return lineage.flow_counts(flows, columns)


_COLUMNS = """
SELECT 'd' || p_partkey AS dataset, 'id' AS "column" FROM part UNION ALL SELECT 'd' || p_partkey, 'size_' || (p_size // 10) FROM part
UNION ALL SELECT 'd' || p_partkey, p_type FROM part"""
_MOVES = "SELECT 'b' || p_partkey AS via_block_id, 'd' || (p_partkey // 2) AS source_dataset, 'd' || p_partkey AS target_dataset FROM part WHERE p_partkey > 0"
_RENAMES = """
SELECT 'b' || t.p_partkey AS via_block_id, 'size_' || (s.p_size // 10) AS old_column, 'size_' || (t.p_size // 10) AS new_column
FROM part t JOIN part s ON s.p_partkey = t.p_partkey // 2 WHERE t.p_partkey > 0 AND t.p_type IN ('PROMO', 'LARGE')"""


@query("ln_10_column_flows", f"""
WITH c AS ({_COLUMNS}), m AS ({_MOVES}), rn AS ({_RENAMES}),
  b AS (SELECT m.*, c."column" AS source_column, coalesce(rn.new_column, c."column") AS "column" FROM m JOIN c ON c.dataset = m.source_dataset
    LEFT JOIN rn ON rn.via_block_id = m.via_block_id AND rn.old_column = c."column"),
  a AS (SELECT m.*, c."column" FROM m JOIN c ON c.dataset = m.target_dataset)
SELECT via_block_id, source_dataset, target_dataset, source_column, "column",
  CASE WHEN source_column IS NULL THEN 'derived' WHEN a."column" IS NULL THEN 'dropped' WHEN source_column = "column" THEN 'passed' ELSE 'renamed' END AS transformation
FROM b FULL JOIN a USING (via_block_id, source_dataset, target_dataset, "column")""")
def ln_10(spark, d):
    ask = lambda sql: _ask(spark, d, sql.replace('"', "`"), "part")
    return lineage.column_flows(ask(_COLUMNS), ask(_MOVES), ask(_RENAMES))


_RISKY = "SELECT p_partkey AS node, p_size / 50.0 AS score, p_type FROM part"


@query("ln_11_risk_propagation", f"""
WITH RECURSIVE n AS ({_RISKY}), e AS ({_TREE}), seed AS (SELECT node FROM n WHERE score < 0.1 AND p_type = 'PROMO' AND node > 2),
  below AS (SELECT e.dst AS node FROM e JOIN seed ON e.src = seed.node UNION SELECT e.dst FROM e JOIN below ON e.src = below.node),
  steps AS (SELECT node, CAST(0 AS BIGINT) AS k FROM seed UNION SELECT e.dst, steps.k + 1 FROM e JOIN steps ON e.src = steps.node), near AS (SELECT node, min(k) AS distance FROM steps GROUP BY 1)
SELECT n.node, seed.node IS NOT NULL AS risky, below.node IS NOT NULL AS risk_propagated, near.distance FROM n LEFT JOIN near ON near.node = n.node LEFT JOIN seed ON seed.node = n.node LEFT JOIN below ON below.node = n.node""")
def ln_11(spark, d):
    risky = (F.col("score") < 0.1) & (F.col("p_type") == "PROMO") & (F.col("node") > 2)
    return lineage.propagate_risk(_ask(spark, d, _RISKY, "part"), _ask(spark, d, _TREE, "part"), risky)


@query("ln_12_orphans", f"""
WITH {_flows(_SHARED)}, p AS (SELECT DISTINCT dataset FROM w), c AS (SELECT DISTINCT dataset FROM r)
SELECT dataset, 'never_consumed' AS state FROM p WHERE dataset NOT IN (SELECT dataset FROM c) UNION ALL SELECT dataset, 'never_produced' FROM c WHERE dataset NOT IN (SELECT dataset FROM p)""")
def ln_12(spark, d):
    return lineage.orphans(_steps(spark, d, _SHARED))


@query("ln_12_cycles", f"""
WITH RECURSIVE {_flows(_SHARED)}, e AS (SELECT DISTINCT source AS a, target AS b FROM flow),
  pairs AS (SELECT a, b FROM e UNION SELECT pairs.a, e.b FROM pairs JOIN e ON e.a = pairs.b)
SELECT p.a AS node, min(p.b) AS cycle FROM pairs p JOIN pairs q ON q.a = p.b AND q.b = p.a GROUP BY p.a HAVING bool_or(p.a = p.b)""")
def ln_12b(spark, d):
    return lineage.circular(_steps(spark, d, _SHARED))


# A script per part. Line 3 starts its first block; the second starts on line 7, the third on line 10 or 12.
_SCRIPTS = """
SELECT 'scripts/p' || p_partkey || '.sas' AS path, '%LET cutoff = ' || p_size || ';' || chr(10) || '/* ' || p_name || ' */' || chr(10)
  || 'DATA work.a' || p_partkey || ';' || chr(10) || '  SET raw.' || p_type || ';' || chr(10) || '  IF size > &cutoff THEN keep_it = 1;' || chr(10) || 'RUN;' || chr(10)
  || CASE WHEN p_size <= 25 THEN 'proc sort data=work.a' || p_partkey || ' out=Work.S' || p_partkey || ';' || chr(10) || '  by descending size;' || chr(10) || 'run;' || chr(10)
     ELSE 'DATA work.m' || p_partkey || ' work.n' || p_partkey || ';' || chr(10) || '  MERGE work.a' || p_partkey || ' work.s' || (p_partkey // 2) || ';' || chr(10)
       || '  BY size;' || chr(10) || '  CALL SYMPUT("top", size);' || chr(10) || 'RUN;' || chr(10) END
  || CASE p_type WHEN 'ECONOMY' THEN 'PROC SQL;' || chr(10) || '  CREATE TABLE work.q' || p_partkey || ' AS SELECT * FROM work.a' || p_partkey || ' a LEFT JOIN raw.facts b ON a.k = b.k WHERE b.v > &floor_value.;' || chr(10) || 'QUIT;'
     WHEN 'PROMO' THEN 'PROC MEANS DATA=work.a' || p_partkey || '; VAR size; RUN;' WHEN 'LARGE' THEN 'PROC REG DATA=work.a' || p_partkey || '; MODEL y = size; QUIT;' ELSE '' END AS text
FROM part"""


def _scripts(spark, d):
    return _ask(spark, d, _SCRIPTS, "part")


_ALL_BLOCKS = """
SELECT p_partkey, p_size, p_type, 'scripts/p' || p_partkey || '.sas' AS path, 3 AS start_line, 6 AS end_line, 'DATA_STEP' AS block_type, 1 AS nth FROM part
UNION ALL SELECT p_partkey, p_size, p_type, 'scripts/p' || p_partkey || '.sas', 7, CASE WHEN p_size <= 25 THEN 9 ELSE 11 END, CASE WHEN p_size <= 25 THEN 'PROC_SORT' ELSE 'DATA_STEP' END, 2 FROM part
UNION ALL SELECT p_partkey, p_size, p_type, 'scripts/p' || p_partkey || '.sas', CASE WHEN p_size <= 25 THEN 10 ELSE 12 END,
  CASE WHEN p_size <= 25 THEN 10 ELSE 12 END + CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 0 END, CASE p_type WHEN 'ECONOMY' THEN 'PROC_SQL' WHEN 'PROMO' THEN 'PROC_MEANS' ELSE 'PROC_UNKNOWN' END, 3
  FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'LARGE')"""


@query("cp_1_inventory", f"SELECT path, block_type, count(*) AS n_blocks FROM ({_ALL_BLOCKS}) GROUP BY 1, 2")
def cp_1(spark, d):
    return corpus.inventory(_scripts(spark, d))


@query("cp_1_blocks", f"SELECT path || ':' || start_line AS block_id, path, start_line, end_line, block_type FROM ({_ALL_BLOCKS})")
def cp_1b(spark, d):
    return corpus.blocks(_scripts(spark, d)).drop("raw", "ordinal", "statements")


@query("cp_2_dataset_usage", f"""
WITH b AS (SELECT *, path || ':' || start_line AS block_id FROM ({_ALL_BLOCKS}))
SELECT path, block_id, 'raw.' || lower(p_type) AS dataset, 'read' AS direction FROM b WHERE nth = 1
UNION ALL SELECT path, block_id, 'work.a' || p_partkey, 'write' FROM b WHERE nth = 1
UNION ALL SELECT path, block_id, 'work.a' || p_partkey, 'read' FROM b WHERE nth >= 2
UNION ALL SELECT path, block_id, 'work.s' || p_partkey, 'write' FROM b WHERE nth = 2 AND p_size <= 25
UNION ALL SELECT path, block_id, 'work.s' || (p_partkey // 2), 'read' FROM b WHERE nth = 2 AND p_size > 25
UNION ALL SELECT path, block_id, 'work.m' || p_partkey, 'write' FROM b WHERE nth = 2 AND p_size > 25
UNION ALL SELECT path, block_id, 'work.n' || p_partkey, 'write' FROM b WHERE nth = 2 AND p_size > 25
UNION ALL SELECT path, block_id, 'raw.facts', 'read' FROM b WHERE block_type = 'PROC_SQL'
UNION ALL SELECT path, block_id, 'work.q' || p_partkey, 'write' FROM b WHERE block_type = 'PROC_SQL'""")
def cp_2(spark, d):
    return corpus.dataset_usage(_scripts(spark, d))


@query("cp_3_macro_usages", f"""
WITH b AS (SELECT *, path || ':' || start_line AS block_id FROM ({_ALL_BLOCKS}))
SELECT 'CUTOFF' AS macro_name, CAST(p_size AS VARCHAR) AS macro_value, block_id AS used_in_block_id FROM b WHERE nth = 1
UNION ALL SELECT 'FLOOR_VALUE', NULL, block_id FROM b WHERE block_type = 'PROC_SQL'""")
def cp_3(spark, d):
    return corpus.macro_usages(_scripts(spark, d))


@query("cp_3_unresolved_macros", f"""
SELECT 'FLOOR_VALUE' AS macro_name, path || ':' || start_line AS used_in_block_id FROM ({_ALL_BLOCKS}) WHERE block_type = 'PROC_SQL'""")
def cp_3b(spark, d):
    return corpus.unresolved_macros(_scripts(spark, d))


@query("cp_4_log_severity", """
WITH l AS (SELECT 'logs/u' || user_id || '.log' AS log_file, max(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) AS r FROM events GROUP BY 1),
  f AS (SELECT DISTINCT 'logs/u' || user_id || '.log' AS log_file, 'scripts/p' || CAST(floor(value) AS BIGINT) || '.sas' AS related_file FROM events WHERE event_type <> 'view'),
  k AS (SELECT f.* FROM f JOIN part ON f.related_file = 'scripts/p' || p_partkey || '.sas')
SELECT log_file, CASE r WHEN 2 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, related_file FROM l LEFT JOIN k USING (log_file)""")
def cp_4(spark, d):
    lines = _ask(spark, d, """
        SELECT 'logs/u' || user_id || '.log' AS log_file, CASE event_type WHEN 'error' THEN 'ERROR: step failed in ' WHEN 'signup' THEN 'WARNING: uninitialized in ' ELSE 'NOTE: no ERROR in ' END
          || CASE WHEN event_type = 'view' THEN 'general' ELSE 'scripts/p' || CAST(floor(value) AS BIGINT) || '.sas' END || ' at ' || event_id AS line FROM events""", "events")
    return corpus.log_links(lines, _scripts(spark, d).select(F.col("path").alias("file")))


@query("cp_5_risk_flags", f"""
SELECT path || ':' || start_line AS block_id, path,
  CASE WHEN nth = 2 AND p_size > 25 OR block_type = 'PROC_UNKNOWN' THEN 'high' WHEN nth = 2 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN nth = 2 AND p_size > 25 THEN 'call symput, multiple outputs, merge, by group' WHEN nth = 2 THEN 'by group' WHEN block_type = 'PROC_UNKNOWN' THEN 'unknown procedure' ELSE '' END AS flags
FROM ({_ALL_BLOCKS})""")
def cp_5(spark, d):
    return corpus.risk_flags(corpus.blocks(_scripts(spark, d)))


@query("cp_5_overall_risk", f"""
SELECT path, CASE max(CASE WHEN nth = 2 AND p_size > 25 OR block_type = 'PROC_UNKNOWN' THEN 2 WHEN nth = 2 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS overall_risk,
  count(*) AS n_blocks, count(*) FILTER (nth = 2 AND p_size > 25 OR block_type = 'PROC_UNKNOWN') AS n_high FROM ({_ALL_BLOCKS}) GROUP BY path""")
def cp_5b(spark, d):
    return corpus.overall_risk(corpus.risk_flags(corpus.blocks(_scripts(spark, d))))


# A job per order, whose parent is the order with a tenth of its key.
_JOBS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 10 END AS parent_job_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, 'order ' || o_orderkey AS name FROM orders"""


def _jobs(spark, d):
    return _ask(spark, d, _JOBS, "orders")


@query("jb_1_list_jobs", f"""
SELECT id, name, status, created_at, CASE status WHEN 'failed' THEN 1 WHEN 'queued' THEN 2 ELSE 0 END AS file_count,
  row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM ({_JOBS})""")
def jb_1(spark, d):
    files = F.when(F.col("status") == "failed", F.create_map(F.lit("main.sas"), F.lit("x"), F.lit("__ref_csv_a.csv__"), F.lit("y"))).when(
        F.col("status") == "queued", F.create_map(F.lit("a.sas"), F.lit("x"), F.lit("b.sas"), F.lit("y")))
    listed = jobs.list_jobs(_jobs(spark, d).withColumn("files", files))
    return positions(listed, "DESCENDING created_at DESCENDING id", "place").drop("parent_job_id")


_LINE_ORDER = "l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice"


@query("jb_2_latest_revision", f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER.replace(',', ' DESC,')} DESC) AS rn FROM lineitem) WHERE rn = 1""")
def jb_2(spark, d):
    latest = jobs.latest_revision(table(spark, d, "lineitem"), "l_orderkey", _LINE_ORDER.replace(",", ""))
    return latest.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_returnflag")


@query("jb_3_changelog", """
SELECT event_id AS id, user_id AS job_id, ts AS created_at, event_type AS trigger, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events""")
def jb_3(spark, d):
    revisions = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("trigger"))
    return jobs.changelog_positions(revisions)


@query("jb_4_version_history", f"""
WITH RECURSIVE j AS ({_JOBS}), up AS (SELECT id, parent_job_id FROM j WHERE id = 42 UNION SELECT j.id, j.parent_job_id FROM j JOIN up ON j.id = up.parent_job_id),
  down AS (SELECT id FROM up UNION SELECT j.id FROM j JOIN down ON j.parent_job_id = down.id)
SELECT id, status, created_at, id = 42 AS is_current, row_number() OVER (ORDER BY created_at, id) AS place FROM j WHERE id IN (SELECT id FROM down)""")
def jb_4(spark, d):
    family = jobs.version_history(_jobs(spark, d), 42).select("id", "status", "created_at", "is_current")
    return positions(family, "created_at id", "place")


@query("jb_4_family_roots", f"""
WITH RECURSIVE j AS ({_JOBS}), walk AS (SELECT id, id AS root, 0 AS depth FROM j WHERE parent_job_id IS NULL OR parent_job_id = 3
  UNION ALL SELECT j.id, walk.root, walk.depth + 1 FROM j JOIN walk ON j.parent_job_id = walk.id WHERE j.parent_job_id <> 3)
SELECT id AS node, root, depth FROM walk""")
def jb_4b(spark, d):
    parent = F.when(F.col("parent_job_id") != 3, F.col("parent_job_id"))
    return graph.roots(_jobs(spark, d).select(F.col("id").alias("node"), parent.alias("parent")))


@query("jb_5_override_merge", """
WITH u AS (SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN c_custkey + 1000000000000 ELSE c_custkey END AS c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING'))
SELECT c_custkey, c_name, c_acctbal FROM u UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)""")
def jb_5(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new_key = F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_custkey") + 1000000000000).otherwise(F.col("c_custkey"))
    updates = c.filter(F.col("c_mktsegment").isin("FURNITURE", "BUILDING")).select(new_key.alias("c_custkey"), "c_name", F.lit(None).cast("double").alias("c_acctbal"))
    return jobs.merge_overrides(c.drop("c_mktsegment"), updates, "c_custkey")


_PLANS = """
SELECT 'b' || p_partkey AS block_id, 'proj/' || p_brand || '.sas' AS source_file,
  CASE p_type WHEN 'LARGE' THEN 'manual' WHEN 'MEDIUM' THEN 'skip' WHEN 'PROMO' THEN 'translate_with_review' ELSE 'translate' END AS strategy,
  CASE WHEN p_type <> 'ECONOMY' THEN p_size / CAST(50 AS DOUBLE) END AS confidence_score FROM part"""
_CONFIDENCE = """
SELECT 'b' || p_partkey AS block_id, CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 30 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN p_retailprice < 1000 THEN 'verified_low' WHEN p_retailprice < 1300 THEN 'verified_medium' WHEN p_retailprice < 1600 THEN 'verified_high' END AS verified_confidence
FROM part WHERE p_size <= 45"""
_REVISIONS = """
SELECT 'b' || l_partkey AS block_id, l_orderkey, l_linenumber, l_shipdate, l_extendedprice,
  CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' END AS reconciliation_status FROM lineitem"""
_TRUST = f"""
{_flows(_SHARED)}, plans AS ({_PLANS}), conf AS ({_CONFIDENCE}), rev AS ({_REVISIONS}),
  latest AS (SELECT block_id, reconciliation_status FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_shipdate DESC, l_extendedprice DESC) AS rn FROM rev) WHERE rn = 1),
  radius AS (SELECT source_file, count(*) AS blast_radius FROM flow WHERE source_file <> target_file GROUP BY 1),
  trust AS (SELECT p.block_id, p.source_file, p.strategy, p.confidence_score, coalesce(c.confidence, 'unknown') AS self_confidence, c.verified_confidence, l.reconciliation_status, r.blast_radius,
    (coalesce(c.verified_confidence, 'verified_low') = 'verified_low' AND coalesce(l.reconciliation_status = 'fail', false)) OR p.strategy IN ('manual', 'manual_ingestion', 'skip') AS needs_attention
    FROM plans p LEFT JOIN conf c USING (block_id) LEFT JOIN latest l USING (block_id) LEFT JOIN radius r USING (source_file))"""


def _trust(spark, d):
    plans, confidence = _ask(spark, d, _PLANS, "part"), _ask(spark, d, _CONFIDENCE, "part")
    latest = jobs.latest_value(_ask(spark, d, _REVISIONS, "lineitem"), "block_id", "reconciliation_status", "l_orderkey l_linenumber l_shipdate l_extendedprice")
    steps = _steps(spark, d, _SHARED)
    return jobs.trust_rows(plans, confidence, latest, lineage.blast_radius(steps, lineage.cross_file_edges(steps)))


@query("jb_6_trust_rows", f"WITH {_TRUST} SELECT * FROM trust")
def jb_6(spark, d):
    return _trust(spark, d)


@query("jb_7_review_queue", f"""
WITH {_TRUST} SELECT block_id, needs_attention, blast_radius, self_confidence, row_number() OVER (ORDER BY coalesce(blast_radius, -1) DESC,
  CASE self_confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE -1 END, block_id) AS queue_position FROM trust WHERE needs_attention""")
def jb_7(spark, d):
    return jobs.review_order(_trust(spark, d)).select("block_id", "needs_attention", "blast_radius", "self_confidence", "queue_position")


_METRICS = """count(*) AS total_blocks, count(*) FILTER (verified_confidence IN ('verified_high', 'verified_medium')) AS auto_verified,
  count(*) FILTER (needs_attention AND strategy NOT IN ('manual', 'manual_ingestion', 'skip')) AS needs_review, count(*) FILTER (strategy IN ('manual', 'manual_ingestion', 'skip')) AS manual_todo,
  count(*) FILTER (reconciliation_status = 'fail') AS failed_reconciliation"""


@query("jb_8_trust_totals", f"WITH {_TRUST} SELECT source_file, {_METRICS} FROM trust GROUP BY source_file UNION ALL SELECT '(all)', {_METRICS} FROM trust")
def jb_8(spark, d):
    rows = _trust(spark, d)
    return jobs.trust_totals(rows, "source_file").unionByName(jobs.trust_totals(rows).withColumn("source_file", F.lit("(all)")))


_BAND = "CASE WHEN avg_score IS NULL THEN 'unknown' WHEN avg_score >= 0.85 THEN 'high' WHEN avg_score >= 0.65 THEN 'medium' WHEN avg_score >= 0.40 THEN 'low' ELSE 'very_low' END AS overall_confidence"


@query("jb_9_overall_confidence", f"""
WITH p AS ({_PLANS}), g AS (SELECT source_file, strategy, avg(confidence_score) AS avg_score FROM p GROUP BY 1, 2)
SELECT source_file, strategy, round(coalesce(avg_score, 0), 6) AS avg_score, {_BAND} FROM g""")
def jb_9(spark, d):
    found = jobs.overall_confidence(_ask(spark, d, _PLANS, "part"), "source_file strategy")
    return found.withColumn("avg_score", F.round("avg_score", 6))


@query("jb_10_verified_score", f"""
WITH p AS (SELECT p_partkey, p_size / CAST(50 AS DOUBLE) AS s, CASE p_type WHEN 'PROMO' THEN true WHEN 'LARGE' THEN true WHEN 'MEDIUM' THEN false WHEN 'SMALL' THEN false END AS ok FROM part)
SELECT p_partkey, round(CASE WHEN ok THEN CASE WHEN s >= 0.85 THEN s ELSE least(s + 0.1, 1.0) END WHEN NOT ok THEN greatest(s * 0.5, 0.1) END, 6) AS verified FROM p""")
def jb_10(spark, d):
    kind = F.col("p_type")
    passed = F.when(kind.isin("PROMO", "LARGE"), True).when(kind.isin("MEDIUM", "SMALL"), False)
    return table(spark, d, "part").select("p_partkey", F.round(jobs.verified_score(F.col("p_size") / F.lit(50.0), passed), 6).alias("verified"))


@query("jb_11_plan_groups", """
WITH u AS (SELECT CASE WHEN url LIKE '%.org/%' THEN 'page' || page_id ELSE split_part(url, '?', 1) END AS f, CASE WHEN url LIKE '%?%' THEN 'manual' ELSE 'translate' END AS s FROM pages)
SELECT 'folder' AS grouped, CASE WHEN contains(f, '/') THEN regexp_extract(f, '^(.*)/', 1) ELSE '(root)' END AS group_key, count(*) AS n_blocks FROM u GROUP BY 2
UNION ALL SELECT 'manual', f, count(*) FROM u WHERE s = 'manual' GROUP BY 2""")
def jb_11(spark, d):
    url = F.col("url")
    source = F.when(url.like("%.org/%"), F.concat(F.lit("page"), F.col("page_id"))).otherwise(F.split_part(url, F.lit("?"), F.lit(1)))
    plans = table(spark, d, "pages").select(source.alias("source_file"), F.when(url.like("%?%"), "manual").otherwise("translate").alias("strategy"))
    folders = jobs.plan_groups(plans, "folder").withColumn("grouped", F.lit("folder"))
    return folders.unionByName(jobs.plan_groups(plans, "file", ["manual"]).withColumn("grouped", F.lit("manual")))


@query("jb_12_content_hash", """
WITH h AS (SELECT doc_id, sha256(text) AS input_hash FROM documents)
SELECT doc_id, input_hash, row_number() OVER (PARTITION BY input_hash ORDER BY doc_id) AS version FROM h""")
def jb_12(spark, d):
    files = F.array(F.struct(F.col("source").alias("path"), F.col("text").alias("content")))
    hashed = table(spark, d, "documents").select("doc_id", jobs.input_hash(files).alias("input_hash"))
    return jobs.versions_of_same_input(hashed, "input_hash", "doc_id")


@query("jb_12_same_inputs", "SELECT sha256(text) AS input_hash, count(*) AS n_jobs, min(doc_id) AS first_job FROM documents GROUP BY 1")
def jb_12b(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", jobs.content_hash(F.col("text")).alias("input_hash"))
    return hashed.groupBy("input_hash").agg(F.count("*").alias("n_jobs"), F.min("doc_id").alias("first_job"))


@query("jb_13_dashboard", f"""
SELECT CAST(created_at AS DATE) AS day, count(*) AS n_jobs, round(100.0 * count(*) FILTER (status IN ('done', 'accepted')) / count(*), 6) AS pct_done,
  round(100.0 * count(*) FILTER (status = 'done') / nullif(count(*) FILTER (status <> 'queued'), 0), 6) AS pass_rate,
  round(avg(CASE WHEN status = 'done' THEN id END), 4) AS avg_seconds, count(*) FILTER (status = 'failed') AS n_failed FROM ({_JOBS}) GROUP BY 1""")
def jb_13(spark, d):
    passed = F.when(F.col("status") == "done", True).when(F.col("status") == "failed", False)
    later = F.expr("created_at + make_dt_interval(0, 0, 0, id)")
    rows = _jobs(spark, d).withColumns({"passed": passed, "updated_at": later, "day": F.col("created_at").cast("date")})
    found = jobs.dashboard(rows, "day")
    return found.withColumns({"pct_done": F.round("pct_done", 6), "pass_rate": F.round("pass_rate", 6), "avg_seconds": F.round("avg_seconds", 4)})


@query("jb_14_revision_diff", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), n AS (SELECT conv_id, turn, line, count(*) AS n FROM l GROUP BY 1, 2, 3),
  added AS (SELECT a.conv_id, a.turn, sum(greatest(a.n - coalesce(b.n, 0), 0)) AS added FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.line = a.line GROUP BY 1, 2),
  removed AS (SELECT b.conv_id, b.turn + 1 AS turn, sum(greatest(b.n - coalesce(a.n, 0), 0)) AS removed FROM n b LEFT JOIN n a ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND b.line = a.line GROUP BY 1, 2)
SELECT conv_id, turn, CAST(added AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed FROM added LEFT JOIN removed USING (conv_id, turn)""")
def jb_14(spark, d):
    return jobs.revision_diff(table(spark, d, "conversations"), "conv_id", "turn", "text")


# Revisions 1, 3 and 4 of each document, its lines numbered: 3 leaves out every third line, 4 has the first line of 3 at its
# end (where 3 has over two lines) and a new line in front.
_NUMBERED = """
SELECT doc_id, i, concat(CAST(i AS STRING), ': ', line) AS line FROM (SELECT doc_id, posexplode(split(text, chr(10))) AS (i, line) FROM documents)"""
_REVISED = f"""
WITH l AS ({_NUMBERED}), third AS (SELECT doc_id, i, line, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE i % 3 <> 1)
SELECT doc_id, 1 AS n, array_join(transform(array_sort(collect_list(struct(i, line))), x -> x.line), chr(10)) AS code FROM l GROUP BY doc_id
UNION ALL SELECT doc_id, 3, array_join(transform(array_sort(collect_list(struct(i, line))), x -> x.line), chr(10)) FROM third GROUP BY doc_id
UNION ALL SELECT doc_id, 4, concat('new', chr(10), array_join(transform(array_sort(collect_list(struct(IF(i = 0 AND n > 2, 999999999, i) AS i, line))), x -> x.line), chr(10))) FROM third GROUP BY doc_id"""


@query("jb_14_line_diff", """
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, (i - 1) || ': ' || s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
  third AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM l WHERE i % 3 <> 1)
SELECT doc_id, 1 AS n, 'added' AS change, NULL AS old_line, i + 1 AS new_line, line FROM l
UNION ALL SELECT doc_id, 3, 'removed', i + 1, NULL, line FROM l WHERE i % 3 = 1
UNION ALL SELECT DISTINCT doc_id, 4, 'added', NULL::INTEGER, 1, 'new' FROM l
UNION ALL SELECT doc_id, 4, 'moved', 1, n + 1, line FROM third WHERE i = 0 AND n > 2""")
def jb_14b(spark, d):
    return line_diff(run_sql(spark, _REVISED, {"documents": table(spark, d, "documents")}), "doc_id", "n", "code")


@query("jb_15_audit", """
SELECT o_orderkey AS job_id, sha256(CAST(o_orderkey AS VARCHAR)) AS input_hash, o_orderpriority AS llm_model, o_orderdate AS created_at, o_orderdate AS updated_at, o_orderstatus AS report FROM orders""")
def jb_15(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), jobs.content_hash(F.col("o_orderkey").cast("string")).alias("input_hash"), F.col("o_orderpriority").alias("llm_model"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderstatus").alias("report"), "o_totalprice")
    return jobs.audit_records(rows)
