"""Lineage over tables of steps: who produces what, order, closures, files, column flows.

A step row has `node` (unique), `seq` (program order), `file`, `inputs` and `outputs` (arrays of dataset names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.operators.graph import cycles, peel, reach
from stepframe.operators.ordered import counter, retain


def _inputs(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("node").alias("target"), F.col("file").alias("target_file"), F.explode("inputs").alias("dataset"))


def last_producers(steps: DataFrame) -> DataFrame:
    """(dataset, source, source_file): the last step in program order that writes it."""
    written = steps.select("seq", "node", "file", F.explode("outputs").alias("dataset"))
    last = written.groupBy("dataset").agg(F.max_by(F.struct("node", "file"), F.struct("seq", "node")).alias("p"))
    return last.select("dataset", F.col("p.node").alias("source"), F.col("p.file").alias("source_file"))


def flow_edges(steps: DataFrame) -> DataFrame:
    """(source, target, dataset, inferred): last producer to every consumer, no edge to itself."""
    joined = last_producers(steps).join(_inputs(steps), "dataset")
    return joined.filter(F.col("source") != F.col("target")).select("source", "target", "dataset", F.lit(False).alias("inferred"))


def cross_file_edges(steps: DataFrame) -> DataFrame:
    """Flow edges whose ends lie in different files."""
    joined = last_producers(steps).join(_inputs(steps), "dataset")
    return joined.filter((F.col("source") != F.col("target")) & (F.col("source_file") != F.col("target_file"))).select(
        F.col("source").alias("source_block_id"), F.col("target").alias("target_block_id"),
        F.col("dataset").alias("shared_dataset"), "source_file", "target_file")


def as_edges(flows: DataFrame) -> DataFrame:
    return flows.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def dependency_order(steps: DataFrame) -> DataFrame:
    """(node, seq, level): sort by level, then seq. Any cycle puts every step at level 0, the original order."""
    levels, left, _ = peel(steps.select("node"), as_edges(flow_edges(steps)))
    if not left.isEmpty():
        return steps.select("node", "seq", F.lit(0).alias("level"))
    return steps.select("node", "seq").join(levels, "node")


def related(edges: DataFrame, node) -> DataFrame:
    """Ancestors, the node itself and descendants: (node, relation)."""
    seed = edges.sparkSession.createDataFrame([(node,)], ["node"])
    seed = seed.select(F.col("node").cast(edges.schema["src"].dataType).alias("node"))
    side = lambda backwards: reach(edges, seed, backwards=backwards).filter("distance > 0").select("node")
    tagged = side(True).withColumn("a", F.lit(1)).withColumn("d", F.lit(0)).unionByName(side(False).withColumn("a", F.lit(0)).withColumn("d", F.lit(1)))
    relation = F.when((F.max("a") == 1) & (F.max("d") == 1), "both").when(F.max("a") == 1, "ancestor").otherwise("descendant")
    return tagged.groupBy("node").agg(relation.alias("relation")).unionByName(seed.withColumn("relation", F.lit("self")))


def propagate_risk(nodes: DataFrame, edges: DataFrame, risky: Column) -> DataFrame:
    """(node, risky, risk_propagated, distance): what lies downstream of a low-confidence or failed step."""
    marked = nodes.select("node", F.coalesce(risky, F.lit(False)).alias("risky"))
    hit = reach(edges, marked.filter("risky").select("node"))
    below = as_below(hit, edges)
    return marked.join(hit, "node", "left").join(below, "node", "left").select(
        "node", "risky", F.coalesce("below", F.lit(False)).alias("risk_propagated"), "distance")


def as_below(hit: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with a predecessor among the hit nodes (seeds that feed each other count as well)."""
    return hit.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().withColumn("below", F.lit(True))


def blast_radius(files: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Outgoing cross-file edges per file; 0 for a file without any."""
    out = file_edges.filter(F.col("source_file") != F.col("target_file")).groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("n"))
    return files.select("file").distinct().join(out, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("blast_radius"))


def degrees(file_edges: DataFrame) -> DataFrame:
    """How many edge ends touch each file."""
    ends = file_edges.select(F.explode(F.array("source_file", "target_file")).alias("file"))
    return ends.groupBy("file").agg(F.count("*").alias("degree"))


def file_nodes(steps: DataFrame, file_edges: DataFrame) -> DataFrame:
    """(file, basename, block_count, connection_count) for every file with steps."""
    blocks = steps.groupBy("file").agg(F.count("*").alias("block_count"))
    return blocks.join(degrees(file_edges), "file", "left").select(
        "file", F.element_at(F.split("file", "/"), -1).alias("basename"), "block_count", F.coalesce("degree", F.lit(0)).alias("connection_count"))


def merge_parallel_edges(file_edges: DataFrame) -> DataFrame:
    """One edge per file pair, its distinct reasons in words, joined in order."""
    words = F.lower(F.replace("reason", F.lit("_"), F.lit(" ")))
    return file_edges.groupBy("source_file", "target_file").agg(F.array_join(F.array_sort(F.collect_set(words)), ", ").alias("label"))


def _written_and_read(stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    placed = stages.where(F.col("position").isNotNull())
    return (placed.select(F.col("step_id").alias("source"), F.col("position").alias("p"), F.explode(F.array_distinct("outputs")).alias("dataset")),
            placed.select(F.col("step_id").alias("target"), F.col("position").alias("q"), F.explode(F.array_distinct("inputs")).alias("dataset")))


def step_edges(stages: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, label): an earlier stage's outputs that a later stage reads. Needs step_id, position, inputs, outputs.

    As many rows as pairs; with `targets` (column `node`) only the edges into those stages. `step_links` counts all of
    them without forming a pair.
    """
    written, read = _written_and_read(stages)
    if targets is not None:
        read = read.join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi")
    shared = written.join(read, "dataset").filter(F.col("p") < F.col("q"))
    return shared.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_list("dataset")), ", ").alias("label"))


def step_links(stages: DataFrame) -> DataFrame:
    """(dataset, target, n_sources): how many earlier stages write what a stage reads, by a sweep over positions.

    Writers and readers of a dataset stay one row each: at a reader's position the writers before it are counted. A dataset with
    very many of both is cut into ranges like any other order.
    """
    written, read = _written_and_read(stages)
    # At one position reads come first, for a stage reads what earlier ones wrote.
    events = read.select("dataset", F.col("q").alias("position"), F.lit(0).alias("writes"), F.col("target").alias("step")).unionByName(
        written.select("dataset", F.col("p").alias("position"), F.lit(1).alias("writes"), F.col("source").alias("step")))
    counted = retain(events, "dataset", "position writes step", {"n_sources": counter(F.when(F.col("writes") == 1, 1))})
    return counted.where("writes = 0 AND n_sources > 0").select("dataset", F.col("step").alias("target"), "n_sources")


def flow_counts(flows: DataFrame, column_flows: DataFrame) -> DataFrame:
    """Flow edges with the number of column flows made by their source step."""
    counts = column_flows.groupBy(F.col("via_block_id").alias("source")).agg(F.count("*").alias("n"))
    return flows.join(counts, "source", "left").select(*[flows[c] for c in flows.columns], F.coalesce("n", F.lit(0)).alias("column_count"))


def column_flows(catalogue: DataFrame, steps: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """Passed, renamed, derived and dropped columns of every step.

    `catalogue` has (dataset, column); `steps` has (via_block_id, source_dataset, target_dataset); `renames` has
    (via_block_id, old_column, new_column).
    """
    columns = catalogue.select("dataset", "column").distinct()
    step = ["via_block_id", "source_dataset", "target_dataset"]
    before = steps.select(*step).join(columns.withColumnsRenamed({"dataset": "source_dataset"}), "source_dataset").select(*step, F.col("column").alias("source_column"))
    after = steps.select(*step).join(columns.withColumnsRenamed({"dataset": "target_dataset"}), "target_dataset").select(*step, "column")
    if renames is None:
        before = before.withColumn("column", F.col("source_column"))
    else:
        declared = renames.select("via_block_id", F.col("old_column").alias("source_column"), "new_column")
        before = before.join(declared, ["via_block_id", "source_column"], "left").withColumn("column", F.coalesce("new_column", "source_column")).drop("new_column")
    # One source column per (step, target column): both sides hold unique keys, so a plain full join is safe.
    before = before.groupBy(*step, "column").agg(F.min("source_column").alias("source_column"))
    kind = (
        F.when(F.col("source_column").isNull(), "derived").when(F.col("__after").isNull(), "dropped")
        .when(F.col("source_column") == F.col("column"), "passed").otherwise("renamed")
    )
    return before.join(after.withColumn("__after", F.lit(1)), [*step, "column"], "full").select(*step, "source_column", "column", kind.alias("transformation"))


def orphans(steps: DataFrame) -> DataFrame:
    """Datasets never consumed or never produced: (dataset, state)."""
    ends = steps.select(F.explode("outputs").alias("dataset"), F.lit(1).alias("made"), F.lit(0).alias("used")).unionByName(
        steps.select(F.explode("inputs").alias("dataset"), F.lit(0).alias("made"), F.lit(1).alias("used")))
    seen = ends.groupBy("dataset").agg(F.max("made").alias("made"), F.max("used").alias("used"))
    state = F.when(F.col("used") == 0, "never_consumed").when(F.col("made") == 0, "never_produced")
    return seen.select("dataset", state.alias("state")).filter(F.col("state").isNotNull())


def circular(steps: DataFrame) -> DataFrame:
    """Steps that depend on themselves through others: (node, cycle)."""
    return cycles(steps.select("node"), as_edges(flow_edges(steps)))


