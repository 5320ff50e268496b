"""Analytics over job, revision and plan tables: history, trust report, review queue, versions, dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.operators.combine import upsert
from stepframe.operators.graph import roots
from stepframe.operators.ordered import last_of_group, positions, row_numbers
from stepframe.operators.step import band
from stepframe.ranges import order_rank
from stepframe.semantics import Key, by_keys, names_of
from stepframe.sizing import cut_lineage

# Fixed values of the trust report.
MANUAL_STRATEGIES = ["manual", "manual_ingestion", "skip"]
VERIFIED_BY_MACHINE = ["verified_high", "verified_medium"]
CONFIDENCE_ORDER = {"unknown": -1, "low": 0, "medium": 1, "high": 2}
BAND_EDGES = [None, 0.40, 0.65, 0.85, None]
BANDS = ["very_low", "low", "medium", "high"]


def is_sentinel(path: Column) -> Column:
    """`__key__` entries of a files map stand for stored uploads, not for script files."""
    return path.startswith("__") & path.endswith("__")


def list_jobs(jobs: DataFrame) -> DataFrame:
    """Newest first, with the number of real files."""
    return with_file_count(jobs).orderBy(F.col("created_at").desc(), F.col("id").desc())


def with_file_count(jobs: DataFrame) -> DataFrame:
    """`files` (map path -> content) replaced by `file_count`; an absent map counts 0."""
    count = F.size(F.map_filter("files", lambda path, _: ~is_sentinel(path)))
    return jobs.withColumn("file_count", F.when(F.col("files").isNull(), 0).otherwise(count)).drop("files")


def latest_revision(revisions: DataFrame, by: str | Sequence[str] = "block_id", order_by="revision_number") -> DataFrame:
    """The highest revision of each block; whole rows, limited per group before the shuffle."""
    return last_of_group(revisions, by, order_by)


def latest_value(revisions: DataFrame, by: str | Sequence[str], value: str, order_by) -> DataFrame:
    """One column of the latest revision, as an aggregate combined before the shuffle."""
    return revisions.groupBy(*names_of(by)).agg(F.max_by(value, order_rank(revisions, by_keys(order_by))).alias(value))


def changelog(revisions: DataFrame, job_id) -> DataFrame:
    """One job's revisions, newest first."""
    return revisions.filter(F.col("job_id") == job_id).orderBy(F.col("created_at").desc(), F.col("id").desc())


def changelog_positions(revisions: DataFrame, name: str = "place", **options) -> DataFrame:
    """Every job's change log at once: `place` 1 is a job's newest revision. Ids are numbers here."""
    return row_numbers(revisions, ["job_id"], [Key("created_at", True), Key("id", True)], name, **options)


def version_history(jobs: DataFrame, job_id) -> DataFrame:
    """All versions of a job's family, from its root down, oldest first, with `is_current`."""
    tree = roots(jobs.select(F.col("id").alias("node"), F.col("parent_job_id").alias("parent")))
    # One root.
    own = F.broadcast(tree.filter(F.col("node") == job_id).select("root"))
    family = tree.join(own, "root", "left_semi").select(F.col("node").alias("id"))
    return jobs.join(family, "id", "left_semi").withColumn("is_current", F.col("id") == job_id)


def merge_overrides(base: DataFrame, updates: DataFrame, key: str = "block_id") -> DataFrame:
    return upsert(base, updates, key)


def trust_rows(plans: DataFrame, confidence: DataFrame, latest: DataFrame, radius: DataFrame | None) -> DataFrame:
    """One row per planned block with its confidence, reconciliation status, attention flag and blast radius.

    `confidence` has (block_id, confidence, verified_confidence), `latest` (block_id, reconciliation_status),
    `radius` (file, blast_radius) or None if no lineage is known.
    """
    rows = (
        plans.join(confidence.select("block_id", "confidence", "verified_confidence"), "block_id", "left")
        .join(latest.select("block_id", "reconciliation_status"), "block_id", "left")
        .withColumn("self_confidence", F.coalesce("confidence", F.lit("unknown")))
        .drop("confidence")
    )
    if radius is None:
        rows = rows.withColumn("blast_radius", F.lit(None).cast("long"))
    else:
        rows = rows.join(radius.select(F.col("file").alias("source_file"), "blast_radius"), "source_file", "left")
        # A file without outgoing edges has no radius, which sorts last.
        rows = rows.withColumn("blast_radius", F.when(F.col("blast_radius") > 0, F.col("blast_radius")))
    unproven = F.col("verified_confidence").isNull() | (F.col("verified_confidence") == "verified_low")
    failed = F.coalesce(F.col("reconciliation_status") == "fail", F.lit(False))
    return rows.withColumn("needs_attention", (unproven & failed) | F.col("strategy").isin(MANUAL_STRATEGIES))


def review_order(rows: DataFrame, name: str = "queue_position") -> DataFrame:
    """The trust rows that need attention, with their place: wide blast radius first, low confidence, then block id."""
    rank = F.lit(CONFIDENCE_ORDER["unknown"])
    for word, value in CONFIDENCE_ORDER.items():
        rank = F.when(F.col("self_confidence") == word, value).otherwise(rank)
    keyed = rows.where("needs_attention").withColumns({"__reach": F.coalesce("blast_radius", F.lit(-1).cast("long")), "__rank": rank})
    # The order is sized, sampled and sorted, so the joined rows are written once first.
    placed = positions(cut_lineage(keyed), [Key("__reach", True), Key("__rank"), Key("block_id")], name)
    return placed.drop("__reach", "__rank")


def trust_totals(rows: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Block counts per file (`by="source_file"`) or over all."""
    manual = F.col("strategy").isin(MANUAL_STRATEGIES)
    return rows.groupBy(*names_of(by)).agg(
        F.count("*").alias("total_blocks"),
        F.count_if(F.col("verified_confidence").isin(VERIFIED_BY_MACHINE)).alias("auto_verified"),
        F.count_if(F.col("needs_attention") & ~manual).alias("needs_review"),
        F.count_if(manual).alias("manual_todo"),
        F.count_if(F.col("reconciliation_status") == "fail").alias("failed_reconciliation"),
    )


def confidence_band(score: Column) -> Column:
    """high >= .85, medium >= .65, low >= .40, else very_low; unknown without a score or below 0."""
    return F.when(score.isNull() | (score < 0), "unknown").otherwise(band(score, BAND_EDGES, BANDS))


def overall_confidence(plans: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Average score (blocks without one are left out) and its band."""
    averaged = plans.groupBy(*names_of(by)).agg(F.avg("confidence_score").alias("avg_score"))
    return averaged.withColumns({"overall_confidence": confidence_band(F.col("avg_score")), "avg_score": F.coalesce("avg_score", F.lit(0.0))})


def verified_score(score: Column, passed: Column) -> Column:
    """After reconciliation: a pass keeps .85 and more and lifts less by .1 up to 1; a failure halves, at least .1."""
    lifted = F.when(score >= 0.85, score).otherwise(F.least(score + 0.1, F.lit(1.0)))
    return F.when(passed, lifted).when(~passed, F.greatest(score * 0.5, F.lit(0.1)))


def folder_of(path: Column) -> Column:
    """Everything before the last slash; `(root)` without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise("(root)")


def plan_groups(plans: DataFrame, group_by: str = "file", strategies: Sequence[str] = ()) -> DataFrame:
    """Planned blocks per file, per folder or in all, optionally of some strategies only."""
    keys = {"file": F.col("source_file"), "folder": folder_of(F.col("source_file")), "none": F.lit("")}
    chosen = plans.filter(F.col("strategy").isin(list(strategies))) if strategies else plans
    return chosen.groupBy(keys[group_by].alias("group_key")).agg(F.count("*").alias("n_blocks"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def input_hash(files: Column) -> Column:
    """SHA-256 over a job's file contents in upload order; `files` is an array of (path, content) in that order."""
    return F.sha2(F.array_join(F.transform(files, lambda f: f["content"]), ""), 256)


def versions_of_same_input(jobs: DataFrame, hash_column: str, order_by, **options) -> DataFrame:
    """`version` counts jobs with the same input hash in order; one hash may belong to very many."""
    return row_numbers(jobs, [hash_column], order_by, "version", **options)


def dashboard(jobs: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Jobs, share done, pass rate and mean duration. Needs status, passed (nullable), created_at, updated_at."""
    seconds = F.unix_timestamp("updated_at") - F.unix_timestamp("created_at")
    done = F.col("status").isin("done", "accepted")
    return jobs.groupBy(*names_of(by)).agg(
        F.count("*").alias("n_jobs"),
        F.try_divide(F.count_if(done) * 100.0, F.count("*")).alias("pct_done"),
        F.try_divide(F.count_if(F.col("passed")) * 100.0, F.count("passed")).alias("pass_rate"),
        F.avg(F.when(done, seconds)).alias("avg_seconds"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def revision_diff(revisions: DataFrame, by: str | Sequence[str], number: str, text: str) -> DataFrame:
    """Lines added and removed between a revision and the one numbered before it, counted as multisets.

    Every line counts +1 for its own revision and -1 for the next; no revisions are joined. The first revision
    of a block adds all its lines. Numbers are consecutive.
    """
    by = names_of(by)
    lines = revisions.select(*by, number, F.explode(F.split(text, "\n")).alias("line"))
    signs = F.array(F.struct(F.col(number).alias("n"), F.lit(1).alias("s")), F.struct((F.col(number) + 1).alias("n"), F.lit(-1).alias("s")))
    signed = lines.select(*by, "line", F.inline(signs)).groupBy(*by, "n", "line").agg(F.sum("s").alias("s"))
    counted = signed.groupBy(*by, "n").agg(
        F.sum(F.greatest("s", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("s"), F.lit(0))).alias("removed"))
    # The revision after the last one is not real.
    real = revisions.select(*by, F.col(number).alias("n")).distinct()
    return counted.join(real, [*by, "n"], "left_semi").withColumnRenamed("n", number)


def audit_records(jobs: DataFrame) -> DataFrame:
    """The immutable provenance columns of a job."""
    return jobs.select(F.col("id").alias("job_id"), "input_hash", "llm_model", "created_at", "updated_at", "report")
