"""Reconcile a stream against running totals per group: a group is judged as its rows arrive, late ones included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.operators.reconcile import RELATIVE_TOLERANCE
from stepframe.semantics import names_of, numeric_columns, require_columns, same_keys
from stepframe.sizing import cut_lineage

_FACTS = "status string, ref_rows long, actual_rows long, detail string, batch_id long"


def _totals(df: DataFrame, by: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    sums = [x for c in columns for x in (F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(f"{side}_sum_{c}"), F.count(number(c)).alias(f"{side}_n_{c}"))]
    return df.groupBy(*by).agg(F.count("*").alias(f"{side}_rows"), *sums)


def _off(columns: Sequence[str], rtol: float) -> Column:
    """What is wrong with a group whose rows are all there, empty if nothing is."""
    parts = []
    for c in columns:
        r, a, rn, an = (F.col(f"{side}_{fact}_{c}") for fact in ("sum", "n") for side in ("ref", "actual"))
        far = F.when(r == 0, a != 0).otherwise(F.coalesce(F.try_divide(F.abs(r - a), F.abs(r)) > rtol, F.lit(False)))
        parts.append(F.when(far, F.format_string(f"{c}: ref_sum=%.4f, actual_sum=%.4f", r, a)).when(rn != an, F.format_string(f"{c}: ref_count=%d, actual_count=%d", rn, an)))
    return F.concat_ws("; ", *parts) if parts else F.lit("")


def reconcile_running(arrivals: DataFrame, reference: DataFrame, by: str | Sequence[str], report_path: str, checkpoint_path: str, *,
                      rtol: float = RELATIVE_TOLERANCE) -> None:
    """Run over all that has arrived, then stop; run again to go on where it ended.

    The stream's totals per group are state that Spark keeps; the reference is aggregated once a run, not per batch. Each
    batch reports the groups it touched: `open` while rows are missing, then `pass` or `fail`; `fail` too with rows too
    many, `unexpected` for a group the reference lacks. A late row updates its group's report. A batch that is replayed
    goes on from the state before it and overwrites its own folder.
    """
    by = names_of(by)
    require_columns(arrivals, by, "BY variable")
    columns = [c for c in numeric_columns(reference) if c in arrivals.columns and c not in by]
    expected = cut_lineage(_totals(reference, by, columns, "ref"))

    def report(totals: DataFrame, batch_id: int) -> None:
        joined = same_keys(totals, expected, by, "left")
        detail = (F.when(F.col("actual_rows") > F.col("ref_rows"), F.format_string("ref=%d, actual=%d", "ref_rows", "actual_rows"))
                  .when(F.col("actual_rows") == F.col("ref_rows"), _off(columns, rtol)))
        status = (F.when(F.col("ref_rows").isNull(), "unexpected").when(F.col("actual_rows") < F.col("ref_rows"), "open")
                  .when(F.coalesce(detail, F.lit("")) != "", "fail").otherwise("pass"))
        joined.select(*by, status.alias("status"), "ref_rows", "actual_rows", F.nullif(detail, F.lit("")).alias("detail")).write.mode("overwrite").parquet(f"{report_path}/batch_id={batch_id}")

    running = _totals(arrivals, by, columns, "actual")
    query = running.writeStream.outputMode("update").foreachBatch(report).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    query.awaitTermination()


def group_reports(spark: SparkSession, report_path: str, reference: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """The latest report of each group; `missing` for groups of the reference that never arrived."""
    by = names_of(by)
    keys = ", ".join(f"`{c}` {reference.schema[c].dataType.simpleString()}" for c in by)
    reports = spark.read.schema(f"{keys}, {_FACTS}").parquet(report_path)
    latest = reports.groupBy(*by).agg(F.max_by(F.struct("status", "ref_rows", "actual_rows", "detail"), "batch_id").alias("r")).select(*by, "r.*")
    counts = reference.groupBy(*by).agg(F.count("*").alias("ref_rows"))
    never = same_keys(counts, latest.select(*by), by, "left_anti").select(*by, F.lit("missing").alias("status"), "ref_rows", F.lit(0).cast("long").alias("actual_rows"), F.lit(None).cast("string").alias("detail"))
    return latest.unionByName(never)
