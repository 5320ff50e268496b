"""Reconcile batches as they arrive: each one once, its check rows appended under its batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.operators.reconcile import CHECKS, RELATIVE_TOLERANCE, reconcile


def reconcile_stream(arrivals: DataFrame, reference_for: Callable[[DataFrame], DataFrame], report_path: str, checkpoint_path: str, *,
                     transform: Callable[[DataFrame], DataFrame] | None = None, rtol: float = RELATIVE_TOLERANCE) -> None:
    """Run over all that has arrived, then stop; run again to go on where it ended.

    `reference_for(batch)` gives the reference rows a batch must equal. A batch that is replayed after a lost
    driver overwrites its own folder, so its rows never appear twice.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        actual = transform(batch) if transform else batch
        report = reconcile(reference_for(batch), actual, rtol)
        report.coalesce(1).write.mode("overwrite").parquet(f"{report_path}/batch_id={batch_id}")

    query = (
        arrivals.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_reports(spark, report_path: str) -> DataFrame:
    return spark.read.schema(f"{CHECKS}, batch_id long").parquet(report_path).select(F.col("batch_id"), "seq", "name", "status", "detail")
