"""The shared folder, written intermediate tables, and numbers that grow with an order key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.semantics import StepError


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise StepError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stepframe-{spark.sparkContext.applicationId}"


_paths: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the session's part of the shared folder."""
    _paths.append(f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def scratch_paths() -> tuple[str, ...]:
    """All paths given out so far, in order."""
    return tuple(_paths)


def delete_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete some intermediate tables; frames built on them can no longer be read."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session; frames built on them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; the shuffles that led to them go at once.

    One job, against two for `checkpoint()`, and later plans know the real size and read only needed columns.
    """
    path = scratch_path(df.sparkSession, "cut")
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Written rows and, from the same job, how many of them meet each condition."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()]))
    return written, {name: (seen.get or {}).get(name) or 0 for name in counts}


def cut_bucketed(df: DataFrame, column: str, **options: str) -> DataFrame:
    """Written rows in as many buckets of a column as there are shuffle partitions: a join on it moves only the other side.

    The name in the catalog goes at once; the rows stay in the session's part of the shared folder.
    """
    spark = df.sparkSession
    path, buckets = scratch_path(spark, "buckets"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stepframe_{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).options(path=path, **options).saveAsTable(name)
    table = spark.table(name)
    # The plan of `table` knows its files and buckets by now.
    table.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return table


def ordinal(column: Column, data_type: T.DataType) -> Column | None:
    """A number that grows with the value, or None for a type without one."""
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(data_type, T.TimestampNTZType):
        # Not through a zoned timestamp: a clock change would break the order.
        minutes = (F.unix_date(column.cast("date")).cast("long") * 24 + F.hour(column)) * 60 + F.minute(column)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return column.cast("double")
    return None
