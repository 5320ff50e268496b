"""Reading and writing files: CSV, parquet, PROC IMPORT / EXPORT, in-line records, logs, the reference chooser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.semantics import StepError, nan_to_null, normalize_names, require_columns

CORRUPT = "_corrupt_record"
_FORMATS = {"csv": ("csv", {}), "tab": ("csv", {"sep": "\t"}), "dlm": ("csv", {"sep": " "}), "json": ("json", {}), "parquet": ("parquet", {}), "orc": ("orc", {})}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Types are inferred (one more pass over the file) unless a schema is given."""
    reader = spark.read.options(header=True, **options)
    if schema is not None:
        return nan_to_null(normalize_names(reader.schema(schema).csv(path)))
    return nan_to_null(normalize_names(_wide_integers(reader.option("inferSchema", True).csv(path))))


def _wide_integers(df: DataFrame) -> DataFrame:
    """Inferred integers are long, so that one file's values do not decide the type."""
    return df.withColumns({f.name: F.col(f.name).cast("long") for f in df.schema.fields if isinstance(f.dataType, T.IntegerType)})


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(normalize_names(spark.read.parquet(path)))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    require_columns(df, partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _format(dbms: str) -> tuple[str, dict]:
    try:
        return _FORMATS[dbms.lower()]
    except KeyError:
        raise StepError(f"unknown DBMS {dbms!r}; known: {sorted(_FORMATS)}") from None


def proc_import(spark: SparkSession, datafile: str, dbms: str = "csv", schema: T.StructType | None = None, getnames: bool = True,
                delimiter: str | None = None) -> DataFrame:
    """PROC IMPORT. With a schema, rows that do not fit keep their text in `_corrupt_record` and are not lost."""
    name, options = _format(dbms)
    reader = spark.read.format(name).options(**options)
    if delimiter:
        reader = reader.option("sep", delimiter)
    if name == "csv":
        reader = reader.option("header", getnames)
    if schema is None:
        df = _wide_integers(reader.option("inferSchema", True).load(datafile)) if name == "csv" else reader.load(datafile)
        return nan_to_null(normalize_names(df))
    if name in ("csv", "json"):
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return nan_to_null(normalize_names(reader.schema(schema).load(datafile)))


def proc_export(df: DataFrame, outfile: str, dbms: str = "csv", replace: bool = False, delimiter: str | None = None) -> None:
    """PROC EXPORT; without REPLACE an existing target is an error."""
    name, options = _format(dbms)
    writer = df.write.format(name).options(**options).mode("overwrite" if replace else "errorifexists")
    if name == "csv":
        writer = writer.option("header", True)
    if delimiter:
        writer = writer.option("sep", delimiter)
    writer.save(outfile)


def read_records(lines: DataFrame, column: str, schema: T.StructType | str, delimiter: str = ",", dsd: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """INFILE DATALINES: delimited text rows to columns.

    With DSD two delimiters in a row mean a missing value and quotes protect delimiters; without it runs of
    delimiters count as one.
    """
    require_columns(lines, [column, *keep])
    text = F.col(column) if dsd else F.regexp_replace(F.trim(F.col(column)), f"(\\Q{delimiter}\\E)+", delimiter)
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return lines.select(*keep, F.from_csv(text, ddl, {"sep": delimiter}).alias("__r")).select(*keep, "__r.*")


def split_special_missing(df: DataFrame, columns: Sequence[str], data_type: str = "double") -> DataFrame:
    """Text columns to numbers; special missings .A to .Z and ._ become NULL with their code in `<c>_miss`."""
    require_columns(df, columns)
    code = {f"{c}_miss": F.nullif(F.regexp_extract(F.trim(F.col(c)), r"^\.([A-Z_])$", 1), F.lit("")) for c in columns}
    return df.withColumns(code).withColumns({c: F.col(c).try_cast(data_type) for c in columns})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (log_file, line)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("log_file"), F.col("value").alias("line"))


def choose_reference(spark: SparkSession, parquet: str = "", csv: str = "", schema: T.StructType | str | None = None) -> DataFrame | None:
    """The typed reference wins over CSV; None if neither is given, which means nothing to reconcile."""
    if parquet:
        return read_parquet(spark, parquet)
    if csv:
        return read_csv(spark, csv, schema)
    return None


def write_report(report: DataFrame, path: str) -> None:
    """Check rows as JSON lines."""
    report.write.mode("overwrite").json(path)
