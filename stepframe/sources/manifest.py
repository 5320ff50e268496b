"""Which files of an upload are accepted, and why others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted file types.
ACCEPTED_EXTENSIONS = [".sas", ".sas7bdat", ".csv", ".log", ".xlsx", ".xls"]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of all files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", F.col("modificationTime").alias("modified"), "length")
    )


def classify(listing: DataFrame, path: str = "path") -> DataFrame:
    """Adds norm_path, extension, status (accepted, rejected, ignored) and reason.

    Resource-fork files, names ending in a slash and paths with a `..` part are ignored; an unknown extension is rejected.
    """
    norm = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"^/+", "")
    name = F.element_at(F.split("norm_path", "/"), -1)
    # Leading dots of a name do not start an extension.
    extension = F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]*)$", 1))
    parts = F.split("norm_path", "/")
    ignored = (
        F.when(name == "", "directory")
        .when(name.startswith("._") | F.col("norm_path").startswith("__MACOSX/"), "resource fork")
        .when(F.array_contains(parts, ".."), "path escapes the upload")
    )
    rejected = F.when(~F.col("extension").isin(ACCEPTED_EXTENSIONS),
                      F.concat(F.lit("Unsupported file type: "), F.when(F.col("extension") == "", "(none)").otherwise(F.col("extension"))))
    return (
        listing.withColumn("norm_path", norm)
        .withColumn("extension", extension)
        .withColumn("__ignored", ignored)
        .withColumn("status", F.when(F.col("__ignored").isNotNull(), "ignored").when(rejected.isNotNull(), "rejected").otherwise("accepted"))
        .withColumn("reason", F.coalesce(F.col("__ignored"), rejected))
        .drop("__ignored")
    )
