"""Lists of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select_paths(
    df: DataFrame, path: str, include: str, exclude: str | None = None,
    extra: DataFrame | None = None,
) -> DataFrame:
    """Found paths that match `include`, then the extra ones; drops all that match `exclude`.

    Paths listed twice stay listed twice.
    """
    found = df.select(path).filter(F.col(path).rlike(include))
    if extra is not None:
        found = found.unionByName(extra.select(path))
    return found if exclude is None else found.filter(~F.col(path).rlike(exclude))


def list_files(
    spark: SparkSession, folder: str, suffix: str = ".php", exclude: str | None = None
) -> DataFrame:
    """Files below a folder that end in `suffix`: rows (path, length). Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
        .select("path", "length")
    )
    return files if exclude is None else files.filter(~F.col("path").rlike(exclude))


def read_files(spark: SparkSession, folder: str, suffix: str = ".php") -> DataFrame:
    """Whole files below a folder: rows (path, text)."""
    return (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .text(folder)
        .select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    )
