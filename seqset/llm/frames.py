"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text: longest runs without space, tab, LF, VT, FF or CR."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case and all other letters as they are."""
    return text.encode().lower().split() if text else []


def per_batch(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]):
    """A function of one record batch as `mapInArrow` wants it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return run


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
