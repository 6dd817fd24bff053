"""Texts as numbered lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a line with its line break, or what follows the last break
_PIECE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"


@F.pandas_udf(T.ArrayType(T.LongType()))
def starts_of(lengths: pd.Series) -> pd.Series:
    """1-based start of each piece from the lengths of the pieces of a text."""
    return lengths.map(lambda n: np.cumsum(np.asarray(n, dtype="int64")) - n + 1)


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def bare_line(piece: Column) -> Column:
    return F.rtrim(piece, F.lit("\r\n"))


def read_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text: rows (key, line, offset, text), all counted from 1.

    `offset` counts characters. Lines stay in the task that holds their text; only
    line lengths go through the running total.
    """
    cut = df.select(key, pieces_of(F.col(text)).alias("_pieces"))
    placed = cut.withColumn("_starts", starts_of(F.transform("_pieces", lambda p: F.length(p))))
    each = placed.select(key, F.posexplode(F.arrays_zip("_pieces", "_starts")).alias("_at", "_piece"))
    return each.select(
        key,
        (F.col("_at") + 1).alias("line"),
        F.col("_piece._starts").alias("offset"),
        bare_line(F.col("_piece._pieces")).alias("text"),
    )


def section_size(text: Column) -> Column:
    """Characters of a text without its line breaks."""
    return F.length(F.translate(text, "\r\n", ""))
