"""Quality rules by compression: texts and chunks whose zstandard ratio leaves its band are rejected.

The ratio is compressed bytes by bytes. Repetitive text compresses far better than prose, encoded or random
text far worse. What is usual depends on length, so each length has limits of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import per_batch, table

LEVEL = 3
#: Bytes, the lowest and the highest ratio of a text of so many; between them both go straight over the logarithm of the length.
#: Shorter texts have no limits, longer ones those of the last. The highest lie between what prose gave (`documents` at sf0.1, by
#: quarters of a doubling) and what words of random base64 digits, from 861 bytes on of letters and from 2048 on of hex digits give.
BANDS = (
    (128, 0.40, 0.95),
    (181, 0.38, 0.89),
    (256, 0.35, 0.85),
    (362, 0.32, 0.80),
    (512, 0.30, 0.74),
    (608, 0.29, 0.70),
    (724, 0.28, 0.645),
    (861, 0.28, 0.615),
    (1024, 0.27, 0.608),
    (1217, 0.27, 0.585),
    (1448, 0.26, 0.570),
    (1722, 0.26, 0.545),
    (2048, 0.25, 0.533),
    (2435, 0.24, 0.528),
    (2896, 0.23, 0.520),
    (4096, 0.22, 0.506),
    (8192, 0.20, 0.490),
    (16384, 0.20, 0.470),
)
#: Bytes of the largest and the smallest chunk, and the share of chunks outside their limits from which on a text is rejected.
CHUNK, LEAST_CHUNK, CHUNK_SHARE = 4096, 128, 0.25

LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(found: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of `size` words that occurs twice or more in the text, its first place included."""
    if len(found) <= size:
        return 0
    index: dict[bytes, int] = {}
    codes = np.array([index.setdefault(w, len(index)) for w in found], dtype=np.int64)
    # number the windows of growing width exactly: no hashes
    window, width = codes, 1
    while width < size:
        step = min(width, size - width)  # two windows that overlap still tell the wider one exactly
        left, right = window[: len(window) - step], window[step:]
        _, window = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
        width += step
    often = np.bincount(window)[window] > 1
    covered = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return again


def ratio(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(compressor.compress(data)) / len(data)


def limits(size: int) -> tuple[float, float]:
    """The lowest and the highest usual ratio of so many bytes."""
    if size < BANDS[0][0]:
        return 0.0, float("inf")
    at = np.log2([b[0] for b in BANDS])
    return tuple(float(np.interp(np.log2(size), at, [b[k] for b in BANDS])) for k in (1, 2))


def chunks(data: bytes) -> list[bytes]:
    """Chunks that cover all of a text of twice LEAST_CHUNK or more; the last ends with the text and may overlap the one before.

    They are CHUNK bytes long, or the power of two that fits a shorter text two or three times.
    """
    size = min(CHUNK, 1 << max(0, len(data).bit_length() - 2))
    if size < LEAST_CHUNK:
        return []
    starts = [*range(0, len(data) - size + 1, size)]
    if len(data) % size:
        starts.append(len(data) - size)
    return [data[i : i + size] for i in starts]


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    ratio: float | None
    chunks_outside: float
    kept: bool


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> Measures:
    data = (text or "").encode()
    found = data.split()
    chars = len(data.translate(None, _SPACE + _CONTINUED))  # bytes that begin a code point of a word
    repeats = repeated_words(found)
    failed = len(found) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(found)
    whole = ratio(data, compressor) if data else None
    low, high = limits(len(data))
    parts = chunks(data)
    least, most = limits(len(parts[0])) if parts else (0.0, float("inf"))
    outside = sum(not least <= ratio(part, compressor) <= most for part in parts) / max(1, len(parts))
    kept = not failed and low <= whole <= high and outside < CHUNK_SHARE
    return Measures(
        len(found), chars, len(data.translate(None, _NOT_SYMBOLS)), repeated_lines(data), repeats, failed, whole, outside, kept
    )


def compression_bands(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunks_outside) per row.

    `kept` is false where a base rule fails, where the ratio of the whole text leaves the band of its length, or
    where CHUNK_SHARE or more of its chunks, which cover it to its end, leave theirs. A null or empty text has no words, a null
    ratio, and fails. Whole texts are measured, however long. Ids may be null or repeated: each row gives one
    row. Only the two named columns are read. No rows give no rows.
    """
    columns = {
        "n_words": pa.int64(),
        "word_chars": pa.int64(),
        "n_symbols": pa.int64(),
        "n_dup_lines": pa.int64(),
        "n_repeat_words": pa.int64(),
        "base_failed": pa.bool_(),
        "kept": pa.bool_(),
        "ratio": pa.float64(),
        "chunks_outside": pa.float64(),
    }
    compressors: list[zstandard.ZstdCompressor] = []

    def of(batch: pa.RecordBatch):
        if not compressors:  # one per worker
            compressors.append(zstandard.ZstdCompressor(level=LEVEL))
        found = [measure(t.as_py(), compressors[0]) for t in batch["text"]]
        arrays = [pa.array([getattr(m, name) for m in found], kind) for name, kind in columns.items()]
        yield pa.RecordBatch.from_arrays([batch["id"], *arrays], ["id", *columns])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(
        per_batch(of),
        f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, ratio double, chunks_outside double",
    )


def op2_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return compression_bands(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
