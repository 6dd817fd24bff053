"""Product codes of vectors: eight parts, sixteen codebook entries for each, assigned through memoised grid cells.

Every part of a vector lies in a cell of a coarse grid. For a cell, only those entries can be nearest to a point in it that
no other entry dominates across its whole box: an entry falls if its least distance from the box is above another entry's
largest, or if another is nearer at every corner of the box. What is left is remembered by the cell's hash, so that each cell is
judged once per worker and round; distances are computed, exactly and in integers, to those entries alone.

The driver holds the codebooks only. A round is one pass over the vectors: tasks add up their parts per entry, the sums are added by Spark.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import table
from seqset.operators.skew import null_safe_left
from seqset.session import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Cells that a worker remembers of one part; beyond, it starts anew.
CELLS = 1 << 18
#: Integers up to this are computed with in 64 bits, larger ones in numbers of any length.
SMALL = 1 << 26
#: Rows that are compared with the entries at once.
BLOCK = 4096
#: Bits of a number that sums of large numbers are cut into.
LIMB = 48
LONGEST = (1 << 63) - 1


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of floor(SCALE * x), filled with 0 up to `width`; and which rows are too large for 64 bits, left 0 here."""
    sizes = np.diff(np.asarray(vectors.offsets))
    values = np.asarray(vectors.values.cast(pa.float64()))[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(scaled)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    large = np.zeros(len(sizes), bool)
    large[row[np.abs(scaled) >= SMALL]] = True
    out = np.zeros((len(sizes), width), np.int64)
    inside = ~large[row]
    out[row[inside], place[inside]] = scaled[inside].astype(np.int64)
    return out, large


def exact_integers(vector: list[float], width: int) -> np.ndarray:
    """floor(SCALE * x) in numbers of any length."""
    found = [math.floor(Fraction(float(x)) * SCALE) for x in vector]
    return np.array(found + [0] * (width - len(found)), dtype=object)


class GridCells:
    """Nearest entries of one part's codebook; what can be nearest within a grid cell is judged once and remembered."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.small = bool((np.abs(book) < SMALL).all()) if book.size else True
        # a cell is as wide as the entries are spread, rounded to a power of two
        spread = float(np.std(book.astype(float))) if self.small and book.size else 1.0
        self.side = 1 << max(0, round(math.log2(max(1.0, spread))))
        self.cells: dict[int, tuple[bytes, int]] = {}
        self.factors = np.random.default_rng(book.shape[1]).integers(1, 1 << 62, book.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bits = np.uint32(1) << np.arange(len(book), dtype=np.uint32)
        if self.small:
            self.numbers = book.astype(np.int64)

    def _judged(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries, as bits, that no other dominates across its box."""
        low = cells * self.side
        high = low + (self.side - 1)
        below, above = low[:, None] - self.numbers[None], self.numbers[None] - high[:, None]
        nearest = np.maximum(np.maximum(below, above), 0)
        farthest = np.maximum(np.abs(below), np.abs(above))
        least, most = (nearest * nearest).sum(2), (farthest * farthest).sum(2)
        kept = least <= most.min(axis=1)[:, None]
        # |x - a|^2 - |x - b|^2 is linear in x: its largest value in the box is found one coordinate at a time
        for a in range(len(self.numbers)):
            slope = 2 * (self.numbers - self.numbers[a])
            rest = (self.numbers[a] ** 2).sum() - (self.numbers**2).sum(1)
            largest = np.maximum(slope[None] * low[:, None], slope[None] * high[:, None]).sum(2) + rest[None]
            kept &= largest >= 0
        return kept @ self.bits

    def _masks(self, parts: np.ndarray) -> np.ndarray:
        cells = parts // self.side
        hashes = (cells.view(np.uint64) * self.factors).sum(1, dtype=np.uint64)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        masks = np.zeros(len(first), np.uint32)
        names = [(int(hashes[k]), cells[k].tobytes()) for k in first]
        new = []
        for k, (number, cell) in enumerate(names):
            known = self.cells.get(number)
            if known is not None and known[0] == cell:
                masks[k] = known[1]
            else:
                new.append(k)
        for at in range(0, len(new), 256):
            some = np.array(new[at : at + 256])
            masks[some] = self._judged(cells[first[some]])
        if len(self.cells) + len(new) > CELLS:
            self.cells.clear()
        for k in new:
            self.cells[names[k][0]] = (names[k][1], int(masks[k]))
        out = masks[inverse]
        # another cell of the same hash: all entries are compared
        out[(cells != cells[first][inverse]).any(axis=1)] = self.bits.sum(dtype=np.uint32)
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each part the nearest entry (the first of several), the squared distance and how many were computed."""
        if not self.small:
            return self.plain(parts.astype(object))
        where, error, compared = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for at in range(0, len(parts), BLOCK):
            some = parts[at : at + BLOCK]
            open_ones = (self._masks(some)[:, None] & self.bits[None]) != 0
            row, entry = np.nonzero(open_ones)
            apart = some[row] - self.numbers[entry]
            distance = (apart * apart).sum(1)
            counts = open_ones.sum(1)
            starts = np.cumsum(counts) - counts
            best = np.minimum.reduceat(distance, starts)
            hits = np.flatnonzero(distance == best[row])
            _, first = np.unique(row[hits], return_index=True)
            where[at : at + BLOCK], error[at : at + BLOCK], compared[at : at + BLOCK] = entry[hits[first]], best, counts
        return where, error, compared

    def plain(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for numbers of any length, with all entries."""
        apart = parts[:, None] - self.book.astype(object)[None]
        distance = (apart * apart).sum(2) if parts.shape[1] else np.zeros((len(parts), len(self.book)), object)
        where = np.array([min(range(len(d)), key=d.__getitem__) for d in distance.tolist()], np.int64)
        best = np.array([d[k] for d, k in zip(distance.tolist(), where)], dtype=object)
        return where, best, np.full(len(parts), len(self.book))


def _judge(batch: pa.RecordBatch, grids: list[GridCells], width: int):
    """Runs of rows: (row numbers, parts, entries, errors, comparisons), small and large numbers apart."""
    vectors = batch["vector"]
    numbers, large = integers(vectors, width * PARTS)
    runs = [(np.flatnonzero(~large), numbers[~large])]
    if large.any():
        at = np.flatnonzero(large)
        runs.append((at, np.array([exact_integers(vectors[int(k)].as_py(), width * PARTS) for k in at], dtype=object).reshape(len(at), -1)))
    for at, found in runs:
        if len(at):
            parts = [np.ascontiguousarray(found[:, p * width : (p + 1) * width]) for p in range(PARTS)]
            yield at, parts, [g.plain(x) if x.dtype == object else g.nearest(x) for g, x in zip(grids, parts)]


def _grids(books: list[np.ndarray]) -> list[GridCells]:
    return [GridCells(b) for b in books]


def _sums(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, place, limb, total) over all vectors; place -1 has the count."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def of(batches):
        grids, total = _grids(shared.value), {}
        sums, counts = np.zeros((PARTS, ENTRIES, width), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        seen = 0
        for batch in batches:
            for _, parts, found in _judge(batch, grids, width):
                for p, (x, (where, _, _)) in enumerate(zip(parts, found)):
                    counts[p] += np.bincount(where, minlength=ENTRIES)
                    if x.dtype != object:
                        np.add.at(sums[p], where, x)
                        continue
                    for k, row in zip(where, x.tolist()):
                        for place, value in enumerate(row):
                            total[p, int(k), place] = total.get((p, int(k), place), 0) + value
            seen += batch.num_rows
            if seen > LONGEST // SMALL // 2:
                yield written(sums, counts, total)
                sums[:], counts[:], seen = 0, 0, 0
                total.clear()
        yield written(sums, counts, total)

    def written(sums, counts, total):
        rows = [(p, k, -1, 0, int(counts[p, k])) for p, k in zip(*np.nonzero(counts))]
        rows += [(p, k, i, 0, int(sums[p, k, i])) for p, k, i in zip(*np.nonzero(sums))]
        for (p, k, i), value in total.items():
            limb, rest = 0, abs(value)
            while rest:
                part = rest & ((1 << LIMB) - 1)
                rows.append((p, k, i, limb, part if value > 0 else -part))
                limb, rest = limb + 1, rest >> LIMB
        names = ["part", "entry", "place", "limb", "total"]
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], names)

    found = rows.select("vector").mapInArrow(of, "part int, entry int, place int, limb int, total bigint")
    return found.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _moved(books: list[np.ndarray], sums: DataFrame, width: int) -> list[np.ndarray]:
    """Each entry that has parts becomes floor(sum / count) of them."""
    totals: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():  # entries times components, whatever the number of vectors
        own = totals.setdefault((r["part"], r["entry"]), [0] * (width + 1))
        own[r["place"]] += int(r["total"]) << (LIMB * r["limb"])
    out = [b.copy() for b in books]
    for (p, k), own in totals.items():
        if own[-1]:
            out[p][k] = [s // own[-1] for s in own[:-1]]
    return out


def grid_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, compared) per vector, and the codebooks of the eight parts.

    Components become floor(SCALE * x), exactly, however large. Vectors that are null or hold null or no finite number are left
    out. A width that eight does not divide, and vectors shorter than the longest, are filled with zeros. Codebooks start with the vectors of
    the 16 smallest ids (fewer rows: all; equal ids: by components; null ids last) and are moved ROUNDS times to the floor of the mean of
    what is nearest; ties go to the first entry, unused ones stay. `error` is the sum of squared distances (no more than the
    largest long), `compared` the distances computed, of ENTRIES * PARTS. Repeated rows count each; null ids and labels are kept; extra columns
    are not read. An empty table gives an empty table. The driver holds the codebooks; all rows are assigned in every round.
    """
    finite = F.forall(vector_column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vector_column).isNotNull() & finite).select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")
    )
    rows = saved(rows)
    width = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    start = np.array([exact_integers(r["vector"], width * PARTS) for r in first], dtype=object).reshape(len(first), width * PARTS)
    books = [start[:, p * width : (p + 1) * width] for p in range(PARTS)]
    for _ in range(ROUNDS if first else 0):
        books = _moved(books, _sums(rows, books, width), width)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def of(batches):
        grids = _grids(shared.value)
        for batch in batches:
            code = np.zeros((batch.num_rows, PARTS), np.int64)
            error, compared = np.zeros(batch.num_rows, object), np.zeros(batch.num_rows, np.int64)
            for at, _, found in _judge(batch, grids, width):
                for p, (where, squares, tried) in enumerate(found):
                    code[at, p] = where
                    error[at] += squares.astype(object)
                    compared[at] += tried
            texts = ["".join(f"{k:02x}" for k in row) for row in code.tolist()]
            errors = [min(e, LONGEST) for e in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], pa.array(texts, pa.string()), pa.array(errors, pa.int64()), pa.array(compared)],
                ["id", "label", "code", "error", "compared"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(of, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, compared bigint"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimals, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def op13_grid_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, the errors of its label, and the digest of the codebooks."""
    found, books = grid_codes(table(spark, folder, "embeddings"))
    codes = saved(found)
    of_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("bigint").alias("label_error"))
    return null_safe_left(codes, of_label, ["label"]).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _round_sql(k: int) -> str:
    """Assignment to the codebook of round k, and the next codebook."""
    return f""", a{k} AS MATERIALIZED (
  SELECT r, p, min({{'d': list_sum(list_transform(x, lambda v, i: (v - e[i]) * (v - e[i])))::BIGINT, 'k': k}}) AS best
  FROM parts JOIN b{k} USING (p) GROUP BY r, p
), s{k} AS (
  SELECT p, best.k AS k, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n
  FROM parts JOIN a{k} USING (r, p), unnest(generate_series(1, len(x))) AS u(i) GROUP BY 1, 2, 3
), m{k} AS (
  SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{k} GROUP BY p, k
), b{k + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (p, k)
)"""


OP13_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * (len(v) // 8) + 1, (p + 1) * (len(v) // 8)) AS x FROM kept, unnest(generate_series(0, 7)) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, r - 1 AS k, x AS e FROM parts WHERE r <= 16
)"""
    + "".join(_round_sql(k) for k in range(ROUNDS))
    + f""", last AS MATERIALIZED (
  SELECT r, p, min({{'d': list_sum(list_transform(x, lambda v, i: (v - e[i]) * (v - e[i])))::BIGINT, 'k': k}}) AS best
  FROM parts JOIN b{ROUNDS} USING (p) GROUP BY r, p
), codes AS (
  SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (r) CROSS JOIN digest
"""
)
