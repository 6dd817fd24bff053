"""Exact search for the highest inner products with a pivot-distance index.

The index keys each vector by its nearest pivot and its distance to that pivot, cut into annuli of bounded size. By the triangle
inequality no vector of an annulus is nearer to a query than its pivot's distance allows, and none reaches farther from the pivot than
the annulus; with the annulus' largest norm both bound its inner products with the query. A query first expands the annuli of the highest bounds, and knows then
its k-th best score; of the others it visits those whose bound reaches it.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqset.llm.frames import per_batch, table
from seqset.session import saved

TOP, SCALE = 10, 1024
#: Vectors for each pivot, pivots at most, sampled vectors that pivots and annuli are fitted on.
PIVOT_ROWS, MAX_PIVOTS, SAMPLE = 512, 256, 16_384
#: Vectors of an annulus, about; larger ones are dealt into slices. Annuli that a query visits before it prunes.
ANNULUS_ROWS, FIRST = 256, 4
#: Queries that meet one slice in one task.
QUERY_ROWS = 4096
#: Vectors with a larger component have no place among the pivots: every query meets them.
FAR = 2.0**200
#: More than the rounding of any bound, in parts of what it is made of.
SLACK = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1
SEED = 42


def _numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) with components as little-endian 64-bit floats, without vectors that hold null or no finite number."""

    def of(batch: pa.RecordBatch):
        found, kept = [], []
        for row, vector in enumerate(batch["vector"]):
            values = vector.as_py()
            if values is None or None in values:
                continue
            numbers = np.array(values, dtype="<f8")
            if np.isfinite(numbers).all():
                kept.append(row)
                found.append(numbers.tobytes())
        ids = batch["id"].take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], ["id", "vector"])

    kind = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    return rows.mapInArrow(per_batch(of), f"id {kind}, vector binary")


def _matrix(blobs, width: int) -> np.ndarray:
    """Rows of equal width; missing components are 0."""
    out = np.zeros((len(blobs), width))
    for row, blob in enumerate(blobs):
        values = np.frombuffer(blob, "<f8")
        out[row, : len(values)] = values
    return out


def _floors(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as floats."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * matrix)


def _exact(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in numbers of any length."""
    found = [[math.floor(Fraction(x) * SCALE) for x in row] for row in matrix.tolist()]
    return np.array(found, dtype=object).reshape(matrix.shape)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of the integers floor(SCALE * x), exactly; a product beyond 64 bits is the nearest 64-bit number."""
    a, b = _floors(left), _floors(right)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, left.shape[1])
    if bound < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    products = _exact(left) @ _exact(right).T if left.shape[1] else np.zeros((len(left), len(right)), object)
    return np.array([[min(max(p, LEAST), MOST) for p in row] for row in products.tolist()], np.int64).reshape(products.shape)


class Pivots:
    """Pivots, and the distances at which the annuli of each end."""

    def __init__(self, sample: np.ndarray, rows: int):
        points = _floors(sample)
        points = points[(np.abs(points) < FAR).all(axis=1)]
        random = np.random.default_rng(SEED)
        wanted = int(max(1, min(MAX_PIVOTS, rows // PIVOT_ROWS, len(points))))
        self.points = points[random.choice(len(points), wanted, replace=False)] if len(points) else np.zeros((1, sample.shape[1]))
        for _ in range(4 if len(points) else 0):  # towards the middle of what they are nearest to
            near = self.distances(points).argmin(1)
            for k in range(wanted):
                if (near == k).any():
                    self.points[k] = points[near == k].mean(0)
        distance = self.distances(points)
        near = distance.argmin(1) if len(points) else np.empty(0, int)
        self.ends = []
        for k in range(len(self.points)):
            own = distance[near == k, k]
            bands = max(1, round(len(own) / max(1, len(points)) * rows / ANNULUS_ROWS))
            self.ends.append(np.unique(np.quantile(own, np.arange(1, bands) / bands)) if len(own) and bands > 1 else np.empty(0))

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points * points).sum(1)[:, None] + (self.points * self.points).sum(1)[None] - 2 * points @ self.points.T
        return np.sqrt(np.maximum(0, squares))

    def of_vectors(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest pivot (-1: none), distance to it, annulus and norm."""
        points = _floors(vectors)
        far = (np.abs(points) >= FAR).any(axis=1)
        points[far] = 0
        distance = self.distances(points)
        pivot = distance.argmin(1)
        own = distance[np.arange(len(points)), pivot]
        band = np.array([np.searchsorted(self.ends[p], d) for p, d in zip(pivot, own)], dtype=np.int64)
        norm = np.sqrt((points * points).sum(1))
        pivot[far], own[far], band[far], norm[far] = -1, 0, 0, np.inf
        return pivot, own, band, norm

    def of_queries(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Norms, distances to all pivots and products with them; a query too far for that has infinite ones."""
        points = _floors(vectors)
        far = (np.abs(points) >= FAR).any(axis=1)
        points[far] = 0
        norm, distance, product = np.sqrt((points * points).sum(1)), self.distances(points), points @ self.points.T
        norm[far], distance[far], product[far] = np.inf, 0, np.inf
        return norm, distance, product


BLOCK = ["pivot", "band", "slice"]


def _visits(blocks: DataFrame, visits: DataFrame, asked: DataFrame, width: int, slices: int, top: int, kind: str) -> DataFrame:
    """The best of each visited block for each visiting query: (query_id, vec_id, score)."""
    schema = f"query_id {kind}, vec_id {kind}, score bigint"

    def best(block: pa.Table, callers: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, sort_keys=[("id", "ascending")], null_placement="at_end"))
        ids, names = block["id"].combine_chunks(), callers["id"].combine_chunks()
        who, what, scores = [], [], []
        if len(ids) and len(names):
            # by places from here on: ids stay as Arrow has them
            found = _products(_matrix(callers["vector"].to_pylist(), width), _matrix(block["vector"].to_pylist(), width))
            for k, row in enumerate(found):
                own = np.asarray(pc.fill_null(pc.equal(ids, names[k]), False))
                others = np.flatnonzero(~own)
                at = others[np.argsort(~row[others], kind="stable")[:top]]
                who.append(np.full(len(at), k))
                what.append(at)
                scores.append(row[at])
        who, what, scores = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (who, what, scores))
        return pa.table({"query_id": names.take(pa.array(who)), "vec_id": ids.take(pa.array(what)), "score": pa.array(scores)})

    key = [*BLOCK, "callers"]
    spread = blocks.withColumn("callers", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    called = visits.select("id", *BLOCK).join(asked.select("id", "vector"), "id").withColumn("callers", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    return (
        spread.select(*key, "id", "vector").groupBy(*key).cogroup(called.select(*key, "id", "vector").groupBy(*key)).applyInArrow(best, schema)
    )


def search(vectors: DataFrame, queries: DataFrame, top: int, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """The result of `top_products`, and (id, compared): how many vectors each query was compared with."""
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = saved(_numbers(vectors, id_column, vector_column))
    asked = _numbers(queries, id_column, vector_column).where("id IS NOT NULL")
    asked = saved(asked.groupBy("id").agg(F.min("vector").alias("vector")))
    numbers = rows.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    n, width = numbers[0], max((numbers[1] or 0), asked.agg(F.max(F.octet_length("vector"))).first()[0] or 0) // 8
    dealt = F.pmod(F.xxhash64("id", "vector", F.lit(SEED)), F.lit(1 << 30))
    sample = rows.where(dealt < int((1 << 30) * min(1.0, SAMPLE / max(1, n))) + 1).select("vector").collect()
    shared = vectors.sparkSession.sparkContext.broadcast(Pivots(_matrix([r["vector"] for r in sample], width), n))

    def key(batch: pa.RecordBatch):
        if batch.num_rows:
            found = shared.value.of_vectors(_matrix(batch["vector"].to_pylist(), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], ["id", "vector", "pivot", "distance", "band", "norm"])

    keyed = saved(rows.mapInArrow(per_batch(key), f"id {kind}, vector binary, pivot bigint, distance double, band bigint, norm double"))
    cut = keyed.groupBy("pivot", "band").agg(F.ceil(F.count("*") / F.lit(4 * ANNULUS_ROWS)).alias("slices"))
    blocks = saved(
        keyed.join(cut, ["pivot", "band"]).withColumn("slice", F.pmod(F.xxhash64("id", "vector"), F.col("slices")).cast("int"))
    )
    edges = blocks.groupBy(*BLOCK).agg(
        F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.max("norm").alias("longest"), F.count("*").alias("rows")
    )

    def measure(batch: pa.RecordBatch):
        if batch.num_rows:
            norm, distance, product = shared.value.of_queries(_matrix(batch["vector"].to_pylist(), width))
            # one more row for the vectors without pivot
            distance, product = (np.hstack([x, np.full((len(x), 1), end)]) for x, end in ((distance, 0), (product, np.inf)))
            pivots = distance.shape[1]
            who, pivot = np.repeat(np.arange(len(norm)), pivots), np.tile([*range(pivots - 1), -1], len(norm))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(who)), *map(pa.array, (norm[who], pivot.astype(np.int64), distance.ravel(), product.ravel()))],
                ["id", "norm", "pivot", "far", "product"],
            )

    at_pivots = asked.mapInArrow(per_batch(measure), f"id {kind}, norm double, pivot bigint, far double, product double")
    gap = F.greatest(F.lit(0.0), F.col("far") - F.col("outer"), F.col("inner") - F.col("far"))
    squares = F.col("norm") * F.col("norm") + F.col("longest") * F.col("longest")
    # what lies within the annulus: at most `outer` from the pivot, at least `gap` from the query, at most `longest` from the origin
    bound = F.least(F.col("product") + F.col("norm") * F.col("outer"), (squares - gap * gap) / 2, F.col("norm") * F.col("longest"))
    reach = bound + F.lit(SLACK) * (squares + 1)
    open_annuli = at_pivots.join(edges, "pivot").withColumn("reach", F.when(F.isnan(reach), float("inf")).otherwise(reach))
    nearest = Window.partitionBy("id").orderBy(F.desc("reach"), *BLOCK)
    ranked = saved(open_annuli.withColumn("turn", F.row_number().over(nearest)).select("id", *BLOCK, "rows", "reach", "turn"))

    slices = 1 + asked.count() // QUERY_ROWS
    begun = ranked.where(F.col("turn") <= FIRST)
    first = saved(_visits(blocks, begun, asked, width, slices, top, kind))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    last = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == top).select(F.col("query_id").alias("asker"), F.col("score").alias("least"))
    # an equal score may have the smaller id
    rest = ranked.where(F.col("turn") > FIRST).join(last, F.col("id") == F.col("asker"), "left")
    rest = rest.where(F.col("least").isNull() | (F.col("reach") >= F.col("least"))).select(*ranked.columns)
    found = first.union(_visits(blocks, rest, asked, width, slices, top, kind))
    result = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    return result, begun.union(rest).groupBy("id").agg(F.sum("rows").alias("compared"))


def top_products(
    vectors: DataFrame, queries: DataFrame, top: int = TOP, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `top` vectors with the highest integer inner products.

    Components become floor(SCALE * x), exactly; a score that no long holds is the nearest long. A vector that is null or holds null or
    no finite number takes no part; an empty one has product 0 with all; missing components count as 0. A query does not find rows with its own id; fewer
    rows than `top` give fewer. Ties go to the smaller id, null last. Rows repeated in `queries` count once. Extra columns
    are not read. No queries or no vectors give no rows. Every vector is indexed; pivots and annuli are fitted on a sample of about SAMPLE.
    """
    return search(vectors, queries, top, id_column, vector_column)[0]


def op10_pivot_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest integer inner products of every vector whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings")
    return top_products(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
