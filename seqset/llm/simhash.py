"""Near duplicates by SimHash fingerprints, found in vantage-point trees.

Two fingerprints that differ in at most three bits differ in at most one bit of their upper
or of their lower half. So there is one tree for each half, searched with radius one. On whole
fingerprints with radius three the bounds prune little: distances of unlike texts crowd around
32, and most of them lie within three of any boundary.

A tree is built from a bounded sample and only says which shard a half belongs to: an inner
node holds a vantage point and a distance, halves up to that distance go inside, others outside.
A fingerprint lives in one shard per tree and also visits the other shards that the triangle
bounds leave open. Shards are compared exactly, in blocks of bounded size.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.components import component_roots
from seqset.llm.frames import free_name, lower_words, per_batch, table
from seqset.session import saved

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints that a shard should hold, the shards a tree may have, and sampled fingerprints per shard.
SHARD_ROWS, MAX_SHARDS, SAMPLE_PER_SHARD = 1024, 1024, 16
#: Fingerprints in one block of a shard; larger shards are compared block by block, in tasks of their own.
BLOCK_ROWS = 8192


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the lower-cased word shingles of a text, repeats included; 0 without words."""
    found = lower_words(text)
    if not found:
        return 0
    if len(found) < size:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    ends = [s - 1 for s in starts[size:]]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), 1 << 16):
        part = ends[at : at + (1 << 16)]
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at:], part)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, fp) per row; a null text counts as empty."""

    def of(batch: pa.RecordBatch):
        found = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], pa.array(found.view(np.int64))], ["id", "text_hash", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(per_batch(of), f"id {kind}, text_hash bigint, fp bigint")


class Tree:
    """A vantage-point tree over 32-bit halves; its leaves are shards."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = SEED):
        # of each node: vantage point, distance, inner and outer child; a leaf has its number in place of the children
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        random = np.random.default_rng(seed)
        todo = [(np.unique(sample), None, 0)]
        while todo:
            part, parent, side = todo.pop()
            here = len(self.nodes)
            if parent is not None:
                point, cut, inner, outer = self.nodes[parent]
                self.nodes[parent] = (point, cut, here, outer) if side == 0 else (point, cut, inner, here)
            split = self._split(part, random) if len(part) > leaf_size else None
            if split is None:
                self.nodes.append((0, -1, self.leaves, self.leaves))
                self.leaves += 1
                continue
            point, cut, inside = split
            self.nodes.append((point, cut, -1, -1))
            todo += [(part[~inside], here, 1), (part[inside], here, 0)]

    @staticmethod
    def _split(part: np.ndarray, random: np.random.Generator):
        point = part[random.integers(len(part))]
        distance = np.bitwise_count(part ^ point)
        cut = int(np.median(distance))
        if cut == distance.max():
            cut -= 1
        inside = distance <= cut
        return (int(point), cut, inside) if inside.any() and not inside.all() else None

    def route(self, halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: with radius 0 the home of each half, else every leaf that its ball can reach."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(halves)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            point, cut, inner, outer = self.nodes[node]
            if cut < 0:
                rows.append(at)
                leaves.append(np.full(len(at), inner, np.int32))
                continue
            distance = np.bitwise_count(halves[at] ^ np.uint32(point)).astype(np.int16)
            # triangle bounds: what lies within the radius has a distance from d - radius to d + radius
            todo += [(inner, at[distance - radius <= cut]), (outer, at[distance + radius > cut])]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate(rows), np.concatenate(leaves)


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    return (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _routed(nodes: DataFrame, trees: list[Tree], visits: bool) -> DataFrame:
    """(tree, leaf, fp, home) of every fingerprint; visited shards only where their number exceeds the home's.

    Of two linked fingerprints with different homes, the one with the smaller home visits the other's.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(trees)

    def of(batch: pa.RecordBatch):
        fps = np.asarray(batch["fp"])
        for number, (tree, halves) in enumerate(zip(shared.value, _halves(fps))):
            rows, homes = tree.route(halves, 0)
            home = np.empty(len(fps), np.int32)
            home[rows] = homes
            leaf, who, own = home, np.arange(len(fps)), np.ones(len(fps), bool)
            if visits:
                rows, leaves = tree.route(halves, 1)
                far = leaves > home[rows]
                leaf, who = np.concatenate([leaf, leaves[far]]), np.concatenate([who, rows[far]])
                own = np.concatenate([own, np.zeros(far.sum(), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(leaf), number, np.int32)), pa.array(leaf), pa.array(fps[who]), pa.array(own)],
                ["tree", "leaf", "fp", "home"],
            )

    return nodes.select("fp").mapInArrow(per_batch(of), "tree int, leaf int, fp bigint, home boolean")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of all pairs; a group's label is its smallest point."""
    while True:
        left, right = label[a], label[b]
        if (left == right).all():
            return label
        high, low = np.maximum(left, right), np.minimum(left, right)
        target = np.arange(len(label))
        np.minimum.at(target, high, low)
        while not np.array_equal(target, target[target]):
            target = target[target]
        label = target[label]


def _close_pairs(points: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    for at in range(0, len(a), 64):
        some = a[at : at + 64]
        close = np.bitwise_count(points[some][:, None] ^ points[b][None, :]) <= RADIUS
        rows, columns = np.nonzero(close)
        if len(rows):
            label = _joined(label, some[rows], b[columns])
    return label


def _links_of_block(block):
    """Edges that span the linked groups among one block's fingerprints: `first` and `second` slices, and visitors."""
    fps = block["fp"].to_numpy().view(np.uint64)
    role = block["role"].to_numpy()
    members, others = np.flatnonzero(role == 0), np.flatnonzero(role != 0)
    everyone = np.concatenate([members, others])
    # a slice against itself and its visitors, or against another slice
    inner = bool((block["i"].to_numpy()[:1] == block["j"].to_numpy()[:1]).all())
    label = _close_pairs(fps, members, everyone if inner else others, np.arange(len(fps)))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return pd.DataFrame({"a": signed[linked], "b": signed[label[linked]]})


def _trees(nodes: DataFrame) -> list[Tree]:
    n = nodes.count()
    shards = max(1, min(MAX_SHARDS, n // SHARD_ROWS))
    wanted = SAMPLE_PER_SHARD * shards
    dealt = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(1 << 30))
    sample = nodes.where(dealt < F.lit(int((1 << 30) * min(1.0, wanted / max(n, 1))) + 1)).select("fp").toPandas()["fp"]
    return [Tree(half, max(SAMPLE_PER_SHARD, len(half) // shards)) for half in _halves(sample.to_numpy(np.int64))]


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) with at most three differing bits.

    Linked groups come as spanning edges, not as all their pairs. The driver sees a sample of at most
    SAMPLE_PER_SHARD * MAX_SHARDS fingerprints (about) and one count per shard.
    """
    trees = _trees(nodes)
    counts = _routed(nodes, trees, visits=False).groupBy("tree", "leaf").count().collect()
    slices = {(r["tree"], r["leaf"]): -(-r["count"] // BLOCK_ROWS) for r in counts}
    heavy = [(t, s, n) for (t, s), n in slices.items() if n > 1]

    routed = _routed(nodes, trees, visits=True)
    cut = F.lit(1)
    if heavy:  # at most one entry per shard
        sizes = F.create_map(*[F.lit(x) for t, s, n in heavy for x in (f"{t}:{s}", n)])
        cut = F.coalesce(sizes[F.concat_ws(":", "tree", "leaf")], F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")
    blocks = (
        routed.withColumn("slices", cut)
        .withColumn("own", own)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(
            "tree",
            "leaf",
            F.when(F.col("home"), F.least("own", "k")).otherwise(F.col("k")).cast("int").alias("i"),
            F.when(F.col("home"), F.greatest("own", "k")).otherwise(F.col("k")).cast("int").alias("j"),
            "fp",
            # 0: of the first slice, 1: of the second slice, 2: a visitor
            F.when(~F.col("home"), 2).when(F.col("own") > F.col("k"), 1).otherwise(0).cast("int").alias("role"),
        )
    )
    return blocks.groupBy("tree", "leaf", "i", "j").applyInPandas(_links_of_block, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, fp, root, component) per row of `docs`; component is the smallest id reachable over links.

    Texts without words have fingerprint zero and are linked like any other. A null text counts as
    empty. Null ids get a component like any row but are never its name, unless it has no other id.
    Repeated rows stay repeated. Very long texts are hashed in pieces of bounded size. Only the two
    named columns are read. An empty table gives an empty table.
    """
    rows = saved(fingerprints(docs, id_column, text_column))
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = saved(component_roots(fingerprint_links(nodes)))
    of_node = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    of_node = of_node.withColumn("root", F.coalesce("root", "fp"))
    names = of_node.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(of_node.join(names, "root").select("fp", "root", "component"), "fp")


def one_of_each(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of `docs` for each root in `found` (id, text_hash, root), all its columns kept: that with the smallest id.

    A null id counts as larger than any other; equal ids are told apart by a hash of their text, and
    of rows equal in both one stays.
    """
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))
    kept = saved(found.groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.text_hash"))
    mark, who, what = (free_name(docs, c) for c in ("text_hash", "kept_id", "kept_hash"))
    right = kept.select(F.col("id").alias(who), F.col("text_hash").alias(what))
    one = docs.withColumn(mark, F.xxhash64(text_column)).join(
        right, F.col(id_column).eqNullSafe(F.col(who)) & (F.col(mark) == F.col(what)), "left_semi"
    )
    repeated = found.groupBy("id", "text_hash").count().where("count > 1").limit(1).count()
    if repeated:  # rows equal in id and text: only then one has to be picked
        one = one.dropDuplicates([id_column, mark])
    return one.drop(mark)


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each near-duplicate group of `docs`, as `one_of_each` picks it."""
    return one_of_each(docs, near_duplicates(docs, id_column, text_column), id_column, text_column)


def op1_simhash_vp(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id of every document."""
    return near_duplicates(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
