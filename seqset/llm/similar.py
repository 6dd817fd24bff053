"""Near duplicates by the Jaccard similarity of their word shingles: MinHash finds candidates, shingle sets decide.

Two sets of similarity s agree in one MinHash value with probability s, so in all values of one band with s ** ROWS. Whatever
shares a band and agrees in ENOUGH of all values joins one family; sets of similarity 0.8 fail to once in a million pairs, more
similar ones less often still. Inside families whole sets are compared, so nothing is linked below the similarity.

Buckets and families are compared in blocks of bounded size, and only spanning links leave a block: a large group of near copies
is never written as pairs.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqset.llm.components import component_roots
from seqset.llm.frames import lower_words, per_batch
from seqset.llm.simhash import one_of_each
from seqset.session import saved

SEED = 42
SHINGLE = 5
#: Similar are sets with at least this part, numerator by denominator, of their union in common.
LEAST, OF = 4, 5
BANDS, ROWS = 48, 6
#: Equal MinHash values, of BANDS * ROWS, from which on two sets are compared: 5.5 standard deviations below what 0.8 gives.
ENOUGH = 193
#: Shingles that are hashed at once.
PART = 2048
#: Nodes in one slice of a bucket, and nodes and shingles (about) in one slice of a family; a block is a pair of slices.
BUCKET_ROWS, FAMILY_ROWS, FAMILY_SHINGLES = 1024, 512, 1 << 20

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased shingles of a text; one of all words if they are fewer; empty without words."""
    found = lower_words(text)
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, starts[size:])], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    points = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(points), PART):
        values = points[at : at + PART] * _FACTORS
        values += _TERMS
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One signed 64-bit value for each band."""
    data, width = least.tobytes(), 4 * ROWS
    values = [xxhash.xxh64_intdigest(data[k * width : (k + 1) * width], k) for k in range(BANDS)]
    return np.array(values, np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray) -> bytes:
    """A byte of each MinHash value."""
    return (least >> np.uint32(7)).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of LEAST / OF or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= LEAST * (len(a) + len(b) - common)


def _sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_hash, node, size, bands, sketch) per row; node is a hash of the lower-cased words."""

    def of(batch: pa.RecordBatch):
        nodes, sizes, values, sketches = [], [], [], []
        for t in batch["text"]:
            text = t.as_py()
            found = shingles(text)
            least = minima(found)
            nodes.append(xxhash.xxh64_intdigest(b" ".join(lower_words(text)), SEED))
            sizes.append(len(found))
            values.append(bands(least) if len(found) else [])
            sketches.append(sketch(least))
        node = pa.array(np.array(nodes, np.uint64).view(np.int64))
        arrays = [node, pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], *arrays], ["id", "text_hash", "node", "size", "bands", "sketch"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(per_batch(of), f"id {kind}, text_hash bigint, node bigint, size bigint, bands array<bigint>, sketch binary")


def _spanning(nodes: np.ndarray, slices: np.ndarray, close) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that `close(point, others)` calls close, where others are those not yet joined with the point.

    A block of one slice is compared with itself, one of two slices across them.
    """
    label = np.arange(len(nodes))
    a, b = [], []
    across = slices.min() != slices.max()
    upper = np.flatnonzero(slices == slices.max())
    for at in np.flatnonzero(slices == slices.min()):
        others = upper if across else np.arange(at + 1, len(nodes))
        others = others[label[others] != label[at]]
        found = others[close(at, others)] if len(others) else others
        if len(found):
            labels, first = np.unique(label[found], return_index=True)
            a += [at] * len(first)
            b += found[first].tolist()
            label[np.isin(label, labels)] = label[at]
    return nodes[np.array(a, np.int64)], nodes[np.array(b, np.int64)]


def _rough(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sizes = block["size"].to_numpy()
    sketches = np.frombuffer(b"".join(block["sketch"]), np.uint8).reshape(len(block), BANDS * ROWS)

    def close(at, others):
        alike = np.count_nonzero(sketches[others] == sketches[at], axis=1) >= ENOUGH
        return alike & (OF * np.minimum(sizes[at], sizes[others]) >= LEAST * np.maximum(sizes[at], sizes[others]))

    return _spanning(block["node"].to_numpy(), block["slice"].to_numpy(), close)


def _exact(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) for x in block["hashes"]]
    nodes, slices = block["node"].to_numpy(), block["slice"].to_numpy()
    if len(sets) == 2:
        return _spanning(nodes, slices, lambda at, others: np.array([similar(sets[at], sets[k]) for k in others]))
    sizes = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(codes)
    ends = np.cumsum(counts)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    own = np.split(codes, np.cumsum(sizes)[:-1])

    def close(at, others):
        held = np.concatenate([holders[ends[c] - counts[c] : ends[c]] for c in own[at]])
        common = np.bincount(held, minlength=len(sets))[others]
        return OF * common >= LEAST * (sizes[at] + sizes[others] - common)

    return _spanning(nodes, slices, close)


def _links_of_blocks(members: DataFrame, key: str, slices: Column, payload: DataFrame, links) -> DataFrame:
    """Edges (a, b) that `links` finds in the blocks of each key's `members` (key, node), cut into so many slices.

    Blocks are runs of sorted rows, as most are tiny: a function for each group would cost more than its work.
    """

    def of(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            marks = rest[[key, "i", "j"]].to_numpy()
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()]
            yield edges(rest, starts)
            rest = rest.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield edges(rest, [0, len(rest)])

    def edges(rows, starts):
        found = [links(rows.iloc[s:e]) for s, e in zip(starts, starts[1:]) if e - s > 1]
        a, b = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    sizes = members.join(payload.select("node", "size"), "node").groupBy(key).agg(slices.cast("int").alias("slices"))
    blocks = (
        members.join(sizes, key)
        .withColumn("slice", F.pmod(F.xxhash64("node", F.lit(7)), F.col("slices")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(key, "node", "slice", F.least("slice", "k").alias("i"), F.greatest("slice", "k").alias("j"))
    )
    full = blocks.join(payload, "node").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    return full.mapInPandas(of, "a bigint, b bigint")


def _sets(docs: DataFrame, text_column: str, wanted: DataFrame) -> DataFrame:
    """(node, size, hashes) of the nodes in `wanted` (node, text_hash), read from one text each."""

    def of(batch: pa.RecordBatch):
        found = [shingles(t.as_py()) for t in batch["text"]]
        sizes, hashes = pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["node"], sizes, hashes], ["node", "size", "hashes"])

    texts = docs.select(F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    first = texts.join(wanted, "text_hash").groupBy("node").agg(F.any_value("text").alias("text"))
    return first.mapInArrow(per_batch(of), "node bigint, size bigint, hashes binary")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, root) per row of `docs`: rows have the same root if links of similar texts join them.

    Texts with the same lower-cased words are one; texts without words are linked with each other only, and a null text
    counts as empty. Texts of fewer than SHINGLE words are linked if their words are the same. Ids may be null or repeated. Only
    the two named columns are read. An empty table gives an empty table.
    """
    rows = saved(_sketches(docs, id_column, text_column))
    entries = rows.select("node", F.explode("bands").alias("bucket"))
    ends = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = saved(entries.join(ends.where("low < high").select("bucket"), "bucket").select("bucket", "node").distinct())
    sketched = rows.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node")
    nodes = saved(sketched.agg(F.min("text_hash").alias("text_hash"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch")))
    rough = _links_of_blocks(shared, "bucket", F.ceil(F.count("*") / BUCKET_ROWS), nodes.drop("text_hash"), _rough)
    family = saved(component_roots(rough)).withColumnRenamed("root", "family").select("family", "node")

    sets = saved(_sets(docs, text_column, nodes.join(family, "node").select("node", "text_hash")))
    by_size = F.greatest(F.ceil(F.count("*") / FAMILY_ROWS), F.ceil(F.sum("size") / FAMILY_SHINGLES))
    roots = component_roots(_links_of_blocks(family, "family", by_size, sets, _exact))
    found = rows.select("id", "text_hash", "node").join(roots, "node", "left")
    return found.select("id", "text_hash", F.coalesce("root", "node").alias("root"))


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of `similar_documents`, all its columns kept, as `one_of_each` picks it."""
    return one_of_each(docs, saved(similar_documents(docs, id_column, text_column)), id_column, text_column)
