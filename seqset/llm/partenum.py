"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets of similarity 4/5 or more differ in at most a ninth of their summed sizes. Sizes fall into bands, each as wide as the similarity
allows, so that similar sets lie in the same or in neighbouring bands, and within such a pair of bands the difference has a bound k. The
domain of shingles is dealt into n1 parts of n2 cells. At most k differences leave some part with at most k2 of them, and in that part all
but k2 cells are equal; so, with a signature for every choice of n2 - k2 cells of every part, similar sets share one. A set signs for its
own band and for the next one. n1, n2 and k2 follow from the number of sets in a band: more sets buy more selective signatures.

Sets that share a signature are told apart by parity sketches first: a bit for each of 2^j cells, the parity of the number of shingles in
it. Each difference flips one bit, so sketches that differ in more bits than k belong to sets that are not similar. What is left forms
families, in which whole sets are compared. No step drops a similar pair, whatever the number of sets in a bucket: large ones are
compared in blocks, and only spanning links leave a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.components import component_roots
from seqset.llm.frames import lower_words, per_batch, table
from seqset.llm.simhash import _joined
from seqset.llm.similar import _exact, _links_of_blocks
from seqset.session import saved

SHINGLE = 5
#: Two sets are similar if OF * common >= LEAST * union; then SPAN * difference <= sum of sizes.
LEAST, OF, SPAN = 4, 5, 9
#: What comparing two sketches costs, in signatures written.
PAIR_COST = 0.05
#: Choices of cells left out: from none to this many of a part.
MOST_LEFT_OUT = 5
#: Bytes of text whose sets are held at once, nodes that a task remembers as signed, nodes in a slice of a bucket.
TEXT_BYTES, SIGNED, BUCKET_ROWS = 4 << 20, 1 << 20, 1024
#: Nodes and shingles (about) in one slice of a family.
FAMILY_ROWS, FAMILY_SHINGLES = 512, 1 << 20

_U = np.uint64
_ODD = np.random.default_rng(SHINGLE).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _ODD[0]
    x = (x ^ (x >> _U(27))) * _ODD[1]
    return x ^ (x >> _U(31))


def shingle_sets(texts: Sequence[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its lower-cased shingles; one of all words if they are fewer; empty without words."""
    found = [lower_words(t) for t in texts]
    counts = [len(f) for f in found]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(found)), np.uint64, sum(counts))
    rolled = _rolled(hashes, size) if len(hashes) >= size else hashes
    out, at = [], 0
    for n in counts:
        if n >= size:
            own = np.sort(rolled[at : at + n - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(_rolled(hashes[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` neighbours."""
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out ^ (hashes[k : len(hashes) - width + 1 + k] * _ODD[2 + k]))
    return out


def _slices(texts: pa.Array):
    """Slices of an array of texts with about TEXT_BYTES each."""
    sizes = np.cumsum([len(t) if t is not None else 0 for t in texts.to_pylist()]) // TEXT_BYTES
    ends = [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for start, end in zip([0, *ends], ends):
        yield slice(start, end)


def node_of(hashes: np.ndarray) -> int:
    """A name for a set: equal sets have the same."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of elements per cell; as many cells as elements or more, a power of two."""
    cells = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    parity = np.bincount((hashes & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: Sequence[bytes], least: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to `least` bytes: two cells that become one have the parity of both."""
    rows = np.empty((len(sketches), least // 8), np.uint64)
    for k, blob in enumerate(sketches):
        words = np.frombuffer(blob, np.uint64)
        rows[k] = np.bitwise_xor.reduce(words.reshape(-1, least // 8), axis=0)
    return rows


def band_ends(most: int) -> list[int]:
    """The largest size of each band, up to the first that holds `most`: OF / LEAST times the smallest."""
    ends = [0]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * OF // LEAST)
    return ends[1:]


def schemes(ends: list[int], counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(n1, n2, k2) of each band's instance, the cheapest for the sets that sign in it; one more instance for the last band's neighbours."""
    ends = [*ends, (ends[-1] + 1) * OF // LEAST] if ends else []
    out = []
    for band, end in enumerate(ends):
        k = 2 * end // SPAN
        sets = counts.get(band, 0) + counts.get(band - 1, 0)
        best = None
        for k2 in range(min(k, MOST_LEFT_OUT) + 1):
            n1 = k // (k2 + 1) + 1
            for n2 in [1] if k2 == 0 else range(k2 + 1, 2 * k2 + 4):
                signatures = n1 * comb(n2, k2)
                # the chance that a set has nothing in the cells of a signature, as most that share one by chance do
                empty = exp(-0.9 * end * (n2 - k2) / (n1 * n2))
                cost = sets * signatures + PAIR_COST * signatures * (sets * empty) ** 2 / 2
                if best is None or cost < best[0]:
                    best = (cost, (n1, n2, k2))
        out.append(best[1])
    return out


def signatures(sets: Sequence[np.ndarray], ends: list[int], plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(which set, signature) of all sets; an empty set has none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(ends, sizes)
    who, found = [], []
    for instance in sorted({b for b in band[sizes > 0].tolist()} | {b + 1 for b in band[sizes > 0].tolist()}):
        own = np.flatnonzero((sizes > 0) & ((band == instance) | (band == instance - 1)))
        n1, n2, k2 = plan[instance]
        cells = n1 * n2
        elements = mixed(np.concatenate([sets[k] for k in own]) ^ mixed(np.array([instance + 1], np.uint64)))
        at = np.repeat(np.arange(len(own)), sizes[own]) * cells
        at += ((elements >> _U(32)) * _U(cells) >> _U(32)).astype(np.int64)
        values = elements * _ODD[8] ^ (elements >> _U(29))
        low, high = (np.bincount(at, weights=v.astype(float), minlength=len(own) * cells) for v in (values & _U(0xFFFFFFFF), values >> _U(32)))
        # sums of 32-bit numbers are exact as floats
        sums = (low.astype(np.uint64) + (high.astype(np.uint64) << _U(32))).reshape(len(own), n1, n2)
        choices = list(combinations(range(n2), n2 - k2))
        places = mixed(_U(instance) << _U(40) ^ np.arange(n1 * len(choices), dtype=np.uint64)).reshape(n1, len(choices))
        named = mixed(sums + _ODD[10 : 10 + n2])
        for c, choice in enumerate(choices):
            found.append(mixed(named[:, :, list(choice)].sum(axis=2, dtype=np.uint64) ^ places[:, c]).ravel())
            who.append(np.repeat(own, n1))
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(who), np.concatenate(found)


def _described(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_hash, node, size, sketch) per row; node is null without words."""

    def of(batch: pa.RecordBatch):
        nodes, sizes, sketches = [], [], []
        for part in _slices(batch["text"]):
            for found in shingle_sets(batch["text"][part].to_pylist()):
                sizes.append(len(found))
                nodes.append(np.array([node_of(found)], np.uint64).view(np.int64)[0] if len(found) else None)
                sketches.append(sketch(found) if len(found) else None)
        arrays = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], *arrays], ["id", "text_hash", "node", "size", "sketch"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(per_batch(of), f"id {kind}, text_hash bigint, node bigint, size bigint, sketch binary")


def _signed(docs: DataFrame, text_column: str, ends: list[int], plan: list[tuple[int, int, int]]) -> DataFrame:
    """(signature, node) of every text's set; a task signs a set once."""
    shared = docs.sparkSession.sparkContext.broadcast((ends, plan))

    def of(batches):
        known: set[int] = set()
        for batch in batches:
            for part in _slices(batch["text"]):
                if len(known) >= SIGNED:
                    known.clear()
                sets, nodes = [], []
                for found in shingle_sets(batch["text"][part].to_pylist()):
                    node = node_of(found) if len(found) else None
                    if node is not None and node not in known:
                        known.add(node)
                        sets.append(found)
                        nodes.append(node)
                if sets:
                    yield written(sets, nodes)

    def written(sets, nodes):
        who, found = signatures(sets, *shared.value)
        node = np.array(nodes, np.uint64).view(np.int64)[who]
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(node)], ["signature", "node"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(of, "signature bigint, node bigint")


def _shared(signed: DataFrame) -> DataFrame:
    """(signature, node, leader) for all nodes of a signature but its smallest, which leads."""

    def of(batches):
        before = (None, None, None)  # signature, leader, node
        for batch in batches:
            signature, node = np.asarray(batch["signature"]), np.asarray(batch["node"])
            if not len(node):
                continue
            new, again = np.ones(len(node), bool), np.zeros(len(node), bool)
            new[1:] = signature[1:] != signature[:-1]
            new[0] = signature[0] != before[0]
            again[1:] = node[1:] == node[:-1]
            again[0] = node[0] == before[2]
            first = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            leader = np.where(first >= 0, node[first], before[1] if before[1] is not None else 0)
            kept = ~new & ~again
            before = (signature[-1], leader[-1], node[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (signature, node, leader)], ["signature", "node", "leader"])

    ordered = signed.repartition("signature").sortWithinPartitions("signature", "node")
    return ordered.mapInArrow(of, "signature bigint, node bigint, leader bigint")


def _may_be_similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow similarity."""

    def of(batch: pa.RecordBatch):
        kept = []
        for x, y, s, t in zip(*(batch[c].to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b"))):
            if SPAN * abs(x - y) > x + y:
                kept.append(False)
                continue
            s, t = _folded([s, t], min(len(s), len(t)))
            kept.append(SPAN * int(np.bitwise_count(s ^ t).sum()) <= x + y)
        keep = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    told = pairs
    for side in ("a", "b"):
        told = told.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return told.mapInArrow(per_batch(of), "a bigint, b bigint")


def _rough(runs: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers: rows of one run (`runs` is sorted) and different roots whose sketches allow similarity."""
    lengths = np.array([len(s) for s in sketches])
    _, starts, inverse, counts = np.unique(runs, return_index=True, return_inverse=True, return_counts=True)
    shortest = np.minimum.reduceat(lengths, starts)[inverse]
    found = [(np.empty(0, np.int64),) * 2]
    for length in np.unique(shortest).tolist():  # runs of one sketch length together, each neighbour distance in one step
        own = np.flatnonzero(shortest == length)
        words = _folded([sketches[k] for k in own], length)
        run, root, size = runs[own], roots[own], sizes[own]
        for lag in range(1, int(counts[inverse[own]].max(initial=1))):
            a = np.flatnonzero((run[lag:] == run[:-lag]) & (root[lag:] != root[:-lag]))
            b = a + lag
            a, b = (x[SPAN * np.abs(size[a] - size[b]) <= size[a] + size[b]] for x in (a, b))
            for at in range(0, len(a), step := max(1, (1 << 21) // words.shape[1])):
                x, y = a[at : at + step], b[at : at + step]
                apart = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
                close = SPAN * apart <= size[x] + size[y]
                found.append((own[x[close]], own[y[close]]))
    return tuple(np.concatenate(side) for side in zip(*found))


def _rough_links(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spanning links (a, b) among the nodes of each signature in `members` (signature, node, root) that may be similar.

    A signature of very many nodes is cut into slices; a task compares two of them at a time.
    """
    names = ["signature", "i", "j", "node", "root", "size", "sketch"]

    def of(batches):
        rest = None
        for batch in batches:
            now = batch if rest is None else pa.concat_batches([rest, batch])
            key = np.stack([np.asarray(now[c]) for c in names[:3]])
            starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            end = int(starts[-1]) if len(starts) else 0
            if end:
                yield linked(now[:end], starts)
            rest = now[end:]
        if rest is not None and rest.num_rows:
            key = np.stack([np.asarray(rest[c]) for c in names[:3]])
            yield linked(rest, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)

    def linked(batch, starts):
        runs = np.zeros(batch.num_rows, np.int64)
        runs[starts[starts < batch.num_rows]] = 1
        node, back = np.unique(np.asarray(batch["node"]), return_inverse=True)
        a, b = _rough(np.cumsum(runs), np.asarray(batch["root"]), np.asarray(batch["size"]), batch["sketch"].to_pylist())
        label = _joined(np.arange(len(node)), back[a], back[b])
        some = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], ["a", "b"])

    slices = members.groupBy("signature").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("slices"))
    blocks = (
        members.join(slices, "signature")
        .withColumn("slice", F.pmod(F.xxhash64("node", F.lit(7)), F.col("slices")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("signature", F.least("slice", "k").alias("i"), F.greatest("slice", "k").alias("j"), "node", "root")
    )
    full = blocks.join(nodes.select("node", "size", "sketch"), "node").select(*names)
    ordered = full.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j")
    return ordered.mapInArrow(of, "a bigint, b bigint")


def _families(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(family, node): similar sets are in the same family, all members of which are joined by pairs that may be similar.

    Every set is compared with the leaders of its signatures first. Where that leaves the others of a signature in several
    families, they are compared with each other, in blocks.
    """
    stars = saved(_may_be_similar(shared.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes))
    now = saved(component_roots(stars))
    rest = shared.select("signature", "node").join(now, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rest.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("signature")
    open_ones = saved(rest.join(several, "signature").select("signature", "node", "root"))
    return saved(component_roots(stars.union(_rough_links(open_ones, nodes)))).select(F.col("root").alias("family"), "node")


def _sets(docs: DataFrame, text_column: str, wanted: DataFrame) -> DataFrame:
    """(node, size, hashes) of the nodes in `wanted` (node, text_hash), each from one text."""

    def of(batch: pa.RecordBatch):
        found = [s for part in _slices(batch["text"]) for s in shingle_sets(batch["text"][part].to_pylist())]
        sizes, hashes = pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["node"], sizes, hashes], ["node", "size", "hashes"])

    texts = docs.select(F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    first = texts.join(wanted, "text_hash").groupBy("node").agg(F.any_value("text").alias("text"))
    return first.mapInArrow(per_batch(of), "node bigint, size bigint, hashes binary")


def similar_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component) per row of `docs`: the smallest id that links of similar shingle sets reach, itself included.

    Texts without words, null ones among them, have no shingles and are linked with nothing: their component is their id. Texts of
    fewer than SHINGLE words are one shingle. Equal sets are one node, however many rows have them; shingles and nodes are known by 64-bit
    hashes. Null ids get a component like any row and name one only if it has no other id. Repeated rows stay
    repeated. Only the two named columns are read. An empty table gives an empty table. The driver sees a count per size band.
    """
    rows = saved(_described(docs, id_column, text_column))
    told = rows.where("node IS NOT NULL").groupBy("node")
    one = F.min(F.struct("text_hash", "size", "sketch"))
    nodes = saved(told.agg(F.min("id").alias("least"), one.alias("one")).select("node", "least", "one.*"))

    ends = band_ends(nodes.agg(F.max("size")).first()[0] or 0)
    counts = {}
    if ends:
        band = F.expr(f"aggregate(array({', '.join(f'{e}L' for e in ends)}), 0, (n, e) -> n + int(e < size))")
        counts = {r["band"]: r["count"] for r in nodes.groupBy(band.alias("band")).count().collect()}
    plan = schemes(ends, counts)
    shared = saved(_shared(_signed(docs, text_column, ends, plan)))
    family = _families(shared, nodes)

    sets = saved(_sets(docs, text_column, nodes.join(family, "node").select("node", "text_hash")))
    by_size = F.greatest(F.ceil(F.count("*") / FAMILY_ROWS), F.ceil(F.sum("size") / FAMILY_SHINGLES))
    roots = saved(component_roots(_links_of_blocks(family, "family", by_size, sets, _exact)))

    of_node = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = of_node.groupBy("root").agg(F.min("least").alias("component"))
    named = of_node.join(names, "root").select("node", "component")
    found = rows.select("id", "node", "size").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select("id", F.col("size").alias("n_shingles"), component.alias("component"))


def op11_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    found = similar_sets(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
