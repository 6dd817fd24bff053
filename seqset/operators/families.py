"""Families of sets as decision diagrams, and covers that are counted or ranked before any is listed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqset.operators.covers import ROW_OPTIONS, _grow, grouped_lists, option_lists, rank_by_size
from seqset.operators.membership import contains_all
from seqset.operators.skew import ROWS_PER_TASK, apart
from seqset.session import saved

#: Nodes that one request's diagram may have; a larger one is grown as distributed rows instead.
NODES = 200_000
#: Diagrams of equal lists that a task remembers.
REMEMBERED = 10_000


class TooLarge(Exception):
    """A diagram would have more nodes than allowed."""


class Families:
    """Zero-suppressed decision diagrams over the numbers 0, 1, …; a family is the number of its root.

    A node holds a number v, the family of its sets without v, and that of its sets with v, from which v is left out. NONE is the empty
    family, UNIT holds only the empty set. Equal families are the same node, so all results are remembered by their operands.
    """

    NONE, UNIT = 0, 1

    def __init__(self, limit: int = NODES):
        self.limit = limit
        self.nodes: list[tuple[int, int, int]] = [(-1, 0, 0), (-1, 0, 0)]
        self.known: dict[tuple[int, int, int], int] = {}
        self.done: dict[tuple, int] = {}

    def _node(self, v: int, without: int, holding: int) -> int:
        if holding == self.NONE:
            return without
        found = self.known.get((v, without, holding))
        if found is None:
            if len(self.nodes) > self.limit:
                raise TooLarge
            found = self.known[v, without, holding] = len(self.nodes)
            self.nodes.append((v, without, holding))
        return found

    def union(self, a: int, b: int) -> int:
        if a == b or b == self.NONE:
            return a
        if a == self.NONE:
            return b
        key = ("union", min(a, b), max(a, b))
        if key not in self.done:
            (v, a0, a1), (w, b0, b1) = self._split(a, b)
            self.done[key] = self._node(min(v, w), self.union(a0, b0), self.union(a1, b1))
        return self.done[key]

    def _split(self, a: int, b: int) -> tuple:
        """Both families by the smallest number that either begins with."""
        v, w = (self.nodes[x][0] if x > self.UNIT else None for x in (a, b))
        least = min(x for x in (v, w) if x is not None)
        return tuple(self.nodes[x] if y == least else (least, x, self.NONE) for x, y in ((a, v), (b, w)))

    def with_one_of(self, family: int, options: tuple[int, ...]) -> int:
        """Every set with every one of the options (ascending) added to it, once each."""
        if family == self.NONE or not options:
            return self.NONE
        key = ("with", family, options)
        if key not in self.done:
            v, without, holding = self.nodes[family] if family > self.UNIT else (None, family, self.NONE)
            first, rest = options[0], options[1:]
            if v is None or first < v:
                found = self._node(first, self.with_one_of(family, rest), family)
            elif v < first:
                found = self._node(v, self.with_one_of(without, options), self.with_one_of(holding, options))
            else:
                # v itself is added to all; another option keeps v where it was
                added = self.union(self.union(holding, without), self.with_one_of(holding, rest))
                found = self._node(v, self.with_one_of(without, rest), added)
            self.done[key] = found
        return self.done[key]

    def meeting(self, family: int, pins: tuple[int, ...]) -> int:
        """The sets that hold at least one of the pins (ascending)."""
        if family <= self.UNIT or not pins:
            return self.NONE
        key = ("meeting", family, pins)
        if key not in self.done:
            v, without, holding = self.nodes[family]
            left = tuple(p for p in pins if p > v)
            kept = holding if v in pins else self.meeting(holding, left)
            self.done[key] = self._node(v, self.meeting(without, left), kept)
        return self.done[key]

    def count(self, family: int) -> int:
        """How many sets there are, exactly."""
        counts = [0, 1]
        for _, without, holding in self.nodes[2 : family + 1]:  # operands have smaller numbers
            counts.append(counts[without] + counts[holding])
        return counts[family]

    def sizes(self, family: int) -> list[int]:
        """For every node up to the family's, the sizes of its sets as bits."""
        sizes = [0, 1]
        for _, without, holding in self.nodes[2 : family + 1]:
            sizes.append(sizes[without] | sizes[holding] << 1)
        return sizes

    def best_first(self, family: int) -> Iterator[list[int]]:
        """The sets, larger ones first, then by content; each is found without looking at those that come later."""
        sizes = self.sizes(family)
        for size in range(sizes[family].bit_length() - 1, -1, -1):
            stack = [(family, size, [])]
            while stack:
                node, left, chosen = stack.pop()
                if not sizes[node] >> left & 1:
                    continue
                if node == self.UNIT:
                    yield chosen
                    continue
                v, without, holding = self.nodes[node]
                stack.append((without, left, chosen))
                if left:
                    stack.append((holding, left - 1, [*chosen, v]))


def family_of(lists: Sequence[tuple[tuple[int, ...], int]], pins: Sequence[tuple[int, ...]], limit: int = NODES) -> tuple[Families, int]:
    """The sets that take one option of each list (list, how often) and meet each of the pins."""
    families = Families(limit)
    found = families.UNIT
    # long lists last: the diagram stays narrow for longer
    for options, copies in sorted(lists, key=lambda x: (len(x[0]), x)):
        for _ in range(copies):
            found = families.with_one_of(found, options)
    for pin in pins:
        found = families.meeting(found, pin)
    return families, found


def _shaped(each: DataFrame) -> DataFrame:
    """With `_shape`, the lists and pins of a row as places in `_names` (sorted): equal numbers, equal families.

    For each list its copies, its length and its places; then -1; then for each pin its length and its places.
    """
    def places(options: Column) -> Column:
        return F.transform(F.array_sort(options), lambda o: F.array_position("_names", o).cast("int") - 1)

    def counted(options: Column) -> Column:
        return F.concat(F.array(F.size(options)), options)

    # a pin that no list has adds nothing
    met = F.transform("_pins", lambda pin: counted(places(F.array_intersect(pin, F.col("_names")))))
    lists = F.transform(F.arrays_zip("_lists", "_copies"), lambda x: F.concat(F.array(x["_copies"]), counted(places(x["_lists"]))))
    pins = F.coalesce(F.flatten(F.array_sort(met)), F.array().cast("array<int>"))
    return each.withColumn("_shape", F.concat(F.flatten(F.array_sort(lists)), F.array(F.lit(-1)), pins))


def _lists_and_pins(shape: Sequence[int]) -> tuple[list, list]:
    lists, pins, at = [], [], 0
    while shape[at] >= 0:
        copies, n = shape[at : at + 2]
        lists.append((tuple(shape[at + 2 : at + 2 + n]), copies))
        at += 2 + n
    at += 1
    while at < len(shape):
        pins.append(tuple(shape[at + 1 : at + 1 + shape[at]]))
        at += 1 + shape[at]
    return lists, pins


def _listed(each: DataFrame, request: str, container_type: str, max_covers: int | None, top: int | None, nodes: int) -> DataFrame:
    """(request, cover, size, rank, n_covers, state) from rows (request, _names, _lists, _copies, _pins): `listed`, `overflow` or `grown`."""
    each = _shaped(each).select(request, "_names", "_shape")
    kind = each.schema[request].dataType.simpleString()
    schema = f"{request} {kind}, cover array<{container_type}>, size int, rank bigint, n_covers string, state string"

    def answer(lists, pins):
        """State, number, and the sets: their sizes and, one after the other, their places; without sets no sizes but one empty row."""
        try:
            families, found = family_of(lists, pins, nodes)
        except TooLarge:
            return "grown", None, None, None
        number = families.count(found)
        if max_covers is not None and number > max_covers:
            return "overflow", str(number), None, None
        sets = [s for _, s in zip(range(number if top is None else top), families.best_first(found))]
        flat = np.fromiter((k for s in sets for k in s), np.int64)
        return "listed", str(number), np.fromiter(map(len, sets), np.int64, len(sets)), flat

    def of(batches):
        import sys

        sys.setrecursionlimit(1_000_000)  # a diagram is as deep as a request has containers
        remembered = {}
        for batch in batches:
            shapes, names = batch["_shape"], batch["_names"]
            ends, numbers = shapes.offsets.to_numpy(), np.ascontiguousarray(shapes.values.to_numpy(), np.int32)
            written_out, width = numbers.tobytes(), numbers.itemsize
            rows, answers, held = [], [], 0
            for row in range(batch.num_rows):
                shape = written_out[ends[row] * width : ends[row + 1] * width]
                found = remembered.get(shape)
                if found is None:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    found = remembered[shape] = answer(*_lists_and_pins(np.frombuffer(shape, np.int32).tolist()))
                rows.append(row)
                answers.append(found)
                held += 4 if found[2] is None else len(found[3]) + 4 * len(found[2])
                if held > 1 << 20:
                    yield written(batch[request], names, rows, answers)
                    rows, answers, held = [], [], 0
            yield written(batch[request], names, rows, answers)

    def written(keys, names, rows, answers):
        one, none = np.zeros(1, np.int64), np.zeros(0, np.int64)
        given = [(one, none) if a[2] is None else a[2:] for a in answers]
        sizes = np.concatenate([none, *[s for s, _ in given]])
        n_sets = np.array([len(s) for s, _ in given], np.int64)
        of_answer = np.repeat(np.arange(len(rows)), n_sets)
        rank = np.arange(len(sizes)) - np.repeat(np.cumsum(n_sets) - n_sets, n_sets) + 1
        row = np.array(rows, np.int64)[of_answer]
        missing = np.array([a[2] is None for a in answers], bool)[of_answer]
        first = names.offsets.to_numpy().astype(np.int64)[row]
        places = np.concatenate([none, *[f for _, f in given]]) + np.repeat(first, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        cover = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(missing, False)), names.values.take(pa.array(places)))

        def told(k):
            return pa.array([a[k] for a in answers], pa.string()).take(pa.array(of_answer))

        columns = [pa.array(sizes.astype(np.int32), mask=missing), pa.array(rank, mask=missing), told(1), told(0)]
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row)), cover, *columns], [request, "cover", "size", "rank", "n_covers", "state"]
        )

    return each.mapInArrow(of, schema)


def counted_covers(
    requests: DataFrame, membership: DataFrame, request: str, item: str, container: str, qualifier: str | None = None,
    max_covers: int | None = None, top: int | None = None, local_limit: int = 1_000, nodes: int = NODES, rows: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Covers of each request, best first, and the requests with too many.

    The first result is (request, cover, size, rank, n_covers): all covers of requests that have at most `max_covers` (any number, if null),
    or the first `top` of each; larger covers come first, then smaller content. The second is (request, n_covers) of
    the others. `n_covers` is the exact number in decimal digits, however large. Covers are those of `covers`, or with a `qualifier`
    those of `pinned_covers`: items of one qualifier must share a container, and a request of qualified items only is answered by one such container per
    qualifier. A request without any cover has no row. Nulls are no items.

    A request's covers are held as a decision diagram, whose size follows its lists and not the number of its sets; they are counted there, and
    what is listed is read off in order. Requests whose lists or diagrams are too large for a row (`ROW_OPTIONS`, `nodes`) and items with more than
    `local_limit` holders are grown as distributed rows, which gives the same covers.
    """
    items = requests.filter(F.col(item).isNotNull())
    free, pins = items, None
    if qualifier is not None:
        membership = saved(membership.select(container, item).distinct())
        groups = saved(items.select(request, qualifier, item).distinct())
        free, pinned = groups.filter(F.col(qualifier).isNull()), groups.filter(F.col(qualifier).isNotNull())
        pins = saved(contains_all(membership, pinned, [request, qualifier], container, item, rows))
    lists, long_rows = option_lists(free.select(request, item), membership, request, item, container, local_limit, rows)
    if qualifier is not None:
        # a qualifier that no container answers leaves its request without covers
        asked = pinned.select(request, qualifier).distinct().groupBy(request).agg(F.count(F.lit(1)).alias("_asked"))
        of_group = pins.groupBy(request, qualifier).agg(F.sort_array(F.collect_set(container)).alias("_pin"))
        met = of_group.groupBy(request).agg(F.count(F.lit(1)).alias("_met"), F.collect_list("_pin").alias("_pins"))
        wanted = saved(apart(asked).join(met, request, "left").withColumn("_whole", F.col("_asked") == F.coalesce("_met", F.lit(0))))
        only = apart(wanted.filter("_whole")).join(free.select(request).distinct(), request, "left_anti").select(request)
        lists = lists.unionByName(apart(of_group).join(only, request).select(request, F.col("_pin").alias("_options")))
    groups = saved(grouped_lists(lists, request))
    heavy = groups.groupBy(request).agg(F.sum(F.size("_options") * F.col("_copies")).alias("_listed")).filter(F.col("_listed") > ROW_OPTIONS).select(request)
    if long_rows is not None:
        heavy = heavy.unionByName(long_rows.select(request)).distinct()
    light, some_heavy = groups, bool(heavy.take(1))
    if some_heavy:
        heavy = saved(heavy)
        light = apart(groups).join(heavy, request, "left_anti")
    names = F.array_sort(F.array_distinct(F.flatten("_lists")))
    each = light.groupBy(request).agg(F.collect_list("_options").alias("_lists"), F.collect_list("_copies").alias("_copies")).withColumn("_names", names)
    no_pins = F.lit(None).cast(f"array<{groups.schema['_options'].dataType.simpleString()}>")
    if qualifier is None:
        each = each.withColumn("_pins", no_pins)
    else:
        each = apart(each).join(wanted, request, "left").filter(F.coalesce("_whole", F.lit(True)))
    each = each.select(request, "_names", "_lists", "_copies", "_pins")
    element = groups.schema["_options"].dataType.elementType.simpleString()
    found = saved(_listed(each, request, element, max_covers, top, nodes))

    names = [request, "cover", "size", "rank", "n_covers"]
    listed = found.filter(F.col("state") == "listed").select(*names)
    overflow = found.filter(F.col("state") == "overflow").select(request, "n_covers")
    large = found.filter(F.col("state") == "grown").select(request)
    if some_heavy:
        large = large.unionByName(heavy)
    if not large.take(1):
        return listed, overflow
    large = saved(large)
    grown = _grow(apart(groups).join(large, request, "left_semi"), long_rows, large, request, item, container, rows)
    if qualifier is not None:
        grown = _meeting_all(grown, pins, wanted, request, qualifier, container)
    grown = saved(grown.filter(F.size("cover") > 0).withColumn("size", F.size("cover")))
    counts = grown.groupBy(request).agg(F.count(F.lit(1)).alias("_n"))
    few = counts if max_covers is None else counts.filter(F.col("_n") <= max_covers)
    number = F.col("_n").cast("string").alias("n_covers")
    ranked = rank_by_size(apart(grown).join(few.select(request), request, "left_semi"), request, "cover", rows=rows)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    more = apart(ranked).join(counts, request).select(request, "cover", "size", F.col("rank").cast("bigint").alias("rank"), number)
    if max_covers is not None:
        overflow = overflow.unionByName(counts.filter(F.col("_n") > max_covers).select(request, number))
    return listed.unionByName(more), overflow


def _meeting_all(covers: DataFrame, pins: DataFrame, wanted: DataFrame, request: str, qualifier: str, container: str) -> DataFrame:
    """Covers with a container for every qualifier of their request."""
    told = apart(covers).join(wanted.select(request, "_asked", "_whole"), request, "left")
    unpinned = told.filter(F.col("_asked").isNull()).select(*covers.columns)
    held = apart(told.filter("_whole").withColumn(container, F.explode("cover"))).join(pins, [request, container])
    hits = held.groupBy(*covers.columns, "_asked").agg(F.count_distinct(qualifier).alias("_hits"))
    return unpinned.unionByName(hits.filter(F.col("_hits") == F.col("_asked")).select(*covers.columns))


def best_covers(
    requests: DataFrame, membership: DataFrame, request: str, item: str, container: str, top: int, qualifier: str | None = None, **limits: int
) -> DataFrame:
    """(request, cover, size, rank, n_covers): the first `top` covers of each request, larger ones first, without listing the others."""
    return counted_covers(requests, membership, request, item, container, qualifier, top=top, **limits)[0]
