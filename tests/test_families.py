"""Families of sets against plain sets of sets; counted and best covers against all covers."""

import itertools
import math
import random

import pytest

from seqset.operators import families as Z
from seqset.operators.covers import covers, pinned_covers, rank_by_size


def plain(lists):
    return {frozenset(c) for c in itertools.product(*lists)}


def ranked(sets):
    return sorted((sorted(s) for s in sets), key=lambda s: (-len(s), s))


def test_families_equal_plain_sets():
    rng = random.Random(11)
    for _ in range(300):
        lists = [tuple(sorted(rng.sample(range(7), rng.randrange(1, 5)))) for _ in range(rng.randrange(0, 6))]
        pins = [tuple(sorted(rng.sample(range(8), rng.randrange(0, 3)))) for _ in range(rng.randrange(0, 2))]
        families, found = Z.family_of([(x, 1) for x in lists], pins)
        want = {s for s in plain(lists) if all(s & set(p) for p in pins)}
        assert families.count(found) == len(want)
        assert list(families.best_first(found)) == ranked(want)


def test_counts_without_listing():
    # 40 items that the same 40 containers hold: every set but the empty one
    families, found = Z.family_of([(tuple(range(40)), 40)], [])
    assert families.count(found) == 2**40 - 1
    best = families.best_first(found)
    assert next(best) == list(range(40)) and next(best) == list(range(39)) and next(best) == [*range(38), 39]
    # items with holders of their own: all combinations
    families, found = Z.family_of([(tuple(range(10 * k, 10 * k + 10)), 1) for k in range(50)], [])
    assert families.count(found) == 10**50
    with pytest.raises(Z.TooLarge):
        Z.family_of([(tuple(range(40)), 40)], [], limit=20)


def tables(spark, seed=12):
    rng = random.Random(seed)
    holders = [(f"c{c}", i) for i in range(14) for c in rng.sample(range(9), rng.randrange(1, 6))]
    wanted = [(r, rng.choice([None, None, "p", "q"]), rng.randrange(16)) for r in range(25) for _ in range(rng.randrange(1, 6))]
    wanted += [(100, None, None), (101, None, 99), (102, "p", 99), *wanted[:4]]
    requests = spark.createDataFrame(wanted, "request long, qualifier string, item int")
    return requests, spark.createDataFrame(holders, "container string, item int")


def rows(df, *columns):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in (r[c] for c in columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "limits, qualifier", [({}, None), ({"nodes": 6}, None), ({"local_limit": 3}, "qualifier"), ({"nodes": 1, "rows": 20}, "qualifier")]
)
def test_counted_covers_equal_all_covers(spark, monkeypatch, limits, qualifier):
    requests, membership = tables(spark)
    if qualifier is None:
        every = rank_by_size(covers(requests, membership, "request", "item", "container"), "request", "cover")
    else:
        every = pinned_covers(requests, membership, "request", "qualifier", "item", "container")
    if limits.get("nodes") == 6:
        monkeypatch.setattr(Z, "ROW_OPTIONS", 8)
    want = rows(every, "request", "cover", "size", "rank")
    counts = {}
    for request, *_ in want:
        counts[request] = counts.get(request, 0) + 1
    found, more = Z.counted_covers(requests, membership, "request", "item", "container", qualifier, max_covers=10, **limits)
    assert rows(found, "request", "cover", "size", "rank", "n_covers") == sorted(((*w, str(counts[w[0]])) for w in want if counts[w[0]] <= 10), key=str)
    assert rows(more, "request", "n_covers") == sorted(((r, str(n)) for r, n in counts.items() if n > 10), key=str)
    best = Z.best_covers(requests, membership, "request", "item", "container", 2, qualifier, **limits)
    assert rows(best, "request", "cover", "rank", "n_covers") == sorted(((r, c, k, str(counts[r])) for r, c, _, k in want if k <= 2), key=str)


def test_no_requests(spark):
    requests, membership = tables(spark)
    found, more = Z.counted_covers(requests.limit(0), membership, "request", "item", "container", "qualifier", max_covers=1)
    assert found.count() == more.count() == 0
    found, more = Z.counted_covers(requests, membership.limit(0), "request", "item", "container")
    assert found.count() == more.count() == 0


def test_very_many_covers_are_counted_only(spark):
    membership = spark.range(60).selectExpr("id AS container", "explode(sequence(0L, 59L)) AS item")
    requests = spark.range(60).selectExpr("id % 2 AS request", "id AS item")
    found, more = Z.counted_covers(requests, membership, "request", "item", "container", max_covers=1000)
    # thirty items held by the same sixty containers: one to thirty of them
    number = sum(math.comb(60, k) for k in range(1, 31))
    assert found.count() == 0 and {tuple(r) for r in more.collect()} == {(0, str(number)), (1, str(number))}
    best = Z.best_covers(requests, membership, "request", "item", "container", 3).collect()
    assert len(best) == 6 and sorted(best[0]["cover"])[:29] == list(range(29))


def test_rows_of_one_shape_are_one_diagram(spark):
    rows_ = [
        (1, ["a", "b", "c"], [["a", "b"], ["c"]], [2, 1], [["b", "q"], ["a"]]),
        (2, ["d", "m", "x"], [["x"], ["m", "d"]], [1, 2], [["d"], ["m"]]),
        (3, ["d", "m", "x"], [["x"], ["m", "d"]], [1, 1], None),
    ]
    df = spark.createDataFrame(rows_, "r int, _names array<string>, _lists array<array<string>>, _copies array<int>, _pins array<array<string>>")
    one, two, three = (r["_shape"] for r in Z._shaped(df).orderBy("r").collect())
    assert one == two != three
    assert Z._lists_and_pins(one) == ([((2,), 1), ((0, 1), 2)], [(0,), (1,)])
    assert Z._lists_and_pins(three) == ([((2,), 1), ((0, 1), 1)], [])
