"""Sequence operators against plain loops, with and without cut sequences."""

import random

import pytest
from plain import dropped, extract, marked, records, sections, spans
from pyspark.sql import functions as F

from seqset.operators import sequences as S
from seqset.operators.running import Running, following, latest, ordered, running

KINDS = list("abcd()")
SIZES = {"u": 0, "long": 60, "short": 5, "one": 1, "mid": 17}


def sequences(seed):
    rng = random.Random(seed)
    return {name: [rng.choice(KINDS) for _ in range(n)] for name, n in SIZES.items()}


def frame(spark, data, gaps=False):
    """Positions are uneven when `gaps`, so equal steps do not cut evenly."""
    rows = [
        (name, (i**3 if gaps else i), k) for name, kinds in data.items() for i, k in enumerate(kinds)
    ]
    return spark.createDataFrame(rows, "seq string, pos long, kind string")


def listed(df, *columns):
    out = {}
    for r in df.select("seq", "pos", *columns).collect():
        out.setdefault(r["seq"], []).append(tuple(r)[1:])
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


@pytest.fixture(params=[None, 4, 7], ids=["whole", "cut4", "cut7"])
def rows(request):
    return request.param or 1000


@pytest.mark.parametrize("gaps", [False, True])
def test_cutting_really_cuts(spark, gaps):
    o = ordered(frame(spark, sequences(1), gaps), "seq", "pos", 4)
    assert o.split
    biggest = o.frame.groupBy("seq", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 17
    # chunks follow the order
    bounds = o.frame.filter("seq = 'long'").groupBy("_chunk").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    edges = sorted((r["_chunk"], r["a"], r["b"]) for r in bounds.collect())
    assert len(edges) > 4 and all(x[2] < y[1] for x, y in zip(edges, edges[1:]))


def test_cutting_uses_the_second_order_column(spark):
    rows = [("s", 5, i, "a") for i in range(50)] + [("s", 6, i, "a") for i in range(3)]
    df = spark.createDataFrame(rows, "seq string, pos long, tie long, kind string")
    o = ordered(df, "seq", ["pos", "tie"], 5)
    assert o.frame.select("_chunk").distinct().count() > 5
    got = running(o, n=Running("sum", F.lit(1))).done().orderBy("pos", "tie").collect()
    assert [r["n"] for r in got] == list(range(1, 54))


@pytest.mark.parametrize("seed", range(3))
def test_cutting_keeps_the_order_of_several_columns(spark, seed):
    rng = random.Random(seed)
    at = [rng.choice([0, 1, 1, 1, 2, 500]) for _ in range(60)]
    rows = [("s", t, rng.randrange(2), i) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "seq string, t long, side int, id long")
    df = df.withColumn("ts", F.timestamp_micros(F.col("t") * 1000).cast("timestamp_ntz"))
    for order, wanted in ((["t", "side", "id"], lambda r: (r[1], r[2], r[3])), (["ts", "id"], lambda r: (r[1], r[3]))):
        o = ordered(df, "seq", order, 4)
        assert o.split
        got = running(o, n=Running("sum", F.lit(1))).done().collect()
        assert {r["id"]: r["n"] for r in got} == {r[3]: i + 1 for i, r in enumerate(sorted(rows, key=wanted))}


def test_cutting_by_text_and_time(spark):
    rows = [("s", f"{i:05d}" * 3, i) for i in range(40)]
    df = spark.createDataFrame(rows, "seq string, name string, n long")
    df = df.withColumn("at", F.timestamp_seconds(F.col("n") * 3600).cast("timestamp_ntz"))
    for order in ("name", "at"):
        o = ordered(df, "seq", order, 6)
        assert o.split
        got = running(o, n2=Running("sum", F.lit(1))).done().orderBy("n").collect()
        assert [r["n2"] for r in got] == list(range(1, 41))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_running_values(spark, rows, reverse, strict):
    data = sequences(2)
    o = ordered(frame(spark, data, gaps=True), "seq", "pos", rows)
    marked_pos = F.when(F.col("kind") == "a", F.col("pos"))
    got = listed(
        running(
            o, reverse=reverse, strict=strict,
            last=Running("last", marked_pos), first=Running("first", marked_pos),
            total=Running("sum", F.col("pos")), low=Running("min", F.col("pos")), high=Running("max", F.col("pos")),
        ).done(),
        "last", "first", "total", "low", "high",
    )
    for name, kinds in data.items():
        items = [(i**3, k) for i, k in enumerate(kinds)]
        want = []
        for i in range(len(items)):
            if reverse:
                seen = items[i + 1 if strict else i :][::-1]
            else:
                seen = items[: i if strict else i + 1]
            a = [p for p, k in seen if k == "a"]
            ps = [p for p, _ in seen]
            want.append(
                (items[i][0], a[-1] if a else None, a[0] if a else None, sum(ps), min(ps, default=None), max(ps, default=None))
            )
        assert got.get(name, []) == want


def test_following_and_latest(spark, rows):
    data = sequences(3)
    o = latest(following(ordered(frame(spark, data, True), "seq", "pos", rows), "next", F.col("kind")), "last", F.col("kind"), 3)
    got = listed(o.done(), "next", "last")
    for name, kinds in data.items():
        want = [
            (i**3, kinds[i + 1] if i + 1 < len(kinds) else None, kinds[max(0, i - 2) : i + 1][::-1])
            for i in range(len(kinds))
        ]
        assert got.get(name, []) == want


def test_forward_fill_and_context(spark, rows):
    data = sequences(4)
    df = frame(spark, data)
    filled = listed(S.forward_fill(df, "seq", "pos", F.col("kind") == "a", F.col("pos"), "fill", rows), "fill")
    points, marks = df.filter("kind = 'c'"), df.filter("kind in ('a', 'b')")
    context = listed(S.context_at(points, marks, "seq", "pos", "kind", "ctx", rows), "ctx")
    for name, kinds in data.items():
        places = [[j for j in range(i + 1) if kinds[j] == "a"] for i in range(len(kinds))]
        assert filled.get(name, []) == [(i, p[-1] if p else None) for i, p in enumerate(places)]
        want = []
        for i, k in enumerate(kinds):
            if k == "c":
                before = [x for x in kinds[:i] if x in "ab"]
                want.append((i, before[-1] if before else None))
        assert context.get(name, []) == want


def test_context_of_a_statement(spark):
    """Words of `FROM orbit GROUP BY tilt HAVING tilt > 3` with their end offsets."""
    marks = spark.createDataFrame([("q", 5, "FROM"), ("q", 20, "GROUP"), ("q", 32, "HAVING")], "seq string, pos int, word string")
    points = spark.createDataFrame([("q", p) for p in (2, 5, 9, 19, 20, 27, 33)], "seq string, pos int")
    got = S.context_at(points, marks, "seq", "pos", "word", "context")
    assert [r["context"] for r in got.orderBy("pos").collect()] == [None, "FROM", "FROM", "FROM", "GROUP", "GROUP", "HAVING"]


@pytest.mark.parametrize("keep_start", [True, False])
@pytest.mark.parametrize("keep_stop", [True, False])
def test_extract_from_to(spark, rows, keep_start, keep_stop):
    data = sequences(5)
    got = listed(S.extract_from_to(frame(spark, data), "seq", "pos", "kind", ["a", "b"], ["b", "c"], keep_start, keep_stop, rows))
    for name, kinds in data.items():
        assert [p for (p,) in got.get(name, [])] == extract(kinds, "ab", "bc", keep_start, keep_stop)


def test_extract_from_to_literal(spark):
    got = S.extract_from_to(frame(spark, {"s": list("a(ab)c")}), "seq", "pos", "kind", ["a"], ["b"], True, True)
    assert [r["kind"] for r in got.orderBy("pos").collect()] == ["a", "(", "a", "b"]


def test_split_by_markers(spark, rows):
    data = sequences(6)
    markers = {"A": ["a"], "bc": ["b", "c"], "open": ["(", ")"]}
    got = listed(S.split_by_markers(frame(spark, data), "seq", "pos", "kind", markers, ("start", "d"), rows), "section")
    for name, kinds in data.items():
        assert [s for _, s in got.get(name, [])] == sections(kinds, markers, ("start", "d"))


def test_sections_of_a_statement(spark):
    words = "SELECT x FROM x , x WHERE x = x GROUP BY x HAVING x ORDER BY x FROM".split()
    markers = {"from": ["FROM"], "where": ["WHERE"], "group": ["GROUP", "BY"], "having": ["HAVING"], "order": ["ORDER", "BY"]}
    got = S.split_by_markers(frame(spark, {"q": words}), "seq", "pos", "kind", markers, ("select", "SELECT"))
    sizes = {r["section"]: r["count"] for r in got.groupBy("section").count().collect()}
    assert sizes == {"select": 2, "from": 4, "where": 4, "group": 3, "having": 2, "order": 4}


def test_balanced_spans(spark, rows):
    data = sequences(7)
    got = S.balanced_spans(frame(spark, data), "seq", "pos", "kind", {"(": ")"}, rows).collect()
    for name, kinds in data.items():
        assert {r["start"]: r["end"] for r in got if r["seq"] == name} == spans(kinds, {"(": ")"})


def test_balanced_spans_of_kinds(spark, rows):
    data = {f"{seed}{name}": kinds for seed in range(3) for name, kinds in sequences(20 + seed).items()}
    pairs = {"(": ")", "a": "b", "c": "d"}
    got = S.balanced_spans(frame(spark, data), "seq", "pos", "kind", pairs, rows).collect()
    for name, kinds in data.items():
        assert {r["start"]: r["end"] for r in got if r["seq"] == name} == spans(kinds, pairs)


@pytest.mark.parametrize(
    "text, wanted", [("a(ab)c", {1: 4}), ("(ab)", {0: 3}), ("()b", {0: 1}), ("((a)b)", {0: 5, 1: 3}), ("((ab)a", {0: None, 1: 4}), (")(", {1: None})]
)
def test_balanced_spans_literal(spark, text, wanted):
    got = S.balanced_spans(frame(spark, {"s": list(text)}), "seq", "pos", "kind", {"(": ")"}).collect()
    assert {r["start"]: r["end"] for r in got} == wanted


def test_marked_spans(spark, rows):
    rng = random.Random(13)
    data = {n: [rng.choice("(()ab") for _ in range(size)] for n, size in (("x", 50), ("y", 6), ("z", 30), ("w", 40))}
    got = S.marked_spans(frame(spark, data), "seq", "pos", "kind", "(", ")", "a", rows).collect()
    for name, kinds in data.items():
        mine = sorted((r["start"], r["end"], r["depth"], r["parent"]) for r in got if r["seq"] == name)
        assert mine == marked(kinds, "(", ")", "a")


def test_nested_subqueries(spark):
    words = "SELECT * FROM ( SELECT * FROM ( SELECT * FROM x ) ) ;".split()
    got = S.marked_spans(frame(spark, {"q": words}), "seq", "pos", "kind", "(", ")", "SELECT").orderBy("start").collect()
    assert [(r["start"], r["end"], r["depth"], r["parent"]) for r in got] == [(3, 13, 1, None), (7, 12, 2, 3)]


def test_split_records(spark, rows):
    data = sequences(8)
    got = listed(S.split_records(frame(spark, data), "seq", "pos", "kind", ["a"], "(", ")", "rec", rows), "rec")
    for name, kinds in data.items():
        assert [r for _, r in got.get(name, [])] == records(kinds, "a", "(", ")")


def test_drop_blocks_and_take_until(spark, rows):
    data = sequences(9)
    kept = listed(S.drop_blocks(frame(spark, data), "seq", "pos", "kind", ["a"], ["b"], rows))
    until = listed(S.take_until(frame(spark, data), "seq", "pos", F.col("kind") == "d", rows))
    for name, kinds in data.items():
        assert [p for (p,) in kept.get(name, [])] == dropped(kinds, "a", "b")
        stop = kinds.index("d") if "d" in kinds else len(kinds)
        assert [p for (p,) in until.get(name, [])] == list(range(stop))


def test_keep_by_first_and_header(spark, rows):
    data = {**sequences(10), "ab": list("ab") + ["c"] * 30, "a": ["a"]}
    first = listed(S.keep_by_first(frame(spark, data), "seq", "pos", "kind", ["a", "b"], rows))
    header = listed(S.keep_by_header(frame(spark, data), "seq", "pos", "kind", ["a", "b"], rows))
    assert {n for n, k in data.items() if k and k[0] not in "ab"} == set(first)
    assert {n for n, k in data.items() if k[:2] == ["a", "b"]} == set(header)
    assert len(header["ab"]) == 32


def test_preceding(spark, rows):
    data = sequences(11)
    got = listed(S.preceding(frame(spark, data), "seq", "pos", "kind", F.col("kind") == "a", 4, "last", rows), "last")
    for name, kinds in data.items():
        assert got.get(name, []) == [(i, kinds[max(0, i - 3) : i + 1][::-1]) for i, k in enumerate(kinds) if k == "a"]


def test_correlate(spark, rows):
    rng = random.Random(12)
    asked = [("hot" if i % 3 else "k", rng.randrange(200), i) for i in range(60)]
    answered = [("hot" if i % 2 else "k", rng.randrange(200), 100 + i) for i in range(40)] + [("unknown", 1, 999)]
    asking = spark.createDataFrame(asked, "key string, t long, id long")
    answers = spark.createDataFrame(answered, "key string, t long, answer long")
    got = S.correlate(asking, answers, "key", "t", F.lit(10), ["answer"], rows).collect()
    want = {}
    for key, t, i in asked:
        fitting = sorted((t2, a) for k2, t2, a in answered if k2 == key and t <= t2 <= t + 10)
        want[i] = fitting[0][1] if fitting else None
    assert {r["id"]: r["answer"] for r in got} == want and len(got) == 60


@pytest.mark.parametrize("rows", [4, None])
def test_spans_of_kinds_keep_null_large_and_fine_keys(spark, rows):
    big = (1 << 60) + 1
    text = list("(a[b)c])")
    keys = [(None, "2024-01-01 00:00:00.000001"), (big, "2024-01-01 00:00:00.000001"), (big, "2024-01-01 00:00:00.000002"), (None, None)]
    data = [(a, b, i, c) for a, b in keys for i, c in enumerate(text)]
    df = spark.createDataFrame(data, "a long, b string, pos long, kind string").withColumn("b", F.col("b").cast("timestamp"))
    got = S.balanced_spans(df, ["a", "b"], "pos", "kind", {"(": ")", "[": "]"}, rows)
    found = {}
    for r in got.select("a", F.date_format("b", "SSSSSS").alias("b"), "start", "end").collect():
        found.setdefault((r["a"], r["b"]), []).append((r["start"], r["end"]))
    wanted = {(None, "000001"), (big, "000001"), (big, "000002"), (None, None)}
    assert {k: sorted(v) for k, v in found.items()} == {k: [(0, 7), (2, 6)] for k in wanted}


TEXTS = [f"https://www.example.com/0000{i:04d}" for i in range(40)]


@pytest.mark.parametrize(
    "kind, values",
    [
        ("string", TEXTS), ("string", [*TEXTS, None, "", "é"]), ("string", ["x"] * 40),
        ("long", [(-1) ** i * ((1 << 63) - 1 - 3 * i) for i in range(40)] + [-(1 << 63), None, 0]),
        ("long", [(1 << 60) + i for i in range(40)]),
        ("double", [float("inf"), float("-inf"), float("nan"), 1e300, -1e300, None] + [i * 2.5 for i in range(40)]),
    ],
)
def test_long_sequences_are_cut_by_any_order(spark, kind, values):
    df = spark.createDataFrame([("s", v, i) for i, v in enumerate(values)], f"s string, v {kind}, i long")

    def numbered(rows):
        o = ordered(df, "s", ["v", "i"], rows)
        return o, {r["i"]: r["n"] for r in running(o, n=Running("sum", F.lit(1))).done().collect()}

    cut, got = numbered(3)
    assert got == numbered(None)[1]
    assert max(r["count"] for r in cut.frame.groupBy("_chunk").count().collect()) <= 6


def biggest(o):
    return max(r["count"] for r in o.frame.filter("_chunk > 0").groupBy("s", "_chunk").count().collect())


def in_order(df, order, rows):
    """The running count with and without cutting, by the rows' own numbers."""
    o = ordered(df, "s", order, rows)
    counts = [{r["i"]: r["n"] for r in running(x, n=Running("sum", F.lit(1))).done().select("i", "n").collect()} for x in (o, ordered(df, "s", order, None))]
    assert counts[0] == counts[1]
    return o


def test_equal_leading_columns_do_not_stop_cutting(spark):
    df = spark.createDataFrame([("s", 1, "x", None, i) for i in range(60)], "s string, a long, b string, c date, i long")
    assert biggest(in_order(df, ["a", "b", "c", "i"], 3)) <= 6


@pytest.mark.parametrize("expression", ["cast(cast(i as string) as binary)", "named_struct('x', null, 'y', -i)", "array(i div 30, i)", "cast(i as decimal(38, 3))", "make_ym_interval(cast(i as int), 1)"])
def test_every_sortable_type_cuts(spark, expression):
    df = spark.range(60).selectExpr("'s' as s", "id as i").withColumn("v", F.expr(expression))
    assert biggest(in_order(df, ["v"], 3)) <= 6


def test_boolean_orders_cut_in_two(spark):
    df = spark.range(40).selectExpr("'s' as s", "id as i", "id % 2 = 0 as v", "null as nothing")
    o = ordered(df, "s", "v", 4)
    assert {r["count"] for r in o.frame.groupBy("_chunk").count().collect()} == {20}
    # rows equal in all order columns stay together, and a column without a type stays
    assert o.done().columns == ["s", "i", "v", "nothing"] and o.done().count() == 40


def test_skewed_last_column_cuts_around_its_hot_value(spark):
    values = [7] * 500 + [2**40 + i for i in range(50)] + [-i for i in range(50)]
    df = spark.createDataFrame([("s", 1, v, i) for i, v in enumerate(values)], "s string, a long, v long, i long")
    o = ordered(df, "s", ["a", "v"], 5)
    sizes = sorted(r["count"] for r in o.frame.groupBy("_chunk").count().collect())
    assert 500 <= sizes[-1] <= 510 and sizes[-2] <= 10
    assert biggest(in_order(df, ["a", "v", "i"], 5)) <= 10


def test_ranges_that_sampling_left_too_long_are_cut_again(spark):
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", 1)
    try:
        df = spark.createDataFrame([(s, i * i, i) for s in "st" for i in range(400)] + [("u", 1, 1)], "s string, v long, i long")
        o = ordered(df, "s", "v", 5)
        assert biggest(o) <= 10
        for s in "st":
            bounds = o.frame.filter(F.col("s") == s).groupBy("_chunk").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()
            edges = sorted((r["_chunk"], r["a"], r["b"]) for r in bounds)
            assert all(x[2] < y[1] for x, y in zip(edges, edges[1:]))
        assert [r["_chunk"] for r in o.frame.filter("s = 'u'").collect()] == [0]
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")


PAIRS = {"(": ")", "[": "]", "{": "}"}
NESTED = {
    "openers": "([{" * 15, "closers": ")]}" * 15, "deep": "([{" * 9 + "}])" * 9, "outside_in": ")]}" * 6 + "([{" * 6,
    "wrong_late": "([{" * 8 + "}])" * 3 + "]" * 3 + "}])" * 5, "wrong_all": "(" * 20 + "]" * 20 + ")" * 25, "short": "(]", "pairs": "()[]{}" * 7,
}


@pytest.mark.parametrize("cut", [3])
def test_runs_of_chunks_are_joined_as_a_stack_would(spark, cut):
    rng = random.Random(cut)
    data = {name: list(text) for name, text in NESTED.items()}
    data |= {f"random{i}": [rng.choice("([{)]}"[: rng.choice([4, 6])]) for _ in range(50)] for i in range(6)}
    got = S.balanced_spans(frame(spark, data), "seq", "pos", "kind", PAIRS, cut).collect()
    assert len({(r["seq"], r["start"]) for r in got}) == len(got)
    for name, kinds in data.items():
        assert {r["start"]: r["end"] for r in got if r["seq"] == name} == spans(kinds, PAIRS)


@pytest.mark.parametrize("text, matched, stacked", [("([{" * 10, 0, 0), ("([{" * 5 + "}])" * 5, 15, 0), ("(([" + "])]", 2, 2), ("((([" + ")]))", 0, 8)])
def test_only_rows_behind_a_wrong_closer_need_a_stack(spark, text, matched, stacked):
    rows = [("s", 0 if k in PAIRS else 1, i, k, k in PAIRS) for i, k in enumerate(text)]
    rest = spark.createDataFrame(rows, "_seq string, _node int, pos long, kind string, _open boolean")
    settled, on_stack, passed = S._seams(rest, "pos", "kind", PAIRS, 3)
    assert (settled.count(), on_stack.count()) == (matched, stacked)
    assert 2 * matched + stacked + passed.count() == len(text)
    opened, undecided = S._undecided(rest, "pos")
    assert (opened.count(), undecided.count()) == ((30, 0) if matched + stacked == 0 else (0, len(text)))
