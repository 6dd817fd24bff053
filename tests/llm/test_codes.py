"""Product codes against a plain version in numbers of any length; grid cells against all distances."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from seqset.llm import codes


def plain(rows):
    """{row number: (code, error)} and the digest, by comparing everything with everything."""
    kept = [(n, i, v) for n, (i, v) in enumerate(rows) if v is not None and None not in v and all(map(math.isfinite, v))]
    width = -(-max(len(v) for _, _, v in kept) // 8)
    whole = {n: [math.floor(Fraction(x) * 4096) for x in v] + [0] * (8 * width - len(v)) for n, _, v in kept}
    part = lambda n, p: whole[n][p * width : (p + 1) * width]
    first = [n for n, _, _ in sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:16]]
    books = [[part(n, p) for n in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            own = {}
            for n in whole:
                own.setdefault(near(part(n, p), book)[1], []).append(part(n, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(book)]
    out = {}
    for n in whole:
        best = [near(part(n, p), books[p]) for p in range(8)]
        out[n] = ("".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), codes.LONGEST))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def rows_of(rng, n, width):
    rows = [(int(i) * 3, [float(x) for x in rng.normal(size=width).astype(np.float32)]) for i in rng.permutation(n)]
    return rows + [(1, None), (2, [1.0, None]), (4, [float("nan")] * width), (5, [float("-inf")] * width), (None, rows[0][1]), rows[1], rows[1]]


@pytest.mark.parametrize("odd", [[], [(7, [3e38] * 16), (8, [-1e12, 5.0]), (10, [])]])
def test_codes_equal_plain(spark, odd):
    rows = rows_of(np.random.default_rng(3), 90, 16) + odd
    table = [(i, v, None if n % 5 == 0 else n % 3, "e") for n, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, CODE string").repartition(3)
    found, books = codes.grid_codes(df)
    want, digest = plain(rows)
    assert codes.books_digest(books) == digest
    got = sorted((r["id"] is None, r["id"] or 0, r["code"], r["error"]) for r in found.collect())
    assert got == sorted((rows[n][0] is None, rows[n][0] or 0, c, e) for n, (c, e) in want.items())


def test_few_and_no_vectors(spark):
    shape = "vec_id long, embedding array<float>, label int"
    none, books = codes.grid_codes(spark.createDataFrame([], shape))
    assert none.count() == 0 and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
    found, _ = codes.grid_codes(spark.createDataFrame([(2, [1.0] * 8, 1), (1, [0.5] * 8, 1), (3, [0.9] * 8, None)], shape))
    assert {r["id"]: (r["code"], r["error"]) for r in found.collect()} == {1: ("00" * 8, 0), 2: ("01" * 8, 0), 3: ("02" * 8, 0)}


def test_cells_leave_the_nearest_open(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    for cells in (codes.CELLS, 100):
        monkeypatch.setattr(codes, "CELLS", cells)
        grid = codes.GridCells(centres.astype(object))
        where, error, compared = grid.nearest(points)
        every = ((points[:, None] - centres[None]) ** 2).sum(2)
        assert (where == every.argmin(1)).all() and (error == every.min(1)).all()
        assert compared.mean() < 8
    same = np.zeros((16, 8), dtype=object)
    assert (codes.GridCells(same).nearest(points)[0] == 0).all()


def test_cells_of_one_hash_are_told_apart():
    centres = np.array([[0], [1000], [5000]], dtype=object)
    grid = codes.GridCells(centres)
    grid.factors = np.zeros(1, np.uint64)
    points = np.array([[1], [4900], [990], [1]])
    assert grid.nearest(points)[0].tolist() == [0, 2, 1, 0]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = codes.op13_grid_codes(spark, folder).collect()
    data = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want, digest = plain([(r["vec_id"], list(r["embedding"])) for r in data])
    of_label = {}
    for n, (_, e) in want.items():
        of_label[data[n]["label"]] = of_label.get(data[n]["label"], 0) + e
    assert sorted(tuple(r) for r in rows) == sorted((data[n]["vec_id"], c, e, of_label[data[n]["label"]], digest) for n, (c, e) in want.items())
