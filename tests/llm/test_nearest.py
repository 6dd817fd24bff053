"""The pivot-distance search against all products: large ids and numbers, and what it leaves out."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from seqset.llm import nearest


def plain(rows, asked, top=10):
    whole = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    out = {}
    for q, v in whole:
        if q is not None and asked(q):
            scores = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i is None, i or 0, i) for i, w in whole if i != q]
            out[q] = [(i, -s) for s, _, _, i in sorted(scores, key=lambda x: x[:3])[:top]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_large_ids_beside_a_null(spark):
    rows = [(2**60 + k, [float(k), 1.0]) for k in range(8)] + [(None, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    got = found(nearest.top_products(df, df.where("vec_id % 2 = 0")))
    assert got == plain(rows, lambda q: q % 2 == 0)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(14)
    rows = [(k, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 8)]) for k in range(120)]
    rows += [(200, [3e6, -3e6, 2.5e6, 1.0]), (201, [2.0**53, 1.0, 0.0, 0.0]), (202, [1e300] * 4), (203, [-1e308, 0.0, 0.0, 1.0]), (204, [0.0, 0.0, 0.0, 0.5]), (210, [1e306, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(nearest.top_products(df, df.where("vec_id % 10 = 0 OR vec_id > 199"))) == plain(rows, lambda q: q % 10 == 0 or q > 199)


def test_annuli_out_of_reach_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PIVOT_ROWS", 64)
    monkeypatch.setattr(nearest, "ANNULUS_ROWS", 32)
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(24, 16))
    rows = [(k, [float(x) for x in centres[k % 24] + rng.normal(size=16) * 0.05]) for k in range(1536)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    result, compared = nearest.search(df, df.where(F.col("vec_id") % 50 == 0), 10, "vec_id", "embedding")
    assert found(result) == plain(rows, lambda q: q % 50 == 0)
    share = compared.agg(F.avg("compared")).first()[0] / len(rows)
    assert share < 0.5
