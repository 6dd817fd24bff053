"""The PartEnum join against all pairs, and the bounds that it rests on."""

import random

import numpy as np
import pytest

from seqset.llm import partenum

SCHEMA = "doc_id long, text string, NODE int, signature string"


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """(number of shingles, smallest id) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def varied(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return " ".join(out)


def corpus(rng, families, most):
    rows = []
    for f in range(families):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 7, 12, 40, 150, 600]))]
        for _ in range(rng.randrange(1, most)):
            rows.append((len(rows) * 7 % 1009, varied(rng, words, rng.randrange(0, max(2, len(words) // 30)))))
    return rows


def found(spark, rows, partitions=3):
    table = [(i, t, 1, "s") for i, t in rows]
    got = partenum.similar_sets(spark.createDataFrame(table, SCHEMA).repartition(partitions))
    return sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], r["component"] or 0) for r in got.collect())


def wanted(rows):
    return sorted((i is None, i or 0, n, c or 0) for i, n, c in components(rows))


def test_components_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = corpus(rng, 40, 6)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, None), (2003, "one"), (2004, "One"), (2005, "one two three four"), (None, "only here without id"), (None, "one")]
    rows += [(2006, " ".join(f"long{k % 9000}x{k}" for k in range(30_000))), (2007, " ".join(f"long{k % 9000}x{k}" for k in range(28_000)))]
    rows += [rows[0], rows[0], (2008, "a\xa0b c d e f"), (2009, "a b c d e a b c d e a b c d e")]
    assert found(spark, rows) == wanted(rows)
    assert partenum.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{rng.randrange(50)}" for _ in range(120)]
    rows = [(k, varied(rng, words, rng.randrange(0, 8))) for k in range(150)]
    for name, value in (("BUCKET_ROWS", 8), ("FAMILY_ROWS", 16), ("SIGNED", 4), ("TEXT_BYTES", 100)):
        monkeypatch.setattr(partenum, name, value)
    assert found(spark, rows) == wanted(rows)


@pytest.mark.parametrize("sets_in_band", [1, 10_000, 100_000_000])
def test_similar_sets_share_a_signature(sets_in_band):
    rng = np.random.default_rng(7)
    ends = partenum.band_ends(4000)
    plan = partenum.schemes(ends, dict.fromkeys(range(len(ends)), sets_in_band))
    for size in [1, 2, 4, 5, 6, 9, 10, 17, 40, 41, 99, 300, 1200, 2900]:
        for _ in range(20):
            # as different as similarity 4/5 allows: `gone` missing here and `more` missing there
            most = size * 2 // 9
            gone = int(rng.integers(0, most + 1))
            whole = rng.integers(0, 1 << 63, size + most, dtype=np.uint64)
            a = np.sort(whole[:size])
            b = np.sort(whole[gone : size + most - gone])
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common) or not common:
                continue
            who, found = partenum.signatures([a, b], ends, plan)
            assert set(found[who == 0].tolist()) & set(found[who == 1].tolist())
            sketches = [partenum.sketch(x) for x in (a, b)]
            words = partenum._folded(sketches, min(map(len, sketches)))
            assert np.bitwise_count(words[0] ^ words[1]).sum() <= len(a) + len(b) - 2 * common


def test_more_sets_buy_more_selective_signatures():
    ends = partenum.band_ends(1000)
    few, many = (partenum.schemes(ends, dict.fromkeys(range(len(ends)), n)) for n in (100, 100_000_000))
    assert few[-2][2] == 0 < many[-2][2]
    for n1, n2, k2 in many:
        assert n2 > k2 and n1 >= 1


def test_bands_hold_all_similar_sizes():
    ends = partenum.band_ends(5000)
    band = np.searchsorted(ends, np.arange(5001))
    for size in range(1, 4000):
        assert band[min(5000, size * 5 // 4)] - band[size] in (0, 1)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = partenum.op11_partenum_join(spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(components(rows))
