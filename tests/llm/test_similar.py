"""Near duplicates by five-word shingles and a similarity of 0.8, against brute force."""

import collections
import random
import re

import numpy as np

from seqset.llm import similar

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([tuple(found)] if found else [])


def plain_kept(rows):
    """The smallest id of each group that links of similarity 0.8 or more join; texts without words are one group."""
    sets = [plain_shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), name), name)
    return sorted(least.values())


def near_copies(rng):
    """Texts of 20 to 200 words with copies at all similarities around 0.8, chains of copies, and short and empty texts."""
    words, texts = [f"w{i}" for i in range(3000)], [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f"]
    for _ in range(60):
        text = rng.choices(words, k=rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 30)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_at_similarity_08(spark, monkeypatch):
    rows = near_copies(random.Random(1))
    want = plain_kept(rows)
    assert len(rows) - 20 > len(want) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (similar.FAMILY_ROWS, 2):  # whole buckets and families, and many blocks of them
        monkeypatch.setattr(similar, "FAMILY_ROWS", size)
        monkeypatch.setattr(similar, "BUCKET_ROWS", size)
        kept = similar.drop_similar(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = similar.drop_similar(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)


def test_rows_equal_in_id_or_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, text), (None, text + " x"), (5, "other words"), (5, "other words"), (None, None)]
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter([(3, text), (5, "other words"), (None, None)])
    assert similar.drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_become_candidates():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        n = int(rng.integers(10, 300))
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        only = rng.integers(0, 2**64, n // 4, dtype=np.uint64)  # a similarity of 0.8 or a little more
        cut = int(rng.integers(0, len(only) + 1))
        a, b = (similar.minima(np.concatenate([both, x])) for x in (only[:cut], only[cut:]))
        alike = np.frombuffer(similar.sketch(a), np.uint8) == np.frombuffer(similar.sketch(b), np.uint8)
        missed += alike.sum() < similar.ENOUGH or not set(similar.bands(a)) & set(similar.bands(b))
    assert missed == 0
