"""The training-data operators on small tables: odd rows, empty tables, extra columns, brute force."""

import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from seqset.llm import katz, mixing, nearest, packing, preference, quality, secrets, sharding, simhash, toxicity
from seqset.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID string, Key int, `range` int, size int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SECRET = "token = 'Zk3vQ9xW1pLr'"
TEXTS = [None, "", " \n", "one", "one", "a b c d e f g h i j k l", "A b c d e f g h i j k l", LONG, LONG, "x " * 50, SECRET, "ünï cödé wörds"]
ROWS = [(i if i != 3 else None, t, None if i == 1 else "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "e", i, 1, 2) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_near_duplicates(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    fps = [simhash.fingerprint(r[1]) for r in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            group[i] = min(group[j] for j in range(len(ROWS)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {g: min((ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None), default=None) for g in group}
    want = collections.Counter((r[0], least[g]) for r, g in zip(ROWS, group))
    assert collections.Counter((r["id"], r["component"]) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 30)
    fps = np.unique([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 60, (20, 2))])
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    links = {}
    for rows in (simhash.BLOCK_ROWS, 16):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
        monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
        edges = [(int(np.searchsorted(fps, r["a"])), int(np.searchsorted(fps, r["b"]))) for r in simhash.fingerprint_links(nodes).collect()]
        label = simhash._joined(np.arange(len(fps)), *np.array(edges).T)
        links[rows] = label.tolist()
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    want = simhash._joined(np.arange(len(fps)), a, b).tolist()
    assert all(found == want for found in links.values())


def test_quality_toxicity_and_secrets(spark, docs, none):
    got = quality.compression_bands(docs).collect()
    assert len(got) == len(ROWS) and not any(r["kept"] for r in got if r["n_words"] < 10)
    assert quality.compression_bands(none).count() == 0

    ratio = secrets.train(docs)
    found = secrets.find_secrets(docs, ratio)
    assert sorted(len(r["spans"]) for r in found.collect())[-1] >= 1 and found.count() == len(ROWS)
    clean = secrets.redact_secrets(docs, ratio)
    assert clean.columns == docs.columns and "Zk3vQ9xW1pLr" not in "".join(r["text"] or "" for r in clean.collect())
    assert clean.filter("text IS NULL").count() == 1
    assert secrets.find_secrets(none, secrets.train(none)).count() == 0

    labels = spark.createDataFrame([(5, 1), (5, 1), (6, None), (None, 0), (9, 0), (99, 0)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    scored = toxicity.toxicity_scores(docs, model)
    assert scored.filter("score >= 0 AND score <= 1").count() == len(ROWS)
    assert toxicity.toxicity_scores(none, toxicity.train_on(none, labels)).count() == 0
    with pytest.raises(ValueError):
        toxicity.toxicity_scores(docs, model, score_column="KEY")


def test_packing(docs, none, path):
    pieces = packing.pack(docs, path, window=256).collect()
    per_text = collections.Counter()
    tokens = packing.WordTokenizer(path)
    for t in TEXTS + [TEXTS[5], TEXTS[5]]:
        per_text[tokens.ids(t) + b"\x02\x00\x00\x00"] += 1
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p["id"], p["doc_tokens"]].append(p)
    assert sum(p["length"] for p in pieces) == sum(n * len(t) // 4 for t, n in per_text.items())
    assert all(len(p["ids"]) == 4 * p["length"] <= 1024 for p in pieces)
    whole = b"".join(bytes(p["ids"]) for p in sorted(by_doc[7, len(tokens.ids(LONG)) // 4 + 1], key=lambda p: p["start"]))
    assert whole == tokens.ids(LONG) + b"\x02\x00\x00\x00"
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in sequences.values():
        assert [o for o, _ in sorted(held)] == np.cumsum([0] + [n for _, n in sorted(held)])[:-1].tolist() and sum(n for _, n in held) <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(none, path).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    rows = mixing.mixed_documents(docs)
    words = collections.Counter()
    for r in rows.collect():
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert rows.columns == docs.columns and words == +taken
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard_by_splitters(docs, shards=3).collect()
    assert sorted((r["id"], r["size"], r["text_crc32"]) for r in got if r["id"] is not None) == sorted(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS if r[0] is not None
    )
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_splitters(none).count() == 0


def test_katz(spark, docs, none, monkeypatch):
    training = F.col("Key") % 3 != 1
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 9000)
    got = {(r["id"], r["n_tokens"]): r for r in katz.katz_scores(docs, training).collect()}
    texts = {r[0]: (r[1] or "").encode().lower().split() + [b"\n"] for r in ROWS}
    learnt = [(r[1] or "").encode().lower().split() + [b"\n"] for r in ROWS if r[6] % 3 != 1]
    one = collections.Counter(w for t in learnt for w in t)
    two = collections.Counter(p for t in learnt for p in zip([b" "] + t, t))
    heads = collections.Counter(h for t in learnt for h in [b" "] + t[:-1])
    of = lambda c: [sum(1 for n in c.values() if n == r) for r in range(1, 7)]
    total = sum(one.values())
    d, u = katz.Discounts(of(two)), katz.Unigrams(total, of(one))
    p1 = lambda w: float(u.of(np.array([one[w]]))[0])

    def model(h):
        """Probabilities after h of all known words and of the unseen class."""
        if not heads[h]:
            return {w: p1(w) for w in one} | {None: u.unseen}
        seen = {w: n for (a, w), n in two.items() if a == h}
        left = 1 - sum(d.ratio[min(n, 6)] * n for n in seen.values()) / heads[h]
        n_h, left = (heads[h], left) if left > 1e-12 else (heads[h] + 1, 1 / (heads[h] + 1))
        rest = left / (1 - sum(p1(w) for w in seen))
        return {w: d.ratio[min(seen[w], 6)] * seen[w] / n_h if w in seen else rest * p1(w) for w in one} | {None: rest * u.unseen}

    for doc in (0, 2, 5, 6, 9, 10, 11, None):
        text = texts[doc]
        logs = 0.0
        for h, w in zip([b" "] + text, text):
            after = model(h)
            assert abs(sum(after.values()) - 1) < 1e-9
            logs += np.log10(after[w if w in one else None])
        row = got[doc, len(text)]
        assert abs(row["score"] - logs) < 1e-9 * max(1, abs(logs)) and row["train_tokens"] == total
        assert abs(row["base_score"] - sum(np.log10((one[w] + 1) / (total + len(one) + 1)) for w in text)) < 1e-9
        assert row["n_known"] == sum(w in one for w in text)
    assert katz.katz_scores(docs, training).count() == len(ROWS)
    assert katz.katz_scores(none, training).count() == 0
    assert katz.katz_scores(docs, F.lit(False)).agg(F.max(F.abs("score"))).first()[0] == 0


def test_top_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "e") for i in range(300)]
    rows += [(300 + i, rows[7][1], "e") for i in range(40)]
    rows += [(400, None, "e"), (401, [1.0, None], "e"), (402, [float("nan")] * 6, "e"), (403, [], "e"), (404, [1e300] * 6, "e"), (None, rows[3][1], "e"), (5, rows[5][1], "e")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, PIVOT string")
    queries = vectors.filter("vec_id % 10 = 0")
    got = collections.defaultdict(list)
    for r in nearest.top_products(vectors, queries).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v, _ in rows if v is not None and None not in v and np.isfinite(np.array(v)).all()]
    assert set(got) == {i for i, _ in whole if i is not None and i % 10 == 0}
    for q, v in whole:
        if q is not None and q % 10 == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i is None, i) for i, w in whole if i != q]
            assert got[q] == [(i, -s) for s, _, i in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10]]
    assert nearest.top_products(vectors.limit(0), queries.limit(0)).count() == 0
    assert nearest.top_products(vectors, queries.limit(0)).count() == 0


def test_preference_pairs(spark):
    shape = "conv_id long, turn long, role string, text string, prompt string"
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yö"), (1, 2, "user", None), (1, 3, None, "x"), (2, 0, "user", "only"), (None, 0, "user", "z"), (3, 0, "user", "a")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (3, 0, "user", "a"), (3, None, "system", "s"), (4, 0, "user", "q")]
    sides = [spark.createDataFrame([(*r, "e") for r in x], shape) for x in (a, b)]
    got = {r["pair_id"]: r for r in preference.preference_pairs(*sides).collect()}
    assert sorted(got) == [1, 3]
    one, three = got[1], got[3]
    assert one["n_common"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    (mask,) = one["chosen_mask"]
    assert one["chosen"][mask["start"] : mask["end"]] == "yö<|im_end|>\n"
    assert one["rejected"] == "<|im_start|>assistant\nno<|im_end|>\n" and len(one["rejected_mask"]) == 1
    assert (three["n_common"], three["prompt"], three["chosen_mask"]) == (0, "", [])
    assert preference.preference_pairs(*[s.limit(0) for s in sides]).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("Key", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (10**9, "", "en", "s", 0, 1)], docs.schema)
    now = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, now, FOLDER).collect(), now.schema)
        assert after.columns == now.columns
        if name in ("toxicity", "near_duplicates"):
            assert 0 < after.count() <= now.count()
        if name == "secrets":
            assert after.count() == now.count()
        now = after
    assert corpus_pipeline.packing(spark, now, FOLDER).agg(F.max("length")).first()[0] <= 4096
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    problem, rows = differences(spark, duck(FOLDER), name, QUERIES[name], SQL[name], FOLDER)
    assert not problem and rows > 0


def test_labels_are_joined_alike_at_every_size(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (3, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    found = toxicity._labelled(docs, labels, "doc_id", "text", "toxic")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (3, 0, "c"), (3, 0, "d")]
