"""Whole rows of registered queries and of the pipeline on small tables, against plain versions."""

import collections
import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import differences, duck
from pyspark.sql import functions as F

from seqset.llm import mixing, packing, preference, queries, secrets, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_number_own int, text_hash_kept int, kept_hash int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The old house on the hill had a long and quiet history that nobody in the small village ever wanted to tell again".split()


def texts():
    out = [None, "", " \n\t", "one", "One", "a b c", "İ ß ŉ É́ <|endoftext|> x's a.b.c. (1234)!", "line one here\nline one here\n\nother"]
    out += ['token = "abcdef12" AKIA' + "Z9" * 8 + " " + "0f" * 12 + " PASSWORD: abc passwd=0123456789abcdef01234567 api_key='sk_live_12345'"]
    for k in range(30):
        words = [PROSE[(k * 7 + j * (k % 5 + 1)) % len(PROSE)] + ("" if j % 3 else str(k)) for j in range(20 + 9 * k)]
        out += [" ".join(words), " ".join([*words, "end"])] if k % 4 == 0 else [" ".join(words)]
    return out + [" ".join(f"w{j % 90}" for j in range(9000))] * 2


def rows():
    found = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), k, 1, 2) for k, t in enumerate(texts())]
    return found + [found[12], found[12], (None, "no id", None, "s1", 5, 0, 0, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 0, int(k % 6 == 0)) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(table):
    """Fingerprint and smallest id of every row, by all pairs."""
    prints = [plain_fingerprint(t) for _, t, *_ in table]
    group = list(range(len(table)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(table)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    least = {g: min((table[k][0] for k in range(len(table)) if group[k] == g and table[k][0] is not None), default=None) for g in set(group)}
    return [(r[0], f"{p:016x}", least[g]) for r, p, g in zip(table, prints, group)]


def test_op1(spark, folder):
    assert collected(queries.QUERIES["op1_simhash_vp"](spark, folder)) == sorted(plain_groups(rows()), key=str)


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [2]


def test_op5(spark, folder):
    ids = {(r[0], r[1]): plain_ids(r[1]) for r in rows()}
    pieces = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for doc, start, length, crc, total, window, offset in (tuple(r) for r in queries.QUERIES["op5_pack_bfd"](spark, folder).collect()):
        pieces[doc, total].append((start, length, crc))
        windows[window].append((offset, length))
    copies = collections.Counter((r[0], r[1]) for r in rows())
    want = collections.defaultdict(list)
    for (doc, text), whole in ids.items():
        cuts = sorted({(s, n) for s, n, _ in pieces[doc, len(whole)]})
        assert [s for s, _ in cuts] == [0, *itertools.accumulate(n for _, n in cuts)][:-1] and sum(n for _, n in cuts) == len(whole)
        for s, n in cuts:
            want[doc, len(whole)] += [(s, n, zlib.crc32(struct.pack(f"<{n}I", *whole[s : s + n])))] * copies[doc, text]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for held in windows.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 4096
    assert sorted(windows) == list(range(len(windows)))


@pytest.mark.parametrize("size", [packing.SLICE_BYTES, 300])
def test_ids_of_slices(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SLICE_BYTES", size)
    tokens = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    every = pa.array([None, *texts()])
    want = [np.array(plain_ids(t)[:-1], "<u4").tobytes() for t in every.to_pylist()]
    assert list(tokens.in_slices(every)) == want and list(tokens.in_slices(every[5:12])) == want[5:12]


def test_op7(spark, folder):
    found = queries.QUERIES["op7_shard_splitters"](spark, folder).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert 0 <= shard < 16 and slots == list(range(len(slots)))


def test_shards_of_equal_rows_have_equal_bytes(spark):
    table = [(7, "same text " * 40)] * 800 + [(k, f"text {k} " * (k % 50 + 1)) for k in range(400)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    found = sharding.shard_by_splitters(df).collect()
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(16)]
    share = sum(sizes) / 16
    assert len(found) == len(table) and max(abs(s - share) for s in sizes) <= max(r["size"] for r in found) + sharding.TOLERANCE * share


def plain_spans(text):
    kinds = (
        (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, m.end()) for k, (pattern, enough) in enumerate(kinds) for m in pattern.finditer(text) if enough(m)]
    return sorted(found)


def test_op8(spark, folder):
    names = ("assign", "access", "hex")
    want = []
    for doc, text, *_ in rows():
        spans = plain_spans(text or "")
        written = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        want.append((doc, *counts, hashlib.sha256(written.encode()).hexdigest(), written))
    assert collected(queries.QUERIES["op8_secret_markov"](spark, folder)) == sorted(want, key=str)


def test_op2_base(spark, folder):
    want = []
    for doc, text, *_ in rows():
        words = WORD.findall(text or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts = collections.Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed))
    got = queries.QUERIES["op2_compression_bands"](spark, folder)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collected(got.select(*columns)) == sorted(want, key=str)
    assert not got.where("base_failed AND kept").count()


def test_pairs_of_every_conversation(spark, tmp_path):
    talks = [(2 * k, t, ("user", "assistant")[t % 2], f"{k} {t}") for k in range(10) for t in range(k % 4 + 1)]
    talks += [(10**12, None, "assistant", "unnumbered"), (10**12, 3, "user", "last"), (None, 0, "user", "x")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(talks, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    problem, n = differences(spark, con, "op3", preference.op3_preference_format, preference.OP3_SQL, str(tmp_path))
    assert not problem and n == 11
    df = spark.createDataFrame(talks, schema)
    swapped = preference.with_foreign_answers(df, rows=3).collect()
    last = {r["conv_id"]: r["text"] for r in sorted(swapped, key=lambda r: (r["turn"] is not None, r["turn"] or 0)) if r["role"] == "assistant"}
    assert last[0] == "1 1" and last[2] == "2 1" and last[10**12] == "1 1" and last[18] == "1 1"
    alone = preference.with_foreign_answers(df.where("role = 'user'")).count()
    assert alone == df.where("role = 'user' AND conv_id IS NOT NULL").count()


def test_pipeline_run(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    clean = spark.createDataFrame(stages["toxicity"](spark, docs, folder).collect(), docs.schema)
    one = [tuple(r) for r in stages["near_duplicates"](spark, clean, folder).collect()]
    kept = [tuple(r) for r in clean.collect()]
    # one row of each group by all pairs, that of the smallest id
    best = {}
    for row, (doc, _, least) in zip(kept, plain_groups(kept)):
        if doc == least:
            best[least] = row
    assert sorted(one, key=str) == sorted(best.values(), key=str)
    masked = [tuple(r) for r in stages["secrets"](spark, spark.createDataFrame(one, docs.schema), folder).collect()]
    before = {r[0]: r[1] for r in one}
    for doc, text, _, _, n_chars, *_ in masked:
        spans = plain_spans(before[doc] or "")
        assert (text == before[doc]) == (not spans) and n_chars == len(text or "")
        assert all((before[doc])[a:b] not in text for a, _, b in spans)
    mixed = [tuple(r) for r in stages["mixing"](spark, spark.createDataFrame(masked, docs.schema), folder).collect()]
    taken = collections.Counter()
    for r in mixed:
        taken[r[3]] += len(WORD.findall(r[1]))
    plan = mixing.mix(spark.createDataFrame(masked, docs.schema)).groupBy("source").agg(F.max("target").alias("target")).collect()
    assert all(abs(taken[r["source"]] - r["target"]) <= 2 * mixing.BLOCK_WORDS for r in plan)
    assert {r[5:] for r in mixed} <= {r[5:] for r in rows()}
    # the whole run packs exactly these texts
    found = P.run(spark, folder).collect()
    tokens = collections.Counter()
    for r in mixed:
        tokens[r[0], len(plain_ids(r[1]))] += 1
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0) == tokens
    by_start = {}
    for r in found:
        by_start.setdefault(r["doc_id"], set()).add((r["start"], bytes(r["ids"])))
    for r in mixed:
        whole = struct.pack(f"<{len(plain_ids(r[1]))}I", *plain_ids(r[1]))
        assert (0, whole[: 4 * 4096]) in by_start[r[0]]
