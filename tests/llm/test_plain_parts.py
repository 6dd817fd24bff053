"""The parts of the training-data operators that need no Spark, against brute force."""

import collections
import heapq
import random
import re
import tracemalloc
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard

from seqset.llm import katz, mixing, nearest, packing, quality, secrets, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " \t\n", "a", "A b", "é É x", "x " * 400, "one two one two one two one two one two one two", "\x1c\x85 ß\r\n\v\fend"]


def plain_fingerprint(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("ab cd EF É gh".split()) for _ in range(n)) for n in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprint(None) == 0


def test_tree_reaches_every_half_within_one_bit():
    rng = np.random.default_rng(2)
    halves = rng.integers(0, 1 << 32, 4000, dtype=np.uint32)
    tree = simhash.Tree(halves, 64)
    assert tree.leaves > 20
    rows, leaves = tree.route(halves, 0)
    home = np.empty(len(halves), int)
    home[rows] = leaves
    flipped = halves ^ (np.uint32(1) << rng.integers(0, 32, len(halves)).astype(np.uint32))
    reached = set(zip(*(x.tolist() for x in tree.route(flipped, 1))))
    assert all((i, home[i]) in reached for i in range(len(halves)))
    assert simhash.Tree(np.array([7, 7, 7], np.uint32), 1).leaves == 1
    assert simhash.Tree(np.array([], np.uint32), 1).leaves == 1


def plain_best_fit(counts, window):
    left = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [r for r in left if r >= size]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - size)
            else:
                left.append(window - size)
    return sorted(left)


def test_best_fit_decreasing():
    rng = random.Random(3)
    for window in (7, 16, 50):
        for _ in range(40):
            counts = {s: rng.randrange(1, 12) for s in rng.sample(range(1, window + 1), rng.randrange(1, 7))}
            plan = packing.best_fit_decreasing(counts, window)
            length = np.array([s for s, n in counts.items() for _ in range(n)])
            rank = np.array([k for n in counts.values() for k in range(n)])
            where, offset = plan.place(length, rank)
            used = collections.defaultdict(list)
            for s, w, o in zip(length.tolist(), where.tolist(), offset.tolist()):
                used[w].append((o, s))
            assert sorted(used) == list(range(len(used)))
            for pieces in used.values():
                at = 0
                for o, s in sorted(pieces):
                    assert o == at
                    at += s
                assert at <= window
            assert sorted(window - sum(s for _, s in p) for p in used.values()) == plain_best_fit(counts, window)


def test_word_ids_are_the_ids_of_the_whole_text():
    import public_tokenizers

    tokens = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), (8, 8))
    more = ["It's we'll 12 x-1 <|endoftext|>!", "é Σς ﬁ 漢字 مرحبا 🎉", "Straße ÀÉ Ŀŀ İ ŉ", "a b  c ́d", "\x00 \x7f\x1f"]
    for text in ODD + more + [" ".join(more)] * 2:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == tokens.whole.encode(text, add_special_tokens=False).ids
    assert tokens.ids(None) == b""


def plain_sainte_lague(votes, seats, most):
    found = [0] * len(votes)
    heap = [(-Fraction(v), k) for k, v in enumerate(votes) if v > 0 and most[k]]
    heapq.heapify(heap)
    while heap and sum(found) < seats:
        _, k = heapq.heappop(heap)
        found[k] += 1
        if found[k] < most[k]:
            heapq.heappush(heap, (-Fraction(votes[k]) / (2 * found[k] + 1), k))
    return found


def test_word_ids_are_found_in_little_memory():
    """What a worker holds beside the texts and their ids does not follow the size of a batch."""
    words = pa.array([" ".join(f"w{k % 50}" for k in range(50_000))] * 60)  # 11 MB
    tokens = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = len(tokens.ids(words[0].as_py()))
    tracemalloc.start()
    sizes = [len(x) for x in tokens.in_slices(words)]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sizes == [want] * 60
    assert most < 64 << 20


def test_apportionment_and_targets():
    rng = random.Random(4)
    for _ in range(200):
        votes = [Fraction(rng.choice([0, 1, 3, 3, 10, 500]), rng.choice([1, 7])) for _ in range(rng.randrange(1, 7))]
        most = [rng.choice([0, 1, 5, 1000]) for _ in votes]
        seats = rng.randrange(0, 300)
        assert mixing.sainte_lague(votes, seats, most) == plain_sainte_lague(votes, seats, most)
    assert mixing.targets([10, 10, 100], [5, 2, 1]) == [20, 20, 140]
    assert mixing.targets([100, 100], [5, 2]) == [200, 100]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_quality_measures():
    rng, compressor = random.Random(5), zstandard.ZstdCompressor(level=3)
    texts = ODD + ["\n".join(" ".join(rng.choice("a b # c$ dé |".split()) for _ in range(rng.randrange(9))) for _ in range(12)) for _ in range(40)]
    for text in texts:
        found = WORD.findall(text)
        windows = collections.Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
        covered = {i + k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        m = quality.measure(text, compressor)
        assert (m.n_words, m.word_chars, m.n_symbols) == (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (m.n_dup_lines, m.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert m.base_failed == (len(found) < 10 or 100 * len(covered) > 20 * len(found))
    assert [quality.repeated_words(list("abcabcab"), n) for n in (2, 3, 5, 7)] == [8, 8, 8, 0]
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400))
    noise = " ".join("".join(rng.choice(secrets.ALPHABET) for _ in range(60)) for _ in range(200))
    kept = [quality.measure(t, compressor).kept for t in (prose, noise, prose[:900] + " ab" * 6000, None, "")]
    assert kept == [True, False, False, False, False]


def test_secret_spans():
    text = 'é token = "abcdef12" AKIA' + "Z9" * 8 + " " + "0f" * 12 + " secret: abc password=0123456789abcdef01234567"
    spans = secrets.base_spans(text)
    assert [(k, text[a:b][:8]) for k, a, b in spans] == [
        ("assign", "token = "), ("access", "AKIAZ9Z9"), ("hex", "0f0f0f0f"), ("assign", "password"), ("hex", "01234567"),
    ]
    assert secrets.base_spans("") == [] and secrets.redact("x" + text, []) == "x" + text
    assert secrets.redact(text, spans).count(secrets.REDACTED) == 4
    ratio = secrets.Ratio.of(*map(secrets._counted, secrets.generated(secrets.SEED)))
    found = secrets.all_spans("see xK9vQ2mZ7rT4wB1nL6pY and documentationconfiguration now", ratio)
    assert [k for k, *_ in found] == ["markov"]


def test_random_strings_and_identifiers_are_told_apart():
    ratio = secrets.Ratio.of(*map(secrets._counted, secrets.generated(secrets.SEED)))
    strings, identifiers = secrets.generated(77)
    assert np.mean([ratio.is_secret(x) for x in strings]) > 0.98
    assert np.mean([ratio.is_secret(x) for x in identifiers]) < 0.01
    for name in (
        "XMLHttpRequestFactoryBuilder", "MAX_CONNECTION_POOL_SIZE", "usr/local/lib/python3/site-packages", "2024-01-02T03-04-05",
        "123e4567-e89b-12d3-a456-426614174000", "getUserAccountByIdAndName", "0123456789012345678",
    ):
        assert not ratio.is_secret(name), name


def test_transitions_of_many_runs():
    want = secrets._counts()
    for run in ("ab-c", "Z", "a9a9"):
        np.add.at(want, secrets._transitions(run), 1)
    assert (secrets._counted(["ab-c", "Z", "a9a9"]) == want).all() and not secrets._counted([]).any()


def test_discounts_and_unigrams():
    d = katz.Discounts([100, 40, 20, 12, 8, 5])
    assert ((d.ratio[1:-1] > 0) & (d.ratio[1:-1] <= 1)).all() and d.ratio[-1] == 1
    assert (katz.Discounts([0] * 6).ratio > 0).all()
    u = katz.Unigrams(10, [2, 1, 2, 0, 0, 0])
    assert abs(float(u.of(np.array([1, 1, 2, 3, 3])).sum()) + u.unseen - 1) < 1e-12
    assert katz.Unigrams(0, [0] * 6).unseen == 1
    values = np.array([0, 1, 255, 1 << 40], dtype="<u8")
    assert katz._unpacked(katz._packed(values)).tolist() == values.tolist()


def test_products_are_exact():
    big = np.array([[2**31 - 1, -(2**31 - 1)], [3, 4]])
    assert nearest._products(big / 1024, big / 1024).tolist() == [[min(2 * (2**31 - 1) ** 2, 2**63 - 1), -(2**31 - 1)], [-(2**31 - 1), 25]]


def test_shards_of_ranges():
    sizes = np.array([5, 5, 5, 5, 20, 5, 5, 20])
    assert sharding.shard_of_ranges(sizes, 2).tolist() == [0, 0, 0, 0, 0, 1, 1, 1]


def test_classifier_on_held_out_texts():
    rng = random.Random(6)
    words = ["w%d" % i for i in range(400)]
    bad = ["vile", "rotten"]

    def text(toxic):
        found = rng.choices(words, k=rng.randrange(20, 120))
        if toxic:
            found[rng.randrange(len(found))] = rng.choice(bad)
        return "the of and " + " ".join(found)

    rows = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(900)]
    learnt, held = rows[:600], rows[600:]
    model = toxicity.train([np.array(toxicity.hashed_words(t), np.uint32) for t, _ in learnt], np.array([y for _, y in learnt]))
    right = [(s >= toxicity.CUT) == y for s, (_, y) in zip(model.scores([model.encode(t) for t, _ in held]), held)]
    assert sum(right) / len(right) > 0.97
    whole = model.encode("the of " + " ".join(rng.choices(words, k=300_000)) + " vile")
    assert model.scores([whole, model.encode(""), model.encode(None)]).tolist()[0] >= toxicity.CUT
    nothing = toxicity.train([], np.array([], int))
    assert nothing.scores([nothing.encode("a b"), nothing.encode(None)]).max() < 1e-9


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than one task fits, of which each is counted, fitted in one of several shards, or calibrates."""
    random = np.random.default_rng(3)
    rows = [(i, " ".join([*random.choice(["tree", "river", "stone", "cloud", "house"], 12), "vile" if i % 3 == 0 else "kind"]), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    fitted, calibrated = [], []
    shards, calibrate = toxicity._fit_shards, toxicity._calibrate
    monkeypatch.setattr(toxicity, "_fit_shards", lambda m, df, n, *rest: (fitted.append((df.count(), n)), shards(m, df, n, *rest)))
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, df: (calibrated.append(df.count()), calibrate(m, df)))
    model = toxicity.train_on(docs, labels)
    assert fitted[0][0] == fitted[0][1] > 400 and fitted[0][0] + calibrated[0] == 600
    scores = model.scores([model.encode(t) for _, t, _ in rows])
    assert [int(s >= toxicity.CUT) for s in scores] == [y for _, _, y in rows]
    again = toxicity.train_on(docs, labels)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.cuts, again.cuts)
