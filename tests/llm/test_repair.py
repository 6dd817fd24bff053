"""Conversation repair against a plain search over all edits, and the shared automaton."""

import functools
import hashlib
import itertools
import random
import zlib

import pytest

from seqset.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv_key string, COPY int"
FAULTS = {"blank": 0, "duplicate": 1, "truncated": 2}


def initial_after(state, initial):
    """The grammar `(s?(ua)+)?` as a table of its own."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def search(rows):
    """(cost, audit, outcome) of the cheapest, then least, edits of rows (role, text, fault)."""

    @functools.cache
    def best(at, state, inserted):
        options = []
        if at == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            role = "assistant" if state == "u" else "user"
            cost, audit, rest = best(at, role[0], inserted + 1)
            options.append((cost + 3, "I" + audit, ((role, ""), *rest)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, rest = best(at + 1, state, 0)
            options.append((cost + 4, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for edit, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    then = initial_after(state, new[:1])
                    if then is not None:
                        cost, audit, rest = best(at + 1, then, 0)
                        options.append((cost + price + extra, edit + audit, ((new, text), *rest)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def plain(table):
    """The query's rows from rows (conv_id, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            mark = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
            role, text = shown(role), shown(text)
            text = "" if mark == 1 else text.translate({ord(c): None for c in ".!?"}) if mark == 2 else text
            rows += [(turn, "user" if mark == 4 else role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, marked = dict.fromkeys(FAULTS, 0), set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, mended = search(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_automaton_equals_search():
    rng = random.Random(8)
    path = repair.Path(repair.SuffixDawg())
    faults = {"x": "blank", "S": "truncated", "U": "truncated", "A": "truncated", "O": "truncated"}
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    signatures = ["".join(rng.choice("suaoxSUAOuaua") for _ in range(rng.randrange(0, 9))) for _ in range(600)]
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        rows = tuple((names[c.lower()], "t", faults.get(c)) for c in signature)
        assert path.read(signature[::-1]) == search(rows)[:2], signature


def test_each_suffix_is_one_node():
    rng = random.Random(9)
    signatures = {"".join(rng.choice("uaUAx") for _ in range(rng.randrange(0, 12))) for _ in range(3000)}
    path = repair.Path(repair.SuffixDawg())
    for backwards in sorted(s[::-1] for s in signatures):
        path.read(backwards)
    suffixes = {s[k:] for s in signatures for k in range(len(s))}
    assert path.grown == len(suffixes) < sum(map(len, signatures)) / 2
    # and what they cost is found once for all with the same future
    assert len(path.dawg.register) < 200


def odd_rows():
    rng = random.Random(10)
    rows = []
    for conv in [*range(60), None, 10**15]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "Why? ", "", "  \n", None, "Änd so!", "same.", "same.", f"t {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3, 0]), role, text))
    return rows + rows[:5] + rows[:2] + [(77, None, "user", "x"), (78, 2, "user", "y." * 200_000), (78, 1, "assistant", " ." * 9)]


@pytest.mark.parametrize("batch", [4096, 1])
def test_repair_equals_plain(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(repair, "BATCH_ROWS", batch)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op12_dawg_repair(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "hi."), (1, 2, "user", "again?"), (2, 0, "assistant", "a."), (3, 0, "user", " ")]
    plain_rows = spark.createDataFrame([(str(c), t, r, x, 0) for c, t, r, x in rows], "conv_key string, turn long, role string, text string, copy int")
    plans = repair.repair_plans(plain_rows)
    assert {r["conv_key"]: (r["audit"], r["cost"]) for r in plans.collect()} == {"1": ("KDR", 7), "2": ("IK", 3), "3": ("D", 4)}
    got = sorted(tuple(r) for r in repair.repaired_turns(plain_rows, plans).collect())
    assert got == [("1", 0, "user", "hi."), ("1", 1, "assistant", "again?"), ("2", 0, "user", ""), ("2", 1, "assistant", "a.")]


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_dawg_repair(spark, str(tmp_path)).count() == 0
