"""Cheapest repairs of conversations, from a suffix-shared automaton of their role and fault signatures.

A conversation's signature has one letter for each row: its role's initial and its fault. What a row costs to mend depends only on
the letters behind it and on the grammar's state, so conversations with the same end share that work: distinct signatures
are sorted by their reversed letters, and the automaton is grown along the sorted list. Each suffix is one node, whose cost-to-go and
first edit for every grammar state are found once for all conversations that end so; only the nodes of the current
path are held. Nodes whose costs differ by a constant have the same future, and are one in the register of steps.

Rows are read as sorted streams of whole conversations: a conversation of any length needs memory for its letters, not its texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import table
from seqset.session import saved

#: Grammar states: nothing yet, after the system turn, after a user, after an assistant turn. A conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an edit that gives the turn that the grammar wants next.
WANTED = (USER, USER, ASSISTANT, USER)
#: The state after a turn with a given initial, where it is allowed.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The letter of a row that has to go; others are their role's initial or o, in upper case if truncated.
GONE = "x"
#: Rows and bytes of one written batch.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, conv_key, turn, role, text, copy): rows damaged by a checksum of their place; copies 0 and 1 of a repeated row.

    Nulls in ids, turns, roles and texts are written as one space; `turn` and `conv_id` keep their nulls.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", shown("conv_id").alias("conv_key"), "turn", shown("role").alias("role"), shown("text").alias("text"), mark.alias("mark"))
    m = F.col("mark")
    text = F.when(m == 1, "").when(m == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(m == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(m != 0).select(
        "conv_id", "conv_key", "turn", F.when(m == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


def _letters(rows: DataFrame) -> DataFrame:
    """Rows with `blank`, `open` (truncated) and `first`: whether no row of its conversation with its role and text has an earlier place."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("copy"))
    marked = rows.select(
        "conv_key", "turn", "role", "text", "copy", F.sha2("text", 256).alias("digest"), place.alias("place"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    # pre-aggregated: a text that fills a conversation is one row here
    firsts = marked.groupBy("conv_key", "role", "digest").agg(F.min("place").alias("least"))
    return marked.join(firsts, ["conv_key", "role", "digest"]).withColumn("first", F.col("place") == F.col("least")).drop("least", "place", "digest")


def _sorted(rows: DataFrame, *before: str) -> DataFrame:
    """Whole conversations in one partition each, their rows in order."""
    order = [*before, F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    return rows.repartition("conv_key").sortWithinPartitions("conv_key", *order)


def _signatures(rows: DataFrame) -> DataFrame:
    """(conv_key, signature, gaps, blank, duplicate, truncated, illegal) of sorted rows."""
    names = ["conv_key", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def of(batches):
        key, now = None, None
        done = []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_key", "turn", "role", "text", "blank", "open", "first")]
            for conv, turn, role, text, blank, cut, first in zip(*columns):
                if conv != key:
                    if key is not None:
                        done.append(finished(key, now))
                    key, now = conv, {"letters": bytearray(), "turns": [None, None, 0], "faults": [0, 0, 0], "illegal": 0, "before": None}
                # of rows equal in everything, which are neighbours, only one is the first
                twin = now["before"] == (turn, role, text)
                fault = 0 if blank else 1 if not first or twin else 2 if cut else None
                if fault is not None:
                    now["faults"][fault] += 1
                initial = role[:1]
                letter = initial if initial and initial in AFTER else "o"
                now["letters"] += (GONE if fault in (0, 1) else letter.upper() if fault == 2 else letter).encode()
                if now["before"] is not None and now["before"][1][:1] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                if turn is not None:
                    low, high, different = now["turns"]
                    now["turns"] = [turn if low is None else low, turn, different + (high is None or turn != high)]
                now["before"] = (turn, role, text)
            if len(done) >= BATCH_ROWS or sum(len(d[1]) for d in done) > BATCH_BYTES:
                yield written(done)
                done = []
        if key is not None:
            done.append(finished(key, now))
        yield written(done)

    def finished(key, now):
        low, high, different = now["turns"]
        gaps = 0 if low is None else high - low + 1 - different
        return (key, now["letters"].decode(), gaps, *now["faults"], now["illegal"])

    def written(done):
        columns = list(zip(*done)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 2 + [pa.int64()] * 5)], names)

    return rows.mapInArrow(of, "conv_key string, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


class SuffixDawg:
    """Costs and first edits behind every node, for each grammar state; equal futures are one entry of the register."""

    END = (0, 2 * INSERT, INSERT, 0)

    def __init__(self):
        self.register: dict[tuple[str, tuple], tuple] = {}

    def step(self, letter: str, behind: tuple) -> tuple:
        """What a letter in front of a node gives: costs less their least, that least, and the first edit, per grammar state."""
        known = self.register.get((letter, behind))
        if known is None:
            known = self.register[letter, behind] = self._step(letter, behind)
        return known

    @staticmethod
    def _step(letter: str, behind: tuple) -> tuple:
        best = []
        for state in range(4):
            options = [(DELETE + behind[state], "D")]
            if letter != GONE:
                extra = TRUNCATED if letter.isupper() else 0
                kept = AFTER.get(letter.lower(), {}).get(state)
                if kept is not None:
                    options.append((extra + behind[kept], "K"))
                options.append((extra + REROLE + behind[WANTED[state]], "R"))
            best.append(min(options))
        # an insertion leads to a state that consumes the row, or to one more insertion before it does
        for _ in range(2):
            best = [min(best[s], (INSERT + best[WANTED[s]][0], "I")) for s in range(4)]
        least = min(c for c, _ in best)
        return tuple(c - least for c, _ in best), least, "".join(e for _, e in best)


class Path:
    """The nodes of one signature from its end; a following signature keeps those of the suffix that both share."""

    def __init__(self, dawg: SuffixDawg):
        self.dawg, self.letters = dawg, ""
        self.nodes, self.costs, self.edits = [SuffixDawg.END], [0], [""]
        #: Nodes whose costs were found, over all signatures.
        self.grown = 0

    def read(self, backwards: str) -> tuple[int, str]:
        """The least cost and its least audit, of a signature written from its end."""
        shared, most = 0, min(len(self.letters), len(backwards))
        while shared < most and self.letters[shared] == backwards[shared]:
            shared += 1
        del self.nodes[shared + 1 :], self.costs[shared + 1 :], self.edits[shared + 1 :]
        for letter in backwards[shared:]:
            node, cost, edits = self.dawg.step(letter, self.nodes[-1])
            self.nodes.append(node)
            self.costs.append(self.costs[-1] + cost)
            self.edits.append(edits)
            self.grown += 1
        self.letters = backwards
        return self.costs[-1] + self.nodes[-1][START], "".join(self._audit(backwards))

    def _audit(self, backwards: str):
        state = START
        for at in range(len(backwards), 0, -1):
            while (edit := self.edits[at][state]) == "I":
                yield edit
                state = WANTED[state]
            yield edit
            if edit == "K":
                state = AFTER[backwards[at - 1].lower()][state]
            elif edit == "R":
                state = WANTED[state]
        while state in (SYSTEM, USER):
            yield "I"
            state = WANTED[state]


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature, by an automaton that is shared along the sorted list of their ends."""

    def of(batches):
        path = Path(SuffixDawg())
        for batch in batches:
            found = [path.read(b) for b in batch["backwards"].to_pylist()]
            costs, audits = pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch["signature"], costs, audits], ["signature", "cost", "audit"])

    each = signatures.select("signature").distinct().withColumn("backwards", F.reverse("signature"))
    ranged = each.repartitionByRange("backwards").sortWithinPartitions("backwards")
    return ranged.mapInArrow(of, "signature string, cost bigint, audit string")


def _mended(audit: str, rows):
    """The repaired (role, text) rows of one conversation from its audit and its rows in order."""
    state = START
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER[role[0]][state]
        else:
            state = WANTED[state]
            role = ROLES[state]
        yield role, text


def _streamed(rows: DataFrame, audits: DataFrame, use, schema: str) -> DataFrame:
    """`use(conv_key, repaired rows)` for every conversation: yields rows of `schema`. Texts are read once, as a stream."""
    kinds = {"role": "string", "text": "string", "copy": "int", "turn": rows.schema["turn"].dataType.simpleString()}
    plans = audits.select("conv_key", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], "audit")
    turns = rows.select("conv_key", F.lit(1).alias("kind"), *kinds, F.lit(None).cast("string").alias("audit"))
    names = [part.split()[0] for part in schema.split(", ")]

    def of(batches):
        entries = (e for b in batches for e in zip(*(b[c].to_pylist() for c in ("conv_key", "kind", "role", "text", "audit"))))
        done, held = [], 0
        for key, kind, _, _, audit in entries:
            assert kind == 0, "a conversation begins with its audit"
            own = ((role, text) for _, _, role, text, _ in entries)
            for row in use(key, _mended(audit, own)):
                done.append(row)
                held += 64 + sum(len(x) for x in row if isinstance(x, str))
                if len(done) >= BATCH_ROWS or held > BATCH_BYTES:
                    yield written(done)
                    done, held = [], 0
        yield written(done)

    def written(done):
        columns = list(zip(*done)) or [()] * len(names)
        kinds = {"string": pa.string(), "bigint": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[p.split()[1]]) for c, p in zip(columns, schema.split(", "))], names)

    return _sorted(plans.unionByName(turns), "kind").mapInArrow(of, schema)


def repair_plans(rows: DataFrame) -> DataFrame:
    """(conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of `rows` (conv_key, turn, role, text, copy).

    Rows are ordered by turn, null first, then role, text and copy. The first fault of a row counts: blank (no word), duplicate
    (role and text seen before in its conversation) or truncated (last character of a word not `.`, `!` or `?`). `audit`
    has the initials of the cheapest edits (Keep, Rerole, Delete, Insert) after which the role initials are `(s?(ua)+)?`; of
    several the least in ASCII. `illegal` counts neighbours that are not su, ua or au; `gaps` the turns missing between the first and the last.
    Roles with other initials are never kept. Extra columns are not read. No rows give no rows.
    """
    found = saved(_signatures(_sorted(_letters(rows))))
    edits = saved(cheapest_edits(found))
    return found.join(edits, "signature").drop("signature")


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_key, place, role, text): the rows after the edits of `plans`, numbered from 0 in each conversation."""

    def use(key, mended):
        yield from ((key, place, role, text) for place, (role, text) in enumerate(mended))

    return _streamed(rows, plans, use, "conv_key string, place bigint, role string, text string")


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_key, repaired_sha256): SHA-256 of the repaired `role:text` lines, read as a stream."""

    def use(key, mended):
        digest, between = hashlib.sha256(), b""
        for role, text in mended:
            digest.update(between + role.encode() + b":" + text.encode())
            between = b"\n"
        yield key, digest.hexdigest()

    return _streamed(rows, plans, use, "conv_key string, repaired_sha256 string")


def op12_dawg_repair(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with every damaged conversation, its cheapest repair, and the digest of the repaired turns.

    Every original conv_id has a row, null included; one without rows after the damage has zeros, an empty audit and the digest of nothing.
    """
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = saved(damaged(turns))
    plans = saved(repair_plans(rows))
    digests = repaired_digests(rows, plans)
    every = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv_key")).distinct()
    found = every.join(plans, "conv_key", "left").join(digests, "conv_key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _option(cost: str, edit: str, behind: str) -> str:
    return f"{{'c': ({cost}) + {behind}.c, 'a': '{edit}' || {behind}.a}}"


def _base_sql(state: int) -> str:
    """The best edit of the row at hand in a grammar state, from the best (cost, audit) v0 to v3 behind it."""
    never = "{'c': 1000000000, 'a': ''}"
    extra = "CASE WHEN open THEN 3 ELSE 0 END"
    wants = {0: ("'s'", 1, "'u'", 2), 1: ("'u'", 2, "''", 2), 2: ("'a'", 3, "''", 3), 3: ("'u'", 2, "''", 2)}[state]
    keep = f"CASE WHEN initial = {wants[0]} THEN {_option(extra, 'K', f'v{wants[1]}')} WHEN initial = {wants[2]} THEN {_option(extra, 'K', f'v{wants[3]}')} ELSE {never} END"
    rerole = _option(f"3 + {extra}", "R", f"v{WANTED[state]}")
    delete = _option("4", "D", f"v{state}")
    return f"CASE WHEN gone THEN {delete} ELSE {_best(delete, keep, rerole)} END AS w{state}"


_INSERTED = {s: _option("3", "I", f"w{t}") for s, t in {2: 3, 3: 2}.items()}

OP12_SQL = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS ckey, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), bits(i, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS MATERIALIZED (
  SELECT i, c AS v FROM bits WHERE k = 8
), crc(place, spot, c) AS (
  SELECT DISTINCT place, 0, 4294967295::BIGINT FROM turns
  UNION ALL SELECT place, spot + 1, xor(v, c >> 8) FROM crc JOIN crc_table ON i = xor(c, ascii(substr(place, spot + 1, 1))::BIGINT) & 255 WHERE spot < length(place)
), marks AS (
  SELECT place, xor(c, 4294967295::BIGINT) % 20 AS m FROM crc WHERE spot = length(place)
), damaged AS (
  SELECT ckey, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM turns JOIN marks USING (place) WHERE m <> 0
), trimmed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY ckey ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY ckey, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
), rowed AS MATERIALIZED (
  SELECT ckey, turn, role, text, initial, pos, shown = '' AS blank, shown <> '' AND again AS duplicate,
         shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS open, shown = '' OR again AS gone,
         lag(initial) OVER (PARTITION BY ckey ORDER BY pos) AS previous
  FROM trimmed
), counted AS (
  SELECT ckey, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE open) AS truncated,
         count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM rowed GROUP BY ckey
), walk(ckey, pos, v0, v1, v2, v3) AS (
  SELECT ckey, n + 1, {{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM counted
  UNION ALL
  SELECT ckey, pos, {_best('w0', _option('3', 'I', 'x2'))}, {_best('w1', _option('3', 'I', 'x2'))}, x2, x3
  FROM (SELECT *, {_best('w2', _INSERTED[2])} AS x2, {_best('w3', _INSERTED[3])} AS x3
        FROM (SELECT walk.ckey AS ckey, r.pos AS pos, {', '.join(_base_sql(s) for s in range(4))}
              FROM walk JOIN rowed r ON r.ckey = walk.ckey AND r.pos = walk.pos - 1))
), best AS (
  SELECT ckey, v0.c AS cost, v0.a AS audit FROM walk WHERE pos = 1
), edits AS (
  SELECT ckey, spot, substr(audit, spot, 1) AS edit FROM best, unnest(generate_series(1, length(audit))) AS t(spot)
), placed AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS place FROM edits WINDOW w AS (PARTITION BY ckey ORDER BY spot)
), filled AS (
  SELECT p.*, r.role, r.text, r.initial FROM placed p LEFT JOIN rowed r ON r.ckey = p.ckey AND r.pos = p.pos AND p.edit <> 'I' WHERE p.edit <> 'D'
), opened AS (
  SELECT *, max((place = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY ckey) AS system FROM filled
), mended AS (
  SELECT ckey, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                      chr(10) ORDER BY spot)) AS repaired_sha256
  FROM opened GROUP BY ckey
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ckey FROM turns) LEFT JOIN counted USING (ckey) LEFT JOIN best USING (ckey) LEFT JOIN mended USING (ckey)
"""
