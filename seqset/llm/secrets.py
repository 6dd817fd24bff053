"""Secrets in texts: fixed patterns, and random-looking strings by character Markov models.

Two first-order models, one of random strings and one of ordinary identifiers, give each long run of
identifier characters a log-likelihood ratio per character. They are trained from labelled samples: what the fixed patterns
find, with generated strings over usual alphabets, against the other words of a bounded sample of documents, with generated
identifiers as programmers write them. The cut is set on strings and identifiers generated apart, which no model has seen.
"""

from __future__ import annotations

import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import per_batch, table

# The patterns of the three base kinds, and how many characters they need
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: A run of these characters, so long at least, is judged by the models.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHORT_RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Random on purpose and no secrets: ids of the usual 8-4-4-4-12 form, and runs of digits with separators.
PUBLIC = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9TZ/_=+-]+")
#: Documents that the models learn from, about; generated strings of each label; seed of both.
SAMPLE_DOCS, GENERATED, SEED = 20_000, 4000, 42
#: Of generated identifiers held out, the part that the cut may call secrets.
FALSE_ALARMS = 0.002
#: Runs that are counted at once, about.
RUNS = 100_000
REDACTED = "[SECRET]"

_CODE = {c: k for k, c in enumerate(ALPHABET)}
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the three base kinds, in code points, by start and then kind."""
    spans: list[Span] = []
    lowered = text.lower()
    if any(key in lowered for key in _KEYS):  # the pattern's key words; without one it cannot match
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    for run in RUN.finditer(text):  # both kinds lie in runs of 16 and more characters
        first, last = run.span()
        if "AKIA" in run[0]:
            spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, first, last) if m.end() - m.start() >= ACCESS_LEAST]
        if last - first >= HEX_LEAST:
            spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text, first, last) if m.end() - m.start() >= HEX_LEAST]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _transitions(run: str) -> tuple[list[int], list[int]]:
    codes = [_CODE[c] for c in run]
    return [len(ALPHABET), *codes[:-1]], codes


def _counts() -> np.ndarray:
    return np.zeros((len(ALPHABET) + 1, len(ALPHABET)), np.int64)


@dataclass
class Ratio:
    """The log ratio of both models for each character after another, or at the start, and the mean from which on a run is a secret."""

    table: list[list[float]]
    cut: float = 0.0

    @classmethod
    def of(cls, secret: np.ndarray, ordinary: np.ndarray) -> Ratio:
        """From transition counts; each row is smoothed by half a count per character. The cut is set on generated strings held out."""
        logs = [np.log((c + 0.5) / (c + 0.5).sum(1, keepdims=True)) for c in (secret, ordinary)]
        found = cls((logs[0] - logs[1]).tolist())
        _, identifiers = generated(SEED + 1)
        alarms = sorted((found.score(x) for x in identifiers), reverse=True)
        found.cut = max(0.0, alarms[int(FALSE_ALARMS * len(alarms))])
        return found

    def score(self, run: str) -> float:
        """Nats per character for a random string and against an ordinary identifier."""
        return math.fsum(self.table[a][b] for a, b in zip(*_transitions(run))) / len(run)

    def is_secret(self, run: str) -> bool:
        return not PUBLIC.fullmatch(run) and self.score(run) > self.cut


#: Words that generated identifiers are made of, besides made-up ones.
NAMES = (
    "get set is has to from with by id key value name type list map index count size max min total http https request response handler factory "
    "builder manager service client server config option connection pool timeout user account order item price date time start end path file "
    "local lib site packages python java test data base table column row array string number byte buffer stream reader writer parse format"
).split()


def _identifier(source: random.Random) -> str:
    """A name as programs and paths have it, of 16 characters or more."""
    made = lambda: "".join(source.choice("bcdfghklmnprstvw") + source.choice("aeiou") for _ in range(source.randint(2, 4)))
    words: list[str] = []
    while sum(map(len, words)) < 16 or len(words) < 2:
        words.append(source.choice(NAMES) if source.random() < 0.7 else made())
    if source.random() < 0.2:
        words.append(str(source.randint(0, 9999)))
    style = source.randrange(7)
    if style < 2:
        upper = [w.upper() if source.random() < 0.1 and len(w) < 5 else w.capitalize() for w in words]
        return "".join(upper) if style else words[0] + "".join(upper[1:])
    joined = ("_", "-", "/", "_", "")[style - 2].join(words)
    return joined.upper() if style == 5 else joined


def generated(seed: int) -> tuple[list[str], list[str]]:
    """Random strings over the alphabets that keys are usually written in, and identifiers."""
    source = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, ALPHABET)
    strings = ["".join(source.choices(alphabets[k % len(alphabets)], k=source.randint(20, 48))) for k in range(GENERATED)]
    return strings, [_identifier(source) for _ in range(GENERATED)]


_BYTES = np.full(256, -1, np.int64)
_BYTES[list(ALPHABET.encode())] = np.arange(len(ALPHABET))


def _counted(runs: list[str]) -> np.ndarray:
    """Transitions of many runs at once."""
    codes = _BYTES[np.frombuffer((" " + " ".join(runs)).encode(), np.uint8)]
    here = np.flatnonzero(codes >= 0)
    before = np.where(codes[here - 1] < 0, len(ALPHABET), codes[here - 1])
    cells = (len(ALPHABET) + 1) * len(ALPHABET)
    return np.bincount(before * len(ALPHABET) + codes[here], minlength=cells).reshape(-1, len(ALPHABET))


def sample_runs(text: str, secret: list[str], ordinary: list[str]) -> None:
    """Adds a text's labelled samples: runs inside base spans are secret, other runs of letters and digits are ordinary."""
    spans = base_spans(text)
    if not spans:
        ordinary += SHORT_RUN.findall(text)
        return
    for run in SHORT_RUN.finditer(text):
        if not any(a < run.end() and run.start() < b for _, a, b in spans):
            ordinary.append(run[0])
        elif len(run[0]) >= 16:
            secret.append(run[0])


def train(docs: DataFrame, text_column: str = "text") -> Ratio:
    """The models from about SAMPLE_DOCS documents, chosen by a hash of their text; counts are added per task."""
    n = docs.count()
    share = int((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, n))) + 1
    some = docs.where(F.pmod(F.xxhash64(text_column, F.lit(SEED)), F.lit(1 << 30)) < share)

    def count(batches):
        secret, ordinary = _counts(), _counts()
        for batch in batches:
            found: tuple[list[str], list[str]] = ([], [])
            for row, text in enumerate(batch["text"], 1):
                sample_runs(text.as_py() or "", *found)
                if len(found[1]) > RUNS or row == batch.num_rows:
                    secret += _counted(found[0])
                    ordinary += _counted(found[1])
                    found = ([], [])
        yield pa.RecordBatch.from_pydict({"secret": [secret.ravel().tolist()], "ordinary": [ordinary.ravel().tolist()]})

    rows = some.select(F.col(text_column).alias("text")).mapInArrow(count, "secret array<bigint>, ordinary array<bigint>")
    cells = rows.select(F.posexplode(F.arrays_zip("secret", "ordinary"))).groupBy("pos").agg(
        F.sum("col.secret").alias("secret"), F.sum("col.ordinary").alias("ordinary")
    )
    secret, ordinary = map(_counted, generated(SEED))
    for cell in cells.collect():  # one row per pair of characters
        secret.flat[cell["pos"]] += cell["secret"]
        ordinary.flat[cell["pos"]] += cell["ordinary"]
    return Ratio.of(secret, ordinary)


def all_spans(text: str, ratio: Ratio) -> list[Span]:
    """Base spans, and runs that look random and overlap none of them; by start and then kind."""
    spans = base_spans(text)
    added, k = [], 0
    last = 0
    for run in RUN.finditer(text):
        first, end = run.span()
        while k < len(spans) and spans[k][1] < end:
            last = max(last, spans[k][2])
            k += 1
        if last <= first and ratio.is_secret(run[0]):
            added.append(("markov", first, end))
    return sorted(spans + added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every stretch that spans cover written as REDACTED."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, ratio: Ratio, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of every row, spans as an array of (kind, start, end) in code points.

    A null text counts as empty and has no spans. Whole texts are scanned, however long. Ids may be null or
    repeated: each row gives one row. Only the two named columns are read. No rows give no rows.
    """
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batch: pa.RecordBatch):
        found = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t.as_py() or "", ratio)] for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, shape)], ["id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(per_batch(of), f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact_secrets(docs: DataFrame, ratio: Ratio, text_column: str = "text") -> DataFrame:
    """`docs` with every secret in the text column replaced; texts without one, and null, stay as they are."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if not t else redact(t, all_spans(t, ratio)))

    return docs.withColumn(text_column, clean(F.col(text_column)))


def op8_secret_markov(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, a digest of the base spans and all spans of every document."""
    docs = table(spark, folder, "documents")
    found = find_secrets(docs, train(docs))
    written = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(written, lambda s: ~s.startswith("markov:"))
    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[number(kind) for kind in KINDS[:3]],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(written, ",").alias("spans"),
    )
