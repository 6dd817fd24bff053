"""Best-fit decreasing packing of tokenized documents into windows.

Documents are tokenized and cut into full windows and one remainder where they lie. The packing
itself needs only how many remainders there are of each length, which is at most one number per
length; so the driver plans with these counts, and its work does not grow with the documents. A
segment tree over remaining capacities finds the tightest open windows. The plan says, for a
range of ranks within a length, which windows take them; each remainder finds its rank from its
partition and its place there, so that no task sees all remainders of one length.
"""

from __future__ import annotations

import os
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqset.llm.frames import per_batch, table
from seqset.session import saved

WINDOW = 4096
END_ID = 2
#: Bytes of text whose words are looked up together: their places and ids take some ten times as much of a worker's memory.
SLICE_BYTES = 2 << 20
#: Odd words and word parts whose ids a worker remembers, about; half of each are the older ones.
CACHED_WORDS, CACHED_PARTS = 250_000, 500_000

# The word pattern of the tokenizer file word_bpe_49k.json
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# marks that are a part of their own behind a word
MARKS = tuple(",.;:!?)")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")


class _Cache(dict):
    """A dict that computes what it lacks. Full, it becomes the older half, and what is used again comes back from there."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Ids of texts by a tokenizer file, computed once for each distinct word of a batch; ids of word parts are remembered.

    The tokenizer drops white space and never joins words, so the ids of a text are the ids of its
    words in a row. Parts of plain letters go to its model directly; any other word goes through the whole
    tokenizer. Ids are bytes, four for each, little-endian.
    """

    def __init__(self, path: str, cached: tuple[int, int] = (CACHED_WORDS, CACHED_PARTS)):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pattern = regex.compile(PARTS)
        self.plain = regex.compile(r"[\x21-\x7eÀ-ſ]*")
        # byte-level models write each byte as a printable character: itself, or the next one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.written = [k.to_bytes(4, "little") for k in range(self.whole.get_vocab_size())]
        self.parts = _Cache(self._part, cached[1] // 2)
        self.odd = _Cache(self._odd, cached[0] // 2)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.written[t.id] for t in self.model.tokenize(shown)])

    def _odd(self, word: str) -> bytes:
        if "<|" in word or not self.plain.fullmatch(word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = self.pattern.findall(unicodedata.normalize("NFC", word).lower())
        return b"".join([self.parts[p] for p in parts])

    def word(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha():  # letters of the plain range are one part, and composed already
            return self.parts[low] if low.isascii() or self.plain.fullmatch(low) else self.odd[word]
        if low[-1:] in MARKS and (stem := low[:-1]).isalpha() and (stem.isascii() or self.plain.fullmatch(stem)):
            return self.parts[stem] + self.parts[low[-1]]
        return self.odd[word]

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.of_texts(pa.array([text], pa.string())))

    def of_texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; distinct words are looked up once, ids are gathered by their places."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
        blobs = list(map(self.word, found.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        every = np.frombuffer(b"".join(blobs), "<u4")
        at = np.asarray(found.indices).astype(np.int64)
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        first = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        ids = every[np.repeat(first, counts) + np.arange(ends[-1])].tobytes()
        of_text = 4 * ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [ids[s:e] for s, e in zip(of_text, of_text[1:])]

    def in_slices(self, texts: pa.Array):
        """The ids of each text in turn, with about SLICE_BYTES of text in hand; longer texts are cut between words."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        start = 0
        while start < len(texts):
            if sizes[start] > SLICE_BYTES:
                yield b"".join(b"".join(self.of_texts(pa.array([part]))) for part in _between_words(texts[start].as_py()))
                start += 1
                continue
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES, side="right")))
            yield from self.of_texts(texts[start:end])
            start = end


def _between_words(text: str):
    """A long text in pieces that end where a word does."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + SLICE_BYTES // 4)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, cached: tuple[int, int] = (CACHED_WORDS, CACHED_PARTS)) -> WordTokenizer:
    """The tokenizer of a file, loaded once per worker."""
    if (path, cached) not in _TOKENIZERS:
        _TOKENIZERS[path, cached] = WordTokenizer(path, cached)
    return _TOKENIZERS[path, cached]


def token_pieces(
    docs: DataFrame,
    path: str,
    id_column: str,
    text_column: str,
    window: int = WINDOW,
    cached: tuple[int, int] = (CACHED_WORDS, CACHED_PARTS),
) -> DataFrame:
    """The pieces of every document: (id, start, length, doc_tokens, ids, part, place).

    A document is its ids and one end id. Full windows are cut off it; the rest is one more piece.
    `part` and `place` number the pieces of one length within their partition.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        tokens, part, places = tokenizer(path, cached), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, whole = batch["id"], tokens.in_slices(batch["text"])
            out = {k: [] for k in ("row", "start", "length", "doc_tokens", "ids", "place")}
            held = 0
            for row in range(batch.num_rows):
                blob = next(whole) + end
                n = len(blob) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    place = places.get(length, 0)
                    places[length] = place + 1
                    for key, value in zip(out, (row, start, length, n, blob[4 * start : 4 * (start + length)], place)):
                        out[key].append(value)
                held += len(blob)
                if held > 1 << 24 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(out["row"], pa.int64())),
                            *(pa.array(out[k], pa.int64()) for k in ("start", "length", "doc_tokens")),
                            pa.array(out["ids"], pa.binary()),
                            pa.array([part] * len(out["row"]), pa.int64()),
                            pa.array(out["place"], pa.int64()),
                        ],
                        ["id", "start", "length", "doc_tokens", "ids", "part", "place"],
                    )
                    out, held = {k: [] for k in out}, 0

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(
        cut, f"id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, part bigint, place bigint"
    )


class _OpenWindows:
    """A segment tree over remaining capacities; a leaf tells whether windows with that capacity are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.windows: dict[int, list[tuple[int, int]]] = {}  # by capacity: runs (first window, count)

    def add(self, capacity: int, first: int, count: int) -> None:
        self.windows.setdefault(capacity, []).append((first, count))
        at = capacity + self.size
        while at and not self.tree[at]:
            self.tree[at] = True
            at //= 2

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.windows[capacity].pop()
        if not self.windows[capacity]:
            at = capacity + self.size
            self.tree[at] = False
            while at > 1 and not self.tree[at ^ 1]:
                at //= 2
                self.tree[at] = False
        return run

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least `need`."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Plan:
    """Runs of a plan: ranks from `rank` on of a length go to windows from `first` on, `each` to a window, from `offset` on."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of pieces."""
        # runs are sorted by length and rank: a piece is in the last run that begins at or before it
        run = np.searchsorted((self.length << 44) + self.rank, (length << 44) + rank, side="right") - 1
        inside = rank - self.rank[run]
        return self.first[run] + inside // self.each[run], self.offset[run] + inside % self.each[run] * length


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """The plan for so many pieces of each length; pieces are taken by falling length, each into the tightest open window.

    Pieces of one length are alike, and windows of one remaining capacity are too, so they are moved by
    the run. The work is bounded by the square of the window, whatever the counts.
    """
    open_windows, used, runs = _OpenWindows(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_windows.tightest(length)
            # a window that still fits the length after a piece is tighter than before, so it takes the next one too
            if capacity is None:
                each = window // length
                first, count, capacity = used, -(-left // each), window
                used += count
            else:
                each = capacity // length
                first, count = open_windows.take(capacity)
            full = min(count, left // each)
            if full:
                runs.append((length, rank, first, each, window - capacity))
                rank, left = rank + full * each, left - full * each
                if capacity > each * length:
                    open_windows.add(capacity - each * length, first, full)
            if left and full < count:  # fewer pieces than one window takes
                runs.append((length, rank, first + full, each, window - capacity))
                if capacity > left * length:
                    open_windows.add(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < count:
                open_windows.add(capacity, first + full, count - full)
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns)


def pack(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    payload: dict | None = None,
    cached: tuple[int, int] = (CACHED_WORDS, CACHED_PARTS),
) -> DataFrame:
    """Every piece of every document and its place: (id, start, length, doc_tokens, …, sequence_id, offset).

    `payload` names columns made from `ids`, the piece's token ids as little-endian 32-bit bytes; by
    default `ids` itself is kept. `cached` bounds the words and word parts that a worker remembers. A null or empty text is its end id alone. A null id is kept as it is.
    Repeated rows are packed as often as they come. A document longer than a window, however long, is
    cut into full windows and a rest. Pieces of equal length rank by partition and place there, and a
    piece written once keeps its rank. Only the two named columns are read. No rows give no rows.
    """
    made = token_pieces(docs, path, id_column, text_column, window, cached)
    extra = payload or {"ids": F.col("ids")}
    pieces = saved(made.select("id", "start", "length", "doc_tokens", "part", "place", *[c.alias(n) for n, c in extra.items()]))
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.withColumn("base", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(best_fit_decreasing(counts, window))

    def placed(batch: pa.RecordBatch):
        if batch.num_rows:
            found = shared.value.place(np.asarray(batch["length"]), np.asarray(batch["place"]) + np.asarray(batch["base"]))
            kept = [c for c in batch.schema.names if c not in ("part", "place", "base")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *map(pa.array, found)], [*kept, "sequence_id", "offset"])

    joined = pieces.join(bases.select("part", "length", "base"), ["part", "length"])
    kept = [f for f in joined.schema if f.name not in ("part", "place", "base")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    return joined.select(*[f.name for f in kept], "place", "base").mapInArrow(per_batch(placed), schema)


def op5_pack_bfd(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place; its ids as their CRC-32."""
    import public_tokenizers

    pieces = pack(
        table(spark, folder, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        payload={"ids_crc32": F.crc32("ids")},
    )
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
