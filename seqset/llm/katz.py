"""Katz backoff bigram scores of documents, with counts kept in bucketed tables.

Documents are cut once into chunks of about a million tokens, written with their own small
vocabularies. Everything after that moves per chunk and bucket, in compressed columns:

1. Each chunk sends its words and their training counts to buckets by word hash. A bucket adds them up
   and answers each chunk with totals and short word numbers, smaller for more frequent words.
2. Each chunk sends its word pairs to buckets by their first word. A bucket adds them up and answers
   with pair totals and, for each first word, what its backoff weight is made of: the number of
   followers seen once, twice … and the unigram mass of all followers. A first word that is too
   frequent for one bucket is dealt over several by its followers, and their parts are added in the chunk.
3. Each chunk scores its tokens.

Model: P(w|h) = d(c) * c / c(h) for a pair seen c > 0 times in training, else a(h) * P(w); if h was never
seen as a first word, P(w). P(w) = d(c) * c / N for a word seen c > 0 times, else what the discounts left, given to
one class of all unseen words. d is Katz's Good-Turing discount for counts up to LARGEST, 1 above. a(h)
makes P(.|h) add up to one exactly. A text is its words and one end; its first word follows a start mark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import lower_words, table
from seqset.session import saved

#: Counts up to this one are discounted.
LARGEST = 5
#: Tokens of a chunk, tokens for each bucket, and occurrences of a first word that one bucket takes.
CHUNK_TOKENS, BUCKET_TOKENS, HOT_TOKENS = 1_000_000, 2_000_000, 250_000
# no word holds white space, so these two stand for no word
START, END = b" ", b"\n"


def _packed(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed: planes of high bytes are nearly free."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes, kind: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Discounts:
    """Katz's Good-Turing discounts from n_1 … n_6, the numbers of types seen so often.

    Where the counts of counts are too few or too uneven for them (a discount not above 0, or above
    1), a constant is taken off every count up to LARGEST instead: n_1 / (n_1 + 2 n_2), from 0.1 to 0.9.
    """

    def __init__(self, n: list[int]):
        n = [0, *n]
        self.ratio = np.ones(LARGEST + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.arange(1, LARGEST + 1)
            seen = np.array(n[1:], dtype=float)
            tail = (LARGEST + 1) * seen[LARGEST] / seen[0] if seen[0] else np.nan
            found = ((r + 1) * seen[1:] / (r * seen[:-1]) - tail) / (1 - tail)
        if np.isfinite(found).all() and (found > 0).all() and (found <= 1).all():
            self.ratio[1:-1] = found
        else:
            off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.1
            self.ratio[1:-1] = 1 - off / r

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.ratio[np.minimum(counts, LARGEST + 1)]


class Unigrams:
    """The unigram model from N and n_1 … n_6."""

    def __init__(self, tokens: int, n: list[int]):
        self.discounts = Discounts(n)
        left = sum((1 - self.discounts.ratio[r]) * r * n[r - 1] for r in range(1, LARGEST + 1))
        # nothing discounted: one more count for the unseen class
        self.total = tokens + (left == 0)
        self.unseen = (left or 1) / self.total

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) * counts / self.total, self.unseen)


def chunks_of(docs: DataFrame, id_column: str, text_column: str, training: Column) -> DataFrame:
    """Documents in chunks: (chunk, row, id, train, n, vocabulary, tokens).

    A chunk lists segments. A segment is a text, or a part of one that is longer than a chunk; it is
    stored with the word before it, or the start mark, and `n` counts its tokens without that.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, row = TaskContext.get().partitionId(), 0, 0

        def empty():
            index: dict[bytes, int] = defaultdict()
            index.default_factory = index.__len__
            index[START], index[END]
            return index, [], {"row": [], "id": [], "train": [], "n": []}

        def batch_of(index, tokens, about):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + chunk]),
                    pa.array([about["row"]], pa.list_(pa.int64())),
                    pa.array([about["id"]], pa.list_(pa.string())),
                    pa.array([about["train"]], pa.list_(pa.bool_())),
                    pa.array([about["n"]], pa.list_(pa.int64())),
                    pa.array([hashes.tobytes()], pa.binary()),
                    pa.array([_packed(np.concatenate(tokens).astype("<u4"))], pa.binary()),
                ],
                ["chunk", "row", "id", "train", "n", "vocabulary", "tokens"],
            )

        index, tokens, about = empty()
        held = 0
        for batch in batches:
            for name, text, train in zip(batch["id"], batch["text"], batch["train"]):
                found = lower_words(text.as_py())
                found.append(END)
                before = START
                for at in range(0, len(found), CHUNK_TOKENS):
                    some = found[at : at + CHUNK_TOKENS]
                    numbers = map(index.__getitem__, [before, *some])
                    tokens.append(np.fromiter(numbers, np.uint32, len(some) + 1))
                    before = some[-1]
                    for key, value in zip(about, ((part << 32) + row, name.as_py(), train.as_py(), len(some))):
                        about[key].append(value)
                    held += len(some)
                    if held >= CHUNK_TOKENS:
                        yield batch_of(index, tokens, about)
                        chunk, held = chunk + 1, 0
                        index, tokens, about = empty()
                row += 1
        if tokens:
            yield batch_of(index, tokens, about)

    rows = docs.select(
        F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), training.alias("train")
    )
    return rows.mapInArrow(
        cut,
        "chunk bigint, row array<bigint>, id array<string>, train array<boolean>, n array<bigint>, "
        "vocabulary binary, tokens binary",
    )


def _segments(n, train) -> tuple[np.ndarray, np.ndarray]:
    """For each stored token: whether it is scored, and whether it counts for training."""
    n = np.asarray(n, np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    scored = np.ones(int((n + 1).sum()), bool)
    scored[first] = False
    return scored, np.repeat(np.asarray(train, bool), n + 1) & scored


def _word_requests(buckets: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes = np.frombuffer(row["vocabulary"], np.uint64)
                _, trained = _segments(row["n"], row["train"])
                counts = np.bincount(_unpacked(row["tokens"], "<u4")[trained], minlength=len(hashes))
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([int(bucket[some[0]])]),
                            "chunk": pa.array([row["chunk"]]),
                            "hashes": pa.array([hashes[some].tobytes()], pa.binary()),
                            "counts": pa.array([_packed(counts[some].astype("<u8"))], pa.binary()),
                        }
                    )

    return ask


def _of_counts(totals: np.ndarray) -> list[int]:
    """n_1 … n_6."""
    return [int((totals == r).sum()) for r in range(1, LARGEST + 2)]


def _added(which: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(which, weights=counts, minlength=size).astype(np.int64)


def _word_answers(buckets: int):
    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        parts = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        words, which = np.unique(np.concatenate(parts), return_inverse=True)
        totals = _added(which, np.concatenate([_unpacked(c) for c in group["counts"]]), len(words))
        number = np.empty(len(words), np.int64)
        number[np.argsort(-totals, kind="stable")] = np.arange(len(words)) * buckets + int(group["bucket"].iloc[0])
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        rows = [
            {"bucket": bucket, "chunk": chunk, "totals": _packed(totals[w].astype("<u8")), "numbers": _packed(number[w].astype("<u8")), "stats": None}
            for bucket, chunk, w in zip(group["bucket"], group["chunk"], np.split(which, cuts))
        ]
        rows[0]["stats"] = [int(totals.sum()), int((totals > 0).sum()), *_of_counts(totals)]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "totals", "numbers", "stats"])

    return add


class _Chunk:
    """A chunk with the answers to its words, and its pairs in the order in which it sends them."""

    def __init__(self, row, words: pd.DataFrame, buckets: int, texts: int):
        hashes = np.frombuffer(row["vocabulary"], np.uint64)
        size = len(hashes)
        self.totals, numbers = np.zeros(size, np.int64), np.zeros(size, np.int64)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for answer in words.sort_values("bucket").itertuples():
            first, last = np.searchsorted(bucket[order], [answer.bucket, answer.bucket + 1])
            self.totals[order[first:last]] = _unpacked(answer.totals)
            numbers[order[first:last]] = _unpacked(answer.numbers)
        tokens = _unpacked(row["tokens"], "<u4").astype(np.int64)
        self.n = np.asarray(row["n"], np.int64)
        scored, trained = _segments(row["n"], row["train"])
        at = np.flatnonzero(scored)
        self.first, self.second = tokens[at - 1], tokens[at]
        # how often each word was a first word in training: each of its tokens but the start mark has a follower
        self.heads_total = self.totals.copy()
        self.heads_total[0], self.heads_total[1] = texts, 0
        self.known = (self.heads_total[self.first] > 0) & (self.totals[self.second] > 0)
        pairs, which = np.unique(self.first[self.known] * size + self.second[self.known], return_inverse=True)
        self.pair_counts = _added(which, trained[at][self.known], len(pairs))
        head, tail = pairs // size, pairs % size

        spread = np.minimum(buckets, 1 + self.heads_total // HOT_TOKENS)
        pair_bucket = (numbers[head] + numbers[tail] % spread[head]) % buckets
        order = np.lexsort((numbers[tail], numbers[head], pair_bucket))
        self.place = np.empty(len(pairs), np.int64)  # of each pair in the order sent
        self.place[order] = np.arange(len(pairs))
        self.place = self.place[which]
        self.pair_bucket, self.pair_head = pair_bucket[order], numbers[head][order]
        self.pair_tail, self.pair_counts = numbers[tail][order], self.pair_counts[order]
        self.tail_totals = self.totals[tail][order]

        heads = np.unique(self.first)
        heads = heads[self.heads_total[heads] > 0]
        each = spread[heads]
        asked = np.repeat(heads, each)
        step = np.arange(len(asked)) - np.repeat(np.cumsum(each) - each, each)
        head_bucket = (numbers[asked] + step) % buckets
        order = np.lexsort((numbers[asked], head_bucket))
        self.head_bucket, self.head, self.head_number = head_bucket[order], asked[order], numbers[asked][order]

    def slices(self, bucket: int) -> tuple[slice, slice]:
        """Of the heads and of the pairs that go to a bucket."""
        return slice(*np.searchsorted(self.head_bucket, [bucket, bucket + 1])), slice(*np.searchsorted(self.pair_bucket, [bucket, bucket + 1]))


def _pair_requests(buckets: int, texts: int):
    def ask(chunk: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        found = _Chunk(chunk.iloc[0], words, buckets, texts)
        rows = []
        for bucket in np.unique(found.head_bucket).tolist():
            heads, pairs = found.slices(bucket)
            numbers = found.head_number[heads]
            runs = np.diff(np.searchsorted(found.pair_head[pairs], np.append(numbers, np.iinfo(np.int64).max)))
            sent = (np.diff(numbers, prepend=0), runs, found.pair_tail[pairs], found.pair_counts[pairs], found.tail_totals[pairs])
            rows.append((bucket, chunk["chunk"].iloc[0], *(_packed(x.astype("<u8")) for x in sent)))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "heads", "runs", "tails", "counts", "tail_totals"])

    return ask


def _pair_answers(unigrams: Unigrams):
    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        heads = [np.cumsum(_unpacked(x)) for x in group["heads"]]
        runs = [_unpacked(x).astype(np.int64) for x in group["runs"]]
        tails = [_unpacked(x) for x in group["tails"]]
        seen_heads, head = np.unique(np.concatenate(heads), return_inverse=True)
        seen_tails, tail = np.unique(np.concatenate(tails), return_inverse=True)
        code = np.repeat(head, np.concatenate(runs)) * max(1, len(seen_tails)) + tail
        pairs, example, which = np.unique(code, return_index=True, return_inverse=True)
        totals = _added(which, np.concatenate([_unpacked(x) for x in group["counts"]]), len(pairs))
        tail_totals = np.concatenate([_unpacked(x) for x in group["tail_totals"]])[example].astype(np.int64)
        of_head, size = pairs // max(1, len(seen_tails)), len(seen_heads)
        few = [np.bincount(of_head[totals == r], minlength=size).astype("<u8") for r in range(1, LARGEST + 1)]
        live = totals > 0
        mass = np.bincount(of_head[live], weights=unigrams.of(tail_totals[live]), minlength=size)
        head_cuts, pair_cuts = np.cumsum([len(x) for x in heads])[:-1], np.cumsum([len(x) for x in tails])[:-1]
        rows = [
            {
                "bucket": bucket,
                "chunk": chunk,
                "totals": _packed(totals[w].astype("<u8")),
                "few": _packed(np.concatenate([f[h] for f in few])),
                "mass": _packed(mass[h].astype("<f8")),
                "stats": None,
            }
            for bucket, chunk, w, h in zip(group["bucket"], group["chunk"], np.split(which, pair_cuts), np.split(head, head_cuts))
        ]
        rows[0]["stats"] = _of_counts(totals)
        return pd.DataFrame(rows, columns=["bucket", "chunk", "totals", "few", "mass", "stats"])

    return add


def _scores(buckets: int, texts: int, tokens: int, types: int, unigrams: Unigrams, discounts: Discounts):
    def score(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        found = _Chunk(row, answers[answers["level"] == 1], buckets, texts)
        size = len(found.totals)
        few, mass = np.zeros((LARGEST, size)), np.zeros(size)
        pair_totals = np.zeros(len(found.pair_counts), np.int64)
        for answer in answers[answers["level"] == 2].sort_values("bucket").itertuples():
            heads, pairs = found.slices(answer.bucket)
            pair_totals[pairs] = _unpacked(answer.totals)
            who = found.head[heads]  # each head once per bucket
            few[:, who] += _unpacked(answer.few).reshape(LARGEST, -1)
            mass[who] += _unpacked(answer.mass, "<f8")

        count = np.zeros(len(found.first), np.int64)
        count[found.known] = pair_totals[found.place]
        r = np.arange(1, LARGEST + 1)
        left = ((1 - discounts.ratio[1:-1]) * r) @ few
        seen = found.heads_total > 0
        # nothing discounted after a head: one more count for its unseen followers
        total = found.heads_total + (left == 0)
        left = np.where(left == 0, 1.0, left)
        weight = np.ones(size)
        weight[seen] = left[seen] / total[seen] / np.maximum(1 - mass[seen], unigrams.unseen)
        single = unigrams.of(found.totals[found.second])
        backed = weight[found.first] * single
        direct = discounts.of(count) * count / np.maximum(total[found.first], 1)
        logs = np.log10(np.where(count > 0, direct, backed))
        own = found.totals[found.second]
        base = np.log10((own + 1) / (tokens + types + 1))
        starts = np.cumsum(found.n) - found.n
        return pd.DataFrame(
            {
                "row": np.asarray(row["row"]),
                "id": np.asarray(row["id"], dtype=object),
                "train": np.asarray(row["train"]),
                "n_tokens": found.n,
                "n_known": np.add.reduceat((own > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(logs, starts),
            }
        )

    return score


def _sum_stats(rows: DataFrame, size: int) -> list[int]:
    sums = rows.where("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(size)]).first()
    return [int(x or 0) for x in sums]


def katz_scores(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    `training` marks the rows to learn from; a null mark counts as false. `score` is the model's log10
    probability of the text, `base_score` that of add-one smoothed words. A null or empty text is its end alone.
    Null and repeated ids are kept: rows are told apart by their place. A text longer than a chunk is scored
    in parts that know the word before them. Without training rows every token has probability one. Only the named
    columns are read. Word hashes have 64 bits and stand for the words. No rows give no rows.
    """
    trained = F.coalesce(training, F.lit(False))
    chunks = saved(chunks_of(docs, id_column, text_column, trained))
    kind = docs.schema[id_column].dataType
    size = chunks.agg(F.sum(F.expr("aggregate(n, 0L, (s, x) -> s + x)"))).first()[0] or 0
    buckets = 1 + size // BUCKET_TOKENS
    ends = chunks.select(F.explode(F.arrays_zip("row", "train")).alias("s")).where("s.train").agg(F.countDistinct("s.row"))
    texts = ends.first()[0]

    asked = chunks.mapInArrow(_word_requests(buckets), "bucket bigint, chunk bigint, hashes binary, counts binary")
    words = saved(
        asked.groupBy("bucket").applyInPandas(
            _word_answers(buckets), "bucket bigint, chunk bigint, totals binary, numbers binary, stats array<bigint>"
        )
    )
    tokens, types, *of_counts = _sum_stats(words, 3 + LARGEST)
    unigrams = Unigrams(tokens, of_counts)

    pairs = (
        chunks.groupBy("chunk")
        .cogroup(words.drop("stats").groupBy("chunk"))
        .applyInPandas(
            _pair_requests(buckets, texts),
            "bucket bigint, chunk bigint, heads binary, runs binary, tails binary, counts binary, tail_totals binary",
        )
    )
    answers = saved(
        pairs.groupBy("bucket").applyInPandas(
            _pair_answers(unigrams), "bucket bigint, chunk bigint, totals binary, few binary, mass binary, stats array<bigint>"
        )
    )
    discounts = Discounts(_sum_stats(answers, 1 + LARGEST))

    none = F.lit(None).cast("binary")
    both = words.select("chunk", F.lit(1).alias("level"), "bucket", "totals", "numbers", none.alias("few"), none.alias("mass")).union(
        answers.select("chunk", F.lit(2).alias("level"), "bucket", "totals", none.alias("numbers"), "few", "mass")
    )
    parts = (
        chunks.groupBy("chunk")
        .cogroup(both.groupBy("chunk"))
        .applyInPandas(
            _scores(buckets, texts, tokens, types, unigrams, discounts),
            "row bigint, id string, train boolean, n_tokens bigint, n_known bigint, base_score double, score double",
        )
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return (
        parts.groupBy("row", "id", "train")
        .agg(*sums)
        .select(F.col("id").cast(kind).alias("id"), "train", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    )


def op9_katz_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by what those with crc32(doc_id) mod 7 other than 2 teach."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    found = katz_scores(table(spark, folder, "documents"), ~held_out)
    return found.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
