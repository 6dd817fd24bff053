"""Toxicity of texts: a convolutional classifier over hashed word embeddings.

A word is lower-cased, freed of punctuation and hashed; hashes that occur in few training texts share a
fixed zero vector. Filters of several widths run over the vectors of a text, the strongest answer of each
filter over the whole text is kept, and a linear layer makes the logit. All labelled rows are learnt from: Spark
counts their words, shards of them are fitted in tasks from the same start, and the shards' parameters are
averaged. The cut between toxic and clean is set per language, which is guessed from function
words of the text itself, from all calibration rows, and moved to CUT in the score.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import per_batch, table
from seqset.operators.skew import apart
from seqset.session import saved

#: Rows and words, about, that one task fits; more are dealt over more shards.
SHARD_ROWS, SHARD_WORDS = 8000, 1 << 23
DIMENSIONS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: A hash must occur in so many training texts to have a vector of its own.
LEAST_TEXTS = 3
#: ... and in one of so many, which bounds the vectors however many texts there are.
LEAST_SHARE = 3000
#: Bins of a logit of one that calibration rows are counted in, and the largest logit there.
BINS, LARGEST = 1024, 60
#: Parameters that travel in one row.
PARAMETERS = 1 << 16
#: z-scores that chance alone gives to some hashes.
NOISE = 3.0
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 0.01, 1e-4, 42
#: The score that separates toxic from clean in every language.
CUT = 0.7
#: Calibration rows of each class that a language needs for a cut of its own.
LEAST_ROWS = 15
PAD, PIECE = 3, 1 << 17

# Frequent function words that few other languages share
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with",
    "fr": "le les et une dans que pour est pas qui",
    "de": "der die und das ist nicht ein mit von zu",
    "es": "el los que una del por con las para es",
}
_PUNCTUATION = bytes.maketrans(b".,;:!?\"'()[]{}<>|*#$%&_-/\\=+~`^@", b" " * 32)


def hashed_words(text: str | None) -> list[int]:
    if not text:
        return []
    return [zlib.crc32(w) for w in text.encode().lower().translate(_PUNCTUATION).split()]


_LANGUAGES = list(FUNCTION_WORDS)
_FUNCTION_HASHES = {zlib.crc32(w.encode()): k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}


@dataclass
class Model:
    """Rows of known hashes, their vectors, the filters, the linear layer, and the cut of each language."""

    rows: dict[int, int]
    vectors: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width, DIMENSIONS, FILTERS)
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    cuts: np.ndarray | None = None  # of each language, and of texts without a language
    languages: np.ndarray | None = None  # by row: the language whose function word it is, or -1

    def encode(self, text: str | None) -> np.ndarray:
        get = self.rows.get
        return np.array([get(h, 0) for h in hashed_words(text)], dtype=np.int32)

    def guess(self, encoded: np.ndarray) -> int:
        """The language with most function words; the number of languages if there are none."""
        found = self.languages[encoded]
        counts = np.bincount(found[found >= 0], minlength=len(_LANGUAGES))
        return int(counts.argmax()) if counts.any() else len(_LANGUAGES)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The strongest answer of each filter in each text; memory does not depend on how long texts are."""
        table = np.hstack([self.vectors @ self.filters[w][k] for w in WIDTHS for k in range(w)]).astype(np.float32)
        out = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        lengths = np.array([len(t) + PAD for t in texts])
        flat = np.concatenate([x for t in texts for x in (t, np.zeros(PAD, np.int32))])
        who = np.repeat(np.arange(len(texts)), lengths)
        # windows may begin at any word and at the first of the zeros behind a text
        ends = np.cumsum(lengths)
        begins = np.ones(len(flat), bool)
        for k in range(1, PAD):
            begins[ends - k] = False
        flat = np.append(flat, np.zeros(PAD, np.int32))
        for at in range(0, len(who), PIECE):
            n = min(PIECE, len(who) - at)
            answers = table[flat[at : at + n + PAD]]
            parts, column = [], 0
            for w in WIDTHS:
                total = 0
                for k in range(w):
                    total = total + answers[k : k + n, column : column + FILTERS]
                    column += FILTERS
                parts.append(total)
            some = np.where(begins[at : at + n, None], np.hstack(parts), -np.inf)
            owners, starts = np.unique(who[at : at + n], return_index=True)
            out[owners] = np.maximum(out[owners], np.maximum.reduceat(some, starts))
        return np.maximum(out + np.concatenate([self.biases[w] for w in WIDTHS]), 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return (self.pooled(texts) @ self.weights + self.bias).astype(float) if texts else np.empty(0)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        cuts = self.cuts[[self.guess(t) for t in texts]] if texts else np.empty(0)
        moved = self.logits(texts) - cuts + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(moved, -50, 50)))


def _vocabulary(texts: list[np.ndarray], labels: np.ndarray) -> tuple[dict[int, int], np.ndarray]:
    """A row for each hash of several texts, and how clearly each row's hash tells toxic texts from clean ones.

    That is the z-score of the difference between both shares of texts with the hash, less NOISE.
    """
    fixed = np.array(sorted(_FUNCTION_HASHES), dtype=np.uint32)
    once = [np.unique(t) for t in texts]
    hashes, which = np.unique(np.concatenate([fixed, *once]), return_inverse=True)
    which, marks = which[len(fixed) :], np.repeat(labels, [len(t) for t in once])
    toxic = np.bincount(which[marks == 1], minlength=len(hashes))
    clean = np.bincount(which[marks == 0], minlength=len(hashes))
    kept = (toxic + clean >= _least(len(texts))) | np.isin(hashes, fixed)
    rows = {h: k + 1 for k, h in enumerate(hashes[kept].tolist())}
    return rows, _clear(toxic[kept], clean[kept], labels.sum(), (1 - labels).sum())


def _least(n_texts: int) -> int:
    """Texts that a hash must occur in to have a vector of its own."""
    return max(LEAST_TEXTS, -(-n_texts // LEAST_SHARE))


def _clear(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How clearly hashes with so many toxic and clean texts tell them apart; row 0 stands for all others."""
    toxic, clean = np.append(0.0, toxic), np.append(0.0, clean)
    n_toxic, n_clean = max(1, n_toxic), max(1, n_clean)
    share = (toxic + clean) / (n_toxic + n_clean)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_clean))
    z = (toxic / n_toxic - clean / n_clean) / spread
    z[0] = 0
    return np.sign(z) * np.maximum(0, np.abs(z) - NOISE)


def _fit(model: Model, texts: list[np.ndarray], labels: np.ndarray, toxic: float | None = None) -> None:
    """Adam on the log loss, classes weighted alike; `toxic` is their share if the texts are one shard of many."""
    random = np.random.default_rng(SEED)
    padded = [np.concatenate([t, np.zeros(PAD, np.int32)]) for t in texts]
    if toxic is None:
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    else:
        weight = np.where(labels == 1, 0.5 / max(toxic, 1e-9), 0.5 / max(1 - toxic, 1e-9))
    slots = {"vectors": model.vectors, "weights": model.weights, "bias": np.zeros(1)}
    slots |= {f"filter{w}": model.filters[w] for w in WIDTHS} | {f"bias{w}": model.biases[w] for w in WIDTHS}
    first, second = ({k: np.zeros_like(v) for k, v in slots.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(random.permutation(len(texts)), max(1, len(texts) // BATCH)):
            grads = {k: np.zeros_like(v) for k, v in slots.items()}
            places = {w: np.empty((len(batch), FILTERS), np.int64) for w in WIDTHS}
            best = {w: np.empty((len(batch), FILTERS)) for w in WIDTHS}
            for row, number in enumerate(batch):
                vectors = model.vectors[padded[number]]
                n = len(texts[number]) + 1
                for w in WIDTHS:
                    answer = sum(vectors[k : k + n] @ model.filters[w][k] for k in range(w))
                    places[w][row] = answer.argmax(0)
                    best[w][row] = answer.max(0) + model.biases[w]
            hidden = np.maximum(np.hstack([best[w] for w in WIDTHS]), 0)
            logit = hidden @ model.weights + slots["bias"][0]
            wrong = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[batch]) * weight[batch] / len(batch)
            grads["weights"] = hidden.T @ wrong
            grads["bias"][0] = wrong.sum()
            back = np.outer(wrong, model.weights) * (hidden > 0)
            for number, w in enumerate(WIDTHS):
                g = back[:, number * FILTERS : (number + 1) * FILTERS]
                grads[f"bias{w}"] = g.sum(0)
                for k in range(w):
                    words = np.stack([padded[i][p + k] for i, p in zip(batch, places[w])])
                    grads[f"filter{w}"][k] = np.einsum("nfd,nf->df", model.vectors[words], g)
                    np.add.at(grads["vectors"], words.ravel(), (g[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIMENSIONS))
            step += 1
            for key, value in slots.items():
                grad = grads[key] + DECAY * value * (key != "bias")
                first[key] += 0.1 * (grad - first[key])
                second[key] += 0.001 * (grad * grad - second[key])
                value -= RATE * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
            model.vectors[0] = 0  # words without a vector of their own
            model.bias = float(slots["bias"][0])


def _best_cut(values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut with most right answers of both classes, weighted alike; the middle of the gap where it lies.

    `toxic` and `clean` say how many rows of each class have each value.
    """
    order = np.argsort(values, kind="stable")
    values, toxic, clean = values[order], toxic[order], clean[order]
    low = np.append(0, np.cumsum(toxic)) / max(1, toxic.sum())  # toxic rows below each cut
    high = 1 - np.append(0, np.cumsum(clean)) / max(1, clean.sum())  # clean rows above it
    edges = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    loss = low + high
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def _start(rows: dict[int, int], clear: np.ndarray) -> Model:
    """A model before training."""
    random = np.random.default_rng(SEED)
    size = 1 + max(rows.values(), default=0)
    # the first dimension starts with what single words tell, and filters start by looking for it
    vectors = random.normal(0, 0.01, (size, DIMENSIONS))
    vectors[:, 0] += np.clip(clear / 4, -2, 2)
    filters = {w: random.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][0, 0] += 0.5
    model = Model(
        rows,
        vectors,
        filters,
        {w: np.zeros(FILTERS) for w in WIDTHS},
        np.abs(random.normal(0.1, 0.05, FILTERS * len(WIDTHS))),
        0.0,
    )
    model.vectors[0] = 0
    model.languages = np.full(size, -1)
    for h, language in _FUNCTION_HASHES.items():
        model.languages[rows[h]] = language
    model.cuts = np.full(len(_LANGUAGES) + 1, np.inf)
    return model


def _encoder(model: Model):
    """A function from a text's hashes to the rows of their vectors."""
    known = np.array([*model.rows], dtype=np.uint32)

    def encoded(hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at + 1, 0).astype(np.int32)

    return encoded


def _set_cuts(model: Model, language: np.ndarray, values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
    """The cut of each language with enough rows of both classes; that of all rows for the others."""
    model.cuts[:] = _best_cut(values, toxic, clean)
    for k in range(len(model.cuts)):
        own = language == k
        if min(toxic[own].sum(), clean[own].sum()) >= LEAST_ROWS:
            model.cuts[k] = _best_cut(values[own], toxic[own], clean[own])


def train(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of hashed texts and their labels (1: toxic), in this process. Every fifth row calibrates the cuts.

    Without any row, or with one class only, every text scores 0.
    """
    held = np.arange(len(texts)) % 5 == 4
    fitted = ~held if len(set(labels[~held].tolist())) == 2 else np.ones(len(texts), bool)
    model = _start(*_vocabulary([t for t, f in zip(texts, fitted) if f], labels[fitted]))
    if len(set(labels.tolist())) < 2:
        return model
    encoded = [*map(_encoder(model), texts)]
    _fit(model, [t for t, f in zip(encoded, fitted) if f], labels[fitted].astype(float))
    held = held if len(set(labels[held].tolist())) == 2 else np.ones(len(texts), bool)
    some, marks = [t for t, h in zip(encoded, held) if h], labels[held]
    _set_cuts(model, np.array([model.guess(t) for t in some]), model.logits(some), marks, 1 - marks)
    return model


def _counted(fitted: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[int, int], np.ndarray]:
    """`_vocabulary` of rows (label, words), counted by Spark."""

    def count(batch: pa.RecordBatch):
        once = [np.unique(np.frombuffer(w.as_py(), "<u4")) for w in batch["words"]]
        marks = np.repeat(batch["label"].to_numpy(), [len(t) for t in once])
        hashes, which = np.unique(np.concatenate([np.empty(0, np.uint32), *once]), return_inverse=True)
        toxic = np.bincount(which[marks == 1], minlength=len(hashes))
        clean = np.bincount(which[marks == 0], minlength=len(hashes))
        columns = (hashes.astype(np.int64), toxic.astype(np.int64), clean.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "toxic", "clean"])

    fixed = sorted(_FUNCTION_HASHES)
    counts = fitted.select("label", "words").mapInArrow(per_batch(count), "hash long, toxic long, clean long")
    summed = counts.groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = summed.where((F.col("toxic") + F.col("clean") >= _least(n_toxic + n_clean)) | F.col("hash").isin(*fixed))
    found = {h: (0, 0) for h in fixed} | {r["hash"]: (r["toxic"], r["clean"]) for r in kept.collect()}  # bounded by LEAST_SHARE
    hashes = sorted(found)
    toxic, clean = (np.array([found[h][k] for h in hashes], float) for k in (0, 1))
    return {h: k + 1 for k, h in enumerate(hashes)}, _clear(toxic, clean, n_toxic, n_clean)


def _parameters(model: Model) -> list[np.ndarray]:
    return [model.vectors, model.weights, *[model.filters[w] for w in WIDTHS], *[model.biases[w] for w in WIDTHS]]


def _fit_shards(model: Model, fitted: DataFrame, n_rows: int, n_words: int, toxic: float) -> None:
    """Fits shards of all rows (id, label, words) from the same start, and gives the model their mean parameters.

    A shard counts by its rows. Each is fitted by one task; the driver sees the mean alone, in rows of PARAMETERS numbers.
    """
    shards = max(1, -(-n_rows // SHARD_ROWS), -(-n_words // SHARD_WORDS))
    shared = fitted.sparkSession.sparkContext.broadcast(model)

    def fit(key, rows):
        own = pickle.loads(pickle.dumps(shared.value))  # a task's worker fits several shards
        order = sorted(zip(rows["words"].to_pylist(), rows["label"].to_pylist()), key=lambda r: (zlib.crc32(r[0]), r))
        encoded = _encoder(own)
        texts = [encoded(np.frombuffer(w, "<u4")) for w, _ in order]
        _fit(own, texts, np.array([y for _, y in order], float), toxic)
        flat = np.concatenate([*[x.ravel() for x in _parameters(own)], [own.bias]]) * len(texts)
        pieces = [flat[at : at + PARAMETERS].tobytes() for at in range(0, len(flat), PARAMETERS)]
        return pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "shard": pa.array([key[0].as_py()] * len(pieces), pa.int64()), "values": pieces})

    def mean(key, rows):
        total = 0
        for values in rows.sort_by("shard")["values"]:
            total = total + np.frombuffer(values.as_py())
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "values": [(total / n_rows).tobytes()]})

    dealt = fitted.select(F.pmod(F.xxhash64("id", "words", F.lit(SEED)), F.lit(shards)).alias("of"), "label", "words")
    done = dealt.repartition(4 * shards, "of").groupBy("of").applyInArrow(fit, "piece int, shard long, values binary")
    means = done.groupBy("piece").applyInArrow(mean, "piece int, values binary").collect()
    flat = np.concatenate([np.frombuffer(r["values"]) for r in sorted(means, key=lambda r: r["piece"])])
    at = 0
    for x in _parameters(model):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    model.bias = float(flat[at])
    shared.unpersist()


def _calibrate(model: Model, rows: DataFrame) -> None:
    """The cuts, from all rows (label, words), counted by language and logit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        encoded = _encoder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = [encoded(np.frombuffer(w.as_py(), "<u4")) for w in some["words"]]
                bins = np.round(np.clip(shared.value.logits(texts), -LARGEST, LARGEST) * BINS).astype(np.int64)
                languages = [shared.value.guess(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(languages, pa.int32()), pa.array(bins), some["label"]], ["language", "bin", "label"])

    each = rows.select("label", "words").mapInArrow(count, "language int, bin long, label int")
    found = each.groupBy("language", "bin").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).collect()
    found.sort()
    language, bins, toxic, clean = np.array([tuple(r) for r in found], dtype=np.int64).T
    _set_cuts(model, language, bins / BINS, toxic, clean)
    shared.unpersist()


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str) -> DataFrame:
    """The rows (id, label, text) that teach. Labels grow with the rows, so the join shuffles at every size."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    return apart(texts).join(marks.where("id IS NOT NULL"), "id").select("id", "label", "text")


def train_on(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> Model:
    """A model from all labelled rows of `docs`; about every fifth, by a hash, calibrates the cuts, the others are fitted.

    Rows with a null id, text or label teach nothing; of rows repeated in `labels` one counts. If the rows to fit lack a class, all are
    fitted, and likewise for the cuts; with one class only, every text scores 0.
    """

    def encode(batch: pa.RecordBatch):
        texts = [np.array(hashed_words(t.as_py()), dtype="<u4").tobytes() for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(texts, pa.binary())], ["id", "label", "words"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = saved(
        _labelled(docs, labels, id_column, text_column, label)
        .mapInArrow(per_batch(encode), f"id {kind}, label int, words binary")
        .withColumn("held", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(5)) == 4)
    )
    sizes = {
        (r["held"], r["label"]): (r["n"], r["words"])
        for r in found.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words") / 4).cast("long").alias("words")).collect()
    }
    if len({y for _, y in sizes}) < 2:
        return train([], np.array([], int))

    def rows(held: bool) -> tuple[DataFrame, dict]:
        """The rows of one kind with their numbers and words by label; all rows if a class is missing."""
        if all((held, y) in sizes for y in (0, 1)):
            return found.where(F.col("held") == held), {y: sizes[held, y] for y in (0, 1)}
        return found, {y: tuple(sum(sizes.get((h, y), (0, 0))[k] for h in (True, False)) for k in (0, 1)) for y in (0, 1)}

    fitted, of = rows(False)
    n = of[0][0] + of[1][0]
    model = _start(*_counted(fitted, of[1][0], of[0][0]))
    _fit_shards(model, fitted, n, of[0][1] + of[1][1], of[1][0] / n)
    _calibrate(model, rows(True)[0])
    return model


def toxicity_scores(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """`docs` with one more column: the score of the text, from 0 to 1, at least CUT for toxic texts.

    Whole texts are scored. A null or empty text has a score like any other. The score column must be new.
    """
    if score_column.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"{score_column} is already a column")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        found = []
        for at in range(0, len(texts), 256):
            found.append(shared.value.scores([shared.value.encode(t) for t in texts[at : at + 256]]))
        return pd.Series(np.concatenate(found) if found else np.empty(0))

    return docs.withColumn(score_column, score(F.col(text_column)))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 3 == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    return train_on(docs.where(~held_out()), labels.where(~held_out()))


def op4_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every document; rows whose id hash leaves 1 modulo 3 were not learnt from."""
    docs = table(spark, folder, "documents")
    model = toxicity_model(docs, table(spark, folder, "labels"))
    found = toxicity_scores(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
