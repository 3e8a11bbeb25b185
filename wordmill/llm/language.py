"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import vec

UNDETERMINED = "und"
#: Labelled rows that the classifier is fitted on, about; of each, WINDOWS stretches of WINDOW characters.
ROWS, WINDOWS, WINDOW = 5000, 3, 240
BUCKETS, DIMENSIONS, SIZES = 1 << 16, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 5, 32, 4.0
#: A fifth of the sample sets the temperature and is not trained on.
CALIBRATION = 5
#: A calibrated probability below which a language is rejected, at most; less if clean calibration rows would go.
REJECT, SPARED = 0.5, 0.001


@functools.cache
def _values() -> np.ndarray:
    """The random value of every letter's lower case; one value for all that are no letters."""
    values = vec.char_values()[vec.lowered()].copy()
    letter = (vec.classes() == vec.LETTER) | (vec.classes() == vec.MARK)
    values[~letter] = vec.char_values()[32]
    return values


def windows(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of two, three and four letters or word borders: their size, bucket by place, and which hold a letter and leave no text."""
    values, letter = _values()[points], vec.classes()[points] == vec.LETTER
    at = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for size in SIZES:
        n = len(points) - size + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(size))
        some = letter[:n].copy()
        for k in range(size):
            h ^= values[k : n + k]
            h *= np.uint64(0x9E3779B97F4A7C15)
            if k:
                some |= letter[k : n + k]
        some &= at[:n] == at[size - 1 :]
        yield size, (h >> np.uint64(44)).astype(np.uint32) & np.uint32(BUCKETS - 1), some


def subwords(points: np.ndarray) -> np.ndarray:
    """The buckets of all runs of one text."""
    return np.concatenate([np.zeros(0, np.uint32), *(h[some] for _, h, some in windows(points, np.array([0, len(points)])))])


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    reject: float = REJECT

    def means(self, buckets: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """The mean embedding of every text's subwords; texts come in runs."""
        out = np.zeros((n, DIMENSIONS))
        if len(buckets):
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            np.add.at(out, docs[first], np.add.reduceat(self.embeddings[buckets], first, axis=0))
        return out / np.maximum(1, np.bincount(docs, minlength=n))[:, None]

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return softmax(means @ self.weights * self.scale)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language's number (-1: no letter) and its calibrated probability, of whole texts."""
        langs, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        few = len(self.languages) <= DIMENSIONS  # then sums of weighted embeddings, language by language, are the shorter way
        tables = np.append((self.embeddings @ self.weights if few else self.embeddings).astype(np.float32), np.zeros((1, len(self.languages) if few else DIMENSIONS), np.float32), axis=0).T.copy()
        for lo, hi, points, offsets in vec.steps(column):
            n, letter = hi - lo, np.append(vec.classes()[points] == vec.LETTER, False)
            filled = np.diff(offsets) > 0
            sums, count = np.zeros((n, len(tables))), np.zeros(n, np.int64)
            for _, h, some in windows(points, offsets):
                at = np.full(len(points) + 1, BUCKETS, np.uint32)
                at[: len(h)] = np.where(some, h, np.uint32(BUCKETS))
                seen = np.zeros(len(points) + 1, np.int32)
                seen[: len(h)] = some
                count[filled] += np.add.reduceat(seen, offsets[:-1])[filled]
                for k, table in enumerate(tables):
                    sums[filled, k] += np.add.reduceat(table[at], offsets[:-1])[filled]
            means = sums / np.maximum(1, count)[:, None]
            p = softmax((means if few else means @ self.weights) * self.scale) if self.languages else np.zeros((n, 1))
            none = ~(np.logical_or.reduceat(letter, offsets[:-1]) & filled) | (not self.languages)
            langs.append(np.where(none, -1, p.argmax(axis=1)))
            scores.append(np.where(none, 0.0, p.max(axis=1)))
        return np.concatenate(langs), np.concatenate(scores)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Stochastic gradient descent in numpy; the same rows, in whatever order, give the same model."""
    rows = sorted(zip(texts, langs, strict=True))
    names = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    model = Model(names, np.zeros((BUCKETS, DIMENSIONS), np.float32), rng.normal(0, 1, (DIMENSIONS, max(1, len(names)))))
    if len(names) < 2:
        return model
    target = np.array([names.index(lang) for _, lang in rows])
    held = rng.permutation(len(rows)) % CALIBRATION == 0
    if held.all() or len(rows) < 2 * CALIBRATION:
        held[:] = False
    each = [subwords(vec.code_points(pa.array([t]))[0]) for t, _ in rows]
    train = np.flatnonzero([len(b) > 0 and not h for b, h in zip(each, held, strict=True)])
    balance = np.sqrt(len(rows) / len(names) / np.maximum(1, np.bincount(target, minlength=len(names))))
    total = max(1, epochs * len(train))
    for epoch in range(epochs):
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            rate = RATE * (1 - (epoch * len(train) + lo) / total)
            buckets = np.concatenate([each[i] for i in some])
            docs = np.repeat(np.arange(len(some)), [len(each[i]) for i in some])
            means = model.means(buckets, docs, len(some))
            error = model.probabilities(means)
            error[np.arange(len(some)), target[some]] -= 1
            error *= balance[target[some]][:, None]
            back = (error @ model.weights.T)[docs]
            model.weights -= 0.1 * rate / len(some) * means.T @ error
            hit, at, often = np.unique(buckets, return_inverse=True, return_counts=True)
            step = np.stack([np.bincount(at, back[:, k], len(hit)) for k in range(DIMENSIONS)], axis=1)
            model.embeddings[hit] -= (rate / often[:, None] * step / np.sqrt(len(some))).astype(np.float32)
    if held.any():
        some = np.flatnonzero(held & np.array([len(b) > 0 for b in each]))
        means = np.concatenate([model.means(each[i], np.zeros(len(each[i]), np.int64), 1) for i in some])

        def loss(scale: float) -> float:
            model.scale = scale
            return -np.log(np.maximum(1e-12, model.probabilities(means)[np.arange(len(some)), target[some]])).mean()

        model.scale = min(np.geomspace(0.05, 20, 60), key=loss)
        p = model.probabilities(means)
        right = p.max(axis=1)[p.argmax(axis=1) == target[some]]
        model.reject = float(min(REJECT, np.quantile(right, SPARED))) if len(right) else REJECT
    return model


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def sample(docs: DataFrame, rows: int = ROWS, only: Column | None = None) -> tuple[list[str], list[str]]:
    """Stretches of about `rows` labelled documents (all, if there are fewer), taken by a hash of the row, and their languages.

    Rows of one hash come all or not at all, so repeated ones are taken once, and never more than twice `rows`.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.lit(True) if only is None else only))
    share = rows / max(1, known.select("lang").count())
    length = F.greatest(F.length("text"), F.lit(1))
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    parts = [F.expr(f"substring(text, cast(pmod(xxhash64(doc_id, {k}), n) as int) + 1 - {WINDOW // 2}, {WINDOW})") if k else F.expr(f"substring(text, 1, {WINDOW})") for k in range(WINDOWS)]
    part = F.expr("CASE WHEN n <= {0} THEN text ELSE NULL END".format(WINDOW * WINDOWS))
    some = known.where(F.col("text").isNotNull() & pick).withColumn("n", length).select(F.coalesce(part, F.concat_ws(" ", *parts)).alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("row")).dropDuplicates(["row"]).limit(2 * rows).toPandas()
    return some["text"].tolist(), some["lang"].tolist()


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    """The model of documents whose fold is not 2; null doc_ids have no fold and aren't learned from."""
    return fit(*sample(docs, rows, fold() != 2))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected, of every row.

    Null texts and texts without a letter are `und`, score 0 and rejected; so is every text if nothing could be learned.
    Else a text is rejected if its calibrated probability is below the model's threshold. Repeated rows get equal answers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB and a few weights for each language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            lang, score = model.predict(vec.plain(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(lang % len(names))), pa.array(score), pa.array((lang < 0) | (score < model.reject))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score = model.predict(vec.plain(batch.column(at)))
            yield batch.filter(pc.and_(pa.array(lang >= 0), pa.array(score >= model.reject)))

    return docs.mapInArrow(keep, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; see identify() for nulls and texts without letters, train() for what is learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
