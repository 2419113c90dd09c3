"""Toxicity by multiple-instance learning: sentences are judged, only documents have labels.

A document is toxic if at least one of its sentences is: with p the score of a sentence, a document's score is the noisy-or
1 - prod(1 - p). A sentence's score is logistic in the sum of weights of its distinct words; a word has hashed features, the
word itself and its pieces of five letters with both ends marked, so that inflected forms share weights. The weights follow
from the documents' labels by gradient steps on the noisy-or likelihood with a ridge penalty. As the label reaches the
sentences through the noisy-or, the model also says which sentences offend.

Training reads at most ``fit_rows`` labelled rows, those with the smallest hash of the id (a parameter). Their features are
packed once into blocks in the shared folder; every step is a Spark job that adds up gradients per task, and the driver gets one
vector of ``SIZE`` numbers from each of at most ``_PARTS`` tasks. All texts are scored, as a whole.

Null and empty texts, and texts without a letter, are one sentence without words. Labels given twice for an id count twice;
null labels and ids are not learned from. If the rows lack one of the two labels, the score is the share of label 1 in them
(one half without any row) and no sentence offends.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.llm.common import add_columns, pieces, stored

SIZE = 1 << 18
THRESHOLD = 0.3
_PIECE = 5
_PARTS = 16
_BLOCK_WORDS = 500_000
_REMEMBERED = 500_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words) of each sentence with a word; places in code points."""
    out = []
    for found in _SENTENCE.finditer(text or ""):
        words = list(dict.fromkeys(_WORD.findall(found.group().lower())))
        if words:
            out.append((found.start(), found.end(), words))
    return out


def word_features(word: str) -> list[int]:
    """Places of a word's weights."""
    marked = f"^{word}$"
    parts = [marked[i : i + _PIECE] for i in range(max(1, len(marked) - _PIECE + 1))]
    return [xxhash.xxh64_intdigest(word, 7) % SIZE, *[xxhash.xxh64_intdigest(p, 8) % SIZE for p in dict.fromkeys(parts)]]


class Block:
    """Labelled documents as arrays: features of distinct words, words of sentences, sentences of documents."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.features, self.feature_counts, self.words, self.word_counts, self.sentence_counts, self.labels = [], [], [], [], [], []

    def add(self, text: str | None, label: float) -> None:
        found = sentences(text)
        for _, _, words in found:
            for word in words:
                if word not in self.numbers:
                    self.numbers[word] = len(self.numbers)
                    of_word = word_features(word)
                    self.features += of_word
                    self.feature_counts.append(len(of_word))
                self.words.append(self.numbers[word])
            self.word_counts.append(len(words))
        if not found:
            self.word_counts.append(0)
        self.sentence_counts.append(max(1, len(found)))
        self.labels.append(label)

    def packed(self) -> list[bytes]:
        parts = (self.features, self.feature_counts, self.words, self.word_counts, self.sentence_counts)
        return [*[np.array(p, np.int32).tobytes() for p in parts], np.array(self.labels, np.float64).tobytes()]


_NAMES = ["features", "feature_counts", "words", "word_counts", "sentence_counts", "labels"]


def _blocks(batches):
    block = Block()
    pack = lambda b: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in b.packed()], names=_NAMES)
    for batch in batches:
        for part in pieces(batch, "_text"):
            for text, label in zip(part.column("_text").to_pylist(), part.column("_label").to_pylist()):
                block.add(text, label)
                if len(block.words) >= _BLOCK_WORDS:
                    yield pack(block)
                    block = Block()
    if block.labels:
        yield pack(block)


def gradient(weights: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, float, float]:
    """(gradient of the negative log likelihood by weight and last the bias, its value, documents) of a block."""
    features, feature_counts, words, word_counts, sentence_counts = (np.frombuffer(p, np.int32) for p in packed[:5])
    labels = np.frombuffer(packed[5], np.float64)
    word_of = np.repeat(np.arange(len(feature_counts)), feature_counts)
    score = np.bincount(word_of, weights[features], len(feature_counts))
    sentence_of = np.repeat(np.arange(len(word_counts)), word_counts)
    z = np.bincount(sentence_of, score[words], len(word_counts)) + weights[-1]
    doc_of = np.repeat(np.arange(len(labels)), sentence_counts)
    clean = np.bincount(doc_of, -np.logaddexp(0, z), len(labels))  # log of prod(1 - p)
    toxic = np.maximum(-np.expm1(clean), 1e-12)
    loss = -(labels * np.log(toxic) + (1 - labels) * clean).sum()
    of_clean = np.where(labels > 0, np.exp(clean) / toxic, -1.0)
    of_z = -of_clean[doc_of] / (1 + np.exp(-z))
    of_word = np.bincount(words, of_z[sentence_of], len(feature_counts))
    out = np.append(np.bincount(features, of_word[word_of], SIZE), of_z.sum())
    return out, float(loss), float(len(labels))


def _gradients(held, batches):
    weights, total, loss, docs = held.value, None, 0.0, 0.0
    for batch in batches:
        for packed in zip(*[batch.column(n).to_pylist() for n in _NAMES]):
            g, a, n = gradient(weights, list(packed))
            total, loss, docs = g if total is None else total + g, loss + a, docs + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([docs])], names=["g", "loss", "docs"])


@dataclass(frozen=True)
class Model:
    """Weights with the bias last; ``constant`` is the score of all texts if nothing could be learned."""

    weights: np.ndarray
    constant: float | None = None


def fit(
    docs: DataFrame, labels: DataFrame, label: str, text: str = "text", fit_rows: int = 20_000, steps: int = 60, rate: float = 0.1,
    ridge: float = 3e-4,
) -> Model:
    """Learn from labelled documents. The sampled ids are joined by broadcast: ``fit_rows`` ids at most."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("_label"))
    known = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "_label").limit(fit_rows)
    rows = docs.select("doc_id", F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "doc_id").select("_text", "_label")
    parts = min(_PARTS, max(1, spark.sparkContext.defaultParallelism))
    schema = T.StructType([T.StructField(n, T.BinaryType()) for n in _NAMES])
    blocks = stored(rows.repartition(parts).mapInArrow(_blocks, schema), "toxicity-blocks")
    packed_labels = [np.frombuffer(r["labels"], np.float64) for r in blocks.select("labels").collect()]
    every = np.concatenate(packed_labels) if packed_labels else np.zeros(0)
    if not len(every) or every.min() == every.max():
        return Model(np.zeros(0), float(every.mean()) if len(every) else 0.5)
    weights = np.zeros(SIZE + 1)
    weights[-1] = -5.0
    first, second = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for step in range(1, steps + 1):
        held = spark.sparkContext.broadcast(weights)
        found = blocks.coalesce(parts).mapInArrow(partial(_gradients, held), "g binary, loss double, docs double").collect()
        held.destroy()
        g = sum(np.frombuffer(r["g"], np.float64) for r in sorted(found, key=lambda r: (r["loss"], r["docs"]))) / len(every)
        g = g + np.append(ridge * weights[:-1], 0.0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(weights)


class Judge:
    """Scores of sentences; sums of words are remembered up to a bound."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.of_word = weights[:-1].tolist(), {}
        self.bias = float(weights[-1])

    def word(self, word: str) -> float:
        found = self.of_word.get(word)
        if found is None:
            if len(self.of_word) >= _REMEMBERED:
                self.of_word.clear()
            found = self.of_word[word] = sum(self.weights[k] for k in word_features(word))
        return found

    def judge(self, text: str | None, threshold: float) -> tuple[float, list[dict]]:
        """(score, sentences that reach the threshold)."""
        clean, offending = 0.0, []
        for start, end, words in sentences(text) or [(0, 0, [])]:
            z = self.bias + sum(map(self.word, words))
            clean -= math.log1p(math.exp(z)) if z < 30 else z
            if z > -30 and (p := 1 / (1 + math.exp(-z))) >= threshold and words:
                offending.append({"start": start, "end": end, "score": p})
        return -math.expm1(clean), offending


def _score(held, constant: float | None, threshold: float):
    if constant is not None:
        return lambda texts: {"score": [constant] * len(texts), "predicted": [int(constant >= threshold)] * len(texts), "offending": [[]] * len(texts)}
    judge = Judge(held.value)

    def work(texts):
        found = [judge.judge(t, threshold) for t in texts]
        return {"score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found], "offending": [o for _, o in found]}

    return work


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1), ``predicted`` (1 from the threshold on) and ``offending``: start, end and score of sentences that reach it alone."""
    spans = T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    held = None if model.constant is not None else docs.sparkSession.sparkContext.broadcast(model.weights)
    new = {"score": T.DoubleType(), "predicted": T.IntegerType(), "offending": spans}
    return add_columns(docs, text, new, partial(_score, held, model.constant, threshold), keep)
