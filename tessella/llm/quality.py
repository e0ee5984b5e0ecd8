"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: of one and two words (case-folded), and of one to three words
reduced to their shape (letter case, digits, symbols, last character, and whether a word repeats
one shortly before); each n-gram of shapes has further indicators for being frequent in the text.
Indicators are scaled by the classes' log-count ratio and by one over the root of their number in
the text, then a linear hinge-loss model is fitted by dual coordinate descent and interpolated
with the mean size of the weights in use; a sigmoid turns margins into scores. Texts are scored
with the scaling and the bias that were fitted; n-grams that weren't seen in training weigh nothing.

Labels are learned from at most ``MAX_TRAIN`` labelled documents, chosen by a hash of the id
among those whose crc32 modulo 4 is not 2. Of several rows with such an id, one is learned from
(least in the bytes of its features), so that what reaches the driver stays bounded.

Defined results: a null or empty text is scored by the bias alone; several labels of a document
count as the highest; null labels are ignored; with labels of one class only, or none, every
score is the smoothed share of label 1; repeated rows score alike. Only the id and text columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, in_training, table
from tessella.llm.linear import fit_hinge, fit_sigmoid, sigmoid
from tessella.llm.tokens import mix, text_pieces, words

#: Bound on the labelled documents that a model is fitted on.
MAX_TRAIN = 6000
#: Slots of hashed n-grams of shapes and of words.
SHAPES, WORDS = 1 << 16, 1 << 17
SIZE = SHAPES + WORDS
THRESHOLD = 0.7
#: Share of the fitted weights; the rest is their mean size (as in the published method).
BETA = 0.25
#: Bound on a balanced example's dual variable.
COST = 0.1

_CLASS = np.zeros(256, np.uint8)  # bits: lower 1, upper 2, digit 4, common mark 8, other symbol 16
_CLASS[97:123] = _CLASS[128:256] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 8
_CLASS[[b for b in range(33, 127) if not _CLASS[b]]] = 16
_LAST = np.zeros(256, np.uint8)
for _k, _group in enumerate((".?", ",;:", "!", "\"')", "#*$%&|<>@=+/\\^~`_{}[]")):
    _LAST[[ord(c) for c in _group]] = _k + 1


def shapes(found) -> np.ndarray:
    """A number for each word's shape and its relation to the words before."""
    raw = found.raw
    bits = np.bitwise_or.reduceat(_CLASS[raw], found.start) if len(found.start) else np.zeros(0, np.uint8)
    length = found.end - found.start
    first_upper = (_CLASS[raw[found.start]] == 2).astype(np.int64)
    uppers = np.add.reduceat((_CLASS[raw] == 2).view(np.uint8), found.start, dtype=np.int32) if len(found.start) else np.zeros(0, np.int32)
    many_upper = (uppers >= 2).astype(np.int64)
    last = _LAST[raw[found.end - 1]].astype(np.int64)
    double = ((length > 1) & (raw[found.end - 1] == raw[np.maximum(found.end - 2, 0)]) & (last > 0)).astype(np.int64)
    size = np.digitize(length, [2, 16, 40])
    same = np.zeros(len(length), np.int64)
    for lag in (4, 3, 2, 1):
        if len(length) > lag:
            equal = (found.hash[lag:] == found.hash[:-lag]) & (found.doc[lag:] == found.doc[:-lag])
            same[lag:][equal] = 1 if lag == 1 else 2
    return ((((((bits & 31).astype(np.int64) * 2 + first_upper) * 2 + many_upper) * 6 + last) * 2 + double) * 4 + size) * 3 + same


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and numbers (below SIZE) of all indicators that are set, without repeats."""
    found = words(raw, offsets, punctuation=True)
    shape = (shapes(found) + 1).astype(np.uint64)
    docs, grams = [found.doc], [mix(shape * np.uint64(0x9E3779B97F4A7C15))]
    for n in (2, 3):
        if len(shape) >= n:
            whole = found.doc[: len(shape) - n + 1] == found.doc[n - 1 :]
            total = np.zeros(len(shape) - n + 1, np.uint64)
            for k in range(n):
                total = total * np.uint64(1_000_003) + shape[k : len(shape) - n + 1 + k]
            docs.append(found.doc[: len(total)][whole])
            grams.append(mix(total[whole] + np.uint64(n << 60)))
    doc = np.concatenate(docs)
    key = (doc.astype(np.uint64) << np.uint64(32)) | (np.concatenate(grams) & np.uint64(0xFFFFFFFF))
    unique, counts = np.unique(key, return_counts=True)
    sets = [unique]
    for k, least in enumerate((4, 16, 64)):
        often = unique[counts >= least]
        sets.append((often & ~np.uint64(0xFFFFFFFF)) | (mix((often & np.uint64(0xFFFFFFFF)) + np.uint64((k + 1) << 40)) & np.uint64(0xFFFFFFFF)))
    every = np.concatenate(sets)
    doc, gram = (every >> np.uint64(32)).astype(np.int64), (every & np.uint64(SHAPES - 1)).astype(np.int64)
    together = found.doc[1:] == found.doc[:-1]
    two = mix(found.hash[:-1] * np.uint64(1_000_003) + found.hash[1:])[together]
    word = SHAPES + (np.concatenate([found.hash, two]) % np.uint64(WORDS)).astype(np.int64)
    pair = np.unique(np.concatenate([doc * SIZE + gram, np.concatenate([found.doc, found.doc[1:][together]]) * SIZE + word]))
    return pair // SIZE, pair % SIZE


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, gram = features(raw, offsets)
        n = len(offsets) - 1
        total = np.bincount(doc, weights=self.weights[gram], minlength=n)
        margins = total / np.sqrt(np.maximum(1, np.bincount(doc, minlength=n))) + self.bias
        return sigmoid(self.slope * margins + self.offset)


def fit(rows: list[np.ndarray], labels: np.ndarray, beta: float = BETA, tolerance: float = 1e-3, epochs: int = 40) -> Model:
    """Fit the indicator sets ``rows`` with 0/1 ``labels``."""
    n1, n = int(labels.sum()), len(labels)
    if n1 == 0 or n1 == n:
        share = (n1 + 1) / (n + 2)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k]), minlength=SIZE) for k in (0, 1)]
    seen = held[0] + held[1] > 0
    negative, positive = ((h + 1.0) / (h[seen] + 1.0).sum() for h in held)
    ratio = np.where(seen, np.log(positive / negative), 0.0)
    signs = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, n / (2 * n1), n / (2 * (n - n1))) * COST
    scales = [1 / np.sqrt(max(1, len(r))) for r in rows]
    fitted = fit_hinge(rows, [ratio[r] * s for r, s in zip(rows, scales, strict=True)], signs, SIZE, cost, epochs=epochs, tolerance=tolerance)
    weights, bias = fitted[:-1], float(fitted[-1])
    weights = (beta * weights + (1 - beta) * np.abs(weights[seen]).mean()) * ratio
    margins = np.array([weights[r].sum() * s for r, s in zip(rows, scales, strict=True)]) + bias
    slope, offset = fit_sigmoid(margins, labels)
    return Model(weights, bias, slope, offset)


def training_rows(documents: DataFrame, labels: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicator sets and labels of at most ``most`` labelled documents outside the held-out fold."""
    bounded_batches(documents.sparkSession)
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & in_training())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    total = known.count()
    if total > most:
        bound = int((most / total) * 2**63 * 1.05)
        known = known.filter(F.col("order").bitwiseAND(F.lit(2**63 - 1)) < F.lit(min(bound, 2**63 - 1)))
    known = known.orderBy(F.col("order").bitwiseAND(F.lit(2**63 - 1)), "doc_id").limit(most)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("order", F.col("doc_id").cast("string").alias("doc_id"), "label", "text")

    def run(batches):
        for batch in batches:
            grams = []
            for first, last, raw, offsets in text_pieces(batch.column(3)):
                doc, gram = features(raw, offsets)
                counts = np.bincount(doc, minlength=last - first)
                grams += [g.astype("<i4").tobytes() for g in np.split(gram, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.binary())], names=["order", "doc_id", "label", "grams"])

    found = texts.mapInArrow(run, "order long, doc_id string, label int, grams binary")
    rows = found.groupBy("order", "doc_id", "label").agg(F.min("grams").alias("grams")).collect()  # a row an id, however often it is repeated
    rows = sorted(rows, key=lambda r: (r.order & (2**63 - 1), r.doc_id))
    return [np.frombuffer(r.grams, "<i4").astype(np.int64) for r in rows], np.array([r.label for r in rows])


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    return fit(*training_rows(documents, labels, most))


def scored(documents: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns of every row, its ``score`` and ``predicted``."""
    bounded_batches(documents.sparkSession)
    source = documents.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType(list(source.schema.fields[:-1])).add("score", "double").add("predicted", "integer")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(raw, offsets) for _, _, raw, offsets in text_pieces(batch.column(len(keep)))]
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)


def accepted(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns (whatever their names) of the rows that the model predicts as good."""
    bounded_batches(documents.sparkSession)
    at = documents.schema.names.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(raw, offsets) for _, _, raw, offsets in text_pieces(batch.column(at).cast(pa.string()))]
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield batch.filter(pa.array(found >= threshold))

    return documents.mapInArrow(run, documents.schema)


def op7_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    found = scored(documents, model, ["doc_id"])
    return found.select("doc_id", (~in_training()).alias("held_out"), "score", "predicted")
