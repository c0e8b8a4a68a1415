"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from .hashing import mix
from .storage import kept, text_batches

FEATURE_BITS = 20
CHUNK = 1 << 14
ORDERS = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    """``weights`` holds a number per hashed n-gram (log-count ratio times learnt weight)."""

    weights: np.ndarray
    bias: float


class _Grams:
    """Distinct hashed character n-grams of texts; keeps a scratch table for the task."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << FEATURE_BITS, np.int32)
        self.steps = mix(np.arange(1, max(ORDERS) + 1, dtype=np.uint64)) | np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        chars[(chars >= 9) & (chars <= 13)] = 32
        found = []
        total = np.zeros(len(chars), np.uint64)
        for k in range(max(ORDERS)):
            if len(chars) <= k:
                break
            total = total[:len(chars) - k] + chars[k:] * self.steps[k]
            if k + 1 in ORDERS:
                found.append(mix(total + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS))
        grams = (np.concatenate(found) if found else np.zeros(0, np.uint64)).astype(np.int64)
        places = np.arange(len(grams), dtype=np.int32)
        self.last[grams] = places  # the last place of each n-gram stays
        return grams[self.last[grams] == places]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> per block of n-grams the numbers of documents of either label that hold them."""
    grams, counts = _Grams(), np.zeros((2, 1 << FEATURE_BITS), np.float32)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[int(label), grams.of(text)] += 1
    n = (1 << FEATURE_BITS) // CHUNK
    yield pa.record_batch([pa.array(range(n), pa.int32()), *(pa.array(list(c.astype(np.float64).reshape(n, CHUNK)), pa.list_(pa.float64())) for c in counts)], names=["chunk", "clean", "toxic"])


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "clean": [np.sum(pdf["clean"].tolist(), axis=0)], "toxic": [np.sum(pdf["toxic"].tolist(), axis=0)]})


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int = 42) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents, chosen by a hash of the id; one row per id.

    Labels above 0 count as 1, others as 0; of contradicting labels of one id the larger counts.
    """
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    total = max(1, labels.count())
    spin = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20))
    few = labels.where(spin < min(1.0, 1.2 * max_rows / total) * (1 << 20)).orderBy(spin, "doc_id").limit(max_rows)
    return docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).drop("doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, features: int = 4_096, reg: float = 1e-4,
        smoothing: float = 1.0, max_iter: int = 60) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, label of 0 or 1).

    The log-count ratio of an n-gram is log((p + s) / |p + s|) - log((q + s) / |q + s|), where p and q
    count the toxic and clean documents that hold it. The ``features`` n-grams that tell the labels
    apart most (their part of the divergence of p and q) are kept; a document's value of one it holds is its ratio,
    and logistic regression weighs those. At most ``max_rows`` labelled documents are used.
    Labels of one kind only give a constant score, the smoothed share of toxic labels.
    """
    text_batches(docs.sparkSession)
    sample = kept(training_sample(docs, labels, max_rows).repartition(16), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / (n_toxic + n_clean + 1), 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), float(np.log(share / (1 - share))))
    kinds = "chunk int, clean array<double>, toxic array<double>"
    rows = sample.mapInArrow(_count, kinds).groupBy("chunk").applyInPandas(_added, kinds).orderBy("chunk").collect()
    q, p = (np.concatenate([r[c] for r in rows]) for c in ("clean", "toxic"))
    ratio = np.log((p + smoothing) / (p + smoothing).sum()) - np.log((q + smoothing) / (q + smoothing).sum())
    apart = (p / p.sum() - q / q.sum()) * ratio
    chosen = np.sort(np.argsort(-apart, kind="stable")[:features])
    place = np.full(1 << FEATURE_BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    scale = ratio[chosen]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for batch in batches:
            at = [np.sort(place[g][place[g] >= 0]) for g in (grams.of(t) for t in batch.column(0).to_pylist())]
            yield pa.record_batch([pa.array(at, pa.list_(pa.int64())), batch.column(1).cast(pa.float64())], names=["at", "label"])

    vector = F.udf(lambda at: SparseVector(len(chosen), at, scale[at]), VectorUDT())
    rows = sample.mapInArrow(present, "at array<long>, label double").select(vector("at").alias("features"), "label")
    learnt = LogisticRegression(regParam=reg, maxIter=max_iter, standardization=False).fit(rows)
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    weights[chosen] = learnt.coefficients.toArray() * scale
    return Model(weights, float(learnt.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, between 0 and 1 and higher for text likelier toxic, of every whole text.

    Null and empty texts hold no n-gram but those of white space. The model, of fixed size, is
    broadcast. Other columns stay; a column named ``out`` is replaced.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, m = _Grams(), shared.value
        for texts in batches:
            raw = np.array([m.weights[grams.of(t)].sum(dtype=np.float64) for t in texts]) + m.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -700, 700))))

    return docs.withColumn(out, scored(F.col(text).cast("string")))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Rows of ``docs`` with held_out, score and predicted; learns ``labels.toxic`` of ids that aren't held out."""
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), known, **options)
    return (score(docs.drop("held_out", "score", "predicted"), model)
            .withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int")))
