"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each hashed word and each
hashed character n-gram (of code points, the word's ends marked); a softmax layer
gives the class. Vectors and layer are trained together by numpy stochastic
gradient descent on a bounded sample of labelled documents. Because averaging
and the last layer are both linear, scoring adds one number per feature: the
layer is folded into the table of vectors, and whole texts pass through as
arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm._spark import column_at, over_arrow, read, sampled


@dataclass(frozen=True)
class QualityParams:
    """``train_rows`` bounds the labelled rows that are fitted; the rest shape the model."""

    train_rows: int = 3000
    buckets: int = 1 << 17
    dim: int = 16
    grams: tuple[int, ...] = (3, 4)
    #: How often the mark that ends every text counts: what is known of all texts weighs more on short ones.
    ends: int = 16
    epochs: int = 5
    rate: float = 0.25
    seed: int = 7
    #: How many rejected shares of the bad documents a kept share of the good ones is worth.
    keep_good: float = 2.0


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    vectors: np.ndarray
    layer: np.ndarray
    threshold: float
    held_out: float

    def folded(self) -> np.ndarray:
        """Each feature's share in the logit of the good class."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray, params: QualityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of UTF-8 bytes: (bucket of every feature, first feature of each document and the count of all), one pair for words and each n-gram size."""
    data, offsets = X.characters(data, offsets)
    starts, ends, firsts = X.spans(data, offsets)
    h = X.prefix(data)
    mask = X.U(params.buckets - 1)
    words = X.span_hash(h, starts, ends)
    yield (words & mask).astype(np.int64), firsts
    # A word that repeats the one before it, whichever it is, and the end of the text have vectors of their own.
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    again = again[~np.isin(again, firsts)]
    yield np.full(len(again), params.buckets - 1), np.searchsorted(again, firsts)
    yield np.full(params.ends * (len(offsets) - 1), params.buckets - 2), params.ends * np.arange(len(offsets))
    # A word's n-grams may take in the white space, or the end of the text, on either side of it as a mark.
    padded = np.full(len(data) + len(offsets), 32, data.dtype)
    shift = np.arange(len(offsets) - 1)
    place = np.arange(len(data)) + np.repeat(shift, np.diff(offsets)) + 1
    padded[place] = data
    padded[X.blank(padded)] = 32
    space = padded == 32
    edges = offsets + np.arange(len(offsets))
    hp = X.prefix(padded)
    for n in params.grams:
        m = len(padded) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        inner = np.ones(m, bool)
        for k in range(1, n - 1):
            inner &= ~space[k : k + m]
        at = np.flatnonzero(inner)
        yield (X.mix(X.span_hash(hp, at, at + n), n) & mask).astype(np.int64), np.searchsorted(at, edges)


def train(texts: pa.Array, labels: np.ndarray, params: QualityParams = QualityParams()) -> QualityModel:
    """Fits the vectors and the layer; every fifth document is held out to set the threshold and to measure accuracy."""
    data, offsets, _ = X.strings(texts)
    bags = []
    for a, b in X.blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        found = list(features(part, own, params))
        for d in range(b - a):
            ids = np.concatenate([f[k[d] : k[d + 1]] for f, k in found])
            bags.append(np.unique(ids, return_counts=True))
    rng = np.random.default_rng(params.seed)
    vectors = rng.uniform(-1, 1, (params.buckets, params.dim)).astype(np.float32) / params.dim
    layer = np.zeros((params.dim, 2), np.float32)
    usable = np.array([len(ids) > 1 for ids, _ in bags], bool) if bags else np.zeros(0, bool)
    held = (np.arange(len(bags)) % 5 == 0) & usable
    fit = np.flatnonzero(usable & ~held)
    steps, done = max(1, params.epochs * len(fit)), 0
    # Classes count alike, however rare one is.
    share = np.bincount(labels[fit], minlength=2) / max(1, len(fit))
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0).clip(0, 10).astype(np.float32)
    for _ in range(params.epochs):
        for d in rng.permutation(fit):
            rate = params.rate * (1 - done / steps)
            done += 1
            ids, counts = bags[d]
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[ids]
            logits = mean @ layer
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[d]] -= 1
            p *= weight[labels[d]]
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            # The average divides each gradient by the length of the text; the step takes the whole bag's rate.
            vectors[ids] -= (rate * len(ids) * part.clip(0, 4 / len(ids)))[:, None] * back[None, :]
    fold = vectors @ (layer[:, 1] - layer[:, 0])
    score = np.array([fold[ids] @ counts / max(1, counts.sum()) for ids, counts in bags]) if bags else np.zeros(0)
    # Held-out rows alone choose the threshold; without any of one class, the classes meet at logit 0, and labels of one class drop nothing.
    good, bad = score[held & (labels == 1)], score[held & (labels == 0)]
    threshold = 0.0 if (share > 0).all() else -np.inf
    if len(good) and len(bad):
        # A kept good text counts as ``keep_good`` rejected bad ones; labels may be wrong, so no quantile of one class decides.
        both = np.unique(np.concatenate([good, bad]))
        cuts = np.concatenate([[both[0] - 1], (both[1:] + both[:-1]) / 2, [both[-1] + 1]])
        kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
        dropped = np.searchsorted(np.sort(bad), cuts) / len(bad)
        threshold = float(cuts[np.argmax(params.keep_good * kept + dropped)])
    right = np.concatenate([good >= threshold, bad < threshold])
    return QualityModel(params, vectors, layer, threshold, float(right.mean()) if len(right) else float("nan"))


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Trains on at most ``params.train_rows`` rows of ``labels`` (doc_id, quality 0/1) that meet a text in ``docs``.

    Rows with a null key, label or text aren't used; of repeated labels all
    count. No usable row, or usable rows of one class alone, give a model that keeps every text
    (the first with score 0).
    """
    chosen = sampled(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("_quality")), "doc_id", params.train_rows)
    rows = (
        docs.select("doc_id", F.col("text").alias("_text")).filter(F.col("_text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # the sample is bounded by train_rows
        .select("doc_id", "_quality", "_text")
        .toArrow()
    )
    rows = rows.sort_by([("doc_id", "ascending"), ("_quality", "ascending"), ("_text", "ascending")])
    return train(rows["_text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["_quality"].to_numpy().astype(np.int64), params)


def scores(batch_text: pa.Array, fold: np.ndarray, params: QualityParams) -> np.ndarray:
    """The logit of the good class of each text; NaN where it holds no word."""
    data, offsets, _ = X.strings(batch_text)
    out = np.full(len(batch_text), np.nan)
    for a, b in X.blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sums, counts = np.zeros(b - a), np.zeros(b - a)
        for k, (ids, firsts) in enumerate(features(part, own, params)):
            sums += X.total(fold[ids], firsts)
            counts += np.diff(firsts)
            if k == 0:
                blank = np.diff(firsts) == 0
        out[a:b] = np.where(blank, np.nan, sums / np.maximum(counts, 1))
    return out


def score_quality(docs: DataFrame, model: QualityModel, keep_columns: bool = False) -> DataFrame:
    """Scores every row of ``docs`` by its whole text.

    Returns doc_id, score (logit of the good class) and keep; with
    ``keep_columns`` the columns of ``docs`` of the rows that are kept. A null or
    blank text has a null score and isn't kept: there is nothing to learn from
    it. Null ids, repeated rows and other columns pass through. Without
    ``keep_columns`` ids are whole numbers; others are cast to them.
    """
    fold, params, threshold = model.folded(), model.params, model.threshold
    known = bool(np.any(fold))

    def decide(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s = scores(text, fold, params)
        return s, (~np.isnan(s)) & ((s >= threshold) | (not known))

    if keep_columns:

        at = column_at(docs, "text")

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, keep = decide(batch.column(at))
                yield batch.filter(pa.array(keep))

        return over_arrow(docs, chosen, docs.schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, keep = decide(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64(), mask=np.isnan(s)), pa.array(keep)], ["doc_id", "score", "keep"])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double, keep boolean")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and whether it stays."""
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps, as ``score_quality`` says; an empty table stays empty."""
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")), keep_columns=True)
