"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the vectors of its hash and of the hashes of
its beginnings. Filters of several widths slide over the words; the maximum of
each over the whole text goes into a logistic layer. All of it is trained in
numpy on a bounded sample of labelled documents, and the threshold of each
language is chosen on documents that were held out. Scoring folds the filters
into the embedding table, so a filter of width w costs w table rows a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm._spark import over_arrow, read, sampled


@dataclass(frozen=True)
class ToxicityParams:
    """``train_rows`` bounds the labelled rows that are fitted; the rest shape the model."""

    train_rows: int = 6000
    buckets: int = 1 << 18
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    #: Bytes of a word's beginnings that have vectors of their own.
    heads: tuple[int, ...] = (4, 5, 6, 7)
    epochs: int = 5
    rate: float = 0.08
    seed: int = 11


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    vectors: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    layer: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5
    trained: bool = False

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter: what each bucket adds to the filters' outputs."""
        return [[self.vectors @ w[j] for j in range(len(w))] for w in self.filters]


def tokens(data: np.ndarray, offsets: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word: its hash and its beginnings, -1 where it is shorter; first word of each document).

    Letters count in lower case and marks at a word's ends don't count.
    """
    data = X.LOWER[data]
    plain = data.copy()
    letters = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    plain[~letters] = 32
    starts, ends, firsts = X.spans(plain, offsets)
    h = X.prefix(plain)
    mask = X.U(params.buckets - 1)
    out = np.full((len(starts), 1 + len(params.heads)), -1, np.int64)
    out[:, 0] = (X.span_hash(h, starts, ends) & mask).astype(np.int64)
    for k, n in enumerate(params.heads):
        long = np.flatnonzero(ends - starts > n)
        out[long, k + 1] = (X.mix(X.span_hash(h, starts[long], starts[long] + n), n) & mask).astype(np.int64)
    return out, firsts


def embed(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = vectors[ids[:, 0]].copy()
    for k in range(1, ids.shape[1]):
        has = ids[:, k] >= 0
        out[has] += vectors[ids[has, k]]
    return out


def pooled(ids: np.ndarray, firsts: np.ndarray, model: ToxicityModel, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Maxima of all filters over each document; a text shorter than a filter is filled up with nothing."""
    n, widest = len(ids), max(model.params.widths)
    docs = len(firsts) - 1
    # Nothing, of the widest filter's length less one, follows each text.
    place = np.arange(n) + np.repeat(np.arange(docs) * (widest - 1), np.diff(firsts))
    edges = firsts + np.arange(docs + 1) * (widest - 1)
    out = []
    for w, own in zip(model.params.widths, tables, strict=True):
        acts = np.zeros((n + docs * (widest - 1) + widest, own[0].shape[1]), np.float32)
        for j, t in enumerate(own):
            acts[place[place >= j] - j] += embed(ids[place >= j], t)
        # Windows that begin in a text's own words, at least one.
        live = np.zeros(len(acts), bool)
        live[place] = True
        tail = np.minimum(edges[1:] - (widest - 1), edges[1:])
        for j in range(1, w):
            # A window must lie in the text unless the text is shorter than it.
            at = tail - j
            at = at[(at > edges[:-1])]
            live[at] = False
        keep = np.flatnonzero(live)
        out.append(X.maxima(acts[keep], np.searchsorted(keep, edges), 0.0))
    return np.concatenate(out, axis=1) + model.bias


def probability(ids: np.ndarray, firsts: np.ndarray, model: ToxicityModel, tables: list[list[np.ndarray]]) -> np.ndarray:
    z = np.maximum(pooled(ids, firsts, model, tables), 0) @ model.layer + model.offset
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def training_tokens(texts: pa.Array, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of many texts, block by block and in 32 bits: the driver's memory is small."""
    data, offsets, _ = X.strings(texts)
    parts, counts = [np.zeros((0, 1 + len(params.heads)), np.int32)], [np.zeros(1, np.int64)]
    for a, b in X.blocks(offsets):
        ids, firsts = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params)
        parts.append(ids.astype(np.int32))
        counts.append(np.diff(firsts))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def train(texts: pa.Array, langs: list[str | None], labels: np.ndarray, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Trains on four fifths of the documents and calibrates each language's threshold on the rest."""
    ids, firsts = training_tokens(texts, params)
    n = len(labels)
    rng = np.random.default_rng(params.seed)
    total = params.filters * len(params.widths)
    vectors = rng.normal(0, 0.02, (params.buckets, params.dim)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, params.dim, params.filters)).astype(np.float32) for w in params.widths]
    model = ToxicityModel(params, vectors, filters, np.zeros(total, np.float32), rng.normal(0.3, 0.1, total).astype(np.float32), -1.0)
    fit = np.flatnonzero((np.arange(n) % 5 != 0) & (np.diff(firsts) > 0))
    if n == 0 or len(np.unique(labels[fit])) < 2:
        return model
    # Vectors start from how much more often toxic documents hold the bucket: their first half of dimensions.
    held = [np.zeros(params.buckets), np.zeros(params.buckets)]
    for d in fit:
        own = np.unique(ids[firsts[d] : firsts[d + 1]])
        held[int(labels[d])][own[own >= 0]] += 1
    size = [max(1, int((labels[fit] == y).sum())) for y in (0, 1)]
    odds = np.log((held[1] + 0.3) / (size[1] + 0.6)) - np.log((held[0] + 0.3) / (size[0] + 0.6))
    rare = (held[0] + held[1]) < 3
    odds = np.where(rare, 0, odds.clip(-3, 5))
    half = params.dim // 2
    vectors[:, :half] += (0.2 * odds[:, None] * np.ones(half)).astype(np.float32)
    for w in filters:
        w[:, :half, :] = np.abs(w[:, :half, :])
    bias, layer, offset = model.bias, model.layer, -1.0
    share = len(fit) / (2.0 * np.array(size))
    steps, done = params.epochs * len(fit), 0
    for _ in range(params.epochs):
        for d in rng.permutation(fit):
            rate = params.rate * (1 - done / steps)
            done += 1
            own = ids[firsts[d] : firsts[d + 1]]
            emb = embed(own, vectors)
            values, places = np.zeros(total, np.float32), []
            for k, w in enumerate(params.widths):
                m = max(1, len(own) - w + 1)
                acts = np.zeros((m, params.filters), np.float32)
                for j in range(w):
                    part = emb[j : j + m] @ filters[k][j]
                    acts[: len(part)] += part
                best = acts.argmax(0)
                places.append(best)
                values[k * params.filters : (k + 1) * params.filters] = acts[best, np.arange(params.filters)]
            values += bias
            live = values > 0
            p = 1 / (1 + np.exp(-np.clip(values[live] @ layer[live] + offset, -30, 30)))
            g = np.float32((p - labels[d]) * min(share[int(labels[d])], 5.0))
            back = np.where(live, g * layer, 0).astype(np.float32)
            layer[live] -= rate * g * values[live]
            offset -= rate * float(g)
            bias -= rate * back
            for k, w in enumerate(params.widths):
                gk = back[k * params.filters : (k + 1) * params.filters]
                for j in range(w):
                    at = places[k] + j
                    ok = (at < len(own)) & (gk != 0)
                    if not ok.any():
                        continue
                    grad_vectors = gk[ok, None] * filters[k][j][:, ok].T
                    filters[k][j][:, ok] -= rate * (emb[at[ok]] * gk[ok, None]).T
                    for c in range(own.shape[1]):
                        bucket = own[at[ok], c]
                        has = bucket >= 0
                        np.subtract.at(vectors, bucket[has], rate * grad_vectors[has])
    model = ToxicityModel(params, vectors, filters, bias, layer, float(offset), trained=True)
    tables = model.tables()
    out = np.flatnonzero((np.arange(n) % 5 == 0) & (np.diff(firsts) > 0))
    p = np.zeros(n)
    for d in out:
        p[d] = probability(ids[firsts[d] : firsts[d + 1]], np.array([0, firsts[d + 1] - firsts[d]]), model, tables)[0]
    default, own = cut(p[out], labels[out]), {}
    for name in sorted({langs[d] for d in out if langs[d]}):
        mine = np.array([d for d in out if langs[d] == name])
        # A language without held-out documents of both kinds takes the threshold of all.
        if len(np.unique(labels[mine])) == 2:
            own[name] = cut(p[mine], labels[mine])
    return ToxicityModel(params, vectors, filters, bias, layer, float(offset), own, default, True)


def cut(p: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the best F1; 0.5 without documents of both kinds."""
    if len(np.unique(labels)) < 2:
        return 0.5
    values = np.unique(p)
    cuts = np.concatenate([(values[1:] + values[:-1]) / 2, [0.5]])
    toxic, clean = np.sort(p[labels == 1]), np.sort(p[labels == 0])
    hit = len(toxic) - np.searchsorted(toxic, cuts)
    wrong = len(clean) - np.searchsorted(clean, cuts)
    f1 = 2 * hit / np.maximum(1, len(toxic) + hit + wrong)
    best = np.flatnonzero(f1 == f1.max())
    return float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Trains on at most ``params.train_rows`` rows of ``labels`` (doc_id, toxic 0/1) that meet a text in ``docs``.

    Null keys, labels and texts aren't used, repeated labels all count. Without
    labelled documents of both classes nothing is called toxic.
    """
    chosen = sampled(labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("_toxic")), "doc_id", params.train_rows)
    rows = (
        docs.select("doc_id", F.col("text").alias("_text"), F.col("lang").alias("_lang")).filter(F.col("_text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # the sample is bounded by train_rows
        .select("doc_id", "_toxic", "_lang", "_text")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("_toxic", "ascending"), ("_text", "ascending")])
    )
    text = rows["_text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return train(text, rows["_lang"].to_pylist(), rows["_toxic"].to_numpy().astype(np.int64), params)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, lang, score (probability of toxicity) and toxic of every row, by its whole text.

    A null or wordless text has score 0 and isn't toxic; a null or unknown
    language, and one whose held-out rows were all of one class, takes the threshold of all languages together. Null ids and
    repeated rows pass through; other columns are left out. Ids are whole numbers; others are cast to them.
    """
    tables, params = model.tables(), model.params

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = X.strings(batch.column(2))
            p = np.zeros(len(batch))
            for a, b in X.blocks(offsets):
                ids, firsts = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params)
                p[a:b] = np.where(np.diff(firsts) > 0, probability(ids, firsts, model, tables), 0)
            limits = np.array([model.thresholds.get(x, model.default) for x in batch.column(1).to_pylist()])
            toxic = (p >= limits) & (p > 0) & model.trained
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(toxic)], ["doc_id", "lang", "score", "toxic"])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), scored, "doc_id long, lang string, score double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and whether it passes its language's threshold."""
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
