"""URL filters: gradient-boosted trees on lexical features of labelled URLs.

Features are lengths, depth, digit ratio, entropies, parameter counts and, from
all URLs of the table, how many pages and hosts share the host's suffix (its
last two labels). Trees are grown in numpy on quantile bins with logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm._spark import over_arrow, read, scratch

FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_hyphens", "host_entropy", "entropy", "parameters", "fragment", "secure", "upper_ratio", "mark_ratio", "suffix_pages", "suffix_hosts", "pages_a_host")


@dataclass(frozen=True)
class UrlParams:
    """``train_rows`` bounds the labelled URLs of each class that are fitted; the rest shape the trees."""

    train_rows: int = 10_000
    trees: int = 40
    depth: int = 4
    bins: int = 32
    rate: float = 0.3
    smooth: float = 1.0
    #: Suffixes beyond this many are joined by a shuffle instead of a broadcast.
    broadcast_rows: int = 200_000


@dataclass(frozen=True)
class Trees:
    """Complete trees: feature and limit of each inner node, value of each leaf."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.min(initial=inner) < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out


def grow(x: np.ndarray, y: np.ndarray, params: UrlParams = UrlParams()) -> Trees:
    """Boosts complete trees of ``params.depth`` levels; a node without a gain sends all rows left."""
    inner, leaves = 2**params.depth - 1, 2**params.depth
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if len(y) == 0 or len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, params.bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    width = params.bins
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    score = np.zeros(len(y))
    features, limits, values = [], [], []
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = balance * (p - y), balance * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(params.depth):
            first, n = 2**level - 1, 2**level
            own = node - first
            best = np.full(n, 1e-6)
            for k, e in enumerate(edges):
                if len(e) == 0:
                    continue
                key = own * width + binned[:, k]
                sg = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                sh = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + params.smooth) + (tg - sg) ** 2 / (th - sh + params.smooth) - tg**2 / (th + params.smooth)
                at = gain[:, : len(e)].argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best = np.where(better, top, best)
                feature[first : first + n][better] = k
                limit[first : first + n][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        value = -params.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + params.smooth)
        score += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), 0.0)


def _entropy(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Bits of each run of byte values."""
    n = len(firsts) - 1
    size = np.diff(firsts)
    counts = np.bincount(np.repeat(np.arange(n), size) * 256 + codes, minlength=n * 256).reshape(n, 256)
    p = counts / np.maximum(size, 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def lexical(urls: pa.Array, pages: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """The features of a batch of URLs; ``pages`` and ``hosts`` are the suffix's counts. Null URLs count as empty."""
    data, offsets, _ = X.strings(urls)
    n = len(offsets) - 1
    if n == 0:
        return np.zeros((0, len(FEATURES)))
    size = np.diff(offsets)
    count = lambda mark: X.total(mark, offsets)
    # Where host, path, query and fragment begin: by the first mark of each kind.
    ends = offsets[1:]

    def first(mark: np.ndarray, start: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mark)
        k = np.searchsorted(at, start)
        found = np.append(at, len(data))[k]
        return np.minimum(found, ends)

    slash, colon = data == 47, data == 58
    scheme = np.zeros(len(data), bool)
    if len(data) > 2:
        scheme[:-2] = colon[:-2] & slash[1:-1] & slash[2:]
    at = first(scheme, offsets[:-1])
    host = np.where(at < ends, np.minimum(at + 3, ends), offsets[:-1])
    stop = (data == 47) | (data == 63) | (data == 35) | colon
    path = first(stop, host)
    query = first((data == 63) | (data == 35), path)
    fragment = first(data == 35, query)
    within = lambda mark, a, b: np.concatenate([[0], np.cumsum(mark)])[b] - np.concatenate([[0], np.cumsum(mark)])[a]
    digits = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    hosted = np.repeat(host, size) <= np.arange(len(data))
    hosted &= np.arange(len(data)) < np.repeat(path, size)
    host_bytes = data[hosted]
    host_firsts = np.concatenate([[0], np.cumsum(path - host)])
    return np.stack(
        [
            size, path - host, query - path, within(slash, path, query), within(data == 46, host, path) + 1, count(digits) / np.maximum(size, 1), within(data == 45, host, path),
            _entropy(host_bytes, host_firsts), _entropy(data, offsets), within(data == 61, query, fragment), fragment < ends, (at - offsets[:-1]) == 5, count(upper) / np.maximum(size, 1), count(~(digits | upper | lower)) / np.maximum(size, 1),
            np.log1p(pages), np.log1p(hosts), pages / np.maximum(hosts, 1),
        ],
        1,
    ).astype(np.float64)


def with_suffix(pages: DataFrame, params: UrlParams) -> DataFrame:
    """page_id, url and the counts of pages and of hosts that share the host's suffix, over all rows."""
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)", 1))
    named = pages.select("page_id", "url", host.alias("_host")).withColumn("_suffix", F.coalesce(F.substring_index("_host", ".", -2), F.lit("")))
    # Hosts first: so a suffix with most of the pages is counted in parts.
    stats = named.groupBy("_suffix", "_host").agg(F.count(F.lit(1)).alias("n")).groupBy("_suffix").agg(F.sum("n").alias("_pages"), F.count(F.when(F.col("_host") != "", 1)).alias("_hosts"))
    if stats.limit(params.broadcast_rows + 1).count() <= params.broadcast_rows:
        stats = F.broadcast(stats)
    return named.join(stats, "_suffix", "left").select("page_id", "url", "_host", F.coalesce("_pages", F.lit(0)).alias("_pages"), F.coalesce("_hosts", F.lit(0)).alias("_hosts"))


def fit_urls(labelled: DataFrame, params: UrlParams = UrlParams()) -> Trees:
    """Trains on rows (url, label 0/1, _pages, _hosts): of each class at most ``train_rows``, those of the least URL hash. Null URLs and labels aren't used."""
    usable = labelled.filter(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select("url", F.col("label").cast("int").alias("label"), "_pages", "_hosts")
    part = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(params.train_rows) for y in (0, 1)]
    rows = part[0].unionByName(part[1]).toArrow()
    if rows.num_rows == 0:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0), params)
    x = lexical(rows["url"].combine_chunks(), rows["_pages"].to_numpy(), rows["_hosts"].to_numpy())
    return grow(x, rows["label"].to_numpy().astype(np.float64), params)


def score_urls(named: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """page_id, url, score (probability that the URL is bad) and blocked of every row of ``with_suffix``.

    A null URL has a null score and isn't blocked; an empty one is scored by its
    features. Without a trained tree every score is 0.5 and nothing is blocked.
    Repeated rows and null ids pass through.
    """
    trained = len(model.feature) > 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1)
            p = 1 / (1 + np.exp(-model.logits(lexical(urls, batch.column(2).to_numpy(), batch.column(3).to_numpy())).clip(-40, 40)))
            no = ~np.asarray(urls.is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(0), urls, pa.array(p, pa.float64(), mask=no), pa.array((p >= threshold) & ~no & trained)], ["page_id", "url", "score", "blocked"])

    return over_arrow(named.select("page_id", "url", "_pages", "_hosts"), scored, "page_id long, url string, score double, blocked boolean")


#: Words of hosts on the list that labels the URLs here, for want of labels in the tables: a part of a host's name that is one of them makes it bad.
LISTED = ("adult", "casino", "bets", "pills", "spam", "ads")


def listed(host: str = "_host"):
    """1 where a part of the host's name is on the list, else 0."""
    return F.exists(F.split(F.col(host), r"[.\-]"), lambda part: part.isin(*LISTED)).cast("int")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL score; the labels of the URLs that are fitted come from a list of host words."""
    place = scratch(spark, "urls")
    with_suffix(read(spark, sf_dir, "pages"), UrlParams()).write.parquet(place)  # counted once for labels, training and scores
    named = spark.read.parquet(place)
    return score_urls(named, fit_urls(named.withColumn("label", listed())))
