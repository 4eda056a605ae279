"""The corpus queries over the smallest tables: against their SQL, or row by row against plain versions."""

import collections
import math
import re

import numpy as np
import pytest
import tiktoken
from sqlcheck import SF, connection, same_rows
from test_dedup import groups_of, sketch_of
from test_models import naive_bag, naive_features, naive_pool

from lodestar.llm import _tokens, catalogue, quality, simhash, toxicity, urlfilter

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def texts(spark, name="documents", key="doc_id", value="text"):
    return {r[key]: r[value] for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert same_rows(QUERIES[name](spark, SF), connection(), SQL[name]) > 0


def test_url_filter(spark):
    """Scores by string methods, plain counts and a walk through each tree."""
    urls = texts(spark, "pages", "page_id", "url")
    host = {k: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", u)[: re.search(r"[/?#:]|$", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", u)).start()].lower() for k, u in urls.items()}
    suffix = {k: ".".join(h.split(".")[-2:]) for k, h in host.items()}
    pages = collections.Counter(suffix.values())
    hosts = collections.Counter(s for s, _ in {(suffix[k], host[k]) for k in urls})
    named = urlfilter.with_suffix(spark.read.parquet(f"{SF}/pages.parquet"), urlfilter.UrlParams())
    model = urlfilter.fit_urls(named.withColumn("label", urlfilter.listed()))
    got = {r["page_id"]: r for r in QUERIES["op3_url_filter"](spark, SF).collect()}
    assert set(got) == set(urls)
    for k, u in urls.items():
        x = [*naive_features(u), math.log1p(pages[suffix[k]]), math.log1p(hosts[suffix[k]]), pages[suffix[k]] / hosts[suffix[k]]]
        logit = model.base
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (x[feature[node]] > limit[node])
            logit += leaf[node - len(feature)]
        p = 1 / (1 + math.exp(-logit))
        assert got[k]["score"] == pytest.approx(p, abs=1e-9) and got[k]["blocked"] == (p >= 0.5)


def test_url_filter_on_hosts_it_has_not_seen(spark):
    named = urlfilter.with_suffix(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), urlfilter.UrlParams()).withColumn("label", urlfilter.listed())
    model = urlfilter.fit_urls(named.filter("pmod(xxhash64(_host), 5) <> 0"))
    held = named.filter("pmod(xxhash64(_host), 5) = 0")
    truth = {r["page_id"]: r["label"] for r in held.collect()}
    right = [r["blocked"] == bool(truth[r["page_id"]]) for r in urlfilter.score_urls(held, model).collect()]
    assert len(right) >= 30 and np.mean(right) >= 0.8


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fold, own = model.folded(), texts(spark)
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, SF).collect()}
    assert set(got) == set(own)
    for k, t in own.items():
        want = fold[naive_bag(t, model.params)].mean() if t and t.strip() else None
        assert got[k]["score"] == (None if want is None else pytest.approx(want, abs=1e-9))
        assert got[k]["keep"] == (want is not None and want >= model.threshold)


def test_token_index(spark):
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=_tokens.load(), special_tokens={})
    own = texts(spark)
    got = {r["doc_id"]: r for r in QUERIES["op7_token_index"](spark, SF).collect()}
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(reference.encode_ordinary(t or "")) for k, t in own.items()}
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["bucket"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Within a shard the runs of ids lie one after the other.
    for shard in {r["shard"] for r in got.values()}:
        runs = sorted((r["start"], r["n_tokens"]) for r in got.values() if r["shard"] == shard)
        assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:], strict=False))


def test_toxicity(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    for r in rows.collect():
        words = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        if not words:
            assert (got[r["doc_id"]]["score"], got[r["doc_id"]]["toxic"]) == (0, False)
            continue
        z = np.maximum(naive_pool(words, model), 0) @ model.layer + model.offset
        p = 1 / (1 + math.exp(-z))
        assert got[r["doc_id"]]["score"] == pytest.approx(p, abs=1e-4)
        limit = model.thresholds.get(r["lang"], model.default)
        assert abs(p - limit) < 1e-4 or got[r["doc_id"]]["toxic"] == (p >= limit)


def test_simhash(spark):
    own, radius = texts(spark), simhash.SimHashParams().radius
    keys = sorted(own)
    sketches = sketch_of([own[k] for k in keys])
    near = [(i, j) for j in range(len(keys)) for i in range(j) if sketches[i] is not None and sketches[j] is not None and (sketches[i] ^ sketches[j]).bit_count() <= radius]
    want = groups_of(near, len(keys))
    got = {r["doc_id"]: r for r in QUERIES["op9_simhash_dedup"](spark, SF).collect()}
    assert set(got) == set(keys) and len(near) > 5
    # All links lead to one group; what brute force leaves apart stays apart.
    assert sum(got[keys[i]]["group_id"] == got[keys[j]]["group_id"] for i, j in near) >= 0.95 * len(near)
    place = {k: i for i, k in enumerate(keys)}
    assert all(want[place[k]] == want[place[r["group_id"]]] for k, r in got.items())


def test_bpe(spark):
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=_tokens.load(), special_tokens={})
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, SF).collect()}
    for k, t in texts(spark).items():
        assert got[k]["ids"] == (None if t is None else reference.encode_ordinary(t)) and got[k]["round_trip"] is not False
