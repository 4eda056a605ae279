"""Classifiers, URL filter and chat formatting: held-out accuracy and naive versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm import chat, quality, toxicity, urlfilter

GOOD = "river mountain careful window garden letter evening science reading teacher".split()
BAD = "clickhere subscr1be fr33 buynow zzzqq xxkk lolol winwin jackpotz qqqzz".split()
EDGES = [None, "", "   \n", "word", "ß" * 50, "tail \x00 zero", "w " * 50_000]


def texts_of(rng, n):
    return [(" ".join(rng.choice(GOOD if (good := i % 2) else BAD) for _ in range(rng.randint(5, 60))), good) for i in range(n)]


def test_quality(spark):
    rng = random.Random(1)
    own = texts_of(rng, 500)
    rows = [(i, t, "en") for i, (t, _) in enumerate(own)] + [(1000 + i, t, "en") for i, t in enumerate(EDGES)] + [(None, own[1][0], None), (1, own[1][0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("keep", F.lit(3)).withColumn("quality", F.lit(9))
    labels = spark.createDataFrame([(i, g, 0) for i, (_, g) in enumerate(own[:300])] + [(None, 1, 0), (3, None, 0), (7777, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = {}
    for r in quality.score_quality(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    right = [got[i][0]["keep"] == bool(g) for i, (_, g) in enumerate(own[300:], 300)]
    assert np.mean(right) > 0.97 and model.held_out > 0.97
    assert len(got) == len(own) + len(EDGES) + 1 and len(got[1]) == 2 and got[None][0]["keep"]
    assert all(got[1000 + i][0]["score"] is None and not got[1000 + i][0]["keep"] for i in range(3))
    # Scores are the average over a document's features, whichever batch it is in.
    fold = model.folded()
    for i in range(0, 40, 7):
        data = np.frombuffer(own[i][0].encode(), np.uint8)
        ids = np.concatenate([f for f, _ in quality.features(data, np.array([0, len(data)]), model.params)])
        assert got[i][0]["score"] == pytest.approx(fold[ids].mean())
    kept = quality.score_quality(docs, model, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for rs in got.values() for r in rs)
    for only in (0, 1):
        one = quality.fit_quality(docs, labels.filter(f"quality = {only}"))
        assert quality.score_quality(docs, one).filter("not keep").count() == 3
    none = quality.fit_quality(docs, labels.filter("false"))
    assert quality.score_quality(docs, none).filter("keep").count() == docs.filter("trim(text) <> '' and doc_id is null or doc_id < 1000 or doc_id > 1002").count()
    assert quality.score_quality(docs.filter("false"), model).count() == 0


M64 = (1 << 64) - 1


def naive_mix(x, salt=0):
    x = (x + 0x9E3779B97F4A7C15 * (salt + 1)) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def naive_hash(s):
    return naive_mix(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(s)) & M64)


def naive_bag(text, params):
    """The buckets of a text, one after the other, by string methods."""
    mask, words = params.buckets - 1, re.findall(r"[^\t\n\x0b\f\r ]+", text)
    out = [naive_hash(w) & mask for w in words] + [mask for a, b in zip(words, words[1:], strict=False) if a == b] + [mask - 1] * params.ends
    padded = " " + re.sub(r"[\t\n\x0b\f\r ]", " ", text) + " "
    for n in params.grams:
        grams = [padded[k : k + n] for k in range(len(padded) - n + 1)]
        out += [naive_mix(naive_hash(g), n) & mask for g in grams if " " not in g[1:-1]]
    return out


def test_quality_features():
    """Words and n-grams of code points against string methods, also where texts share a block."""
    params = quality.QualityParams()
    texts = ["a bb bb  ccc", "", "naïve café 東京タワー", " \n", "ß", "x\ty", "\U0001f600\U0001f600 ü", "plain only"]
    for own in (texts, ["plain only", "more plain words"]):
        data, offsets, _ = X.strings(pa.array(own))
        found = list(quality.features(data, offsets, params))
        for d, t in enumerate(own):
            assert sorted(np.concatenate([ids[f[d] : f[d + 1]] for ids, f in found]).tolist()) == sorted(naive_bag(t, params)), t


def test_quality_training_step_by_step():
    """The vectors and the layer after training, against plain loops over features."""
    params = quality.QualityParams(buckets=64, dim=3, epochs=2, grams=(3,), ends=1)
    rng = random.Random(2)
    own = texts_of(rng, 12)
    labels = np.array([g for _, g in own])
    model = quality.train(pa.array([t for t, _ in own]), labels, params)
    rng = np.random.default_rng(params.seed)
    vectors = rng.uniform(-1, 1, (64, 3)) / 3
    layer = np.zeros((3, 2))
    fit = [d for d in range(12) if d % 5]
    share = [sum(labels[d] == y for d in fit) / len(fit) for y in (0, 1)]
    done = 0
    for _ in range(2):
        for d in rng.permutation(fit):
            rate, y = params.rate * (1 - done / (2 * len(fit))), labels[d]
            done += 1
            bag = naive_bag(own[d][0], params)
            mean = sum(vectors[i] for i in bag) / len(bag)
            logits = [sum(mean[k] * layer[k][c] for k in range(3)) for c in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
            back = [0.5 / share[y] * (p[c] - (c == y)) for c in (0, 1)]
            step = {i: rate * len(set(bag)) * min(bag.count(i) / len(bag), 4 / len(set(bag))) * (layer[:, 0] * back[0] + layer[:, 1] * back[1]) for i in set(bag)}
            for c in (0, 1):
                layer[:, c] -= rate * mean * back[c]
            for i, x in step.items():
                vectors[i] -= x
    assert np.allclose(model.layer, layer, atol=1e-4) and np.allclose(model.vectors, vectors, atol=1e-4)


def naive_pool(words, model):
    """Each filter over each window of words, one after the other."""
    ids, firsts = toxicity.tokens(*X.strings(pa.array([" ".join(words)]))[:2], model.params)
    emb = toxicity.embed(ids, model.vectors)
    out = []
    for w, own in zip(model.params.widths, model.filters, strict=True):
        span = max(1, len(emb) - w + 1)
        acts = [sum(emb[k + j] @ own[j] for j in range(w) if k + j < len(emb)) for k in range(span)]
        out.append(np.max(acts, axis=0))
    return np.concatenate(out) + model.bias


def test_toxicity(spark):
    rng = random.Random(3)
    plain, slur = [f"common{i}" for i in range(60)], ["vilename", "nastyslur", "hateword"]
    own = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        if toxic := int(i % 4 == 0):
            words[rng.randrange(len(words))] = rng.choice(slur)
        own.append((" ".join(words), toxic, rng.choice(["en", "fr"])))
    rows = [(i, t, g) for i, (t, _, g) in enumerate(own)] + [(2000 + i, t, None) for i, t in enumerate(EDGES)] + [(None, own[0][0], "en"), (0, own[0][0], "xx"), (0, own[0][0], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t, _) in enumerate(own[:600])] + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert set(model.thresholds) == {"en", "fr"}
    got = {}
    for r in toxicity.score_toxicity(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert np.mean([got[i][0]["toxic"] == bool(t) for i, (_, t, _) in enumerate(own[600:], 600)]) > 0.97
    assert len(got[0]) == 3 and got[None][0]["toxic"] and all(not got[2000 + i][0]["toxic"] and got[2000 + i][0]["score"] == 0 for i in range(3))
    tables = model.tables()
    for words in (["a"], ["vilename"], own[1][0].split(), own[4][0].split()[:2]):
        data, offsets, _ = X.strings(pa.array(["x y z", " ".join(words), ""]))
        ids, firsts = toxicity.tokens(data, offsets, model.params)
        assert np.allclose(toxicity.pooled(ids, firsts, model, tables)[1], naive_pool(words, model), atol=1e-4)
    # A language with held-out rows of one class takes the threshold of all, and so does a null one among the labels.
    half = toxicity.train(pa.array([t for t, _, _ in own[:600]]), ["en" if t or i % 3 else None if i % 2 else "fr" for i, (_, t, _) in enumerate(own[:600])], np.array([t for _, t, _ in own[:600]]))
    assert set(half.thresholds) == {"en"} and 0 < half.default < 1
    none = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"))
    assert toxicity.score_toxicity(docs, none).filter("toxic").count() == 0 and toxicity.score_toxicity(docs.filter("false"), model).count() == 0


def naive_trees(x, y, params):
    """Boosted trees by loops over rows, features and limits."""
    limits = [sorted({float(np.quantile(x[:, k], q)) for q in np.linspace(0, 1, params.bins + 1)[1:-1]}) for k in range(x.shape[1])]
    weight = [0.5 / y.mean() if v else 0.5 / (1 - y.mean()) for v in y]
    score, trees = [0.0] * len(y), []
    for _ in range(params.trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [w * (a - b) for w, a, b in zip(weight, p, y, strict=True)]
        h = [w * a * (1 - a) for w, a in zip(weight, p, strict=True)]
        at, inner = [0] * len(y), {}
        for level in range(params.depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = [i for i in range(len(y)) if at[i] == node]
                worth = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + params.smooth)
                best = (1e-6, 0, math.inf)
                for k, own in enumerate(limits):
                    for limit in own:
                        left, right = [i for i in rows if x[i, k] <= limit], [i for i in rows if x[i, k] > limit]
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, k, limit)
                inner[node] = best[1:]
                for i in rows:
                    at[i] = 2 * node + 1 + (x[i, best[1]] > best[2])
        values = {}
        for leaf in range(2**params.depth - 1, 2 ** (params.depth + 1) - 1):
            rows = [i for i in range(len(y)) if at[i] == leaf]
            values[leaf] = -params.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + params.smooth)
            for i in rows:
                score[i] += values[leaf]
        trees.append((inner, values))
    return score, trees


def test_trees_against_loops():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    params = urlfilter.UrlParams(trees=3, depth=2, bins=6)
    model = urlfilter.grow(x, y, params)
    score, trees = naive_trees(x, y, params)
    assert np.allclose(model.logits(x), score)
    for k, (inner, values) in enumerate(trees):
        assert [(int(f), float(t)) for f, t in zip(model.feature[k], model.limit[k], strict=True)] == [inner[n] for n in range(3)]
        assert np.allclose(model.leaf[k], [values[n] for n in range(3, 7)])


def naive_features(url):
    """The features of a URL's own text, by string methods."""
    rest = url.split("://", 1)[1] if "://" in url else url
    host = rest
    for c in "/?#:":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    query = rest[len(host) + len(path) :].split("#", 1)[0]

    def entropy(s):
        p = np.array([s.count(c) for c in set(s)]) / max(1, len(s))
        return float(-(p * np.log2(p)).sum()) if len(s) else 0.0

    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / max(1, len(url)), host.count("-"), entropy(host), entropy(url), query.count("="), float("#" in rest), float(url.startswith("https://")), sum("A" <= c <= "Z" for c in url) / max(1, len(url)), sum(not c.isalnum() for c in url) / max(1, len(url))]


def test_url_filter(spark):
    rng = random.Random(6)
    urls = []
    for i in range(800):
        bad = i % 2
        host = f"{rng.choice(['win', 'hot', 'spin'])}{rng.randint(10, 9999)}-{rng.choice(['casino', 'pills'])}.{rng.choice(['xyz', 'top'])}" if bad else f"www.{rng.choice(['library', 'museum', 'school'])}.{rng.choice(['org', 'edu'])}"
        urls.append((f"http://{host}/{rng.randint(1, 10**9)}?a={i}&b=2&c=3" if bad else f"https://{host}/articles/{rng.choice(['art', 'history'])}", bad))
    edges = [None, "", "x", "http://", "https://h:80/p?q=1#f", "ftp://ü.de/é?=", "/only/path", "a" * 50_000, "http://h.com?x=1&y=2", "h.com/a?b=c#d=e"]
    rows = [(i, u, "h") for i, (u, _) in enumerate(urls)] + [(5000 + i, u, None) for i, u in enumerate(edges)] + [(None, urls[1][0], "h"), (1, urls[1][0], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("score", F.lit("clash"))
    named = urlfilter.with_suffix(pages, urlfilter.UrlParams())
    assert named.count() == len(rows)
    counts = {r["url"]: (r["_pages"], r["_hosts"]) for r in named.filter("page_id < 5000").collect()}
    ends = [u.split("/")[2].split(".")[-2:] for u, _ in urls] + [urls[1][0].split("/")[2].split(".")[-2:]] * 2
    for u, _ in urls[:20]:
        assert counts[u][0] == ends.count(u.split("/")[2].split(".")[-2:])
    truth = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "page_id long, label int")
    small = named.withColumn("label", F.col("page_id")).join(truth.filter("page_id < 400").withColumnRenamed("label", "y"), "page_id").withColumn("label", F.col("y"))
    model = urlfilter.fit_urls(small)
    got = {}
    for r in urlfilter.score_urls(named, model).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert np.mean([got[i][0]["blocked"] == bool(b) for i, (_, b) in enumerate(urls[400:], 400)]) > 0.97
    assert got[5000][0]["score"] is None and not got[5000][0]["blocked"] and len(got[1]) == 2 and got[None][0]["blocked"]
    known = [e for e in edges if e is not None]
    x = urlfilter.lexical(pa.array(known), np.ones(len(known)), np.ones(len(known)))
    for row, e in zip(x, known, strict=True):
        if e.isascii() and e not in ("http://",):
            assert np.allclose(row[:14], naive_features(e)), e
    untrained = urlfilter.fit_urls(small.filter("label = 1"))
    assert urlfilter.score_urls(named, untrained).filter("blocked or score <> 0.5").count() == 0
    assert urlfilter.score_urls(named.filter("false"), model).count() == 0
    tree = urlfilter.Trees(np.array([[0, 1, 1]]), np.array([[1.0, 5.0, 7.0]]), np.array([[1.0, 2.0, 3.0, 4.0]]), 0.5)
    assert tree.logits(np.array([[0, 0], [0, 6], [2, 7], [2, 8]], float)).tolist() == [1.5, 2.5, 3.5, 4.5]


def naive_fold(events):
    """One event after the other."""
    seen, log = set(), []
    for e in events:
        if None in (e[0], e[1], e[2]) or e[3] not in chat.KINDS or e in seen:
            continue
        seen.add(e)
        log.append(e)
    out = {}
    for conv in {e[0] for e in log}:
        own = [e for e in log if e[0] == conv]
        live = [e for e in own if not any(o[3] in chat.REWRITES and o[1] < e[1] and o[2] >= e[2] for o in own)]
        for turn in {e[1] for e in live}:
            mine = [e for e in live if e[1] == turn]
            resets = [(e[2], e[3], e[5] or "") for e in mine if e[3] in chat.RESETS]
            base = max(resets) if resets else None
            deltas = sorted((e[2], e[5] or "") for e in mine if e[3] == "delta" and (base is None or e[2] >= base[0]))
            roles = [(e[2], e[4]) for e in mine if e[4] is not None]
            out[conv, turn] = (max(roles)[1] if roles else "unknown", ("" if base is None or base[1] == "regenerate" else base[2]) + "".join(t for _, t in deltas))
    return out


def test_chat(spark):
    rng = random.Random(9)
    events = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice([*range(12), None]), rng.choice([*chat.KINDS, "other", None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b\n", "", None, "ü"])) for _ in range(400)]
    # A null text and an empty one are the same event.
    events = [(*e[:5], e[5] or "") if rng.random() < 0.9 else e for e in events]
    df = spark.createDataFrame(events + events[:30], "conv_id long, turn long, seq long, kind string, role string, text string").withColumn("k", F.lit(1)).withColumn("e", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(df).collect()}
    assert got == naive_fold([(*e[:5], e[5] or "") for e in events])
    shown = {r["conv_id"]: r for r in chat.render(chat.fold(df)).collect()}
    assert set(shown) == {c for c, _ in got}
    for c, r in shown.items():
        turns = sorted((t, *got[c, t]) for k, t in got if k == c)
        assert r["n_messages"] == len(turns) and r["rendered"] == "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in turns)
    assert chat.render(chat.fold(df.filter("false"))).count() == 0
    talk = spark.createDataFrame([(1, 0, "user", "hi\n\nthere"), (1, 1, "assistant", "a\nb\n"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x"), (3, 0, "assistant", "y" * 100_000)], "conv_id long, turn long, role string, text string")
    again = {(r["conv_id"], r["turn"]): r["text"] for r in chat.fold(chat.log_of(talk)).collect()}
    assert again == {(1, 0): "hi\n\nthere", (1, 1): "a\nb\n", (1, 2): "", (2, 0): "", (3, 0): "y" * 100_000}
