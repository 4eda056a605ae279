"""Near-dedup, suffix arrays, repeated passages and the pipeline against brute force."""

import itertools
import random
import time
import tracemalloc
import unicodedata

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from lodestar.llm import _induce, _tokens, decontaminate, quality, simhash, suffix
from lodestar.llm import _text as X

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def doc_rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def sketch_of(texts, lanes=simhash.SimHashParams().blocks // 2):
    """Sketches by the definition: a bit is 1 where more than half of a text's words have it."""
    out = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        hashes, _ = simhash.features(data, np.array([0, len(data)])) if len(data) else (np.zeros(0, np.uint64), None)
        if not len(hashes):
            out.append(None)
            continue
        value = 0
        for lane in range(lanes):
            bits = np.unpackbits(X.mix(hashes, 1000 + lane).view(np.uint8).reshape(-1, 8), axis=1)
            value = value << 64 | int.from_bytes(np.packbits(2 * bits.sum(0) > len(hashes)).tobytes(), "little")
        out.append(value)
    return out


def groups_of(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def near_texts(rng):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(own))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "  ", ", "]).join(copy))
    return texts


@pytest.mark.parametrize("cell", [1 << 19, 16])
def test_simhash(spark, cell):
    rng = random.Random(12)
    texts = near_texts(rng) + ["", None, "...", "same again here"] * 2 + ["z" * 60_000]
    params = simhash.SimHashParams(cell=cell)
    docs = spark.createDataFrame(doc_rows(texts), COLUMNS).repartition(3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, params).collect()}
    sketches = sketch_of(texts)
    near = [(i, j) for j in range(len(texts)) for i in range(j) if sketches[i] is not None and sketches[j] is not None and (sketches[i] ^ sketches[j]).bit_count() <= params.radius]
    assert len(near) > 50
    # Just the pairs that are near are joined, and equal texts without words.
    want = groups_of(near + [(i, j) for j in range(len(texts)) for i in range(j) if sketches[i] is None and texts[i] is not None and texts[i] == texts[j]], len(texts))
    assert [got[i]["group_id"] for i in range(len(texts))] == want
    for i, r in got.items():
        assert r["group_size"] == want.count(want[i]) and r["keep"] == (i == r["group_id"])
    kept = simhash.drop_near_duplicates(docs, params)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["keep"])


def test_simhash_words_by_unicode():
    """Words by an independent cut, character by character: case, typographic marks and scripts don't change them."""

    def words(text):
        kinds = ((c, unicodedata.category(c)[0] in "LMN") for c in text.casefold())
        return {"".join(c for c, _ in run) for solid, run in itertools.groupby(kinds, key=lambda x: x[1]) if solid}

    def hashes(texts):
        raw = [t.encode() for t in texts]
        found, firsts = simhash.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        return [set(found[a:b].tolist()) for a, b in zip(firsts, firsts[1:])]

    plain = ["élan vital à noël, déjà vu", "über straße ärger 42", "el niño soñó más", "съешь ещё этих булок", "ὁ λόγος τῆς ὁδοῦ σοφός", "हिन्दी में पाठ", "plain text only"]
    loud = [t.upper() for t in plain]
    marked = ["\u00a0".join(f"\u201c{w}\u201d\u2014" for w in t.split()) for t in plain]
    got = hashes(plain + loud + marked)
    n = len(plain)
    assert [len(g) for g in got] == [len(words(t)) for t in plain + loud + marked]
    assert got[:n] == got[n : 2 * n] == got[2 * n :]
    known = {}
    for g, w in zip(got, map(words, plain + loud + marked), strict=True):
        assert known.setdefault(frozenset(w), g) == g
    assert hashes(["\u201c \u201d\u2014\u00a0\u2026", "", "e\u0301"]) == [set(), set(), hashes(["E\u0301"])[0]]


def test_recall_by_distance(spark):
    """Pairs of words of their own, so no other text can tie them: all are found in each band up to the radius."""
    rng = random.Random(31)
    texts = []
    for i in range(1500):
        n = rng.choice([rng.randint(6, 30), rng.randint(30, 90), rng.randint(90, 250)])
        own = [f"p{i}w{k}" for k in range(n)]
        texts.append(" ".join(own))
        part = rng.uniform(0, 0.25)
        texts.append(" ".join(f"q{i}w{k}" if rng.random() < part else w for k, w in enumerate(own)))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(doc_rows(texts), COLUMNS)).collect()}
    sketches = sketch_of(texts)
    bands = {}
    for i in range(0, len(texts), 2):
        d = (sketches[i] ^ sketches[i + 1]).bit_count()
        if d <= simhash.SimHashParams().radius:
            bands.setdefault(next(b for b in (35, 41, 47, 53) if d <= b), []).append(got[i + 1] == i)
    found = {b: sum(hits) / len(hits) for b, hits in sorted(bands.items())}
    assert min(map(len, bands.values())) >= 50 and min(found.values()) == 1, found


def test_upper_cased_and_typographic_copies(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("é", "ä", "ñ", "ж", "λ") for b in ("ba", "öl", "ши") for c in ("ç", "ü", "я", "n")]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(60)) for _ in range(12)]
    copies = texts + [t.upper() for t in texts] + ["\u00a0".join(f"\u00ab{w}\u00bb\u2013" for w in t.split()) for t in texts]
    docs = spark.createDataFrame(doc_rows(copies), COLUMNS)
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()} == {i: i % 12 for i in range(36)}


def test_simhash_odd_rows(spark):
    rows = [(None, "one two three", "a"), (None, "one two three", "b"), (5, "one two three", "c"), (5, "one two three", "c"), (7, "unlike all others", "d"), (7, None, "e"), (None, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame([(*r, 1, True, "x") for r in rows], "doc_id long, text string, _row string, _n int, keep boolean, group_id string")
    r = simhash.near_duplicates(docs)
    assert r.count() == 8 and r.filter("keep and group_size = 4").count() == 1
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted((x["doc_id"] or -1, x["_row"]) for x in left.collect()) == [(-1, "f"), (5, "c"), (7, "d"), (7, "e"), (8, "g")]
    only = docs.filter("doc_id is null and text is not null")
    assert [x["group_id"] for x in simhash.near_duplicates(only).collect()] == [None, None] and simhash.drop_near_duplicates(only).count() == 1
    assert simhash.near_duplicates(docs.filter("false")).count() == 0 and simhash.drop_near_duplicates(docs.filter("false")).count() == 0


@pytest.mark.parametrize("high", [0, 1, 4, 9])
def test_cells_and_meeting(spark, high):
    """All pairs within the radius meet in some cell, no others are joined, and a bucket whose first node is unlike the rest loses none."""
    rng = random.Random(3 + high)
    params = simhash.SimHashParams(blocks=2, radius=6)
    rows = []
    for k in range(400):
        old = rng.choice(rows)[1] if rows and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 9])):
            old ^= 1 << rng.randrange(64)
        rows.append((k, old))
    signed = [(k, s - (1 << 64) if s >> 63 else s) for k, s in rows]
    nodes = spark.createDataFrame(signed, "node long, s0 long")
    joined = groups_of([tuple(r) for r in simhash.links(nodes, params, high).collect()], 400)
    near = [(i, j) for j in range(400) for i in range(j) if (rows[i][1] ^ rows[j][1]).bit_count() <= 6]
    assert len(near) > 100 and joined == groups_of(near, 400)
    value = np.arange(3, dtype=np.uint64) << simhash.X.U(8)
    assert simhash.shared(value, np.ones(3, bool), 0)[0].tolist() != [] and simhash.meet(value, np.ones(3, bool), value[:, None], 0, 2).tolist() == [0, 0, 0]


def test_links_at_the_radius(spark):
    """Pairs of random sketches that differ in 53 bits spread evenly, no fingerprint within two bits; each pair on its own, none lost."""
    rng = random.Random(53)
    params = simhash.SimHashParams()
    rows = []
    for k in range(60):
        old = [rng.getrandbits(32) for _ in range(params.blocks)]
        offs = [5] * 5 + [4] * 7 if k % 2 else [3] * 3 + [5] * 8 + [4]
        rng.shuffle(offs)
        new = [v ^ sum(1 << b for b in rng.sample(range(32), n)) for v, n in zip(old, offs, strict=True)]
        for node, own in ((2 * k, old), (2 * k + 1, new)):
            rows.append((node, *(int(x) for x in np.array(own, np.uint32).view(np.int64))))
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{s} long" for s in params.words()))
    for high in (0, 3):
        assert {tuple(sorted(r)) for r in simhash.links(nodes, params, high).collect()} == {(2 * k, 2 * k + 1) for k in range(60)}


def test_many_with_one_fingerprint():
    """Items of several rows that aren't all near: every pair of rows of two items is verified."""
    rng = np.random.default_rng(7)
    value = rng.integers(0, 3, 300).astype(np.uint64)
    sketch = np.stack([value, X.U(1) << rng.integers(0, 60, 300).astype(np.uint64)], 1)
    for high in (0, 28):
        label = simhash.meet(value, np.ones(300, np.int8), sketch, high, 2)
        near = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(2) <= 2
        assert label.tolist() == groups_of(np.argwhere(near).tolist(), 300)


def test_large_cell_in_parts():
    rng = np.random.default_rng(5)
    value = rng.integers(0, 1 << 20, 150_000).astype(np.uint64)
    sketch = np.stack([value, np.zeros_like(value)], 1)
    label = simhash.meet(value, np.ones(len(value), bool), sketch, 0, 0)
    _, want = np.unique(value, return_inverse=True)
    first = np.full(want.max() + 1, len(value))
    np.minimum.at(first, want, np.arange(len(value)))
    assert (label == first[want]).all()


@pytest.mark.parametrize(("memory", "most"), [(16 << 20, 500_000), (64, 64), (2000, 50)])
@pytest.mark.parametrize("cap", [200, 300])
def test_suffix_order(tmp_path, memory, most, cap):
    rng = np.random.default_rng(7)
    for n, letters in ((1, 1), (2, 1), (30, 1), (50, 2), (300, 3), (700, 50), (600, 1)):
        t = rng.integers(0, letters, n)
        if n == 700:
            t = np.concatenate([t, t[:400], t[100:300]])
        scratch = _induce.Scratch(str(tmp_path), memory, most)
        order, lcp = _induce.order_of(t, scratch, cap)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert order.tolist() == want
        for k in range(1, len(t)):
            a, b = t[want[k - 1] :], t[want[k] :]
            m = min(len(a), len(b))
            same = int(np.argmin(np.append(a[:m] == b[:m], False)))
            assert lcp[k] == min(same, cap)
        scratch.close()
    assert not list(tmp_path.iterdir())


def test_shard_larger_than_memory(tmp_path):
    """A string of ten times the bytes that an array may hold is sorted within a bound on all memory, its queues on disk."""
    rng = np.random.default_rng(2)
    t = rng.integers(0, 20_000, 400_000)
    t[200_000:260_000] = t[:60_000]
    scratch = _induce.Scratch(str(tmp_path), t.nbytes // 10, 20_000)
    tracemalloc.start()
    order, lcp = _induce.order_of(t, scratch, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * t.nbytes and scratch.spilled > len(t)
    whole, same = _induce.order_of(t, None, 50)
    assert (order == whole).all() and (lcp == same).all() and (lcp == 50).sum() == 60_000 - 49
    scratch.close()


def brute_repeats(rows, n):
    """(marks: (row, first word, word after the last, keeper)) of rows (doc_id, text) in order; and the windows that are marked."""
    first, marked = {}, {}
    leaders = {}
    for k, (doc, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        if text is not None:
            leaders.setdefault(text, k)
    for text, k in sorted(leaders.items(), key=lambda x: (rows[x[1]][0] is None, rows[x[1]][0] or 0)):
        words = text.split(" ")
        for i in range(len(words) - n + 1):
            key = tuple(words[i : i + n])
            if key in first:
                marked.setdefault((k, first[key]), []).append(i)
            else:
                first[key] = k
    spans = []
    for (k, keeper), places in marked.items():
        a = places[0]
        for x, y in zip(places, places[1:] + [None], strict=True):
            if y is None or y > x + n:
                spans.append((rows[k][0], rows[keeper][0], a, x + n))
                a = y
    for k, (doc, text) in enumerate(rows):
        if text is not None and leaders[text] != k and len(text.split(" ")) >= n:
            spans.append((doc, rows[leaders[text]][0], 0, len(text.split(" "))))
    return spans


def passages(rng, docs=70, n=6):
    words = [f"t{i}" for i in range(30)]
    shared = [[rng.choice(words) for _ in range(rng.randint(n, 3 * n))] for _ in range(8)]
    texts = []
    for _ in range(docs):
        own = []
        for _ in range(rng.randint(1, 4)):
            own += [rng.choice(words) for _ in range(rng.randint(0, 9))]
            if rng.random() < 0.6:
                own += rng.choice(shared)
        texts.append(" ".join(own or ["t0"]))
    return texts + [" ".join(shared[0] + shared[0] + shared[0]), "a a a a a a a a a a a a", texts[3], texts[3], " ".join(words[:4])]


@pytest.mark.parametrize(("shard_words", "memory"), [(1_000_000, 16 << 20), (300, 16 << 20), (1_000_000, 400)])
def test_repeated_passages(spark, shard_words, memory):
    rng = random.Random(21)
    texts = passages(rng)
    params = suffix.SuffixParams(words=6, gram=3, shard_words=shard_words, queue=500, memory=memory)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(doc_rows(texts), COLUMNS).repartition(3)
    got = sorted(tuple(r) for r in suffix.repeated_passages(docs, params).collect())
    assert got == sorted(brute_repeats(rows, 6))
    # What is cut is the union of the marked stretches.
    cuts = {}
    for doc, _, a, b in brute_repeats(rows, 6):
        cuts.setdefault(doc, set()).update(range(a, b))
    want = {}
    for i, t in rows:
        left = [w for k, w in enumerate(t.split(" ")) if k not in cuts.get(i, ())]
        if left:
            want[i] = " ".join(left)
    kept = suffix.drop_repeats(docs, params)
    assert kept.columns == docs.columns
    out = {r["doc_id"]: r for r in kept.collect()}
    assert {i: r["text"].strip() for i, r in out.items()} == want and all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_shuffles_are_freed(spark):
    """What the steps shuffled leaves the disks with the step, not when the driver happens to collect its garbage."""
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    texts = [" ".join(f"a{i % 5}w{k}" for k in range(70)) + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(doc_rows(texts), COLUMNS).repartition(3)
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    spans, _ = suffix.marked(docs, suffix.SuffixParams())
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spans.count() == 35 and spark.conf.get(key) == setting


def test_repeated_passages_odd_rows(spark):
    params = suffix.SuffixParams(words=4, gram=2)
    rows = [(None, "a b c d e", 1), (3, "x a b c d e", 2), (3, "x a b c d e", 3), (4, None, 4), (5, "", 5), (6, "a b c", 6), (7, "a b c", 7), (8, "é\ta\nb  c d ü", 8), (9, "z " * 30_000, 9)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, _hash int, _cuts string, a int")
    got = sorted((tuple(r) for r in suffix.repeated_passages(docs, params).collect()), key=str)
    assert got == sorted([(None, 3, 0, 5), (3, 3, 0, 6), (8, 3, 1, 5), (9, 9, 1, 30_000)], key=str)
    left = suffix.drop_repeats(docs, params)
    assert left.columns == docs.columns
    # The row that comes twice stays once; a row without any word left goes.
    assert sorted((r["_hash"], r["text"]) for r in left.collect()) == [(2, "x a b c d e"), (4, None), (5, ""), (6, "a b c"), (7, "a b c"), (8, "é\tü"), (9, "z ")]
    assert suffix.repeated_passages(docs.filter("false"), params).count() == 0 and suffix.drop_repeats(docs.filter("false"), params).count() == 0


@pytest.mark.parametrize("words", [201, 300])
def test_long_passages(spark, words):
    rng = random.Random(words)
    shared = [f"s{rng.randrange(50)}" for _ in range(450)]
    texts = [" ".join([f"a{i}w{k}" for k in range(30)] + shared[i * 20 :]) for i in range(5)]
    docs = spark.createDataFrame(doc_rows(texts), COLUMNS)
    got = sorted(tuple(r) for r in suffix.repeated_passages(docs, suffix.SuffixParams(words=words)).collect())
    assert got == sorted(brute_repeats(list(enumerate(texts)), words)) and len(got) == 4


def test_pipeline(spark):
    """Every stage on its own input against brute force, over all documents of the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    whole = corpus_pipeline.run(spark, SF)
    model = quality.fit_quality(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fold = model.folded()

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        ids = np.concatenate([f for f, _ in quality.features(data, np.array([0, len(data)]), model.params)])
        return fold[ids].mean()

    one = {d: t for d, t in rows.items() if t and t.split() and score(t) >= model.threshold}
    keys = sorted(one)
    sketches = sketch_of([one[k] for k in keys])
    radius = simhash.SimHashParams().radius
    roots = groups_of([(i, j) for j in range(len(keys)) for i in range(j) if (sketches[i] ^ sketches[j]).bit_count() <= radius], len(keys))
    two = {keys[i]: one[keys[i]] for i in range(len(keys)) if roots[i] == i}
    seen, three = set(), {}
    for d in sorted(two):
        spans = [m.span() for m in __import__("re").finditer(r"[^\t\n\x0b\f\r ]+", two[d])]
        words, cut = [two[d][a:b] for a, b in spans], set()
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            if key in seen:
                cut.update(range(i, i + 50))
            seen.add(key)
        ends = [a for a, _ in spans[1:]] + [len(two[d])]
        left = (two[d][: spans[0][0]] if spans else two[d]) + "".join(two[d][a:e] for k, ((a, _), e) in enumerate(zip(spans, ends, strict=True)) if k not in cut)
        if left.strip() or not cut:
            three[d] = left
    windows = {(w, whole) for w, _, _, _, whole in decontaminate.windows([(r["item_id"], r["text"]) for r in bench.collect()], decontaminate.LeakParams())}
    plain = {d: " ".join(decontaminate.WORD.findall(t.lower())) for d, t in three.items()}
    four = {d: t for d, t in three.items() if not any(w == plain[d] if whole else f" {w} " in f" {plain[d]} " for w, whole in windows)}
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=_tokens.load(), special_tokens={})
    got = {r["doc_id"]: r for r in whole.collect()}
    assert set(got) == set(four) and len(four) < len(three) <= len(two) < len(one) < len(rows)
    assert all(got[d]["ids"] == reference.encode_ordinary(t) and got[d]["round_trip"] for d, t in four.items())


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of clashing names through all stages."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(None, base[1][1], None, None, None), (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, " \n", "en", "s", 2), base[2], base[2], (9004, base[3][1] + " long" * 60_000, "en", "s", 1)]
    docs = spark.createDataFrame(base + odd, COLUMNS)
    for c in ("_keep", "_hash", "keep", "quality", "row", "node", "ids"):
        docs = docs.withColumn(c, docs["lang"])
    (tmp_path / "sf").mkdir()
    for name in ("labels", "benchmark"):
        (tmp_path / "sf" / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    own = spark.read.parquet(f"file://{tmp_path}/sf/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = own, stage(spark, own, f"{tmp_path}/sf")
        out.write.parquet(f"file://{tmp_path}/{k}")
        own = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert own.columns == docs.columns and own.count() <= before.count()
        else:
            assert own.count() == before.count() and own.filter("not round_trip").count() == 0
        if k == 1:
            ids = [r["doc_id"] for r in own.collect()]
            assert len(ids) == len(set(ids))
    whole = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    assert sorted(str(r["doc_id"]) for r in whole.collect()) == sorted(str(r["doc_id"]) for r in own.collect())


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


