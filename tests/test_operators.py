"""Retrieval operators on small tables, edge cases first."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sqlcheck import SF

from lodestar.operators import evaluation as E
from lodestar.functions import text as T
from lodestar.functions import trigrams as G
from lodestar.functions import vectors as V
from lodestar.operators import ann, fusion, keyword, semantic
from lodestar.operators.common import Scope, Top, condition
from lodestar.operators.search import Searcher, SearchOptions
from lodestar.plans import tables as X
from lodestar.sources.documents import prepared

DOC = "entity_type string, entity_id string, language string, text string"
VEC = "entity_type string, entity_id string, model string, language string, embedding array<float>"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("gallery", "1", "en", "Two factor authentication"), ("gallery", "2", "en", "factor factor two"), ("page", "3", "en", "nothing here"), ("page", "4", "fr", "facteur"), ("page", "5", "en", ""), ("page", "6", "en", None), (None, "7", "en", "two factor"), ("gallery", " ", "en", "two factor")]
    return prepared(spark.createDataFrame(rows, DOC), "simple").cache()


@pytest.fixture(scope="module")
def vecs(spark):
    rows = [("gallery", "1", "m", "en", [1.0, 0.0, 0.0]), ("gallery", "2", "m", "en", [0.5, 0.5, 0.0]), ("page", "1", "m", "en", [-1.0, 0.1, 0.0]), ("page", "8", "m", "en", None), ("page", "9", "m", "en", [1.0]), ("page", "10", "m", "en", [0.0, 0.0, 0.0]), ("gallery", "1", "other", "en", [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, VEC)


def ids(df):
    return [(r["entity_type"], r["entity_id"]) for r in df.collect()]


def test_hybrid_case(docs, vecs):
    asked = []
    s = Searcher(docs, vecs, lambda model, text: asked.append((model, text)) or [1.0, 0.0, 0.0], model="m", language="xx")
    own = SearchOptions(language="en", entity_types=("gallery",))
    assert ids(keyword.keyword_search(docs, "factor", Scope("en", ("gallery",)), 10, "simple")) == [("gallery", "2"), ("gallery", "1")]
    assert ids(s.search("two-factor", SearchOptions(language="en", mode="semantic", entity_types=("gallery",), limit=1))) == [("gallery", "1")]
    assert asked == [("m", "two factor")]
    asked.clear()
    s.search("two-factor", SearchOptions(language="xx", mode="lexical", entity_types=("gallery",)))
    assert asked == []
    assert s.search("!!", own).count() == 0 and s.search("", own).count() == 0
    with pytest.raises(ValueError, match="embedder"):
        Searcher(docs, vecs, model="m").search("two", own)
    with pytest.raises(ValueError, match="entity types"):
        s.search("two")
    with pytest.raises(ValueError, match="mode"):
        s.search("two", SearchOptions(mode="other"))
    assert Searcher(docs, vecs, lambda m, t: [], model="m").search("two", own).count() == 0


def test_trigram_and_typeahead(docs):
    hits = keyword.trigram_search(docs, "two factor", Scope("en"), 10).collect()
    assert [(r["entity_id"], round(r["score"], 4)) for r in hits] == [("2", 1.0), ("1", round(11 / 26, 4))]
    assert keyword.trigram_search(docs, "...", Scope("en"), 10).count() == 0
    assert keyword.trigram_search(docs, "two", Scope("en"), 0).count() == 0
    assert keyword.trigram_search(docs, "two factor", Scope("en", condition="sd.entity_id <> :x", args={"x": "2"}), 10).count() == 1
    with pytest.raises(ValueError, match="taken"):
        condition("a = :limit", {"limit": 1})
    with pytest.raises(ValueError, match="empty"):
        condition("true", {" ": 1})
    with pytest.raises(ValueError, match="language"):
        keyword.trigram_search(docs, "a", Scope(""), 1)
    s = Searcher(docs, language="en")
    assert ids(s.typeahead("facto", ["gallery", " "])) == [("gallery", "2"), ("gallery", "1")]
    with pytest.raises(ValueError, match="entity types"):
        s.typeahead("a", [" "])


def test_folded_scripts_find_themselves(spark):
    """Every text, folded when stored, is found by itself with similarity 1, by a scan, by stored sets and by postings."""
    rows = [("s", str(i), g, t) for i, (g, t, _) in enumerate(X.SCRIPTS)]
    own = prepared(spark.createDataFrame(rows, DOC), "simple").cache()
    assert [r["document"] for r in own.orderBy("entity_id").collect()] == [f for _, _, f in X.SCRIPTS]
    stored = G.with_trigrams(own).cache()
    postings = keyword.trigram_postings(stored).cache()
    for i, (g, t, _) in enumerate(X.SCRIPTS):
        for found in (keyword.trigram_search(own, t, Scope(g)), keyword.trigram_search(stored, t, Scope(g)), keyword.trigram_search(stored, t, Scope(g), postings=postings)):
            top = found.first()
            assert (top["entity_id"], top["score"]) == (str(i), 1.0)


def test_plans(spark):
    """One fold for a stored row, no fold and no scan of documents in a search by postings, no exchange for lexeme positions."""
    from lodestar.functions import lexemes as L

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    docs, postings = X.documents(spark, SF), X.postings(spark, SF)
    for df in (keyword.trigram_search(docs, "anthing the ouen tion", Scope("en"), 20, postings=postings), keyword.trigram_search(docs, "anthing the ouen tion", Scope("en"), 20), keyword.keyword_search(docs, '"of the" that', Scope("en"), 20, "simple")):
        assert "translate" not in plan(df) and "regexp_replace" not in plan(df)
    assert "document" not in plan(keyword.trigram_search(docs, "anthing", Scope("en"), postings=postings)).split("ReadSchema")[1] and "In(gram" in plan(keyword.trigram_search(docs, "anthing", Scope("en"), postings=postings))
    assert "Exchange" not in plan(L.positions(docs, "entity_type", "entity_id", "language"))
    raw = prepared(X.raw_documents(spark, SF), "simple")
    assert plan(G.with_trigrams(raw)).count("translate(") <= 2


def test_condition_literals(spark):
    df = spark.createDataFrame([("it's :x", 1), ("b", 2)], "s string, n int")
    assert df.filter(condition("s = :v AND 'it''s :no' <> @w", {"v": "it's :x", "w": "z"})).count() == 1
    assert df.filter(condition("array_contains(:l, n)", {"l": [1, 5]})).count() == 1
    with pytest.raises(ValueError, match="needs"):
        condition("n = :missing", {})


def test_native(spark):
    docs = X.native(spark, SF)
    assert ids(keyword.native_search(docs, "鬼滅", Scope("ja"))) == [("series", "1")]
    assert ids(keyword.native_search(docs, "鬼", Scope("ja"), prefix=True)) == [("series", "2"), ("series", "1")]
    assert ids(keyword.native_search(docs, "tok", Scope("ja"), prefix=True)) == [("series", "10"), ("film", "4"), ("series", "11")]
    assert keyword.native_search(docs, " !", Scope("ja")).count() == 0
    r = keyword.native_search(docs, "龙", Scope("zh")).collect()
    assert [(x["entity_id"], x["raw_score"], round(x["score"], 3)) for x in r] == [("6", 2.0, 0.667), ("5", 1.0, 0.5)]
    s = Searcher(docs)
    got = s.typeahead("tokyo 東京", ["series", "film"], "ja").collect()
    assert {x["entity_id"] for x in got} == {"4", "10", "11"} and got[0]["entity_id"] == "10"
    assert s.search("봉준호", SearchOptions(language="KO", mode="lexical", entity_types=("film",))).count() == 0  # rows keep the language as given
    assert ids(s.search("봉준호", SearchOptions(language="ko", mode="lexical", entity_types=("film",)))) == [("film", "7")]


def test_semantic(vecs):
    q, scope = [1.0, 0.0, 0.0], Scope("en")
    got = semantic.semantic_search(vecs, "m", q, scope, 10).collect()
    assert [(r["entity_type"], r["entity_id"]) for r in got] == [("gallery", "1"), ("gallery", "2"), ("page", "1"), ("page", "10")] and got[-1]["score"] is None
    assert ids(semantic.semantic_search(vecs, "m", q, scope, 10, least=0.8)) == [("gallery", "1")]
    assert ids(semantic.semantic_search(vecs, "m", q, scope, 10, two_stage=True)) == [("gallery", "1"), ("gallery", "2")]
    assert ids(semantic.semantic_search(vecs, "m", q, Scope("en", exclude_ids=("1",)), 10))[0] == ("gallery", "2")
    assert semantic.semantic_search(vecs, "m", [], scope).count() == 0 and semantic.semantic_search(vecs, "m", q, scope, 0).count() == 0
    with pytest.raises(ValueError, match="model"):
        semantic.semantic_search(vecs, "", q, scope)
    assert ids(semantic.similar_to(vecs, "gallery", "1", "m", scope)) == [("gallery", "2"), ("page", "1"), ("page", "10")]
    assert semantic.similar_to(vecs, "gallery", "77", "m", scope).count() == 0


def test_wide_vectors_and_cells(spark, tmp_path):
    """At the sizes of today's models: exact, in two stages with and without stored signs, and through cells."""
    rng = np.random.default_rng(8)
    for dims in (1024, 2560):
        centres = rng.normal(size=(6, dims))
        v = (centres[np.arange(300) % 6] + 0.7 * rng.normal(size=(300, dims))).astype(np.float32)
        v[7] = v[1]
        df = spark.createDataFrame([("t", f"{i:03d}", "m", "en", [float(x) for x in v[i]]) for i in range(300)] + [("t", "none", "m", "en", None), ("t", "short", "m", "en", [1.0]), ("t", "zero", "m", "en", [0.0] * dims)], VEC)
        df.write.parquet(f"{tmp_path}/v{dims}")
        df = spark.read.parquet(f"{tmp_path}/v{dims}")
        q = v[1].astype(float)
        score = (v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q)).round(9)
        want = [f"{i:03d}" for i in sorted(range(300), key=lambda i: (-score[i], i))[:10]]
        assert [r["entity_id"] for r in semantic.semantic_search(df, "m", q.tolist(), Scope("en"), 10).collect()] == want
        apart = ((v > 0) != (q > 0)).sum(1)
        near = sorted(range(300), key=lambda i: (apart[i], i))[:50]
        two = [f"{i:03d}" for i in sorted(near, key=lambda i: (-score[i], i))[:10]]
        for rows in (df, V.with_signs(df)):
            assert [r["entity_id"] for r in semantic.semantic_search(rows, "m", q.tolist(), Scope("en"), 10, two_stage=True).collect()] == two
        assert [i for _, i in ids(semantic.similar_to(df, "t", "001", "m", Scope("en"), 5))] == [w for w in want if w != "001"][:5]
        fitted = ann.fit_cells(df.filter("entity_id <> 'short'"))
        file = ann.write_cells(df, fitted, f"{tmp_path}/c{dims}")
        assert file.count() == 303 and {r["entity_id"] for r in file.filter("cell = -1").collect()} == {"none", "short", "zero"}
        assert 0 < fitted.probes <= len(fitted.centres)
        hits = sum(len({f"{i:03d}" for i in np.argsort(-(v @ v[k]) / np.linalg.norm(v, axis=1), kind="stable")[:10]} & {r["entity_id"] for r in ann.cell_search(file, fitted, "m", v[k].tolist(), Scope("en"), 10).collect()}) for k in range(0, 300, 60))
        assert hits >= 0.9 * 50
    assert ann.cell_search(file, fitted, "m", [], Scope("en")).count() == 0
    none = ann.fit_cells(df.filter("false"))
    assert none.probes == 0 and ann.filed(df, none).filter("cell = -1").count() == 303


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_search_all(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4)).round(1)
    v[7] = v[3]
    rows = [("t", f"{i:02d}", "m", "en", [float(x) for x in v[i]]) for i in range(40)] + [("t", "zero", "m", "en", [0.0] * 4), ("t", "none", "m", "en", None), ("t", "short", "m", "en", [1.0])]
    df = spark.createDataFrame(rows, VEC)
    got = semantic.search_all(df, df.select(F.col("entity_id").alias("query_id"), "embedding"), 5, block_bytes=block).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["entity_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(40):
        s = (u @ u[i]).round(12)
        want = [f"{j:02d}" for j in sorted(range(40), key=lambda j: (-s[j], j))[:5]]
        assert by[f"{i:02d}"] == want
    assert "none" not in by and "zero" not in by and by["short"] == ["short"]


def test_fusion(spark):
    rows = [(0, 1, "gallery", "1", "en", ""), (0, 2, "gallery", "2", "en", ""), (1, 1, " gallery", "2", "en", None), (1, 2, "gallery", "3", "en", "")]
    lists = spark.createDataFrame(rows, "list_id int, rank int, entity_type string, entity_id string, language string, model string")
    got = {r["entity_id"]: r["score"] for r in fusion.fuse(lists, 0).collect()}
    assert got["2"] == pytest.approx(1 / 62 + 1 / 61) and got["1"] == pytest.approx(1 / 61) and got["3"] == pytest.approx(1 / 62)
    got = {r["entity_id"]: r["score"] for r in fusion.fuse(lists, 1, (2.0, -1.0)).collect()}
    assert got["2"] == pytest.approx(2 / 3 + 1 / 2)
    again = fusion.fuse(lists.unionByName(lists), 60).filter("entity_id = '1'").first()["score"]
    assert again == pytest.approx(2 / 61)


def test_diversify(spark):
    def naive(scores, sim, k, w):
        left, out = list(range(1, len(scores))), [0]
        while len(out) < k and left:
            best = max(left, key=lambda i: (w * scores[i] - (1 - w) * max([0] + [sim[i][j] for j in out]), -i))
            out.append(best)
            left.remove(best)
        return out

    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scores, sim = sorted(rng.random(12).tolist(), reverse=True), (v @ v.T).tolist()
    for w in (0.0, 0.3, 1.0):
        assert fusion.diversified(scores, lambda i, j: sim[i][j], 6, w) == naive(scores, sim, 6, w)
    assert fusion.diversified(scores, lambda i, j: 0, 3, 7.0) == [0, 1, 2] and fusion.diversified([], None, 3, 0.5) == [] and fusion.diversified([1.0], None, 0, 0.5) == []
    rows = [("q", i + 1, f"{i}", scores[i], [float(x) for x in v[i]]) for i in range(12)]
    got = fusion.diversify(spark.createDataFrame(rows, "query_id string, rank int, entity_id string, score double, embedding array<double>"), 6, 0.3).orderBy("place").collect()
    assert [int(r["entity_id"]) for r in got] == naive(scores, sim, 6, 0.3)


def test_metrics(spark):
    cases = {"a": (["x", "y", "x"], ["x", "z", "z"]), "b": (["y"], ["x"]), "c": (["x"], []), "d": ([], ["x"])}
    got = spark.createDataFrame([(q, i + 1, "t", e) for q, (g, _) in cases.items() for i, e in enumerate(g)], "query_id string, rank int, entity_type string, entity_id string")
    want = spark.createDataFrame([(q, "t", e) for q, (_, x) in cases.items() for e in x], "query_id string, entity_type string, entity_id string")
    rows = {r["query_id"]: (r["recall"], r["reciprocal_rank"]) for r in E.evaluate(got, want, 3).collect()}
    for q, (g, x) in cases.items():
        assert rows[q] == pytest.approx((E.recall_at(g, x, 3), E.reciprocal_rank(g, x)))
    assert E.recall_at(["x"], ["x"], 0) == 0 and E.recall_at([], [], 0) == 1 and E.reciprocal_rank(["a", "b"], ["b"]) == 0.5


def test_trigram_search_all_makes_no_pairs(spark):
    """Each query finds what it finds alone, over several blocks and among many ties; pairs of a query and a document are no rows."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcd"), 3)) for _ in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 5))) for _ in range(120)]
    docs = spark.createDataFrame([("t", f"{i:03d}", "en" if i % 3 else "de", t) for i, t in enumerate(texts)], "entity_type string, entity_id string, language string, document string").repartition(3)
    rows = [(i, "en" if i % 2 else "de", t) for i, t in enumerate([*words[:6], " ".join(words[:4]), "", "zzz"])] + [(99, None, words[0])]
    asked = spark.createDataFrame(rows, "query_id int, language string, text string")
    for block in (4_000_000, 12):
        found = keyword.trigram_search_all(docs, asked, 3, block=block)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        got = {(r["query_id"], r["rank"]): (r["entity_id"], round(r["score"], 9)) for r in found.collect()}
        want = {}
        for i, language, text in rows:
            if language and text:
                hits = keyword.trigram_search(docs, text, Scope(language), 3).collect()
                want |= {(i, k + 1): (r["entity_id"], round(r["score"], 9)) for k, r in enumerate(hits)}
        assert got == want and len(want) > 20


def test_top_holds_no_more_than_its_limit():
    """A thousand equal rows for each of two queries: the first by key stay, whatever the order in which they come."""
    for limit in (1, 3):
        top = Top(2, limit, 9)
        top.most = 10
        for a in np.random.default_rng(1).permutation(100):
            keys = pa.RecordBatch.from_arrays([pa.array([f"{a * 10 + i:04d}" for i in range(10)])], ["k"])
            top.add(np.repeat([0, 1], 10), np.ones(20), keys, np.tile(np.arange(10), 2))
            assert top.n <= 30
        q, _, keys = top.rows()
        assert sorted(zip(q.tolist(), keys["k"].to_pylist(), strict=True))[:limit] == [(0, f"{i:04d}") for i in range(limit)]
    assert Top(1, 3, 9).rows() is None


def test_diversified_ties():
    """Hits as near to the query as to the first hit are equal, whatever the last bit of either figure."""
    scores = [1.0, 0.37, 0.36, 0.33]
    near = {(i, 0): s + e for i, s, e in ((1, 0.37, 1e-16), (2, 0.36, -1e-16), (3, 0.33, -2e-16))}
    assert fusion.diversified(scores, lambda i, j: near.get((i, j), 0.0), 4, 0.5) == [0, 1, 2, 3]


@pytest.mark.parametrize("block", [64 << 20, 1 << 12])
def test_search_all_is_bounded(spark, block):
    """Many equal vectors, of which the first by key stay; long queries; vectors in several batches. No product of all queries with a batch is made, and no task passes on more than its best."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 16)).astype(np.float32)
    v = np.concatenate([v, np.repeat(v[:1], 60, 0)])
    ids_ = [f"{i:03d}" for i in rng.permutation(len(v))]
    df = spark.createDataFrame([("t", i, "m", "en", x.tolist()) for i, x in zip(ids_, v, strict=True)], VEC).repartition(3)
    asked = df.select(F.col("entity_id").alias("query_id"), "embedding")
    found = semantic.search_all(df, asked, 4, block_bytes=block)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {}
    for i, own in enumerate(ids_):
        s = np.einsum("ij,j->i", u, u[i]).round(12)
        want |= {(own, k + 1): ids_[j] for k, j in enumerate(sorted(range(len(v)), key=lambda j: (-s[j], ids_[j]))[:4])}
    assert {(r["query_id"], r["rank"]): r["entity_id"] for r in found.collect()} == want


def test_search_block_holds_little():
    """What a task holds grows neither with the vectors nor with the size of a batch."""
    rng = np.random.default_rng(6)
    q = rng.normal(size=(3000, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    block = semantic._Block(np.arange(len(q)), q, 2, -1.0)
    tracemalloc.start()
    for a in range(3):
        n = 20_000
        keys = pa.RecordBatch.from_arrays([pa.array([f"{a}-{i}" for i in range(n)])] * 4, ["a", "b", "c", "d"])
        block.add(keys, np.arange(n), rng.normal(size=(n, 8)))
        assert block.top.n <= 3 * block.top.most
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all products at once would be 480 MB


def test_groups_are_expected_without_pairs(spark):
    got = spark.createDataFrame([("a", 1, "t", "1"), ("a", 2, "t", "3"), ("b", 1, "t", "1"), ("b", 2, "t", "2"), ("c", 1, "t", "9"), ("e", 1, "t", "1")], "query_id string, rank int, entity_type string, entity_id string")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 2), ("b", 2)], "query_id string, label int")
    items = spark.createDataFrame([("t", "1", 1), ("t", "2", 2), ("t", "3", 1), ("t", "4", 2), ("t", "5", None), ("t", "2", 2)], "entity_type string, entity_id string, label int")
    pairs = asked.join(items, "label").select("query_id", "entity_type", "entity_id")
    found = E.evaluate_groups(got, asked, items, 1, "label")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, E.evaluate(got, pairs, 1).collect()))
    assert not [r for r in found.collect() if r["query_id"] == "a" and r["recall"] != 0.5]


def test_cell_search_all(spark, tmp_path):
    """A table of queries finds what each finds by itself, in one plan."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([("t", f"{i:03d}", "m", "en", x.tolist()) for i, x in enumerate(v)] + [("t", "zero", "m", "en", [0.0] * 8)], VEC)
    cells = ann.fit_cells(df)
    cells = ann.Cells(cells.centres, 4)
    file = ann.write_cells(df, cells, f"{tmp_path}/cells")
    asked = df.filter("entity_id < '020'").select(F.col("entity_id").alias("query_id"), "embedding")
    got = {}
    for r in ann.cell_search_all(file, cells, "m", asked, Scope("en"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["entity_id"]
    for i in range(20):
        want = [r["entity_id"] for r in ann.cell_search(file, cells, "m", v[i].astype(float).tolist(), Scope("en"), 5).collect()]
        assert [got[f"{i:03d}"][k + 1] for k in range(len(want))] == want
    none = ann.fit_cells(df.filter("false"))
    assert ann.cell_search_all(ann.filed(df, none), none, "m", asked, Scope("en"), 5).count() == 0


def test_stores_hold_what_is_read(spark):
    """A query of words alone stores no postings; sets of many texts are those of each text."""
    X._stored.clear()
    X.documents(spark, SF, "english")
    assert [k[1] for k in X._stored] == ["documents"] and "trigrams" in X.documents(spark, SF).columns
    texts = [None, "", " -- ", "a", "two words, two", "東京 ab_c", "x" * 50, "\U0001f600 \U00020000z é", None]
    assert [x if x is None else sorted(x) for x in G.sets_of(texts).to_pylist()] == [None if t is None else sorted(G.trigrams_of(t)) for t in texts]
    assert G.sets_of([]).to_pylist() == []
    forms = ["Ærø ß œuvre ½ ŉ", "plain TEXT", "déjà vu", "Ǆ ŋ þ", None]
    got = spark.createDataFrame([(t,) for t in forms], "t string").select(T.fold_latin("t")).collect()
    assert [r[0] for r in got] == [None if t is None else T.fold(t) for t in forms]
