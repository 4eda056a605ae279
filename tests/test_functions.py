"""Scalar functions against known values and against their Python forms."""

import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from lodestar.functions import lexemes as L
from lodestar.functions import scores as C
from lodestar.functions import text as T
from lodestar.functions import trigrams as G
from lodestar.functions import vectors as V
from lodestar.functions.stem import english, stem


@pytest.mark.parametrize(("query", "want"), [("", ""), ("  two   factor  ", "two factor"), ("two-factor", "two factor"), ("-factor", "factor"), ("--factor", "factor"), ("two not factor", "two not factor"), ("not two-factor", "not two factor"), ("R-18", "R 18"), ("a-b-c", "a b c"), ("- -", "")])
def test_query_for_embedding(query, want):
    assert T.for_embedding(query) == want


@pytest.mark.parametrize(("query", "want"), [("", ""), ("two factor", "two factor"), ("two-factor", "two factor"), ("-factor", "factor"), ("two not factor", "two -factor"), ("not factor", "-factor"), ("not two-factor", "-two factor"), ("X NOT Y", "X -Y"), ("x not", "x not"), ("not --", ""), ('not "two factor"', '-"two factor"')])
def test_query_for_keywords(query, want):
    assert T.for_keywords(query) == want


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("  ", ""), ("Straße Ærø", "strasse aero"), ("Ｆｕｌｌ　ｗｉｄｔｈ ﬁ", "full width fi"), ("Élan-vital!", "elan vital"), ("Привет мир", "privet mir"), ("カタカナ", "katakana"), ("한글", "hangeul"), ("…", "")])
def test_fold(text, want):
    assert T.fold(text) == want


def test_fold_columns_agree(spark):
    texts = ["Straße Ærø ÀÉÎõü", " -- ", "a\tb\n c_d", "œuvre ŁÓDŹ ıİ", "1½ x²", "", None, "don't", "ŉ Ǆ"]
    other = ["Привет мир", "鬼滅の刃", "東京タワー", "기생충", "Ελληνικά", "cafe\u0301", "\ufb01ne ｆｕｌｌ", "שלום", "हिन्दी", "“quoted” — …", "\U0001f600 x"]
    rows = spark.createDataFrame([(t,) for t in texts + other], "t string").select("t", T.fold_latin("t").alias("latin"), T.fold_any(F.col("t")).alias("any"), T.fold_column("t").alias("column")).collect()
    assert [r["column"] for r in rows[len(texts) :]] == [T.fold(t) for t in other] == ["privet mir", "gui mie noren", "dong jing tawa", "gisaengcung", "ellenika", "cafe", "fine full", "slwm", "hainadai", "quoted", "x"]
    for r in rows[: len(texts)]:
        assert r["column"] == r["any"]
        assert r["any"] == (None if r["t"] is None else T.fold(r["t"]))
        assert r["latin"] == r["any"], r["t"]


def test_query_columns_agree(spark):
    texts = ["two-factor  -x", "--", "a-b-c", "R-18 tok*", "ü-ß 鬼-滅"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.for_embedding_column("t").alias("e"), T.only_words_column("t").alias("w"), T.as_prefixes_column("t").alias("p")).collect()
    for r in rows:
        assert (r["e"], r["w"], r["p"]) == (T.for_embedding(r["t"]), T.only_words(r["t"]), T.as_prefixes(r["t"]))


def test_scripts_and_prefixes():
    assert T.has_cjk("鬼滅") and T.has_cjk("かな") and T.has_cjk("한") and not T.has_cjk("abc é") and not T.has_cjk("ｱ")
    assert T.has_ascii_word("鬼 a") and not T.has_ascii_word("鬼é")
    assert T.is_cjk_language(" JA ") and not T.is_cjk_language("ja-JP") and not T.is_cjk_language(None)
    assert [T.as_prefixes(x) for x in ("", "  a  ", "blue archive", "tok*")] == ["", "a*", "blue* archive*", "tok*"]
    assert T.only_words("áb, c!") == "a b c"
    assert T.distinct_trimmed([" a", "b", "a ", ""]) == ["a", "b"] and T.distinct_trimmed([" "]) is None


def test_scores(spark):
    assert C.bounded_value(0) == 0 and C.bounded_value(-1) == 0 and C.bounded_value(1) == 0.5 and 0.8 < C.bounded_value(9) < 1
    assert C.bounded_value(10, 10) == 0.5 and 0 < C.bounded_value(10, 0) < 1
    rows = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (9.0,), (None,)], "x double").select(C.bounded("x")).collect()
    assert [round(r[0], 3) for r in rows] == [0, 0, 0.5, 0.9, 0]
    assert [C.config_of(x) for x in (" EN ", "ja", None, "ru")] == ["english", "simple", "simple", "russian"]
    rows = spark.createDataFrame([(1, 500), (3, None), (12, 429), (1, 404), (20, 401), (0, 408)], "n int, s int").select(C.retry_seconds("n", "s")).collect()
    assert [r[0] for r in rows] == [5, 20, 600, 900, 604800, 5]
    assert C.retry_delay(3) == 20 and C.retry_delay(50) == 600
    rng = random.Random(1)
    assert all(8 <= C.jittered_value(8, rng) < 10 for _ in range(100))
    assert all(8 <= r[0] < 10 for r in spark.range(50).select(C.jittered(F.lit(8.0), 3)).collect())


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0, 0.0],), ([1.0, -1.0, 2.0],), ([0.0, 0.0, 0.0],), ([1.0],), (None,)], "v array<float>")
    q = [1.0, 2.0, -1.0]
    got = V.with_signs(rows.withColumnRenamed("v", "embedding")).select(V.cosine("embedding", F.array(*map(F.lit, q))).alias("b"), V.signs_apart("signs", q).alias("h"), V.unit("embedding").alias("u"), F.size("signs").alias("n")).collect()
    assert [None if r["b"] is None else round(r["b"], 6) for r in got] == [0.408248, -0.5, None, None, None]
    assert [r["h"] for r in got][:3] == [1, 2, 2] and got[2]["u"] == [0, 0, 0] and got[4]["h"] is None
    rng = np.random.default_rng(1)
    for dims in (1, 63, 64, 65, 1024, 2560):
        v = rng.normal(size=(5, dims))
        packed = V.packed_signs(v)
        assert packed.shape == (5, -(-dims // 64)) and all(packed[i, k // 64] >> (k % 64) & 1 == (v[i, k] > 0) for i in range(5) for k in range(dims))
        apart = spark.createDataFrame([([int(x) for x in p],) for p in packed], "s array<long>").select(V.signs_apart("s", v[0].tolist())).collect()
        assert [r[0] for r in apart] == ((v > 0) != (v[0] > 0)).sum(1).tolist()
    groups = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0]), (2, [1.0, 2.0]), (3, []), (1, None)], "k int, embedding array<float>")
    means = {r["k"]: r["embedding"] for r in V.mean_unit_vectors(groups, ["k"]).collect()}
    assert [round(x, 4) for x in means[1]] == [0.7071, 0.7071] and means[2] is None and means[3] is None
    assert V.unit_of([3, 4]) == [0.6, 0.8] and V.unit_of([0, 0]) == [0, 0]


def test_trigrams(spark):
    assert sorted(G.trigrams_of("cat")) == sorted(["  c", " ca", "cat", "at "])
    a, b = set(G.trigrams_of("word")), set(G.trigrams_of("two words"))
    assert round(len(a & b) / len(a | b), 6) == 0.363636
    texts = ["Two words, two", "", None, "a b", "ünïcode x-y", "  lead", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.trigrams("t").alias("g"), G.shared_with(G.trigrams("t"), G.trigrams_of("two a code lead")).alias("n")).collect()
    for r in rows:
        if r["t"] is not None:
            assert set(r["g"]) == set(G.trigrams_of(r["t"]))
            assert r["n"] == len(set(r["g"]) & set(G.trigrams_of("two a code lead")))


def test_stems():
    words = {"running": "run", "flies": "fli", "relational": "relat", "hopping": "hop", "hoping": "hope", "generously": "generous", "national": "nation", "dying": "die", "agreed": "agre", "cats": "cat", "skies": "sky", "happily": "happili", "consistency": "consist", "knightly": "knight", "by": "by", "gas": "gas", "this": "this"}
    assert {w: english(w) for w in words} == words
    assert stem("Häuser".lower(), "german") == "häus" and stem("abc", "simple") == "abc"


def brute_density(words, terms):
    """Minimal covers by trying all stretches."""
    total, n = 0.0, len(words)
    covers = [(s, e) for s in range(n) for e in range(s, n) if set(terms) <= set(words[s : e + 1])]
    minimal = [(s, e) for s, e in covers if not any((a, b) != (s, e) and s <= a and b <= e for a, b in covers)]
    for s, e in minimal:
        total += 0.1 / (1 + sum(w not in terms for w in words[s : e + 1]))
    return total


def test_keyword_queries(spark):
    rng = random.Random(5)
    docs = [[rng.choice(["a", "b", "c", "x", "y", None]) for _ in range(rng.randint(0, 14))] for _ in range(80)] + [None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, w array<string>")
    cases = {
        "a b": lambda d: "a" in d and "b" in d, "a or b": lambda d: "a" in d or "b" in d, "a -b": lambda d: "a" in d and "b" not in d, '"a b" c': lambda d: ("a", "b") in list(zip(d, d[1:], strict=False)) and "c" in d,
        "-a": lambda d: "a" not in d, "a b or c": lambda d: ("a" in d and "b" in d) or "c" in d, '-"a b"': lambda d: ("a", "b") not in list(zip(d, d[1:], strict=False)),
    }
    for query, want in cases.items():
        parsed = L.parse(query)
        got = {r["i"]: (r["m"], r["s"]) for r in df.select("i", L.matches("w", parsed).alias("m"), L.cover_density("w", parsed).alias("s")).collect()}
        assert all(got[i][0] == (d is not None and want(d)) for i, d in enumerate(docs)), query
    parsed = L.parse("a b c")
    for r in df.select("i", "w", L.cover_density("w", parsed).alias("s")).collect():
        if r["w"] is not None:
            assert abs(r["s"] - brute_density(r["w"], ["a", "b", "c"])) < 1e-9
    assert L.parse("") == () and L.parse('"unfinished quote')[0][0].words == ("unfinished", "quote")
    assert L.parse("the things of", "english")[0][0].words == ("thing",)
    places = {(r["i"], r["lexeme"]): r["positions"] for r in L.positions(df.withColumnRenamed("w", "lexemes"), "i").collect()}
    assert all(v == [k + 1 for k, w in enumerate(docs[i]) if w == x] for (i, x), v in places.items())
