"""Queries of the retrieval operators over the test tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import lexemes as L
from lodestar.functions import scores as C
from lodestar.functions import text as T
from lodestar.functions import trigrams as G
from lodestar.functions import vectors as V
from lodestar.operators import ann, evaluation, fusion, keyword, semantic
from lodestar.operators.common import Scope, ranked
from lodestar.operators.search import Searcher, SearchOptions
from lodestar.plans import tables as X
from lodestar.session import shared_dir, table
from lodestar.sources.documents import prepared

ENGLISH = Scope("en")
HIT = ["entity_type", "entity_id", "language"]


def _six(df: DataFrame, column: str = "score") -> DataFrame:
    """Scores at six digits: engines add floats in different orders."""
    return df.withColumn(column, F.round(F.col(column).cast("double"), 6))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.stored_vector(spark, sf_dir, 0)
    return _six(semantic.semantic_search(X.vectors(spark, sf_dir), X.MODEL, q, ENGLISH, 10)).select("entity_id", "model", "score")


def knn_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.stored_vector(spark, sf_dir, 3)
    scope = Scope("en", exclude_ids=("3", "7"), condition="ev.label <> :label AND ev.entity_id <> @id", args={"label": 4, "id": "11"})
    return _six(semantic.semantic_search(X.vectors(spark, sf_dir), X.MODEL, q, scope, 50, least=0.1)).select("entity_id", "score")


def knn_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.stored_vector(spark, sf_dir, 1)
    return _six(semantic.semantic_search(X.vectors(spark, sf_dir), X.MODEL, q, ENGLISH, 10, two_stage=True)).select("entity_id", "score")


def _wide(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    """The vectors repeated to ``times`` their length, which changes no cosine and no order by signs."""
    return X.vectors(spark, sf_dir).withColumn("embedding", F.flatten(F.array_repeat("embedding", times)))


def knn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 2,560 dimensions."""
    q = X.stored_vector(spark, sf_dir, 0) * 40
    return _six(semantic.semantic_search(_wide(spark, sf_dir, 40), X.MODEL, q, ENGLISH, 10)).select("entity_id", "model", "score")


def knn_wide_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 2,560 dimensions, from signs that are made on the way."""
    q = X.stored_vector(spark, sf_dir, 1) * 40
    return _six(semantic.semantic_search(_wide(spark, sf_dir, 40), X.MODEL, q, ENGLISH, 10, two_stage=True)).select("entity_id", "score")


def knn_stored_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two stages of which the first reads stored signs."""
    place = f"{shared_dir(spark)}/signs-{uuid.uuid4().hex}"
    V.with_signs(X.vectors(spark, sf_dir)).write.parquet(place)
    q = X.stored_vector(spark, sf_dir, 1)
    return _six(semantic.semantic_search(spark.read.parquet(place), X.MODEL, q, ENGLISH, 10, two_stage=True)).select("entity_id", "score")


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many searches through the cells were made, one for each vector whose number is divisible by 100, and whether they found nine of ten of what exact search finds."""
    v = X.vectors(spark, sf_dir).drop("label")
    cells = ann.fit_cells(v)
    file = ann.write_cells(v, cells, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}")
    asked = v.filter(F.col("entity_id").cast("long") % 100 == 0).select(F.col("entity_id").alias("query_id"), "embedding")
    want = semantic.search_all(v, asked, 10)
    found = ann.cell_search_all(file, cells, X.MODEL, asked, ENGLISH, 10).select("query_id", "entity_id", F.lit(1).alias("hit"))
    return want.join(found, ["query_id", "entity_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_of_ten"))


def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of every vector, among those whose label is below 5."""
    v = X.vectors(spark, sf_dir)
    found = semantic.search_all(v, v.select(F.col("entity_id").alias("query_id"), "embedding"), 3, model=X.MODEL, scope=Scope("en", condition="ev.label < :n", args={"n": 5}))
    return _six(found).select("query_id", "rank", "entity_id", "score")


def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(semantic.similar_to(X.vectors(spark, sf_dir), "vec", "5", X.MODEL, ENGLISH, 20)).select("entity_id", "score")


def knn_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector."""
    v = X.vectors(spark, sf_dir)
    found = semantic.search_all(v, v.select(F.col("entity_id").alias("query_id"), "embedding"), 10)
    return _six(found).select("query_id", "rank", "entity_id", "score")


def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(keyword.trigram_search(X.documents(spark, sf_dir), "Anthing the Ouen-tion!", ENGLISH, 50, 0.1, X.postings(spark, sf_dir))).select(*HIT, "score")


def trigram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram search with a condition on the documents, which are scanned."""
    scope = Scope("de", exclude_ids=("2",), condition="length(sd.document) > :n", args={"n": 100})
    return _six(keyword.trigram_search(X.documents(spark, sf_dir), "anthing ouen", scope, 30)).select(*HIT, "score")


def trigram_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most similar to each benchmark text, of any language."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.fold_column("text").alias("text"))
    return _six(keyword.trigram_search_all(X.documents(spark, sf_dir), asked, 5)).select("query_id", "rank", *HIT, "score")


def trigram_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in many scripts, each searched by itself in its own language, among all documents: each finds itself with score 1."""
    rows = spark.createDataFrame([(i, "script", str(i), g, t) for i, (g, t, _) in enumerate(X.SCRIPTS)], "query_id int, entity_type string, entity_id string, language string, text string")
    own = X.documents(spark, sf_dir).select(*HIT, "trigrams").unionByName(G.with_trigrams(prepared(rows, "simple").select(*HIT, "document")).select(*HIT, "trigrams"))
    asked = rows.select("query_id", "language", T.fold_column("text").alias("text"))
    return _six(keyword.trigram_search_all(own, asked, 3)).select("query_id", "rank", *HIT, "score")


def typeahead_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of each text in many scripts, typed, with the text that is found."""
    rows = spark.createDataFrame([("script", str(i), g, t) for i, (g, t, _) in enumerate(X.SCRIPTS)], "entity_type string, entity_id string, language string, text string")
    own = prepared(rows, "simple")
    own = X.documents(spark, sf_dir).select(own.columns).unionByName(own)
    found = None
    for i, (g, t, _) in enumerate(X.SCRIPTS):
        one = Searcher(own).typeahead(t, ("script",), g, 1).select(F.lit(i).alias("query_id"), "entity_id", F.round("score", 6).alias("score"))
        found = one if found is None else found.unionByName(one)
    return found


def _keyword(query: str, limit: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _six(keyword.keyword_search(X.documents(spark, sf_dir), query, ENGLISH, limit, "simple")).select(*HIT, "score")

    return run


def keyword_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(keyword.keyword_search(X.documents(spark, sf_dir), "that with from", ENGLISH, 30, "simple", normalized=True)).select(*HIT, "score")


def keyword_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English stems and stop words; the SQL lists the words of the query's stems."""
    return _six(keyword.keyword_search(X.documents(spark, sf_dir, "english"), "things not worthless", ENGLISH, 30, "english")).select(*HIT, "score")


def native_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_six(keyword.native_search(X.native(spark, sf_dir), "東京 tokyo", Scope("ja"), 20)), "raw_score").select(*HIT, "score", "raw_score")


def native_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(keyword.native_search(X.native(spark, sf_dir), "tok", Scope("ja"), 20, prefix=True)).select(*HIT, "score")


def native_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native search over all documents in French: words anywhere."""
    return _six(keyword.native_search(X.documents(spark, sf_dir), "aux ié", Scope("fr"), 40)).select(*HIT, "score")


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vecs = X.documents(spark, sf_dir), X.document_vectors(spark, sf_dir)
    a = ranked(keyword.trigram_search(docs, "anthing ouen", ENGLISH, 20, postings=X.postings(spark, sf_dir)))
    b = ranked(semantic.semantic_search(vecs, X.MODEL, X.stored_vector(spark, sf_dir, 2), ENGLISH, 20))
    return _six(fusion.fuse(fusion.union_lists([a, b]), 60.0, (2.0, 0.0)), "score").select(*HIT, "score")


def _searcher(spark: SparkSession, sf_dir: str, config: str, postings: bool = False) -> Searcher:
    """With ``postings`` for typeahead alone: a search in English looks up words, not trigrams."""
    vector = X.stored_vector(spark, sf_dir, 2)
    return Searcher(X.documents(spark, sf_dir, config), X.document_vectors(spark, sf_dir), lambda model, text: vector, language="en", model=X.MODEL, postings=X.postings(spark, sf_dir) if postings else None, config=config)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_searcher(spark, sf_dir, "simple").search("that with from", SearchOptions(entity_types=X.types(spark, sf_dir)))).select(*HIT, "score")


def hybrid_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with English stems and stop words, in two stages."""
    return _six(_searcher(spark, sf_dir, "english").search("anthing in-onble", SearchOptions(entity_types=X.types(spark, sf_dir), two_stage=True))).select(*HIT, "score")


def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_searcher(spark, sf_dir, "simple", postings=True).typeahead("ouen-the", X.types(spark, sf_dir), limit=25)).select(*HIT, "score")


def typeahead_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(Searcher(X.native(spark, sf_dir)).typeahead("tokyo 東京", ("series", "film"), "ja")).select(*HIT, "score")


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of every vector's twenty nearest by maximal marginal relevance."""
    v = X.vectors(spark, sf_dir)
    hits = semantic.search_all(v, v.select(F.col("entity_id").alias("query_id"), "embedding"), 20).join(v.select("entity_id", "embedding"), "entity_id")
    return fusion.diversify(hits.select("query_id", "rank", "entity_id", "score", "embedding"), 5, 0.5).select("query_id", "place", "entity_id")


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten and reciprocal rank of every vector as a query; vectors of its label are expected."""
    v = X.vectors(spark, sf_dir)
    got = semantic.search_all(v, v.select(F.col("entity_id").alias("query_id"), "embedding"), 10)
    asked, items = v.select(F.col("entity_id").alias("query_id"), "label"), v.select("entity_type", "entity_id", "label")
    return _six(_six(evaluation.evaluate_groups(got, asked, items, 10, "label"), "recall"), "reciprocal_rank")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents(spark, sf_dir).select(*HIT, "document")


def lexeme_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lexemes with how often and where first they come."""
    rows = L.positions(X.documents(spark, sf_dir), *HIT)
    return rows.select(*HIT, "lexeme", F.size("positions").cast("long").alias("n"), F.col("positions")[0].cast("long").alias("first_at"))


def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sets that built-in expressions give; ``trigram_stored`` has those that are stored."""
    return X.documents(spark, sf_dir).select("entity_id", F.size(G.trigrams("document")).cast("long").alias("n_trigrams"))


def trigram_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents(spark, sf_dir).select("entity_id", F.size("trigrams").cast("long").alias("n_trigrams"))


def query_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries: words alone, as prefixes, and what script they are in."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", T.only_words_column("text").alias("words"), T.as_prefixes_column(T.only_words_column("text")).alias("prefixes"), F.col("text").rlike(T.CJK).alias("cjk"), F.col("text").rlike("[A-Za-z0-9]").alias("ascii"), F.col("text").rlike(r"[\p{L}\p{N}]").alias("usable"))


def embedding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as queries for an embedder: hyphens go."""
    return table(spark, sf_dir, "pages").select("page_id", T.for_embedding_column("url").alias("query"))


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(C.bounded("value"), 9).alias("plain"), F.round(C.bounded(F.col("value") - 50, 10), 9).alias("shifted"), F.round(C.bounded("value", 0), 9).alias("zero_k"), C.retry_seconds((F.col("user_id") % 15).cast("int"), (F.col("user_id") % 200 + 400).cast("int")).alias("wait"))


def text_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("code", F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
    return rows.groupBy(C.text_config("code").alias("config")).agg(F.count(F.lit(1)).alias("n"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.unit(F.transform("embedding", lambda x: x * 3))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.mean_unit_vectors(table(spark, sf_dir, "embeddings"), ["label"])
    return means.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


def sign_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signs of each vector differ from those of the vector of the same label with the least id."""
    rows = table(spark, sf_dir, "embeddings")
    first = Window.partitionBy("label").orderBy("vec_id")
    return rows.withColumn("head", F.first("embedding").over(first)).select("vec_id", V.hamming("embedding", "head").cast("long").alias("apart"))


QUERIES = {
    "knn_exact": knn_exact, "knn_floor": knn_floor, "knn_two_stage": knn_two_stage, "knn_wide": knn_wide, "knn_wide_two_stage": knn_wide_two_stage, "knn_stored_signs": knn_stored_signs, "knn_cells": knn_cells, "knn_scoped": knn_scoped, "similar_to": similar_to, "knn_all_queries": knn_all_queries, "trigram_search": trigram_search, "trigram_all_queries": trigram_all_queries, "trigram_scan": trigram_scan, "trigram_scripts": trigram_scripts, "typeahead_scripts": typeahead_scripts, "trigram_stored": trigram_stored,
    "keyword_and": _keyword("that with from", 40), "keyword_term": _keyword("worthless", 40), "keyword_or": _keyword("worthless or onrein", 60), "keyword_not": _keyword("the of not with", 40), "keyword_phrase": _keyword('"of the" that', 40), "keyword_only_not": _keyword("not the", 400),
    "keyword_normalized": keyword_normalized, "keyword_stemmed": keyword_stemmed, "native_search": native_search, "native_prefix": native_prefix, "native_documents": native_documents, "rank_fusion": rank_fusion, "hybrid_search": hybrid_search, "hybrid_stemmed": hybrid_stemmed,
    "typeahead": typeahead, "typeahead_native": typeahead_native, "diversified": diversified, "retrieval_quality": retrieval_quality, "folded": folded, "lexeme_positions": lexeme_positions, "trigram_counts": trigram_counts, "query_forms": query_forms, "embedding_queries": embedding_queries,
    "score_rules": score_rules, "text_configs": text_configs, "unit_vectors": unit_vectors, "label_means": label_means, "sign_distances": sign_distances,
}

_COS = "(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def _cos(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


def _grams(expr: str) -> str:
    return f"(SELECT coalesce(list(DISTINCT substr(p, i::INTEGER, 3)), []) FROM (SELECT '  ' || w || ' ' AS p, unnest(range(1, length(w) + 2)) AS i FROM (SELECT unnest(regexp_extract_all({expr}, '[\\p{{L}}\\p{{N}}]+')) AS w)))"


def _trigram_hits(query: str, limit: int, least: float = 0.1, where: str = "language = 'en'", rows: str = "docs") -> str:
    return f"""SELECT entity_type, entity_id, language, score FROM (
      SELECT entity_type, entity_id, language, len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) AS score
      FROM (SELECT entity_type, entity_id, language, {_grams("document")} AS g FROM {rows} WHERE {where}), (SELECT {_grams(f"'{query}'")} AS q))
    WHERE score >= {least} ORDER BY round(score, 9) DESC, entity_type, entity_id LIMIT {limit}"""


def _and(terms: list[str]) -> str:
    """Cover density of the documents that hold all terms, by running maxima over the places of the terms."""
    lasts = ", ".join(f"max(k) FILTER (WHERE w = '{t}') OVER o AS p{i}" for i, t in enumerate(terms))
    places = ", ".join(f"p{i}" for i in range(len(terms)))
    every = " AND ".join(f"p{i} IS NOT NULL" for i in range(len(terms)))
    return f"""SELECT entity_type, entity_id, language, sum(0.1::DOUBLE / (1 + (e - s) - (rn - rs))) AS score FROM (
      SELECT c.entity_type, c.entity_id, c.language, c.s, min(c.k) AS e, min(c.rn) AS rn, min(h.rn) AS rs FROM
        (SELECT entity_type, entity_id, language, k, rn, least({places}) AS s FROM (SELECT *, {lasts} FROM hits WINDOW o AS (PARTITION BY entity_id ORDER BY k)) WHERE {every}) c
        JOIN hits h ON h.entity_id = c.entity_id AND h.k = c.s
      GROUP BY ALL) GROUP BY ALL"""


def _hits(terms: list[str], stems: dict[str, str] | None = None) -> str:
    """The places of the terms; ``stems`` lists the words that stand for a term."""
    word = "w" if stems is None else "map_from_entries([" + ", ".join(f"('{w}', '{t}')" for w, t in stems.items()) + "])[w]"
    listed = ", ".join(f"'{t}'" for t in (terms if stems is None else stems))
    return f"""hits AS (SELECT entity_type, entity_id, language, {word} AS w, k, row_number() OVER (PARTITION BY entity_id ORDER BY k) AS rn FROM (SELECT entity_type, entity_id, language, unnest(lexemes) AS w, generate_subscripts(lexemes, 1) AS k FROM docs WHERE language = 'en') WHERE w IN ({listed}))"""


def _of_stem(stem: str, words: str) -> dict[str, str]:
    return dict.fromkeys(words.split(), stem)


#: All words of the test tables that have the stems which the queries ask for.
_THING = _of_stem("thing", "thing thinged thingedly thinges thinging thingingly thingly thinglyed thinglying")
_ANTH = _of_stem("anth", "anth anthed antheing anthes anthing anthingly anthly anthlyed") | _of_stem("onbl", "onble onbleing onbleingly onblely onblelying")
_SCRIPTS = "scripts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, 'script', '{i}', '{g}', '{f}')" for i, (g, _, f) in enumerate(X.SCRIPTS)) + ") AS v(query_id, entity_type, entity_id, language, document))"


def _ordered(inner: str, limit: int, shown: str = "round(s::DOUBLE, 6)") -> str:
    return f"SELECT entity_type, entity_id, language, {shown} AS score FROM (SELECT entity_type, entity_id, language, score AS s FROM ({inner}) ORDER BY round(score, 9) DESC, entity_type, entity_id LIMIT {limit})"


_AND3 = f"WITH {X.DOCUMENTS_SQL}, {_hits(['that', 'with', 'from'])}"
_PHRASE = "list_contains(list_transform(range(1, len(lexemes)), lambda i: lexemes[i] = 'of' AND lexemes[i + 1] = 'the'), true)"

SQL = {
    "knn_exact": f"WITH {X.VECTORS_SQL} SELECT v.entity_id, v.model, round({_cos('v.embedding', 'q.embedding')}, 6) AS score FROM vecs v, vecs q WHERE q.vec_id = 0 ORDER BY round({_cos('v.embedding', 'q.embedding')}, 9) DESC, v.entity_id LIMIT 10",
    "knn_wide": f"WITH {X.VECTORS_SQL} SELECT v.entity_id, v.model, round({_cos('v.embedding', 'q.embedding')}, 6) AS score FROM vecs v, vecs q WHERE q.vec_id = 0 ORDER BY round({_cos('v.embedding', 'q.embedding')}, 9) DESC, v.entity_id LIMIT 10",
    "knn_cells": "SELECT count(*) AS n_queries, true AS nine_of_ten FROM embeddings WHERE vec_id % 100 = 0",
    "knn_scoped": f"WITH {X.VECTORS_SQL} SELECT query_id, rank, entity_id, round(s, 6) AS score FROM (SELECT q.entity_id AS query_id, v.entity_id, {_cos('q.embedding', 'v.embedding')} AS s, (row_number() OVER (PARTITION BY q.entity_id ORDER BY round({_cos('q.embedding', 'v.embedding')}, 12) DESC, v.entity_id))::INTEGER AS rank FROM vecs v, vecs q WHERE v.label < 5) WHERE rank <= 3",
    "knn_floor": f"WITH {X.VECTORS_SQL} SELECT entity_id, round(s, 6) AS score FROM (SELECT v.entity_id, {_cos('v.embedding', 'q.embedding')} AS s FROM vecs v, vecs q WHERE q.vec_id = 3 AND v.vec_id NOT IN (3, 7, 11) AND v.label <> 4 ORDER BY round(s, 9) DESC, v.entity_id LIMIT 50) WHERE s >= 0.1",
    "knn_two_stage": f"""WITH {X.VECTORS_SQL}, near AS (
      SELECT v.*, q.embedding AS qe FROM vecs v, vecs q WHERE q.vec_id = 1
      ORDER BY list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)), v.entity_id LIMIT 50)
    SELECT entity_id, round(s, 6) AS score FROM (SELECT entity_id, {_cos('embedding', 'qe')} AS s FROM near) WHERE s >= 0 ORDER BY round(s, 9) DESC, entity_id LIMIT 10""",
    "knn_wide_two_stage": f"""WITH {X.VECTORS_SQL}, near AS (
      SELECT v.*, q.embedding AS qe FROM vecs v, vecs q WHERE q.vec_id = 1
      ORDER BY list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)), v.entity_id LIMIT 50)
    SELECT entity_id, round(s, 6) AS score FROM (SELECT entity_id, {_cos('embedding', 'qe')} AS s FROM near) WHERE s >= 0 ORDER BY round(s, 9) DESC, entity_id LIMIT 10""",
    "knn_stored_signs": f"""WITH {X.VECTORS_SQL}, near AS (
      SELECT v.*, q.embedding AS qe FROM vecs v, vecs q WHERE q.vec_id = 1
      ORDER BY list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)), v.entity_id LIMIT 50)
    SELECT entity_id, round(s, 6) AS score FROM (SELECT entity_id, {_cos('embedding', 'qe')} AS s FROM near) WHERE s >= 0 ORDER BY round(s, 9) DESC, entity_id LIMIT 10""",
    "similar_to": f"WITH {X.VECTORS_SQL} SELECT entity_id, round(s, 6) AS score FROM (SELECT v.entity_id, {_cos('v.embedding', 'q.embedding')} AS s FROM vecs v, vecs q WHERE q.vec_id = 5 AND v.vec_id <> 5 ORDER BY round(s, 9) DESC, v.entity_id LIMIT 20)",
    "knn_all_queries": f"WITH {X.VECTORS_SQL} SELECT query_id, rank, entity_id, round(s, 6) AS score FROM (SELECT q.entity_id AS query_id, v.entity_id, {_cos('q.embedding', 'v.embedding')} AS s, (row_number() OVER (PARTITION BY q.entity_id ORDER BY round({_cos('q.embedding', 'v.embedding')}, 12) DESC, v.entity_id))::INTEGER AS rank FROM vecs v, vecs q) WHERE rank <= 10",
    "trigram_search": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language, round(score, 6) AS score FROM ({_trigram_hits('anthing the ouen tion', 50)})",
    "trigram_all_queries": f"""WITH {X.DOCUMENTS_SQL}, d AS (SELECT entity_type, entity_id, language, {_grams("document")} AS g FROM docs), q AS (SELECT item_id AS query_id, {_grams("f")} AS g FROM (SELECT item_id, {T.fold_latin_sql("text")} AS f FROM benchmark)),
    s AS (SELECT query_id, entity_type, entity_id, language, len(list_intersect(d.g, q.g)) / (len(d.g) + len(q.g) - len(list_intersect(d.g, q.g))) AS score FROM d, q)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_type, entity_id))::INTEGER AS rank, entity_type, entity_id, language, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY rank <= 5""",
    "trigram_scan": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language, round(score, 6) AS score FROM ({_trigram_hits('anthing ouen', 30, where="language = 'de' AND entity_id <> '2' AND length(document) > 100")})",
    "trigram_scripts": f"""WITH {X.DOCUMENTS_SQL}, {_SCRIPTS}, every AS (SELECT entity_type, entity_id, language, document FROM docs UNION ALL SELECT entity_type, entity_id, language, document FROM scripts),
    d AS (SELECT entity_type, entity_id, language, {_grams("document")} AS g FROM every WHERE language IN (SELECT language FROM scripts)), q AS (SELECT query_id, language, {_grams("document")} AS g FROM scripts),
    s AS (SELECT query_id, entity_type, entity_id, d.language, len(list_intersect(d.g, q.g)) / (len(d.g) + len(q.g) - len(list_intersect(d.g, q.g))) AS score FROM d JOIN q ON d.language = q.language)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_type, entity_id))::INTEGER AS rank, entity_type, entity_id, language, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY rank <= 3""",
    "typeahead_scripts": f"WITH {_SCRIPTS} SELECT query_id, entity_id, CASE WHEN language IN ('ja', 'ko') THEN 0.666667::DOUBLE WHEN language = 'zh' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM scripts",
    "keyword_and": f"{_AND3} {_ordered(_and(['that', 'with', 'from']), 40)}",
    "keyword_term": f"WITH {X.DOCUMENTS_SQL}, {_hits(['worthless'])} {_ordered('SELECT entity_type, entity_id, language, count(*) * 0.1::DOUBLE AS score FROM hits GROUP BY ALL', 40)}",
    "keyword_or": f"WITH {X.DOCUMENTS_SQL}, {_hits(['worthless', 'onrein'])} {_ordered('SELECT entity_type, entity_id, language, count(*) * 0.1::DOUBLE AS score FROM hits GROUP BY ALL', 60)}",
    "keyword_not": f"WITH {X.DOCUMENTS_SQL}, {_hits(['the', 'of'])} " + _ordered(f"SELECT s.* FROM ({_and(['the', 'of'])}) s JOIN docs d USING (entity_id) WHERE NOT list_contains(d.lexemes, 'with')", 40),
    "keyword_phrase": f"WITH {X.DOCUMENTS_SQL}, {_hits(['of', 'the', 'that'])} " + _ordered(f"SELECT s.* FROM ({_and(['of', 'the', 'that'])}) s JOIN docs d USING (entity_id) WHERE {_PHRASE}", 40),
    "keyword_only_not": f"WITH {X.DOCUMENTS_SQL} {_ordered("SELECT entity_type, entity_id, language, 0.0::DOUBLE AS score FROM docs WHERE language = 'en' AND NOT list_contains(lexemes, 'the')", 400)}",
    "keyword_normalized": f"{_AND3} {_ordered(_and(['that', 'with', 'from']), 30, 'round((s / (s + 1))::DOUBLE, 6)')}",
    "keyword_stemmed": f"WITH {X.DOCUMENTS_SQL}, {_hits(['thing'], _THING)} " + _ordered("SELECT h.entity_type, h.entity_id, h.language, count(*) * 0.1::DOUBLE AS score FROM hits h JOIN docs d USING (entity_id) WHERE NOT list_contains(d.lexemes, 'worthless') GROUP BY ALL", 30),
    "native_search": f"WITH {X.NATIVE_SQL} SELECT entity_type, entity_id, language, round(n / (n + 1), 6) AS score, n AS raw_score FROM (SELECT *, ((length(l) - length(replace(l, '東京', ''))) / 2 + (length(l) - length(replace(l, 'tokyo', ''))) / 5)::DOUBLE AS n FROM (SELECT *, lower(raw_document) AS l FROM native WHERE language = 'ja') WHERE contains(l, '東京') AND contains(l, 'tokyo')) ORDER BY round(n, 9) DESC, entity_type, entity_id LIMIT 20",
    "native_prefix": f"WITH {X.NATIVE_SQL} SELECT entity_type, entity_id, language, round(n / (n + 1), 6) AS score FROM (SELECT *, len(list_filter(regexp_extract_all(lower(raw_document), '[\\p{{L}}\\p{{N}}]+'), lambda w: starts_with(w, 'tok')))::DOUBLE AS n FROM native WHERE language = 'ja') WHERE n > 0 ORDER BY round(n, 9) DESC, entity_type, entity_id LIMIT 20",
    "native_documents": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language, round(n / (n + 1), 6) AS score FROM (SELECT *, ((length(l) - length(replace(l, 'aux', ''))) / 3 + (length(l) - length(replace(l, 'ié', ''))) / 2)::DOUBLE AS n FROM (SELECT *, lower(raw_document) AS l FROM docs WHERE language = 'fr') WHERE contains(l, 'aux') AND contains(l, 'ié')) ORDER BY round(n, 9) DESC, entity_type, entity_id LIMIT 40",
    "rank_fusion": f"""WITH {X.DOCUMENTS_SQL}, {X.DOCUMENT_VECTORS_SQL}, a AS ({_trigram_hits('anthing ouen', 20)}),
    b AS (SELECT v.entity_type, v.entity_id, v.language, {_cos('v.embedding', 'q.embedding::DOUBLE[]')} AS score FROM dvecs v, embeddings q WHERE q.vec_id = 2 AND v.language = 'en' ORDER BY round(score, 9) DESC, v.entity_type, v.entity_id LIMIT 20),
    r AS (SELECT *, 2.0 AS w, row_number() OVER (ORDER BY round(score, 9) DESC, entity_type, entity_id) AS rank FROM a UNION ALL SELECT *, 1.0, row_number() OVER (ORDER BY round(score, 9) DESC, entity_type, entity_id) FROM b)
    SELECT entity_type, entity_id, language, round(sum(w::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY ALL""",
    "hybrid_search": f"""{_AND3}, {X.DOCUMENT_VECTORS_SQL}, a AS (SELECT * FROM ({_and(['that', 'with', 'from'])}) ORDER BY round(score, 9) DESC, entity_type, entity_id LIMIT 20),
    b AS (SELECT v.entity_type, v.entity_id, v.language, {_cos('v.embedding', 'q.embedding::DOUBLE[]')} AS score FROM dvecs v, embeddings q WHERE q.vec_id = 2 AND v.language = 'en' ORDER BY round(score, 9) DESC, v.entity_type, v.entity_id LIMIT 20),
    r AS (SELECT entity_type, entity_id, language, row_number() OVER (ORDER BY round(score, 9) DESC, entity_type, entity_id) AS rank FROM a UNION ALL SELECT entity_type, entity_id, language, row_number() OVER (ORDER BY round(score, 9) DESC, entity_type, entity_id) FROM b)
    SELECT entity_type, entity_id, language, round(s, 6) AS score FROM (SELECT entity_type, entity_id, language, sum(1.0::DOUBLE / (60 + rank)) AS s FROM r GROUP BY ALL ORDER BY round(s, 9) DESC, entity_type, entity_id LIMIT 20)""",
    "hybrid_stemmed": f"""WITH {X.DOCUMENTS_SQL}, {_hits(['anth', 'onbl'], _ANTH)}, {X.DOCUMENT_VECTORS_SQL}, a AS (SELECT * FROM ({_and(['anth', 'onbl'])}) ORDER BY round(score, 9) DESC, entity_type, entity_id LIMIT 20),
    near AS (SELECT v.*, q.embedding::DOUBLE[] AS qe FROM dvecs v, embeddings q WHERE q.vec_id = 2 AND v.language = 'en'
      ORDER BY list_sum(list_transform(list_zip(v.embedding, q.embedding::DOUBLE[]), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)), v.entity_type, v.entity_id LIMIT 100),
    b AS (SELECT * FROM (SELECT entity_type, entity_id, language, {_cos('embedding', 'qe')} AS score FROM near) WHERE score >= 0 ORDER BY round(score, 9) DESC, entity_type, entity_id LIMIT 20),
    r AS (SELECT entity_type, entity_id, language, row_number() OVER (ORDER BY round(score, 9) DESC, entity_type, entity_id) AS rank FROM a UNION ALL SELECT entity_type, entity_id, language, row_number() OVER (ORDER BY round(score, 9) DESC, entity_type, entity_id) FROM b)
    SELECT entity_type, entity_id, language, round(s, 6) AS score FROM (SELECT entity_type, entity_id, language, sum(1.0::DOUBLE / (60 + rank)) AS s FROM r GROUP BY ALL ORDER BY round(s, 9) DESC, entity_type, entity_id LIMIT 20)""",
    "typeahead": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language, round(score, 6) AS score FROM ({_trigram_hits('ouen the', 25)})",
    "typeahead_native": f"""WITH {X.NATIVE_SQL}, forms(entity_type, entity_id, language, document) AS (VALUES ('series', '1', 'ja', 'gui mie noren'), ('series', '2', 'ja', 'gui ping fan ke zhang gui noping zang'), ('series', '3', 'ja', 'blue archive buru a kaibu'), ('film', '4', 'ja', 'dong jing wu yu tokyo story'), ('series', '10', 'ja', 'tokyo dong jing tokyo dong jing 2020'), ('series', '11', 'ja', 'kyoto token')),
    a AS ({_trigram_hits('tokyo dong jing', 10, rows='forms', where="language = 'ja'")}),
    b AS (SELECT entity_type, entity_id, language, n / (n + 1) AS score FROM (SELECT *, ((length(l) - length(replace(l, '東京', ''))) / 2 + len(list_filter(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}]+'), lambda w: starts_with(w, 'tokyo'))))::DOUBLE AS n FROM (SELECT *, lower(raw_document) AS l FROM native WHERE language = 'ja') WHERE contains(l, '東京') AND contains(l, 'tokyo')))
    SELECT entity_type, entity_id, language, round(s, 6) AS score FROM (SELECT entity_type, entity_id, language, max(score) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL ORDER BY round(s, 9) DESC, entity_type, entity_id LIMIT 10)""",
    "diversified": f"""WITH RECURSIVE {X.VECTORS_SQL}, hits AS (
      SELECT q.entity_id AS query_id, v.entity_id, v.embedding, {_cos('q.embedding', 'v.embedding')} AS score, row_number() OVER (PARTITION BY q.entity_id ORDER BY round({_cos('q.embedding', 'v.embedding')}, 12) DESC, v.entity_id) AS rank FROM vecs v, vecs q QUALIFY rank <= 20),
    close AS (SELECT a.query_id, a.rank AS i, b.rank AS j, greatest({_cos('a.embedding', 'b.embedding')}, 0) AS s FROM hits a JOIN hits b USING (query_id)),
    picked(query_id, place, chosen) AS (
      SELECT query_id, 1, [rank] FROM hits WHERE rank = 1
      UNION ALL
      SELECT query_id, place + 1, list_append(chosen, i) FROM (
        SELECT p.query_id, p.place, p.chosen, c.i, row_number() OVER (PARTITION BY p.query_id ORDER BY round(0.5::DOUBLE * any_value(h.score) - 0.5::DOUBLE * max(c.s), 12) DESC, c.i) AS k
        FROM picked p JOIN close c ON c.query_id = p.query_id AND list_contains(p.chosen, c.j) AND NOT list_contains(p.chosen, c.i) JOIN hits h ON h.query_id = p.query_id AND h.rank = c.i
        WHERE p.place < 5 GROUP BY p.query_id, p.place, p.chosen, c.i) WHERE k = 1)
    SELECT p.query_id, p.place::BIGINT AS place, h.entity_id FROM picked p JOIN hits h ON h.query_id = p.query_id AND h.rank = p.chosen[p.place]""",
    "retrieval_quality": f"""WITH {X.VECTORS_SQL}, got AS (SELECT q.entity_id AS query_id, q.label AS ql, v.label AS vl, row_number() OVER (PARTITION BY q.entity_id ORDER BY round({_cos('q.embedding', 'v.embedding')}, 12) DESC, v.entity_id) AS rank FROM vecs v, vecs q QUALIFY rank <= 10),
    n AS (SELECT label, count(*) AS n FROM vecs GROUP BY label)
    SELECT query_id, round(count(*) FILTER (WHERE ql = vl) / any_value(n.n), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE ql = vl), 0), 6) AS reciprocal_rank FROM got JOIN n ON n.label = ql GROUP BY query_id""",
    "folded": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language, document FROM docs",
    "lexeme_positions": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language, lexeme, count(*) AS n, min(k)::BIGINT AS first_at FROM (SELECT entity_type, entity_id, language, unnest(lexemes) AS lexeme, generate_subscripts(lexemes, 1) AS k FROM docs) GROUP BY ALL",
    "trigram_stored": f"WITH {X.DOCUMENTS_SQL} SELECT entity_id, len({_grams('document')})::BIGINT AS n_trigrams FROM docs",
    "trigram_counts": f"WITH {X.DOCUMENTS_SQL} SELECT entity_id, len({_grams('document')})::BIGINT AS n_trigrams FROM docs",
    "query_forms": "SELECT item_id, words, array_to_string(list_transform(list_filter(string_split(words, ' '), lambda w: w <> ''), lambda w: w || '*'), ' ') AS prefixes, regexp_matches(text, '[\\x{3000}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') AS cjk, regexp_matches(text, '[A-Za-z0-9]') AS ascii, regexp_matches(text, '[\\p{L}\\p{N}]') AS usable FROM (SELECT *, trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words FROM benchmark)",
    "embedding_queries": "SELECT page_id, trim(regexp_replace(regexp_replace(url, '([\\p{L}\\p{N}])-([\\p{L}\\p{N}])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) AS query FROM pages",
    "score_rules": """SELECT event_id, round(CASE WHEN value > 0 THEN value / (value + 1) ELSE 0 END, 9) AS plain, round(CASE WHEN value > 50 THEN (value - 50) / (value - 50 + 10) ELSE 0 END, 9) AS shifted, round(CASE WHEN value > 0 THEN value / (value + 1) ELSE 0 END, 9) AS zero_k,
      CASE WHEN slow THEN least(900.0::DOUBLE * pow(2, greatest(n, 1) - 1), 604800) ELSE least(5.0::DOUBLE * pow(2, greatest(n, 1) - 1), 600) END AS wait
    FROM (SELECT *, user_id % 15 AS n, (user_id % 200 + 400) BETWEEN 400 AND 499 AND (user_id % 200 + 400) NOT IN (408, 429) AS slow FROM events)""",
    "text_configs": "SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE 'simple' END AS config, count(*) AS n FROM documents GROUP BY 1",
    "unit_vectors": "SELECT vec_id, i - 1 AS i, round((embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "label_means": "WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) SELECT label, (i - 1)::BIGINT AS i, round((x / sqrt(sum(x * x) OVER (PARTITION BY label)))::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS x FROM m",
    "sign_distances": "SELECT v.vec_id, list_sum(list_transform(list_zip(v.embedding, h.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::BIGINT AS apart FROM embeddings v JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) h USING (label)",
}
