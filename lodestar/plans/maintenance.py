"""Queries of the maintenance operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans import tables as X
from lodestar.session import table
from lodestar.sources import documents as D
from lodestar.sources import schemas
from lodestar.streaming import sync as S
from lodestar.streaming import tasks as Q
from lodestar.streaming.runtime import Runtime

NOW = "2024-01-20 00:00:00"
KEY = ["entity_type", "entity_id", "language"]
TASK = ["entity_type", "entity_id", "model", "language", "reason", "attempts", "next_run_at", "started_at"]


def _now():
    return F.lit(NOW).cast("timestamp")


def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_changes(X.changes(spark, sf_dir)).select(*KEY, "is_deleted", "reason", "updated_at")


def dirty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 250 oldest of the changes that wait."""
    return S.dirty_batch(S.latest_changes(X.changes(spark, sf_dir)), 250).select(*KEY, "is_deleted", "reason", "updated_at")


def backfill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand ids after a cursor."""
    return S.page_after(X.vectors(spark, sf_dir), "vec", "en", "250", 1000)


def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector; the vectors are those of the same number, some of them null."""
    ids = X.documents(spark, sf_dir).select(*KEY)
    vectors = X.document_vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("entity_id").cast("long") % 3 != 0, F.col("embedding")))
    return D.missing_embeddings(ids, vectors, X.MODEL)


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a batch that empties every seventh, rewrites every fifth and brings new ones."""
    now = _now()
    docs = X.documents(spark, sf_dir).drop("trigrams").withColumn("created_at", F.lit("2023-05-05 00:00:00").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    number = F.col("entity_id").cast("long")
    old = docs.filter((number % 7 == 0) | (number % 5 == 0)).select(*KEY, F.when(number % 7 == 0, F.lit(" -- ")).otherwise(F.concat(F.lit("Ärger! "), F.col("entity_id"))).alias("text"))
    new = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("entity_type"), F.col("item_id").cast("string").alias("entity_id"), F.lit("xx").alias("language"), "text")
    after = D.upsert_documents(docs, D.prepared(old.unionByName(new), "simple"), now)
    return after.select(*KEY, "document", F.size("lexemes").cast("long").alias("n_lexemes"), "created_at", "updated_at")


def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a deletion by keys and one by ids."""
    docs = X.documents(spark, sf_dir).select(*KEY)
    gone = X.document_vectors(spark, sf_dir).select(*KEY)
    return D.delete_ids(D.delete_keys(docs, gone), "src3", "en", ["203", "303", "403", "603", " "])


def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after a batch in which every fourth comes anew, reversed, and some come without a vector."""
    rows = X.vectors(spark, sf_dir).withColumn("created_at", F.lit("2023-05-05 00:00:00").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    number = F.col("entity_id").cast("long")
    batch = rows.filter(number % 4 == 0).withColumn("embedding", F.when(number % 3 != 0, F.reverse("embedding")))
    after = D.upsert_vectors(rows.drop("label"), batch, _now())
    return after.select("entity_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"), "created_at", "updated_at")


def prune_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the models that are active, where every third task is of another model."""
    tasks = X.tasks(spark, sf_dir).withColumn("model", F.when(F.col("entity_id").cast("long") % 3 == 0, F.lit("old")).otherwise(F.col("model")))
    models = D.upsert_models(schemas.empty(spark, "embedding_models"), [(X.MODEL, 64, "text")])
    return D.of_models(tasks, models).select("entity_type", "entity_id", "model")


def enqueue_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = X.tasks(spark, sf_dir)
    again = tasks.filter("attempts % 2 = 0").select(*Q.KEY).unionByName(X.vectors(spark, sf_dir).select(*Q.KEY))
    return Q.enqueue(tasks, again, "model_backfill", _now()).select(*TASK)


def lease_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks after 250 that are due were leased."""
    return Q.lease(X.tasks(spark, sf_dir), _now())[0].select(*TASK)


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, letters, results): results of all tasks that were due, a few of which have lost their lease."""
    tasks = X.tasks(spark, sf_dir)
    n = F.col("entity_id").cast("long")
    results = tasks.filter(F.col("next_run_at") <= _now()).select(
        *Q.KEY, F.when(n % 10 == 9, F.col("next_run_at") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("next_run_at")).alias("lease"), "attempts",
        F.when(n % 4 != 0, F.lit("failed")).alias("error"), F.when(n % 3 == 0, F.lit(404)).when(n % 3 == 1, F.lit(429)).alias("status"), (n % 20 == 7).alias("missing"),
    )
    return tasks, schemas.empty(spark, "embedding_dead_letters"), results


def settle_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after their results: done, waiting longer, or gone to the dead letters."""
    return Q.settle(*_results(spark, sf_dir), _now(), jitter=False)[0].select(*TASK)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.settle(*_results(spark, sf_dir), _now(), jitter=False)[1].select("entity_type", "entity_id", "model", "language", "reason", "error", "attempts", "failed_at")


class Counts:
    """A provider that SQL can follow: characters, spaces and the letters e of a text, the first ``dims`` of them, and of assets how many there are."""

    def __init__(self, dims: int):
        self.dims = dims

    def embed(self, texts):
        return [[float(x) for x in (len(t), t.count(" "), t.count("e"))[: self.dims]] for t in texts]

    def embed_assets(self, text, assets):
        return [float(len(text)), float(sum(a["kind"] == "image" for a in assets)), float(len(assets))][: self.dims]


def embedded_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task of every document for five models: two for texts, one for assets, which every third document has, one whose vectors are of the wrong length, and one without a provider."""
    texts = X.raw_documents(spark, sf_dir)
    number = F.col("entity_id").cast("long")
    asset = lambda kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("http://a/"), F.col("entity_id")).alias("url"))
    assets = texts.filter(number % 3 == 0).select("entity_type", "entity_id", F.when(number % 2 == 0, F.array(asset("image"), asset("video"))).otherwise(F.array(asset("image"))).alias("assets"))
    runtime = Runtime({"text3": Counts(3), "text2": Counts(2), "short": Counts(1)}, {"vl3": Counts(3)}, asset_urls=assets)
    models = spark.createDataFrame([(m,) for m in ("text3", "text2", "short", "vl3", "none")], "model string")
    tasks = texts.select(*KEY).crossJoin(F.broadcast(models)).select(*Q.KEY, _now().alias("next_run_at"), F.lit(2).alias("attempts"))
    got = runtime.embed(tasks, texts, {"text3": 3, "text2": 2, "short": 2, "vl3": 3})
    return got.select(*Q.KEY, F.size("embedding").cast("long").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("head"), F.round(F.element_at("embedding", -1).cast("double"), 5).alias("tail"), "error", "missing")


def index_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index names of a model for every source and size of text."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("n_chars").cast("string").alias("dims")).distinct()
    return rows.select("source", "dims", F.substring(F.sha1(F.concat("source", F.lit(":"), "dims").cast("binary")), 1, 16).alias("suffix"))


QUERIES = {
    "latest_changes": latest_changes, "dirty_batch": dirty_batch, "backfill_page": backfill_page, "missing_embeddings": missing_embeddings, "upsert_documents": upsert_documents, "delete_documents": delete_documents, "upsert_vectors": upsert_vectors,
    "prune_tasks": prune_tasks, "enqueue_tasks": enqueue_tasks, "lease_tasks": lease_tasks, "settle_tasks": settle_tasks, "dead_letters": dead_letters, "embedded_by_model": embedded_by_model, "index_suffixes": index_suffixes,
}

_T = f"TIMESTAMP '{NOW}'"
_OLD = "TIMESTAMP '2023-05-05 00:00:00'"
_LATEST = f"{X.CHANGES_SQL}, latest AS (SELECT * EXCLUDE seq FROM changes QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, language ORDER BY updated_at DESC, seq DESC) = 1)"
_TASK = ", ".join(TASK)
_NUMBER = "entity_id::BIGINT"
_RESULTS = f"""{X.TASKS_SQL}, results AS (
  SELECT *, {_NUMBER} % 10 <> 9 AS held, {_NUMBER} % 4 <> 0 AND {_NUMBER} % 20 <> 7 AS failed, attempts + 1 AS n, {_NUMBER} % 3 = 0 AS slow FROM tasks WHERE next_run_at <= {_T})"""
_BATCH_FOLD = X.T.fold_latin_sql("trim(text)")

SQL = {
    "latest_changes": f"WITH {_LATEST} SELECT * FROM latest",
    "dirty_batch": f"WITH {_LATEST} SELECT * FROM latest ORDER BY updated_at, entity_type, entity_id, language LIMIT 250",
    "backfill_page": f"WITH {X.VECTORS_SQL} SELECT entity_type, entity_id, language FROM vecs WHERE entity_id > '250' ORDER BY entity_id LIMIT 1000",
    "missing_embeddings": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language FROM docs WHERE entity_id NOT IN (SELECT vec_id::VARCHAR FROM embeddings)",
    "upsert_documents": f"""WITH {X.DOCUMENTS_SQL}, batch AS (
      SELECT entity_type, entity_id, language, CASE WHEN {_NUMBER} % 7 = 0 THEN ' -- ' ELSE 'Ärger! ' || entity_id END AS text FROM docs WHERE {_NUMBER} % 7 = 0 OR {_NUMBER} % 5 = 0
      UNION ALL SELECT 'benchmark', item_id::VARCHAR, 'xx', text FROM benchmark),
    ready AS (SELECT entity_type, entity_id, language, {_BATCH_FOLD} AS document, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS n_lexemes, CASE WHEN entity_type = 'benchmark' THEN {_T} ELSE {_OLD} END AS created_at, {_T} AS updated_at FROM batch)
    SELECT entity_type, entity_id, language, document, len(lexemes)::BIGINT AS n_lexemes, {_OLD} AS created_at, {_OLD} AS updated_at FROM docs WHERE {_NUMBER} % 7 <> 0 AND {_NUMBER} % 5 <> 0
    UNION ALL SELECT * FROM ready WHERE document <> ''""",
    "delete_documents": f"WITH {X.DOCUMENTS_SQL} SELECT entity_type, entity_id, language FROM docs WHERE entity_id NOT IN (SELECT vec_id::VARCHAR FROM embeddings) AND NOT (entity_type = 'src3' AND language = 'en' AND entity_id IN ('203', '303', '403', '603'))",
    "upsert_vectors": f"SELECT vec_id::VARCHAR AS entity_id, round((CASE WHEN vec_id % 4 = 0 AND vec_id % 3 <> 0 THEN embedding[len(embedding)] ELSE embedding[1] END)::DOUBLE, 6) AS head, {_OLD} AS created_at, CASE WHEN vec_id % 4 = 0 AND vec_id % 3 <> 0 THEN {_T} ELSE {_OLD} END AS updated_at FROM embeddings",
    "prune_tasks": f"WITH {X.TASKS_SQL} SELECT entity_type, entity_id, model FROM tasks WHERE {_NUMBER} % 3 <> 0",
    "enqueue_tasks": f"""WITH {X.TASKS_SQL}, {X.VECTORS_SQL} SELECT entity_type, entity_id, model, language, CASE WHEN attempts % 2 = 0 THEN 'model_backfill' ELSE reason END AS reason, attempts, CASE WHEN attempts % 2 = 0 THEN least(next_run_at, {_T}) ELSE next_run_at END AS next_run_at, started_at FROM tasks
    UNION ALL SELECT entity_type, entity_id, model, language, 'model_backfill', 0, {_T}, NULL FROM vecs""",
    "lease_tasks": f"""WITH {X.TASKS_SQL}, picked AS (SELECT entity_type, entity_id FROM tasks WHERE next_run_at <= {_T} ORDER BY next_run_at, entity_type, entity_id LIMIT 250)
    SELECT t.entity_type, t.entity_id, model, language, reason, attempts, CASE WHEN p.entity_id IS NOT NULL THEN {_T} + INTERVAL 30 SECOND ELSE next_run_at END AS next_run_at, CASE WHEN p.entity_id IS NOT NULL THEN {_T} END AS started_at
    FROM tasks t LEFT JOIN picked p ON t.entity_type = p.entity_type AND t.entity_id = p.entity_id""",
    "settle_tasks": f"""WITH {_RESULTS}
    SELECT {_TASK} FROM tasks WHERE next_run_at > {_T}
    UNION ALL SELECT {_TASK} FROM results WHERE NOT held
    UNION ALL SELECT entity_type, entity_id, model, language, reason, n::INTEGER, {_T} + to_seconds((CASE WHEN slow THEN least(900 * pow(2, n - 1), 604800) ELSE least(5 * pow(2, n - 1), 600) END)::BIGINT), started_at FROM results WHERE held AND failed AND n < 10""",
    "dead_letters": f"WITH {_RESULTS} SELECT entity_type, entity_id, model, language, reason, 'failed' AS error, n::INTEGER AS attempts, {_T} AS failed_at FROM results WHERE held AND failed AND n >= 10",
    "embedded_by_model": f"""WITH docs AS (SELECT source AS entity_type, doc_id::VARCHAR AS entity_id, lang AS language, doc_id, text, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank, coalesce(length(text), 0)::DOUBLE AS a, coalesce(length(text) - length(replace(text, ' ', '')), 0)::DOUBLE AS b, coalesce(length(text) - length(replace(text, 'e', '')), 0)::DOUBLE AS c FROM documents),
    made AS (SELECT *, unnest(['text3', 'text2', 'short', 'vl3', 'none']) AS model FROM docs),
    vectors AS (SELECT *, blank OR (model = 'vl3' AND doc_id % 3 <> 0) AS missing, CASE model WHEN 'text3' THEN [a, b, c] WHEN 'text2' THEN [a, b] WHEN 'vl3' THEN CASE WHEN doc_id % 3 = 0 THEN [a, 1, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END] END END AS v FROM made)
    SELECT entity_type, entity_id, language, model, CASE WHEN NOT missing THEN len(v)::BIGINT END AS dims, CASE WHEN NOT missing THEN round((v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))))::FLOAT::DOUBLE, 5) END AS head, CASE WHEN NOT missing THEN round((v[len(v)] / sqrt(list_sum(list_transform(v, lambda x: x * x))))::FLOAT::DOUBLE, 5) END AS tail,
      CASE WHEN NOT missing THEN CASE model WHEN 'short' THEN 'a vector of 1 numbers for ' || chr(39) || 'short' || chr(39) WHEN 'none' THEN 'no provider for ' || chr(39) || 'none' || chr(39) END END AS error, missing FROM vectors""",
    "index_suffixes": "SELECT DISTINCT source, n_chars::VARCHAR AS dims, substr(sha1(source || ':' || n_chars::VARCHAR), 1, 16) AS suffix FROM documents",
}
