"""Snapshots, task states and whole passes of maintenance."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from lodestar.sources import documents as D
from lodestar.sources import schemas
from lodestar.sources.providers import HashProvider, HttpProvider, ProviderError
from lodestar.sources.store import Store
from lodestar.streaming import sync as S
from lodestar.streaming import tasks as Q
from lodestar.streaming.runtime import Runtime

NOW = "2024-01-01 00:00:00"
LATER = "2024-01-01 01:00:00"
TEXT = "entity_type string, entity_id string, language string, text string"


def ts(x):
    return F.lit(x).cast("timestamp")


def test_schemas_and_names(spark):
    assert schemas.identifier(" abc_1 ") == "abc_1" and schemas.literal("a'b") == "'a''b'"
    for bad in ("", "a b", "a;b"):
        with pytest.raises(ValueError, match="identifier"):
            schemas.identifier(bad)
    assert len(schemas.index_suffix("m", 3)) == 16
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("embedding_models").count() == 0
    store.write("embedding_models", D.upsert_models(store.read("embedding_models"), [("a", 3, "text"), ("b", 4, "vl")]))
    store.write("embedding_models", store.read("embedding_models").filter("model = 'a'"))
    assert [r["model"] for r in store.read("embedding_models").collect()] == ["a"]
    assert store.prune("embedding_models") == 1 and store.prune("embedding_models") == 0 and store.read("embedding_models").count() == 1
    key = "entity_type string, entity_id string, model string, language string"
    vector = lambda i, x: spark.createDataFrame([("t", i, "m", "en", [x])], key + ", embedding array<float>").withColumns({"created_at": ts(NOW), "updated_at": ts(NOW)})
    for k in range(23):
        store.merge("embedding_vectors", vector(str(k % 5), float(k)), spark.createDataFrame([("t", str((k + 1) % 5), "m", "en")], key))
    got = {r["entity_id"]: r["embedding"][0] for r in store.read("embedding_vectors").collect()}
    assert got == {"0": 20.0, "1": 21.0, "2": 22.0, "4": 19.0}
    for bad in ([("", 3, "text")], [("a", 0, "text")], [("a", 1, "audio")]):
        with pytest.raises(ValueError, match="not a model"):
            D.upsert_models(store.read("embedding_models"), bad)


def test_documents(spark):
    docs = schemas.empty(spark, "search_documents")
    raw = spark.createDataFrame([("t", "1", "en", " Running Dogs "), ("t", "2", "xx", "Running Dogs"), ("t", "3", "en", "!!"), ("t", "", "en", "x"), ("t", "4", "en", None), ("t", "1", "en", " ")], TEXT)
    one = D.upsert_documents(docs, D.prepared(raw), ts(NOW))
    rows = {r["entity_id"]: r for r in one.collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["lexemes"] == ["run", "dog"] and rows["2"]["lexemes"] == ["running", "dogs"] and rows["1"]["raw_document"] == "Running Dogs"
    two = D.upsert_documents(one, D.prepared(spark.createDataFrame([("t", "1", "en", "new"), ("t", "2", "xx", "")], TEXT)), ts(LATER)).collect()
    assert len(two) == 1 and two[0]["document"] == "new" and two[0]["created_at"] < two[0]["updated_at"]
    assert D.delete_ids(one, "t", "en", ["1", " "]).count() == 1 and D.delete_ids(one, "t", "en", []).count() == 2 and D.delete_ids(one, " ", "en", ["1"]).count() == 2
    batch = spark.createDataFrame([("t", "1", "m", "en", [1.0]), ("t", "2", "m", "en", []), ("t", "3", "m", "en", None)], "entity_type string, entity_id string, model string, language string, embedding array<float>")
    vectors = D.upsert_vectors(schemas.empty(spark, "embedding_vectors"), batch.filter("entity_id <> '2'"), ts(NOW))
    assert vectors.count() == 1
    with pytest.raises(Exception, match="empty"):
        D.upsert_vectors(schemas.empty(spark, "embedding_vectors"), batch, ts(NOW)).collect()
    missing = D.missing_embeddings(spark.createDataFrame([("t", "1", "en"), ("t", "9", "en"), ("t", "9", "en"), ("t", " ", "en")], "entity_type string, entity_id string, language string"), vectors, "m")
    assert [r["entity_id"] for r in missing.collect()] == ["9", "9"]


def test_task_states(spark):
    keys = spark.createDataFrame([("t", "1", "m", "en"), ("t", "2", "m", "en"), ("t", " ", "m", "en"), ("t", "1", "m", "en")], "entity_type string, entity_id string, model string, language string")
    tasks = Q.enqueue(schemas.empty(spark, "embedding_tasks"), keys, "dirty", ts(NOW))
    assert tasks.count() == 2
    after, leased = Q.lease(tasks, ts(NOW), 1)
    assert [r["entity_id"] for r in leased.collect()] == ["1"] and Q.ready(after, ts(NOW), 9).count() == 1
    lease = leased.withColumn("lease", F.col("next_run_at"))
    # Enqueued again meanwhile: neither completing nor failing touches it.
    again = Q.enqueue(after, keys.limit(1), "again", ts(NOW))
    assert Q.complete(again, lease).count() == 2 and Q.complete(after, lease).count() == 1
    failed = {r["entity_id"]: r for r in Q.fail(after, lease.withColumn("seconds", F.lit(0.2)), ts(LATER)).collect()}
    assert failed["1"]["attempts"] == 1 and failed["1"]["next_run_at"].second == 1 and failed["2"]["attempts"] == 0
    same = {r["entity_id"]: r for r in Q.fail(again, lease.withColumn("seconds", F.lit(9.0)), ts(LATER)).collect()}
    assert same["1"]["attempts"] == 0 and same["1"]["reason"] == "again"
    left, letters = Q.dead_letter(after, schemas.empty(spark, "embedding_dead_letters"), lease.withColumn("error", F.lit("x")), ts(NOW))
    assert left.count() == 1 and [(r["entity_id"], r["error"]) for r in letters.collect()] == [("1", "x")]
    models = D.upsert_models(schemas.empty(spark, "embedding_models"), [("k", 1, "text")])
    assert D.of_models(tasks, models).count() == 0 and D.of_models(tasks, schemas.empty(spark, "embedding_models")).count() == 2


class Broken:
    def embed(self, texts):
        raise ProviderError("no", 404 if "bad" in texts[0] else 500)


def test_pass(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    texts = spark.createDataFrame([("page", f"{i:02d}", "en", f"text number {i}") for i in range(30)] + [("page", "blank", "en", " ")], TEXT)
    entities = texts.select("entity_type", "entity_id", "language")
    options = S.SyncOptions(lexical_types=("page",), semantic_types=("page",), languages=("en",), page=20, pages=3, task_batch=12, config="simple")
    store.write("embedding_models", D.upsert_models(store.read("embedding_models"), [("m", 8, "text")]))
    S.sync_once(store, entities, texts, Runtime({"m": HashProvider(8)}), options, ts(NOW))
    # A page of documents and one of tasks, of which a batch is done.
    assert store.read("search_documents").count() == 20 and store.read("embedding_vectors").count() == 12 and store.read("embedding_tasks").count() == 8
    state = store.read("search_documents_backfill_state").first()
    assert (state["cursor"], state["state"]) == ("19", "running")
    S.sync_once(store, entities, texts, Runtime({"m": HashProvider(8)}), options, ts(LATER))
    assert store.read("search_documents_backfill_state").first()["state"] == "done" and store.read("search_documents").count() == 30
    assert store.read("embedding_vectors").count() == 24 and store.read("embedding_tasks").count() == 7
    # A change, a deletion and one with a blank key, which stays.
    dirty = spark.createDataFrame([("page", "00", "en", True), ("page", "01", "en", False), (" ", "x", "en", False)], "entity_type string, entity_id string, language string, is_deleted boolean").select("*", F.lit("r").alias("reason"), ts(NOW).alias("created_at"), ts(NOW).alias("updated_at"))
    store.write("search_dirty", dirty)
    texts2 = texts.withColumn("text", F.when(F.col("entity_id") == "01", F.lit("fresh")).otherwise(F.col("text")))
    S.apply_changes(store, texts2, options, ts(LATER))
    documents = store.read("search_documents")
    assert store.read("search_dirty").count() == 1 and documents.count() == 29 and store.read("embedding_vectors").count() == 23
    assert documents.filter("entity_id = '01'").first()["document"] == "fresh" and store.read("embedding_tasks").filter("entity_id = '01' and reason = 'dirty'").count() == 1
    store.write("embedding_tasks", store.read("embedding_tasks").filter("entity_id <> '01'"))
    # Failures wait; the wrong request waits longer; the last attempt is a dead letter.
    due = "2024-01-03 00:00:00"
    tasks = store.write("embedding_tasks", store.read("embedding_tasks").withColumn("attempts", F.when(F.col("entity_id") == F.lit("24"), 9).otherwise(0)))
    assert tasks.count() == 7
    assert S.drain(store, texts, Runtime({"m": Broken()}), options, ts(due)) == 7
    # The blank text is done, one is dead, five wait.
    assert store.read("embedding_dead_letters").count() == 1 and store.read("embedding_tasks").count() == 5
    assert S.drain(store, texts, Runtime({"m": Broken()}), options, ts(due)) == 0


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    texts = spark.createDataFrame([("page", "1", "en", "one"), ("page", "2", "en", "two")], TEXT)
    change = "entity_type string, entity_id string, language string, is_deleted boolean, reason string, updated_at timestamp"
    log = spark.createDataFrame([("page", "1", "en", False, "new"), ("page", "2", "en", False, "new"), ("page", "2", "en", True, "gone")], change.rsplit(",", 1)[0]).withColumn("updated_at", F.when(F.col("is_deleted"), ts(LATER)).otherwise(ts(NOW)))
    log.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(change).parquet(f"{tmp_path}/log")
    options = S.SyncOptions(lexical_types=("page",), languages=(), config="simple")
    S.follow(stream, store, texts.select("entity_type", "entity_id", "language"), texts, None, options, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [r["entity_id"] for r in store.read("search_documents").collect()] == ["1"] and store.read("search_dirty").count() == 0


def test_providers(spark):
    a, b, c = HashProvider(16).embed(["red cat", "red cat", "blue sky"])
    assert a == b != c and abs(sum(x * x for x in a) - 1) < 1e-9
    sent = []

    class Answer(io.BytesIO):
        def __exit__(self, *_):
            pass

    def opener(request, timeout):
        sent.append((request.full_url, json.loads(request.data), timeout))
        return Answer(json.dumps({"data": [{"embedding": [3, 4]} for _ in sent[-1][1]["input"]][: 1 + (len(sent) > 1)]}).encode())

    p = HttpProvider("http://x/v1/", "m", dimensions=2, names=(("m", "host/m"),), opener=opener)
    assert p.embed(["t"]) == [[0.6, 0.8]] and p.embed([]) == []
    assert sent[0] == ("http://x/v1/embeddings", {"model": "host/m", "input": ["t"], "dimensions": 2}, 60.0)
    with pytest.raises(ProviderError, match="vectors"):
        p.embed(["a", "b", "c"])

    def refuse(request, timeout):
        raise urllib.error.HTTPError("u", 429, "slow", {}, None)

    with pytest.raises(ProviderError) as e:
        HttpProvider("http://x", "m", opener=refuse).embed(["a"])
    assert e.value.status == 429
