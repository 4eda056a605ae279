"""Embedding by model, with and without assets, one entity at a time, the rate limit, and queues that write only changes."""

import pytest
from pyspark.sql import functions as F

from lodestar.sources import documents as D
from lodestar.sources import schemas
from lodestar.sources.providers import HashProvider, ProviderError
from lodestar.sources.store import Store
from lodestar.streaming import sync as S
from lodestar.streaming.runtime import Bucket, EntityNotFound, Runtime, register_models

TEXT = "entity_type string, entity_id string, language string, text string"
ASSETS = "entity_type string, entity_id string, assets array<struct<kind:string,url:string>>"


def ts(x):
    return F.lit(x).cast("timestamp")


NOW, LATER = "2024-01-01 00:00:00", "2024-01-01 01:00:00"


class Assets:
    def embed_assets(self, text, assets):
        if text == "bad":
            raise ProviderError("no", 400)
        return [3.0 * len(assets), 4.0 * len(assets)]


def test_runtime(spark, tmp_path):
    urls = spark.createDataFrame([("t", "1", [("image", "u")]), ("t", "2", []), ("t", "3", [("video", "u"), ("frame", "w")]), ("t", "4", None)], ASSETS)
    with pytest.raises(ValueError, match="required"):
        Runtime()
    with pytest.raises(ValueError, match="both"):
        Runtime({"m": HashProvider(4)}, {"m": Assets()}, asset_urls=urls)
    with pytest.raises(ValueError, match="list of assets"):
        Runtime({"m": HashProvider(4)}, {"v": Assets()})
    with pytest.raises(ValueError, match="blank"):
        Runtime({" ": HashProvider(4)})
    assert Runtime(documents_only=True).models() == []
    rt = Runtime({"m": HashProvider(4)}, {"v": Assets()}, asset_urls=urls)
    assert rt.models() == ["m", "v"] and rt.takes_assets("v") and not rt.takes_assets("m") and len(rt.embed_query("m", "x")) == 4
    assert rt.specs({"m": 4, "v": 2}) == [("m", 4, "text"), ("v", 2, "vl")]
    texts = spark.createDataFrame([("t", "1", "en", "a b"), ("t", "2", "en", "x"), ("t", "3", "en", "bad"), ("t", "4", "en", "y"), ("t", "5", "en", " ")], TEXT)
    got = {r["entity_id"]: r for r in rt.embed_entities(texts, texts, "m", calls=2).collect()}
    assert len(got["1"]["embedding"]) == 4 and got["5"]["missing"] and not got["2"]["missing"]
    got = {r["entity_id"]: r for r in rt.embed_entities(texts, texts, "v", calls=2).collect()}
    assert [round(x, 3) for x in got["1"]["embedding"]] == [0.6, 0.8] and got["2"]["missing"] and got["4"]["missing"] and got["5"]["missing"] and (got["3"]["error"], got["3"]["status"]) == ("no", 400)
    with pytest.raises(ValueError, match="no provider"):
        rt.embed_entities(texts, texts, "w")
    assert rt.enqueue(schemas.empty(spark, "embedding_tasks"), texts, "r", ts(NOW)).count() == 10
    # One entity at a time, by whichever provider the model has.
    store = Store(spark, f"file://{tmp_path}/s")
    register_models(store, rt.specs({"m": 4, "v": 2}))
    for model in ("m", "v"):
        rt.generate(store, "t", "1", model, "en", texts, ts(NOW))
    assert {(r["model"], len(r["embedding"])) for r in store.read("embedding_vectors").collect()} == {("m", 4), ("v", 2)}
    for entity, model, error in (("5", "m", EntityNotFound), ("77", "m", EntityNotFound), ("2", "v", EntityNotFound), ("3", "v", ProviderError)):
        with pytest.raises(error):
            rt.generate(store, "t", entity, model, "en", texts, ts(NOW))
    assert store.read("embedding_vectors").count() == 2


def test_tasks_go_to_their_models(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    urls = spark.createDataFrame([("page", "1", [("image", "u")]), ("page", "2", [])], ASSETS)
    rt = Runtime({"text3": HashProvider(3), "text5": HashProvider(5), "wrong": HashProvider(2)}, {"vl2": Assets()}, asset_urls=urls)
    register_models(store, rt.specs({"text3": 3, "text5": 5, "wrong": 9, "vl2": 2}))
    texts = spark.createDataFrame([("page", "1", "en", "one"), ("page", "2", "en", "two"), ("page", "3", "en", None)], TEXT)
    store.write("embedding_tasks", rt.enqueue(store.read("embedding_tasks"), texts, "new", ts(NOW)))
    assert S.drain(store, texts, rt, S.SyncOptions(per_second=1000), ts(NOW)) == 12
    got = {(r["model"], r["entity_id"]): len(r["embedding"]) for r in store.read("embedding_vectors").collect()}
    # Entity 2 has no assets and 3 no text: their tasks are done; the wrong length waits.
    assert got == {("text3", "1"): 3, ("text3", "2"): 3, ("text5", "1"): 5, ("text5", "2"): 5, ("vl2", "1"): 2}
    left = store.read("embedding_tasks").collect()
    assert {(r["model"], r["entity_id"], r["attempts"]) for r in left} == {("wrong", "1", 1), ("wrong", "2", 1)}
    # Models that aren't active any more lose their tasks, states and letters; vectors stay.
    register_models(store, [("text3", 3, "text")])
    assert store.read("embedding_tasks").count() == 0 and store.read("embedding_vectors").count() == 5 and [r["model"] for r in store.read("embedding_models").collect()] == ["text3"]
    register_models(store, [])
    assert store.read("embedding_models").count() == 1


def test_bucket():
    now, slept = [0.0], []

    def sleep(x):
        slept.append(x)
        now[0] += x

    b = Bucket(4.0, 3, lambda: now[0], sleep)
    for _ in range(11):
        b.take()
    assert now[0] == pytest.approx(2.0) and len(slept) == 8
    now[0] += 100
    for _ in range(3):
        b.take()
    assert len(slept) == 8
    Bucket(0).take()


def test_queues_write_only_changes(spark, tmp_path):
    """Passes over a large queue leave the table where it lies, also when the log of changes is put together."""
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(5000).select(F.lit("page").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit("m").alias("model"), F.lit("en").alias("language"), F.lit("r").alias("reason"), F.lit(0).alias("attempts"), ts(NOW).alias("next_run_at"), F.lit(None).cast("timestamp").alias("started_at"), ts(NOW).alias("created_at"), ts(NOW).alias("updated_at"))
    store.write("embedding_tasks", rows)
    store.write("embedding_models", D.upsert_models(store.read("embedding_models"), [("m", 4, "text")]))
    version = store._pointer("embedding_tasks")["version"]
    texts = rows.select("entity_type", "entity_id", "language", F.lit("x y").alias("text"))
    for _ in range(11):
        assert S.drain(store, texts, Runtime({"m": HashProvider(4)}), S.SyncOptions(task_batch=5), ts(LATER)) == 5
        assert store._pointer("embedding_tasks")["version"] == version
    assert store.read("embedding_tasks").count() == 5000 - 55 and store.read("embedding_vectors").count() == 55


def test_embedding_partitions_share_evenly(spark):
    """A text comes once for all of its models, and no partition gets more than about its share."""
    from pyspark.sql import functions as F

    from lodestar.sources.providers import HashProvider
    from lodestar.streaming.runtime import Runtime

    texts = spark.range(800).select(F.lit("t").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit("en").alias("language"), F.concat(F.lit("text "), "id").alias("text"))
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    tasks = texts.drop("text").crossJoin(models).withColumn("next_run_at", F.lit("2024-01-20 00:00:00").cast("timestamp")).withColumn("attempts", F.lit(2))
    got = Runtime({m: HashProvider(4) for m in "abc"}).embed(tasks, texts, calls=8)
    rows = got.withColumn("p", F.spark_partition_id()).collect()
    sizes = [sum(r["p"] == p for r in rows) for p in range(8)]
    assert sum(sizes) == 2400 and min(sizes) > 150 and max(sizes) < 450
    assert len({(r["entity_id"], r["p"]) for r in rows}) == 800
    assert {(r["lease"].isoformat(), r["attempts"], r["error"], len(r["embedding"])) for r in rows} == {("2024-01-20T00:00:00", 2, None, 4)}
