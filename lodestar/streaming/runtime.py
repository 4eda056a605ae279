"""Embedding: which provider a model has, and the calls to it, for queries, tables of keys and single entities."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectors import unit_of
from lodestar.operators.common import small_batches
from lodestar.operators.fusion import partial_batches
from lodestar.sources import documents as D
from lodestar.sources import schemas
from lodestar.sources.providers import TEXTS_PER_CALL, Provider, ProviderError
from lodestar.sources.store import Store
from lodestar.streaming import tasks as Q

ENTITY = list(schemas.KEYS["search_documents"])


class AssetProvider(Protocol):
    """Embeds a text together with assets, dicts of kind (image, frame or video) and url."""

    def embed_assets(self, text: str, assets: list[dict]) -> list[float]: ...


class EntityNotFound(LookupError):
    """An entity without a text, or without assets where the model takes them."""


@dataclass
class Bucket:
    """A token bucket: ``take`` waits until a call may go out. A rate of 0 never waits."""

    rate: float
    burst: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self.tokens, self.at = self.burst, self.clock()

    def take(self) -> None:
        if self.rate <= 0:
            return
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        self.tokens -= 1
        if self.tokens < 0:
            self.sleep(-self.tokens / self.rate)


@dataclass(frozen=True)
class Runtime:
    """Providers by model: for texts, and for texts with assets. One of either is needed, unless only documents are indexed.

    ``asset_urls`` (entity_type, entity_id, assets: array<struct<kind,url>>) lists the
    assets of entities; a provider that takes assets is an error without it.
    """

    text: Mapping[str, Provider] = field(default_factory=dict)
    assets: Mapping[str, AssetProvider] = field(default_factory=dict)
    documents_only: bool = False
    asset_urls: DataFrame | None = None

    def __post_init__(self) -> None:
        if not self.text and not self.assets and not self.documents_only:
            raise ValueError("a provider is required")
        if any(not m.strip() for m in (*self.text, *self.assets)):
            raise ValueError("a model's name is blank")
        both = set(self.text) & set(self.assets)
        if both:
            raise ValueError(f"models of both kinds: {sorted(both)}")
        if self.assets and self.asset_urls is None:
            raise ValueError("the list of assets is required")

    def models(self) -> list[str]:
        return sorted({*self.text, *self.assets})

    def takes_assets(self, model: str) -> bool:
        return model in self.assets

    def embed_query(self, model: str, text: str) -> list[float]:
        """The query's vector at length 1."""
        if model not in self.text:
            raise ValueError(f"no provider for {model!r}")
        return unit_of(self.text[model].embed([text])[0])

    def embed(self, leased: DataFrame, texts: DataFrame, dims: Mapping[str, int] | None = None, calls: int = 8, per_second: float = 0.0) -> DataFrame:
        """Results of leased tasks: key, lease, attempts, embedding, error, status, missing.

        Every task goes to the provider of its model: texts in runs of 25 a
        call, texts with assets one a call. A blank or missing text, and an entity without assets where
        the model takes them, is missing and no error. A failed call fails its run; a model without a provider, and a
        vector that is empty or not of the model's length in ``dims``, fails its
        task. Vectors come at length 1.

        ``calls`` partitions run at once, each with that part of ``per_second`` as its own bucket
        of one token: together they make no more than ``per_second``, after a burst of ``calls``. A text comes once for
        all models of its entity, and each partition gets its even share of the entities.
        """
        calls = max(1, calls)
        own = leased.groupBy(*ENTITY).agg(F.to_json(F.collect_list(F.struct("model", F.unix_micros("next_run_at").alias("lease"), "attempts"))).alias("tasks"))
        rows = own.join(texts.select(*ENTITY, "text"), ENTITY, "left").select(*ENTITY, "tasks", "text")
        if self.asset_urls is not None:
            rows = rows.join(self.asset_urls.select("entity_type", "entity_id", "assets"), ["entity_type", "entity_id"], "left").select(*ENTITY, "tasks", "text", F.to_json("assets").alias("assets"))
        else:
            rows = rows.withColumn("assets", F.lit(None).cast("string"))
        rows = small_batches(rows.repartitionById(calls, F.pmod(F.xxhash64(*ENTITY), F.lit(calls)).cast("int")))
        schema = ", ".join([*(f"{k} string" for k in Q.KEY), "lease long", "attempts int", "embedding array<float>", "error string", "status int", "missing boolean"])
        text, assets, dims = dict(self.text), dict(self.assets), dict(dims or {})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bucket = Bucket(per_second / calls)
            for entities in batches:
                tasks = entities["tasks"].map(json.loads)
                batch = entities.drop(columns="tasks").loc[entities.index.repeat(tasks.map(len))].reset_index(drop=True)
                for name in ("model", "lease", "attempts"):
                    batch[name] = pd.Series([t.get(name) for of in tasks for t in of], dtype=object)
                lists = batch["assets"].map(lambda x: json.loads(x) if isinstance(x, str) else [])
                takes = batch["model"].isin(list(assets))
                blank = (batch["text"].fillna("").str.strip() == "") | (takes & (lists.map(len) == 0))
                out = batch.drop(columns=["text", "assets"]).assign(embedding=None, error=None, status=None, missing=blank.to_numpy())
                out["embedding"] = out["embedding"].astype(object)

                def call(index: list, model: str, f: Callable[[], list], out: pd.DataFrame = out) -> None:
                    bucket.take()
                    try:
                        found = f()
                        if len(found) != len(index):
                            raise ProviderError(f"{len(found)} vectors for {len(index)} texts")
                        for i, v in zip(index, found, strict=True):
                            if not len(v) or len(v) != dims.get(model, len(v)):
                                out.loc[i, "error"] = f"a vector of {len(v)} numbers for {model!r}"
                            else:
                                out.at[i, "embedding"] = unit_of(v)
                    except Exception as e:
                        out.loc[index, "error"] = str(e) or type(e).__name__
                        out.loc[index, "status"] = getattr(e, "status", None)

                for model, group in batch[~blank].groupby("model", sort=True):
                    if model in assets:
                        for i in group.index:
                            call([i], model, lambda m=model, i=i, b=batch, a=lists: [assets[m].embed_assets(b.loc[i, "text"], [dict(x) for x in a[i]])])
                    elif model in text:
                        for index in partial_batches(list(group.index), TEXTS_PER_CALL):
                            call(index, model, lambda m=model, x=index, b=batch: text[m].embed(list(b.loc[x, "text"])))
                    else:
                        out.loc[group.index, "error"] = f"no provider for {model!r}"
                yield out

        return rows.mapInPandas(run, schema).withColumn("lease", F.timestamp_micros("lease"))

    def embed_entities(self, keys: DataFrame, texts: DataFrame, model: str, dims: Mapping[str, int] | None = None, calls: int = 8) -> DataFrame:
        """``embed`` outside the task queue, for keys (entity_type, entity_id, language) and one model, which must have a provider: the results without lease and attempts."""
        if model not in self.models():
            raise ValueError(f"no provider for {model!r}")
        own = keys.select(*ENTITY).distinct().select(*ENTITY, F.lit(model).alias("model"), F.lit(None).cast("timestamp").alias("next_run_at"), F.lit(0).alias("attempts"))
        return self.embed(own, texts.dropDuplicates(ENTITY), dims, calls).drop("lease", "attempts")

    def generate_all(self, store: Store, keys: DataFrame, texts: DataFrame, model: str, now: Column) -> DataFrame:
        """Embeds and stores the vectors of ``keys`` with the model's provider, and returns the results. The calls are made once: their results are written first."""
        place = f"{store.root}/results/{time.time_ns()}"
        self.embed_entities(keys, texts, model, dims_of(store)).write.parquet(place)
        results = store.spark.read.parquet(place)
        store.merge("embedding_vectors", D.vector_changes(store.read("embedding_vectors"), embedded(results), now))
        return results

    def generate(self, store: Store, entity_type: str, entity_id: str, model: str, language: str, texts: DataFrame, now: Column) -> None:
        """Embeds and stores one entity; the provider is that of the model. Without a text, or assets where they are taken, ``EntityNotFound``; what the provider raised is a ``ProviderError``."""
        key = store.spark.createDataFrame([(entity_type, entity_id, language)], ", ".join(f"{c} string" for c in ENTITY))
        own = texts.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id) & (F.col("language") == language))
        row = self.generate_all(store, key, own, model, now).first()
        if row["missing"]:
            raise EntityNotFound(f"{entity_type} {entity_id} ({language})")
        if row["error"] is not None:
            raise ProviderError(row["error"], row["status"])

    def enqueue(self, tasks: DataFrame, keys: DataFrame, reason: str, now: Column) -> DataFrame:
        """Tasks with one per key (entity_type, entity_id, language) and model."""
        models = tasks.sparkSession.createDataFrame([(m,) for m in self.models()], "model string")
        return Q.enqueue(tasks, keys.select(*ENTITY).crossJoin(F.broadcast(models)), reason, now)  # a row per model

    def specs(self, dims: Mapping[str, int]) -> list[tuple[str, int, str]]:
        """(model, dims, modality) of all models, for ``register_models``."""
        return [(m, dims[m], "vl" if m in self.assets else "text") for m in self.models()]


def embedded(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNull() & F.col("embedding").isNotNull())


def dims_of(store: Store) -> dict[str, int]:
    """The length of each registered model's vectors; a row per model."""
    return {r["model"]: r["dims"] for r in store.read("embedding_models").collect()}


def register_models(store: Store, active: Sequence[tuple[str, int, str]]) -> None:
    """Makes ``active`` (model, dims, modality) the registered models, and drops the tasks, dead letters and backfill states of all others; vectors stay. Without any, nothing changes."""
    if not active:
        return
    models = store.write("embedding_models", D.upsert_models(store.read("embedding_models"), list(active)))
    for name in ("embedding_tasks", "embedding_vectors_backfill_state", "embedding_dead_letters"):
        store.write(name, D.of_models(store.read(name), models))
