"""One pass of maintenance: changes, backfill, then embedding tasks.

Host data comes as DataFrames: ``texts`` (entity_type, entity_id, language,
text) for documents and for embedding, and ``entities`` to be listed page by page.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources import documents as D
from lodestar.sources import schemas
from lodestar.sources.store import Store
from lodestar.streaming import tasks as Q
from lodestar.streaming.runtime import Runtime, dims_of, embedded

DIRTY_KEY = list(schemas.KEYS["search_dirty"])
#: Rows of a batch that are broadcast; larger batches are joined by a shuffle.
FEW = 50_000


def few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, which are ``most`` at most, to be broadcast if that is few."""
    return F.broadcast(rows) if most <= FEW else rows


@dataclass(frozen=True)
class SyncOptions:
    """Bounds of one pass: changes, rows of a page, pages, tasks, lease and retries; ``calls`` to the providers at a time and ``per_second`` of all together (0: no limit).

    The defaults suit a queue that is polled; ``for_cluster`` has those for tables
    of many millions of rows, where every batch costs a scan.
    """

    lexical_types: tuple[str, ...] = ()
    semantic_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    dirty_batch: int = 250
    page: int = 1000
    pages: int = 5
    task_batch: int = 250
    lease_seconds: float = 30.0
    max_attempts: int = Q.MAX_ATTEMPTS
    backoff: float = 5.0
    backoff_most: float = 600.0
    calls: int = 8
    per_second: float = 0.0
    config: str | None = None

    @staticmethod
    def for_cluster(**own) -> SyncOptions:
        return SyncOptions(**{"dirty_batch": 1_000_000, "page": 10_000_000, "pages": 50, "task_batch": 200_000, "lease_seconds": 3600.0, "calls": 256} | own)


def dirty_batch(dirty: DataFrame, limit: int) -> DataFrame:
    """The oldest changes with a whole key, ties by key."""
    whole = dirty.filter(~D.blank("entity_type") & ~D.blank("entity_id") & ~D.blank("language"))
    return whole.orderBy("updated_at", *DIRTY_KEY).limit(max(0, limit))


def latest_changes(log: DataFrame) -> DataFrame:
    """The last change of every key of an append-only log (key, is_deleted, reason, updated_at, seq)."""
    return D.latest(log, DIRTY_KEY, F.col("updated_at").desc(), F.col("seq").desc()).drop("seq")


@dataclass(frozen=True)
class State:
    """All tables that a pass reads and writes."""

    documents: DataFrame
    dirty: DataFrame
    tasks: DataFrame
    vectors: DataFrame
    models: DataFrame
    letters: DataFrame

    @staticmethod
    def of(store: Store) -> State:
        return State(*[store.read(n) for n in NAMES])


NAMES = ("search_documents", "search_dirty", "embedding_tasks", "embedding_vectors", "embedding_models", "embedding_dead_letters")


def apply_changes(store: Store, texts: DataFrame, options: SyncOptions, now: Column) -> None:
    """Applies the oldest changes: deletions first, then documents, then a task per active model.

    A change is cleared by its key and time, so one that comes meanwhile stays.
    An entity without a row in ``texts`` keeps its document; an empty text
    deletes it. Of every table only what changes is written. A pass that dies is done again by the next one.
    """
    state = State.of(store)
    batch = dirty_batch(state.dirty, options.dirty_batch)
    gone = batch.filter(F.coalesce("is_deleted", F.lit(False))).select(*DIRTY_KEY)
    live = batch.filter(~F.coalesce("is_deleted", F.lit(False))).select(*DIRTY_KEY)
    n = options.dirty_batch
    vectors = state.vectors.join(few(gone, n), DIRTY_KEY, "left_semi")
    store.merge("embedding_vectors", deletes=vectors)
    fresh, emptied = None, gone
    if options.lexical_types:
        wanted = live.filter(F.col("entity_type").isin(*options.lexical_types))
        fresh, blank = D.document_changes(state.documents, D.prepared(texts.join(few(wanted, n), DIRTY_KEY), options.config), now, bounded=n <= FEW)
        emptied = gone.unionByName(blank)
    store.merge("search_documents", fresh, emptied)
    tasks = None
    if options.semantic_types:
        wanted = live.filter(F.col("entity_type").isin(*options.semantic_types)).crossJoin(F.broadcast(state.models.select("model")))  # a row per model
        tasks = Q.enqueue(state.tasks.join(few(wanted.select(*Q.KEY), n), Q.KEY, "left_semi"), wanted, "dirty", now)
    store.merge("embedding_tasks", tasks, state.tasks.join(few(gone, n), DIRTY_KEY, "left_semi"))
    store.merge("search_dirty", deletes=state.dirty.join(few(batch.select(*DIRTY_KEY, "updated_at"), n), [*DIRTY_KEY, "updated_at"], "left_semi"))


def page_after(entities: DataFrame, entity_type: str, language: str, cursor: str, size: int) -> DataFrame:
    """The next ids of a type and language in order; the cursor is the last id of the page before."""
    own = entities.filter((F.col("entity_type") == entity_type) & (F.col("language") == language) & (F.col("entity_id") > cursor))
    return own.select(*DIRTY_KEY).orderBy("entity_id").limit(size)


def backfill(store: Store, entities: DataFrame, texts: DataFrame, options: SyncOptions, now: Column) -> int:
    """Does up to ``options.pages`` pages, documents before vectors, and says how many; cursors are kept in the state tables.

    A failed page is marked as failed with its error and is tried again by the next call.
    """
    done = 0
    if options.page <= 0:
        return 0
    models = [r[0] for r in store.read("embedding_models").select("model").orderBy("model").collect()]  # a row per model
    jobs = [("search_documents_backfill_state", None, t, g) for t in sorted(options.lexical_types) for g in options.languages if g.strip()]
    jobs += [("embedding_vectors_backfill_state", m, t, g) for t in sorted(options.semantic_types) for g in options.languages for m in models]
    for table, model, entity_type, language in jobs:
        if done >= options.pages:
            break
        states = store.read(table)
        own = (F.col("entity_type") == entity_type) & (F.col("language") == language)
        if model is not None:
            own = own & (F.col("model") == model)
        row = states.filter(own).first()
        if row is not None and row["state"] == "done":
            continue
        cursor, state, error = (row["cursor"] or "") if row else "", "running", None
        try:
            page = page_after(entities, entity_type, language, cursor, options.page)
            count, last = page.agg(F.count(F.lit(1)), F.max("entity_id")).first()
            if count and model is None:
                batch = D.prepared(texts.join(few(page, options.page), DIRTY_KEY), options.config)
                store.merge("search_documents", *D.document_changes(store.read("search_documents"), batch, now, bounded=options.page <= FEW))
            elif count:
                missing = D.missing_embeddings(page, store.read("embedding_vectors"), model).withColumn("model", F.lit(model))
                old = store.read("embedding_tasks").join(few(missing.select(*Q.KEY), options.page), Q.KEY, "left_semi")
                store.merge("embedding_tasks", Q.enqueue(old, missing, "model_backfill", now))
            cursor, state = last or cursor, "done" if count < options.page else "running"
        except Exception as e:
            state, error = "failed", str(e)[:1000]
            raise
        finally:
            fields = ({"model": model} if model is not None else {}) | {"entity_type": entity_type, "language": language, "cursor": cursor, "state": state, "last_error": error}
            fresh = store.spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in fields.items()], now.alias("updated_at"))
            store.write(table, states.filter(~own).unionByName(fresh))
        done += 1
    return done


def drain(store: Store, texts: DataFrame, runtime: Runtime, options: SyncOptions, now: Column) -> int:
    """Leases one batch of tasks, embeds their entities with their models' providers, stores vectors and settles the tasks; says how many were leased."""
    leased = Q.lease(store.read("embedding_tasks"), now, options.task_batch, options.lease_seconds)[1]
    place = f"{store.root}/results/{time.time_ns()}"
    leased.write.parquet(f"{place}/leased")
    leased = store.spark.read.parquet(f"{place}/leased")
    count = leased.count()
    if not count:
        return 0
    tasks = store.merge("embedding_tasks", leased)
    # Calls to the provider must not be repeated: their results are written before they are used.
    runtime.embed(leased, texts, dims_of(store), options.calls, options.per_second).write.parquet(f"{place}/results")
    results = store.spark.read.parquet(f"{place}/results")
    store.merge("embedding_vectors", D.vector_changes(store.read("embedding_vectors"), embedded(results), now, bounded=True))
    own = few(results.select(*Q.KEY), count)
    held, letters = tasks.join(own, Q.KEY, "left_semi"), store.read("embedding_dead_letters").join(own, Q.KEY, "left_semi")
    settled, letters = Q.settle(held, letters, results, now, options.max_attempts, options.backoff, options.backoff_most)
    # Letters first: a job that dies in between repeats the task rather than losing it.
    store.merge("embedding_dead_letters", letters)
    store.merge("embedding_tasks", settled, held)
    store.drop(place)
    return count


def sync_once(store: Store, entities: DataFrame, texts: DataFrame, runtime: Runtime | None, options: SyncOptions, now: Column | None = None) -> None:
    """Changes, then backfill, then tasks; the last is left out without models or a runtime with providers."""
    now = now if now is not None else F.lit(pd.Timestamp.now(tz="UTC").to_pydatetime())
    if store.read("search_dirty").limit(1).count():
        apply_changes(store, texts, options, now)
    backfill(store, entities, texts, options, now)
    if runtime is not None and runtime.models() and store.read("embedding_models").limit(1).count():
        drain(store, texts, runtime, options, now)


def follow(changes: DataFrame, store: Store, entities: DataFrame, texts: DataFrame, runtime: Runtime | None, options: SyncOptions, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a pass for every micro-batch of a stream of changes (key, is_deleted, reason, updated_at); without ``every``, over what is there now."""

    def step(batch: DataFrame, _: int) -> None:
        log = batch.withColumn("seq", F.lit(1)).withColumn("created_at", F.col("updated_at"))
        # Of the changes that wait only those that are overtaken are rewritten.
        waiting = store.read("search_dirty").join(log.select(*DIRTY_KEY).distinct(), DIRTY_KEY, "left_semi").withColumn("seq", F.lit(0))
        columns = [f.name for f in schemas.TABLES["search_dirty"].fields]
        store.merge("search_dirty", latest_changes(waiting.select(*columns, "seq").unionByName(log.select(*columns, "seq"))))
        sync_once(store, entities, texts, runtime, options)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_every(seconds: float, once, stop) -> None:
    """Calls ``once`` every ``seconds`` until ``stop()`` is true."""
    while not stop():
        once()
        time.sleep(seconds)
