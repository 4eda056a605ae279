"""Embedding tasks: a table and functions from one state of it to the next.

A lease is the task's next_run_at, moved ahead; completing and failing compare
it, so what was enqueued again meanwhile isn't lost. One writer applies them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scores import jittered, retry_seconds
from lodestar.sources import schemas
from lodestar.sources.documents import blank, delete_keys

KEY = list(schemas.KEYS["embedding_tasks"])
COLUMNS = [f.name for f in schemas.TABLES["embedding_tasks"].fields]
MAX_ATTEMPTS = 10


def at(moment: datetime | str | Column) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")


def enqueue(tasks: DataFrame, keys: DataFrame, reason: str, now: Column) -> DataFrame:
    """Tasks with those of ``keys`` due now: a new one, or the old one with the new reason and the earlier time. Its attempts stay. Blank ids are left out."""
    fresh = keys.filter(~blank("entity_id")).select(*KEY).distinct().withColumn("_new", F.lit(True))
    both = tasks.join(fresh, KEY, "full")
    hit, old = F.col("_new").isNotNull(), F.col("attempts").isNotNull()
    return both.select(
        *KEY,
        F.when(hit, F.lit(reason)).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(hit & old, F.least("next_run_at", now)).when(hit, now).otherwise(F.col("next_run_at")).alias("next_run_at"),
        "started_at",
        F.coalesce("created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def ready(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    """The tasks that are due, those due longest first."""
    return tasks.filter(F.col("next_run_at") <= now).orderBy("next_run_at", "entity_type", "entity_id", "model", "language").limit(max(0, limit))


def lease(tasks: DataFrame, now: Column, limit: int = 250, seconds: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(all tasks after the lease, the leased ones): up to ``limit`` due tasks move ``seconds`` ahead and have a start."""
    until = (now + F.make_dt_interval(secs=F.lit(float(seconds)))).cast("timestamp")
    picked = ready(tasks, now, limit).select(*KEY).withColumn("_leased", F.lit(True))
    mark = F.col("_leased").isNotNull()
    both = tasks.join(F.broadcast(picked), KEY, "left")  # ``limit`` rows at most
    after = both.select(*KEY, "reason", "attempts", F.when(mark, until).otherwise(F.col("next_run_at")).alias("next_run_at"), F.when(mark, F.coalesce("started_at", now)).otherwise(F.col("started_at")).alias("started_at"), "created_at", F.when(mark, now).otherwise(F.col("updated_at")).alias("updated_at"), mark.alias("_leased"))
    return after.drop("_leased"), after.filter("_leased").drop("_leased")


def _held(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with the columns of ``results`` whose lease they still hold."""
    return tasks.join(results.withColumnRenamed("lease", "next_run_at"), [*KEY, "next_run_at"], "left")


def complete(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without those of ``done`` (key, lease) whose next_run_at is still the lease."""
    return tasks.join(done.select(*KEY, F.col("lease").alias("next_run_at")), [*KEY, "next_run_at"], "left_anti").select(*COLUMNS)


def fail(tasks: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Tasks after failures (key, lease, seconds): one attempt more and due again after whole seconds, one at least."""
    both = _held(tasks, failed.select(*KEY, "lease", "seconds"))
    hit = F.col("seconds").isNotNull()
    later = (now + F.make_dt_interval(secs=F.greatest(F.floor("seconds"), F.lit(1)))).cast("timestamp")
    return both.select(*KEY, "reason", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(hit, later).otherwise(F.col("next_run_at")).alias("next_run_at"), "started_at", "created_at", F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"))


def dead_letter(tasks: DataFrame, letters: DataFrame, dead: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks without ``dead``, dead letters with them): ``dead`` has key, lease, attempts and error. A letter of the same key is replaced."""
    held = tasks.join(dead.select(*KEY, F.col("lease").alias("next_run_at"), F.col("attempts").alias("_attempts"), "error"), [*KEY, "next_run_at"])
    old = letters.select(*KEY, F.col("created_at").alias("_created"))
    fresh = held.select(*KEY, "reason", "error", F.col("_attempts").cast("int").alias("attempts")).join(old, KEY, "left")
    fresh = fresh.select(*KEY, "reason", "error", "attempts", now.alias("failed_at"), F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))
    return complete(tasks, dead), delete_keys(letters, fresh.select(*KEY)).select(*[f.name for f in schemas.TABLES["embedding_dead_letters"].fields]).unionByName(fresh)


def settle(tasks: DataFrame, letters: DataFrame, results: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS, base: float = 5.0, most: float = 600.0, seed: int | None = None, jitter: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tasks, dead letters) after results (key, lease, attempts, error, status, missing).

    Without an error, or where the entity is missing, a task is complete. A
    failure counts as an attempt; the ``max_attempts``-th is the last, others wait longer each time.
    """
    failed = F.col("error").isNotNull() & ~F.coalesce(F.col("missing"), F.lit(False))
    n = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    over = failed & (n >= max_attempts)
    wait = retry_seconds(n, "status", base, most)
    again = results.filter(failed & ~over).withColumn("seconds", jittered(wait, seed) if jitter else wait)
    tasks = complete(tasks, results.filter(~failed))
    tasks, letters = dead_letter(tasks, letters, results.filter(over).withColumn("attempts", n), now)
    return fail(tasks, again, now), letters
