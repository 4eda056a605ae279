"""Chat formatting: event-sourced reconstruction of conversations.

An event log (conv_id, seq, turn, kind, role, text) is partitioned by
conversation, sorted by sequence and folded into final messages, then rendered:

- ``message`` sets a turn's text, ``delta`` appends to it;
- ``edit`` replaces it, ``regenerate`` clears it; either discards what later
  turns held up to then, since they answered another text.

The fold is window functions over one exchange by conv_id, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._spark import read

RESETS = ("message", "edit", "regenerate")
REWRITES = ("edit", "regenerate")
KINDS = (*RESETS, "delta")


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, role, text) of an event log.

    Events with a null conv_id, turn or seq, or of an unknown kind, are dropped;
    an event that arrives twice (all of its six columns equal) counts once. At
    equal seq a turn's reset comes before its deltas, of two resets the greater
    kind, then text, counts, and deltas follow by text. A null text is empty.
    The role is the last one that isn't null among the turn's events that still
    count, ``unknown`` without any. A turn that has been discarded and has no
    later event doesn't appear. Extra columns are left out.
    """
    log = events.select("conv_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    log = log.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(*KINDS))
    log = log.repartition("conv_id")  # the one exchange: all windows and the fold keep it
    everything = F.struct("turn", "kind", "role", "text")
    log = log.withColumn("_before", F.lag(everything).over(Window.partitionBy("conv_id", "seq").orderBy("turn", "kind", "role", "text")))
    log = log.filter(~F.coalesce(F.col("_before").eqNullSafe(everything), F.lit(False))).drop("_before")
    earlier_turns = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("_cut", F.max(F.when(F.col("kind").isin(*REWRITES), F.col("seq"))).over(earlier_turns))
    log = log.filter(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    turn = Window.partitionBy("conv_id", "turn")
    log = log.withColumn("_base", F.max(F.when(F.col("kind").isin(*RESETS), F.struct("seq", "kind", "text"))).over(turn))
    delta = F.when((F.col("kind") == "delta") & (F.col("_base").isNull() | (F.col("seq") >= F.col("_base.seq"))), F.struct("seq", "text"))
    folded = log.groupBy("conv_id", "turn").agg(
        F.max("_base").alias("_base"),
        F.array_sort(F.collect_list(delta)).alias("_deltas"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("_role"),
    )
    base = F.when(F.col("_base.kind") != "regenerate", F.col("_base.text"))
    text = F.concat(F.coalesce(base, F.lit("")), F.array_join(F.transform("_deltas", lambda d: d["text"]), ""))
    return folded.select("conv_id", "turn", F.coalesce("_role.role", F.lit("unknown")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_messages and the rendered conversation, its messages by turn; equal turns follow by role and text."""
    own = messages.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
    line = F.transform("_m", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"], F.lit("<|end|>\n")))
    return own.select("conv_id", F.size("_m").cast("long").alias("n_messages"), F.array_join(line, "").alias("rendered"))


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log behind a table of finished turns, as a chat service would have written it.

    A turn of the assistant is streamed: a first draft of its first line, a
    regeneration, then a delta for each line. Any other turn is a message with
    its first line, then an edit to the whole text. Sequence numbers grow with
    the turn.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n = F.size(lines)
    stream = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct((k + 2).cast("long").alias("k"), F.lit("delta").alias("kind"), F.concat(F.get(lines, k), F.when(k < n - 1, F.lit("\n")).otherwise(F.lit(""))).alias("text")),
    )
    event = lambda k, kind, text: F.struct(F.lit(k).cast("long").alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.concat(F.array(event(0, "delta", F.get(lines, F.lit(0))), event(1, "regenerate", F.lit(""))), stream)
    edited = F.array(event(0, "message", F.get(lines, F.lit(0))), event(1, "edit", F.coalesce("text", F.lit(""))))
    rows = conversations.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return rows.select("conv_id", "turn", (F.col("turn") * 1_000_000_000 + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, rebuilt from its event log and rendered."""
    return render(fold(log_of(read(spark, sf_dir, "conversations"))))


OP4_SQL = """
SELECT conv_id, count(*)::BIGINT AS n_messages,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
"""
