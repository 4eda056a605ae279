"""Benchmark decontamination: one Aho-Corasick automaton over normalised questions and answers.

Normal form: lower case, each run of characters other than letters and digits
one space. A benchmark item gives its windows of ``words`` words, or all its
words where it has fewer. An item of fewer than ``least`` words, such as a short
answer, is too common inside a text and is looked for as a whole text. All patterns of all items are one
automaton; every text is scanned once in normal form, matches that touch are
joined, and their ends are mapped to the characters of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._spark import column_at, over_arrow, read

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, start_char long, end_char long, n_words long"


@dataclass(frozen=True)
class LeakParams:
    """``words``: words of a window. ``least``: items with fewer words must be the whole text. ``automaton_chars``: a bound on what is broadcast; only a benchmark of more pattern characters is cut, by item, and takes several passes that find the same."""

    words: int = 8
    least: int = 5
    automaton_chars: int = 50_000_000


def windows(items: list[tuple[int | None, str | None]], params: LeakParams) -> Iterator[tuple[str, int, int, int, bool]]:
    """(normalised window, item, its first word, words of the window, whether it must be the whole text)."""
    for item, text in items:
        words = WORD.findall(text.lower()) if text is not None else []
        if item is None or not words:
            continue
        n = min(params.words, len(words))
        for k in range(len(words) - n + 1):
            yield " ".join(words[k : k + n]), item, k, n, len(words) < min(params.least, params.words)


def normal(text: str) -> str:
    """The normal form that is scanned; line feeds mark the ends of the text."""
    return f"\n {' '.join(WORD.findall(text.lower()))} \n"


def build(patterns: list[tuple[str, int, int, int, bool]]) -> ahocorasick.Automaton:
    """The automaton; a window that several items share knows them all."""
    found: dict[str, list[tuple[int, int]]] = {}
    sizes: dict[str, tuple[int, int]] = {}
    for text, item, k, n, whole in patterns:
        key = f"\n {text} \n" if whole else f" {text} "
        found.setdefault(key, []).append((item, k))
        sizes[key] = len(text) + whole, n
    machine = ahocorasick.Automaton()
    for key, owners in found.items():
        machine.add_word(key, (*sizes[key], tuple(owners)))
    machine.make_automaton()
    return machine


def leaks(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int, int]]:
    """(item, first character, character after the last, words) of each stretch of the text that an item's windows cover.

    Windows of one item that follow each other both in the item and in the text are one stretch.
    """
    low = text.lower()
    plain = normal(text)
    hits = list(machine.iter(plain))
    if not hits:
        return []
    # Characters of the original: lower case may be longer than the original (few letters), then each is mapped.
    if len(low) == len(text):
        places = [m.span() for m in WORD.finditer(low)]
    else:
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        places = [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(low)]
    starts = {}
    for k, m in enumerate(WORD.finditer(plain)):
        starts[m.start()] = k
    runs: dict[tuple[int, int], list[int]] = {}
    for end, (size, n, owners) in hits:
        first = starts[end - size]
        for item, k in owners:
            # The difference of places is the same along a stretch.
            runs.setdefault((item, first - k), []).extend((first, n))
    out = []
    for (item, _), flat in runs.items():
        spans = sorted(zip(flat[::2], flat[1::2], strict=True))
        a, b = spans[0][0], spans[0][0] + spans[0][1]
        for first, n in spans[1:]:
            if first > b:
                out.append((item, places[a][0], places[b - 1][1], b - a))
                a = first
            b = max(b, first + n)
        out.append((item, places[a][0], places[b - 1][1], b - a))
    return sorted(set(out))


def shards(spark: SparkSession, benchmark: DataFrame, params: LeakParams) -> list:
    """Broadcast item lists, each of at most ``automaton_chars`` characters of text (one item at least): one, unless the benchmark is huge."""
    sizes = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    amount = sizes.agg(F.sum(F.length("text"))).first()[0] or 0
    limit = params.automaton_chars // params.words
    parts = max(1, -(-amount // max(1, limit)))
    out = []
    for k in range(parts):
        own = sizes.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else sizes
        out.append(spark.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """Every stretch of a document that repeats windows of a benchmark item: doc_id, item_id, start_char, end_char (code points of the original text, end excluded), n_words.

    Null and empty texts, and items that are null, have no id or no word, match
    nothing. Rows with a null doc_id are reported with
    it. Repeated documents are each reported, repeated items once. Extra columns
    are left out. Ids are whole numbers; others are cast to them.
    """
    out = None
    for items in shards(docs.sparkSession, benchmark, params):

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            machine = build(list(windows(items.value, params)))
            for batch in batches:
                rows = []
                if len(machine):
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        if text:
                            rows += [(doc, *x) for x in leaks(text, machine)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start_char", "end_char", "n_words"])

        part = over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` whose text repeats no window of any item, all columns kept.

    Null, empty and wordless texts stay, as do all rows where there is no item; repeated rows are each kept or dropped.
    """
    at = column_at(docs, "text")
    for items in shards(docs.sparkSession, benchmark, params):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            machine = build(list(windows(items.value, params)))
            for batch in batches:
                texts = batch.column(at).to_pylist()
                keep = [not (t and len(machine)) or next(machine.iter(normal(t)), None) is None for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = over_arrow(docs, clean, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document that a benchmark item covers."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without benchmark passages; null and empty texts stay, an empty table stays empty, columns pass through."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def op1_sql(params: LeakParams = LeakParams()) -> str:
    n, least = params.words, params.least
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words, regexp_split_to_array(lower(text), '[\\p{{L}}\\p{{N}}]+') AS gaps
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, generate_subscripts(words, 1) AS k, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap FROM cut WHERE len(words) > 0
), spots AS (
  SELECT doc_id, k, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS end_char FROM placed
), texts AS (
  SELECT doc_id, list(word ORDER BY k) AS words, list(end_char ORDER BY k) AS ends FROM spots GROUP BY doc_id
), items AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_windows AS (
  SELECT item_id, k, m, array_to_string(words[k:k + m - 1], ' ') AS win
  FROM (SELECT item_id, words, least({n}, len(words)) AS m, unnest(range(1, len(words) - least({n}, len(words)) + 2)) AS k FROM items WHERE len(words) >= {min(least, n)})
), doc_windows AS (
  SELECT doc_id, k, m, array_to_string(words[k:k + m - 1], ' ') AS win
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS k FROM texts, (SELECT DISTINCT m FROM item_windows))
), hits AS (
  SELECT DISTINCT doc_id, item_id, d.k AS k, d.k - i.k AS shift, d.m AS m FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.m = i.m
), marked AS (
  SELECT *, CASE WHEN k > max(k + m) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM hits
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS run FROM marked
), stretches AS (
  SELECT doc_id, item_id, min(k) AS a, max(k + m) - 1 AS b FROM runs GROUP BY doc_id, item_id, shift, run
)
SELECT t.doc_id, i.item_id, (t.ends[1] - length(t.words[1]))::BIGINT AS start_char, t.ends[len(t.ends)]::BIGINT AS end_char, len(t.words)::BIGINT AS n_words
FROM texts t JOIN items i ON t.words = i.words WHERE len(i.words) BETWEEN 1 AND {min(least, n) - 1}
UNION
SELECT DISTINCT s.doc_id, s.item_id, (t.ends[s.a] - length(t.words[s.a]))::BIGINT AS start_char, t.ends[s.b]::BIGINT AS end_char, (s.b - s.a + 1)::BIGINT AS n_words
FROM stretches s JOIN texts t USING (doc_id)
"""
