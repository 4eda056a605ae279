"""Suffix-array dedup: passages of ``words`` words or more that repeat anywhere in the corpus.

Words are runs of bytes other than white space, known by 31 bits of their hash: two unlike windows of 50
words are taken as equal only if all their words' hashes are. Each window
of ``words`` words belongs to the least hash among its ``gram``-word stretches,
so equal windows, wherever they lie, go to the same shard; stretches that occur
once in the corpus can't be in a repeated window and are left behind (an exact
filter). A shard's windows, with their surrounding words, are one long string
whose suffixes are sorted by external induction (``_induce``); neighbours with a common prefix of ``words`` or
more are one repeated window. Its first occurrence stays, the others are marked.

Equal texts, known by 128 bits of hash, are scanned once; the row of the least doc_id stands for them.

A shard that outgrows ``shard_words``, as where one stretch of words is in very many
documents, is sorted in files: only its runs' numbers and a range of its suffixes are in memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm._induce import Scratch, order_of, steps
from lodestar.llm._spark import by_all, column_at, delete, freeing, over_arrow, read, spare, text_key
from lodestar.llm._spark import scratch as scratch_place

LAST = np.iinfo(np.int64).max
#: Anchors, of 8 bytes each, that are sent to all executors; more are joined by a shuffle.
BROADCAST = 1_000_000


@dataclass(frozen=True)
class SuffixParams:
    """``words``: shortest repeat. ``gram``: words of the stretches that route a window. ``shard_words``: words of a shard, about. ``queue``: entries of a priority queue in memory. ``memory``: bytes of an array in memory; longer ones are files."""

    words: int = 50
    gram: int = 14
    shard_words: int = 1_500_000
    queue: int = 500_000
    memory: int = 16 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, firsts = X.spans(data, offsets)
    return X.span_hash(X.prefix(data), starts, ends), starts, ends, firsts


def word_prefix(h: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes over word hashes."""
    p, _ = X.powers(len(h) + 1)
    out = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * p[: len(h)], out=out[1:])
    return out


def anchored(h: np.ndarray, firsts: np.ndarray, params: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (document, first window, last window, anchor hash); windows count from the document's first word."""
    k, w = params.gram, params.words - params.gram + 1
    none = np.zeros(0, np.int64)
    if len(h) < params.words:
        return none, none, none, none.astype(np.uint64)
    sums = word_prefix(h)
    grams = X.span_hash(sums, np.arange(len(h) - k + 1), np.arange(k, len(h) + 1))
    # Least of each w stretches, the leftmost of equals: high bits of the hash above the place, which is told from the window's modulo 2**26.
    low = (grams & ~X.U((1 << 26) - 1)) | (np.arange(len(grams), dtype=np.uint64) & X.U((1 << 26) - 1))
    step = 1
    while 2 * step <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if w > step:
        low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
    window = np.arange(len(low))
    place = window + ((low & X.U((1 << 26) - 1)).astype(np.int64) - window) % (1 << 26)
    # Windows that lie in one document.
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + params.words <= firsts[doc + 1])
    if len(at) == 0:
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    d = doc[at[head]]
    return d, at[head] - firsts[d], at[tail] - firsts[d], grams[place[at[head]]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of all i, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def anchors(docs: DataFrame, params: SuffixParams) -> DataFrame:
    """(anchor, t0, t1, a, b) of every run of windows of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = X.strings(batch.column(2))
            t0, t1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in X.blocks(offsets):
                h, _, _, firsts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                d, a, b, anchor = anchored(h, firsts, params)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(t0[i + d]), pa.array(t1[i + d]), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["anchor", "t0", "t1", "a", "b"])

    key = text_key("text")
    rows = docs.filter(F.length("text") >= 2 * params.words - 1).select(key[0].alias("t0"), key[1].alias("t1"), "text")
    return over_arrow(rows, run, "anchor long, t0 long, t1 long, a int, b int")


def cut_windows(rows: DataFrame, params: SuffixParams, shards: int) -> DataFrame:
    """(shard, first_id, t0, t1, tokens, starts): the words of every kept run; equal runs of a text once, with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = X.strings(batch.column(0))
            t0, t1, first_id = (batch.column(k).to_numpy() for k in (1, 2, 3))
            lists = batch.column(4)
            edges, values = lists.offsets.to_numpy().astype(np.int64), lists.values
            for i, j in X.blocks(offsets):
                h, _, _, firsts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = slice(edges[i], edges[j])
                a, b, anchor = (values.field(k).to_numpy()[own] for k in range(3))
                d = np.repeat(np.arange(j - i), np.diff(edges[i : j + 1]))
                begin, size = firsts[d] + a, (b - a).astype(np.int64) + params.words
                sums = word_prefix(h)
                key = X.mix(X.span_hash(sums, begin, begin + size) ^ X.mix(d.astype(np.uint64)) ^ X.mix(size.astype(np.uint64), 5))
                _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                counts = np.bincount(inverse, minlength=len(one))
                tokens = (h >> X.U(33)).astype(np.uint32)[ragged(begin[one], size[one])]
                body = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.array(np.concatenate([[0], np.cumsum(4 * size[one])]), pa.int32()).buffers()[1], pa.py_buffer(tokens.tobytes())])
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(a[order], pa.int32()))
                shard = (X.mix(anchor[one].view(np.uint64), 17) % X.U(shards)).astype(np.int32)
                at = i + d[one]
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(first_id[at]), pa.array(t0[at]), pa.array(t1[at]), body, places], ["shard", "first_id", "t0", "t1", "tokens", "starts"])

    return over_arrow(rows, run, "shard int, first_id long, t0 long, t1 long, tokens binary, starts array<int>")


def repeats_of(tokens: np.ndarray, sizes: np.ndarray, first_id: np.ndarray, text: np.ndarray, starts: np.ndarray, counts: np.ndarray, params: SuffixParams, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a shard's runs: (run, keeper's id, first word, word after the last) of the windows to be marked, joined where they follow each other, in parts.

    A run has ``sizes`` tokens of the text numbered ``text``, at the words ``starts``, ``counts`` of them. Texts are in the order of their hashes.
    """
    if len(sizes) == 0:
        return
    # Each run ends with a separator of its own, greater than all words.
    ends = np.cumsum(sizes)
    base = ends - sizes + np.arange(len(sizes))
    t = scratch.array(int(ends[-1]) + len(sizes), np.int64)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, max(64, scratch.memory // 32)), "left"))
    for i, j in zip(cuts, np.append(cuts[1:], len(sizes)), strict=True):
        if i == j:
            continue
        own = np.asarray(tokens[ends[i] - sizes[i] : ends[j - 1]], np.int64)
        part = np.empty(len(own) + j - i, np.int64)
        part[np.arange(len(own)) + np.repeat(np.arange(j - i), sizes[i:j])] = own
        part[ends[i:j] - ends[i] + sizes[i] + np.arange(j - i)] = (1 << 32) + np.arange(i, j)
        t[base[i] : base[i] + len(part)] = part
    order, lcp = order_of(t, scratch, params.words)
    firsts = np.cumsum(counts) - counts
    seen = scratch.array(len(t), bool) if (counts > 1).any() else None

    def marks(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whole groups of places: all but each group's first window are marked."""
        run = np.searchsorted(base, at, "right") - 1
        n = counts[run]
        word = starts[ragged(firsts[run], n)] + np.repeat(at - base[run], n)
        run, group = np.repeat(run, n), np.repeat(group, n)
        order = np.lexsort((word, text[run], first_id[run], group))
        run, group, word = run[order], group[order], word[order]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        # The same window may have come twice, from rows that were given twice.
        twice = np.zeros(len(run), bool)
        twice[1:] = ~head[1:] & (word[1:] == word[:-1]) & (text[run[1:]] == text[run[:-1]])
        keeper = first_id[run[np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))]]
        mark = np.flatnonzero(~head & ~twice)
        run, word, keeper = run[mark], word[mark], keeper[mark]
        order = np.lexsort((word, keeper, text[run]))
        run, word, keeper = run[order], word[order], keeper[order]
        new = np.ones(len(run), bool)
        new[1:] = (text[run[1:]] != text[run[:-1]]) | (keeper[1:] != keeper[:-1]) | (word[1:] > word[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(run)) - 1 if len(run) else a
        return run[a], keeper[a], word[a], word[b] + params.words

    held: list[np.ndarray] = []
    for a, b in steps(len(t), scratch):
        near = np.append(lcp[a : b + 1], np.zeros(int(b == len(t)), lcp.dtype)) >= params.words
        inside = np.flatnonzero(near[:-1] | near[1:])
        if len(inside):
            # A place that isn't near the one before it begins a group.
            held.append(np.stack([order[a:b][inside], ~near[inside]], 1))
            if seen is not None:
                seen[held[-1][:, 0]] = True
        if held and (b == len(t) or sum(map(len, held)) >= max(64, scratch.memory // 64)):
            rows = np.concatenate(held)
            heads = np.flatnonzero(rows[:, 1])
            # The last group may go on in the next part.
            done = len(rows) if b == len(t) else int(heads[-1])
            if done:
                yield marks(rows[:done, 0], np.cumsum(rows[:done, 1]))
            held = [rows[done:]] if done < len(rows) else []
    # A run whose words lie in several places of its text stands for all of them; then it repeats itself.
    many = np.flatnonzero(counts > 1)
    for k in range(0, len(many), 4096):
        own = many[k : k + 4096]
        at = ragged(base[own], sizes[own] - params.words + 1)
        at = at[~seen[at]]
        if len(at):
            yield marks(at, np.arange(len(at)))


def sort_shards(windows: DataFrame, params: SuffixParams, shards: int, place: str) -> DataFrame:
    """Marked stretches (t0, t1, first_id, keeper, a, b) of all shards; a partition's shards are sorted as one."""
    # Files of a sort are a task's own, like Spark's spills: in the shared folder if it is a plain one, else where Spark itself spills.
    local = urlparse(place).path if urlparse(place).scheme in ("", "file") else None
    spills = windows.sparkSession.conf.get("spark.local.dir", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = local or (os.environ.get("SPARK_LOCAL_DIRS") or spills or tempfile.gettempdir()).split(",")[0]
        os.makedirs(folder, exist_ok=True)
        scratch = Scratch(folder, params.memory, params.queue)
        numbers: list[list[np.ndarray]] = [[] for _ in range(6)]

        def bodies() -> Iterator[np.ndarray]:
            for batch in batches:
                body, lists = batch.column(4), batch.column(5)
                edges = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
                for k, x in enumerate((np.diff(edges) // 4, *(batch.column(c).to_numpy() for c in (1, 2, 3)), lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy().astype(np.int64)))):
                    numbers[k].append(x)
                yield np.frombuffer(body.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(np.uint32) if len(batch) else np.zeros(0, np.uint32)

        try:
            tokens = scratch.gathered(bodies(), np.uint32)
            if len(tokens):
                sizes, first_id, t0, t1, starts, counts = (np.concatenate(x) for x in numbers)
                by = np.lexsort((t1, t0))
                text = np.empty(len(by), np.int64)
                text[by] = np.cumsum(np.concatenate([[False], (t0[by[1:]] != t0[by[:-1]]) | (t1[by[1:]] != t1[by[:-1]])]))
                for own, keeper, a, b in repeats_of(tokens, sizes, first_id, text, starts, counts, params, scratch):
                    for k in range(0, len(own), 50_000):
                        r = own[k : k + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t0[r], t1[r], first_id[r], keeper[k : k + 50_000], a[k : k + 50_000], b[k : k + 50_000])], ["t0", "t1", "first_id", "keeper", "a", "b"])
        finally:
            scratch.close()

    return over_arrow(windows.repartition(shards, "shard"), run, "t0 long, t1 long, first_id long, keeper long, a long, b long")


def marked(docs: DataFrame, params: SuffixParams) -> tuple[DataFrame, DataFrame]:
    """(stretches to be removed, by t0 and t1; these with the text's least doc_id and count of rows)."""
    spark = docs.sparkSession
    place = scratch_place(spark, "suffix")
    key = text_key("text")
    own = docs.select(key[0].alias("t0"), key[1].alias("t1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("first_id"), "text")
    leaders = own.filter(F.col("text").isNotNull()).groupBy("t0", "t1").agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    # Each step's shuffles, and the rows that only the next step reads, go when it has ended.
    with freeing(spark):
        # Equal texts give equal rows, counted once; an anchor that is left alone can't repeat.
        anchors(docs, params).dropDuplicates(["anchor", "t0", "t1", "a", "b"]).write.parquet(f"{place}/anchors")
        runs = spark.read.parquet(f"{place}/anchors")
        # Counted in parts, so an anchor that very many texts have is no task of its own.
        runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor").write.parquet(f"{place}/often")
        often = spark.read.parquet(f"{place}/often")
        runs.join(F.broadcast(often) if often.count() <= BROADCAST else often, "anchor", "left_semi").write.parquet(f"{place}/runs")
        delete(spark, f"{place}/anchors")
        kept = spark.read.parquet(f"{place}/runs")
        amount = kept.agg(F.sum(F.col("b") - F.col("a") + params.words)).first()[0] or 0
        shards = max(1, -(-amount // params.shard_words))
        by_text = kept.groupBy("t0", "t1").agg(F.collect_list(F.struct("a", "b", "anchor")).alias("runs"))
        rows = own.join(by_text, ["t0", "t1"]).join(leaders.select("t0", "t1", "first_id"), ["t0", "t1", "first_id"], "left_semi").select("text", "t0", "t1", "first_id", "runs")
        spans = sort_shards(cut_windows(rows, params, shards), params, shards, f"{place}/sorts")
        spans.write.parquet(f"{place}-spans")
        delete(spark, place)
    return spark.read.parquet(f"{place}-spans"), leaders


def joined(spans: DataFrame, *keys: str) -> DataFrame:
    """Stretches a..b of the same keys joined where they touch or overlap."""
    by = Window.partitionBy(*keys).orderBy("a", "b")
    far = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(far.isNull() | (F.col("a") > far), 1).otherwise(0)).over(by)
    return spans.withColumn("island", island).groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def repeated_passages(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, kept_doc, start_word, end_word (excluded): stretches of each row all of whose windows of ``words`` words occur earlier.

    Earlier is a smaller doc_id, then text hash, then place; ``kept_doc`` is the
    row whose passage stays (the row itself if it repeats itself). Rows whose
    whole text equals that of a row with a smaller id are one stretch, if they have ``words`` words;
    null ids come last, and of rows given twice one is left. A null text or one of fewer words has no
    stretch. Extra columns are left out. Ids are whole numbers; others are cast to them.
    """
    spans, leaders = marked(docs, params)
    null = lambda c: F.when(F.col(c) != int(LAST), F.col(c))
    found = joined(spans, "t0", "t1", "first_id", "keeper").select(null("first_id").alias("doc_id"), null("keeper").alias("kept_doc"), F.col("a").alias("start_word"), F.col("b").alias("end_word"))
    several = leaders.filter("rows > 1")
    words = F.size(F.expr(r"regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+', 0)")).cast("long")
    key = text_key("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key[0].alias("t0"), key[1].alias("t1"), "text").join(several, ["t0", "t1"])
    own = rows.select("doc_id", "t0", "t1", "first_id", words.alias("n")).filter(f"n >= {params.words}")
    # Of the rows of a text the one of the least id stays; only rows with that id need to be told apart.
    least = F.coalesce("doc_id", F.lit(int(LAST))) == F.col("first_id")
    order = Window.partitionBy("t0", "t1").orderBy("n")
    again = own.filter(least).withColumn("k", F.row_number().over(order)).filter("k > 1").drop("k")
    copies = own.filter(~least).unionByName(again)
    return found.unionByName(copies.select("doc_id", null("first_id").alias("kept_doc"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word")))


def drop_repeats(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """``docs`` without the repeated passages, all columns kept and n_chars, where there is one, brought up to date.

    The white space after a removed passage goes with it. A row that loses all
    its words is dropped, as are all but one of rows with the same text of ``words``
    words or more, of which that of the least doc_id stays; other rows, null texts too, pass through.
    """
    spans, leaders = marked(docs, params)
    cuts = joined(spans, "t0", "t1").groupBy("t0", "t1").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
    h, h1, own, n, cut_, k = spare(docs, "_hash", "_hash1", "_own", "_rows", "_cuts", "_k")
    known = leaders.join(cuts, ["t0", "t1"], "full").filter("rows > 1 or _cuts is not null").select(F.col("t0").alias(h), F.col("t1").alias(h1), F.col("rows").alias(n), F.col("_cuts").alias(cut_))
    key = text_key("text")
    named = docs.withColumn(h, key[0]).withColumn(h1, key[1]).withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))))
    all_rows = named.join(known, [h, h1], "left")
    ordered = [F.col(f"`{c}`") for c in docs.columns]
    once = all_rows.filter(F.coalesce(n, F.lit(1)) == 1).select(*ordered, cut_, F.lit(1).alias(k))
    order = Window.partitionBy(h, h1).orderBy(own, *by_all(docs, "text"))
    several = all_rows.filter(F.col(n) > 1).select(*ordered, cut_, F.row_number().over(order).alias(k))
    columns = docs.columns
    at = column_at(docs, "text")
    count = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, valid = X.strings(batch.column(at))
            cut, rank = batch.column(len(columns)), batch.column(len(columns) + 1).to_numpy()
            texts = batch.column(at).to_pylist()
            keep = np.ones(len(batch), bool)
            touched = {}
            for d in np.flatnonzero(valid & ((rank > 1) | np.asarray(cut.is_valid()))):
                raw = data[offsets[d] : offsets[d + 1]]
                starts, ends, _ = X.spans(raw, np.array([0, len(raw)]))
                if rank[d] > 1:
                    keep[d] = len(starts) < params.words
                    if keep[d] and not cut[int(d)].is_valid:
                        continue
                edge = np.append(starts, len(raw))
                left = np.ones(len(raw), bool)
                for s in cut[int(d)].as_py() or []:
                    left[edge[s["a"]] : edge[s["b"]]] = False
                text = raw[left].tobytes().decode("utf-8")
                touched[int(d)] = text
                keep[d] &= bool(text.strip())
            if touched:
                texts = [touched.get(i, x) for i, x in enumerate(texts)]
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                if count is not None:
                    old = arrays[count].to_pylist()
                    arrays[count] = pa.array([len(touched[i]) if i in touched else x for i, x in enumerate(old)], arrays[count].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch.select(columns).filter(pa.array(keep))

    return over_arrow(once.union(several), run, docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of every document."""
    return repeated_passages(read(spark, sf_dir, "documents"))


def op5_sql(params: SuffixParams = SuffixParams()) -> str:
    n = params.words
    return f"""
WITH leaders AS (
  SELECT text, min(doc_id) AS doc_id, regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+') AS words FROM documents WHERE text IS NOT NULL GROUP BY text
), windows AS (
  SELECT doc_id, k, hash(array_to_string(words[k + 1:k + {n}], ' ')) AS win FROM (SELECT doc_id, words, unnest(range(0, len(words) - {n} + 1)) AS k FROM leaders WHERE len(words) >= {n})
), marked AS (
  SELECT doc_id, k, first_value(doc_id) OVER w AS kept_doc, row_number() OVER w AS nth FROM windows WINDOW w AS (PARTITION BY win ORDER BY doc_id, k)
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kept_doc ORDER BY k) AS island FROM (
    SELECT *, CASE WHEN k > lag(k) OVER (PARTITION BY doc_id, kept_doc ORDER BY k) + {n} THEN 1 ELSE 0 END AS fresh FROM marked WHERE nth > 1)
)
SELECT doc_id, kept_doc, min(k)::BIGINT AS start_word, max(k)::BIGINT + {n} AS end_word FROM islands GROUP BY doc_id, kept_doc, island
UNION ALL
SELECT d.doc_id, l.doc_id AS kept_doc, 0 AS start_word, len(l.words)::BIGINT AS end_word FROM documents d JOIN leaders l USING (text) WHERE d.doc_id > l.doc_id AND len(l.words) >= {n}
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated passages, as ``drop_repeats`` gives them; an empty table stays empty."""
    return drop_repeats(docs)
