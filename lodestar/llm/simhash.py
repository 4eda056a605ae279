"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's features are its distinct words without case: runs of letters,
their accents and digits of any script, all other characters left out. Its
sketch is a row of 32-bit SimHash fingerprints (``blocks`` of them). Copies are
near if their sketches differ in ``radius`` bits at most, about a seventh of all.

Nothing within the radius is missed: if each of two sketches' fingerprints differed in more than
twice its ``flips``, the sketches would differ in more than ``radius`` bits. So each fingerprint emits all
its variants within its flips (two bits for nine of the twelve, one for the others), half of what it may be
off: two fingerprints have a variant in common just where they differ in twice that or less.
Variants are compared where they meet, and nodes that meet at one are verified by their whole sketches.

The shuffle goes by cells. A table of up to ``cell`` nodes has one for each fingerprint. For a larger one
a fingerprint is cut into stretches of bits, one more than it may be off or some more: then one stretch at least, or some, are
alike in both, and a cell is what nodes have in a choice of stretches. A cell's nodes come to less than ``cell`` however many
documents there are, and the pairs found don't depend on the number of cells. Copies with one sketch
are one node, nodes with one fingerprint meet as one, and a cell gives a link from each node to the first of its
component, so thousands of copies cost as much as one.
Groups are the connected components of all links.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm._spark import by_all, delete, over_arrow, read, scratch, spare, text_key

BITS = 32
#: Stretches that a fingerprint is cut into at most: 16 bits alike, for 3 * 10**10 nodes; beyond that cells grow.
STRETCHES = 8
#: Rows to be dropped, of 24 bytes each, that are sent to all executors; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Variants of a cell that are sorted at once, and pairs that are verified at once.
VARIANTS, PAIRS = 1 << 20, 1 << 18


@dataclass(frozen=True)
class SimHashParams:
    """``blocks`` fingerprints of 32 bits (an even number), ``radius`` of the whole sketch, ``cell``: nodes of a cell, about.

    Chance members of a bucket grow as documents * 529 / 2**32: beyond some 10**8 documents a
    cell's work outgrows its rows, and longer fingerprints would be called for.
    """

    blocks: int = 12
    radius: int = 53
    cell: int = 1 << 19

    def words(self) -> list[str]:
        """The columns of a sketch."""
        return [f"s{k}" for k in range(self.blocks // 2)]

    def flips(self) -> list[int]:
        """By fingerprint, how many bits its variants flip: twice that, and one, over all fingerprints come to more than the radius."""
        every = max(0, -(-(self.radius - self.blocks + 1) // 2))
        return [every // self.blocks + (k < every % self.blocks) for k in range(self.blocks)]


@cache
def letters() -> np.ndarray:
    """By code point: 97 for letters, combining marks and digits, a space for all others."""
    return np.array([97 if unicodedata.category(chr(c))[0] in "LMN" else 32 for c in range(0x110000)], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct word of each document, first of each document and the count of all)."""
    raw = data.tobytes()
    folded = [raw[a:b].decode("utf-8", "replace").casefold() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    # Folding may lengthen a text (ss for ß), so offsets are counted anew, in characters.
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in folded], dtype=np.int64)])
    plain = np.frombuffer("".join(folded).encode("utf-32-le"), np.uint32)
    starts, ends, firsts = X.spans(letters()[plain], offsets)
    h = X.span_hash(X.prefix(plain), starts, ends)
    docs = len(offsets) - 1
    # Sorted by (document, 40 bits of the hash); blocks hold fewer documents than 2**24.
    key = np.unique((np.repeat(np.arange(docs, dtype=np.uint64), np.diff(firsts)) << X.U(40)) | (h >> X.U(24)))
    return key & X.U((1 << 40) - 1), np.searchsorted(key >> X.U(40), np.arange(docs + 1))


def signs(hashes: np.ndarray, firsts: np.ndarray, lanes: int) -> np.ndarray:
    """The SimHash of each document, 64 bits a lane: a bit is 1 where more than half of the features' bits are."""
    n = len(firsts) - 1
    out = np.zeros((n, lanes), np.uint64)
    sizes = np.diff(firsts)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    # Runs of at most 255 features add up in bytes.
    parts = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    flat = firsts[:-1][full][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    heads = np.cumsum(parts) - parts
    for lane in range(lanes):
        bits = np.unpackbits(X.mix(hashes, 1000 + lane).view(np.uint8).reshape(-1, 8), axis=1)
        part = np.add.reduceat(bits, flat, axis=0, dtype=np.uint8)
        ones = np.add.reduceat(part.astype(np.int32), heads, axis=0)
        out[full, lane] = np.packbits(2 * ones > sizes[full, None], axis=1).view(np.uint64).ravel()
    return out


def sketches(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """row (a number of its own), doc_id, t0 and t1 (128 bits of the text), the sketch and worded of every row; a null text has null t0."""
    names = params.words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets, _ = X.strings(batch.column(1))
            n = len(batch)
            out = np.zeros((n, len(names)), np.uint64)
            sizes = np.zeros(n, np.int64)
            for a, b in X.blocks(offsets):
                hashes, firsts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out[a:b] = signs(hashes, firsts, len(names))
                sizes[a:b] = np.diff(firsts)
            lanes = [pa.array(out[:, k].view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), batch.column(0), batch.column(2), batch.column(3), *lanes, pa.array(sizes > 0)], ["row", "doc_id", "t0", "t1", *names, "worded"])
            at += n

    key = text_key("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key[0].alias("t0"), key[1].alias("t1"))
    return over_arrow(rows, run, "row long, doc_id long, t0 long, t1 long, " + ", ".join(f"{s} long" for s in names) + ", worded boolean")


def nodes_of(rows: DataFrame, params: SimHashParams) -> DataFrame:
    """A numbered node for each distinct sketch: node, the sketch, first (the row that stays: least doc_id, nulls last, then text) and size."""
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t0", "t1", "row")
    found = rows.filter("worded").groupBy(*params.words()).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"))
    return found.withColumn("node", F.monotonically_increasing_id())


def routes(params: SimHashParams, high: int) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]]:
    """(fingerprint, stretches that a cell's nodes have alike, all others): stretches are (least bit, bits), those alike have ``high`` bits or more, as far as ``STRETCHES`` go.

    Two fingerprints that are off by twice their flips at most are alike in all the stretches of some route.
    """
    out = []
    for b, flips in enumerate(params.flips()):
        off = 2 * flips
        n = next((n for n in range(off + 1, STRETCHES) if (n - off) * (BITS // n) >= high), max(off + 1, STRETCHES))
        edges = [k * BITS // n for k in range(n + 1)]
        cut = [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]
        for alike in combinations(range(n), n - off) if high else [()]:
            out.append((b, [cut[k] for k in alike], [cut[k] for k in range(n) if k not in alike]))
    return out


def cells(nodes: DataFrame, params: SimHashParams, high: int) -> DataFrame:
    """(cell, node, the sketch): each node in its cell of each route; the cell's number has the route's above 32 bits."""
    names = []
    for k, (b, alike, _) in enumerate(routes(params, high)):
        cell, at = F.lit(k << BITS), 0
        for shift, bits in alike:
            own = F.shiftrightunsigned(F.col(params.words()[b // 2]), 32 * (b % 2) + shift).bitwiseAND(F.lit((1 << bits) - 1))
            cell, at = cell.bitwiseOR(F.shiftleft(own, at)), at + bits
        names.append(cell.cast("long"))
    return nodes.select(F.explode(F.array(*names)).alias("cell"), "node", *params.words())


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (each the least member) after joining a[i] and b[i]."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            down = label[label]
            if (down == label).all():
                break
            label = down
    return label


@cache
def ball(bits: int, flips: int) -> np.ndarray:
    """The numbers of ``bits`` bits of which ``flips`` at most are set."""
    return np.array([sum(1 << b for b in own) for k in range(min(bits, flips) + 1) for own in combinations(range(bits), k)], np.uint64)


def shared(value: np.ndarray, spare: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows one bucket after the other, first of each bucket) of the variants that several rows have: all that flip ``spare`` bits at most below the ``high`` ones."""
    low = value & X.U((1 << (BITS - high)) - 1)
    entries = [np.zeros(0, np.uint64)]
    for k in np.unique(spare):
        own = np.flatnonzero(spare == k).astype(np.uint64)
        entries.append(((low[own] << X.U(32) | own)[:, None] ^ (ball(BITS - high, int(k)) << X.U(32))).ravel())
    entries = np.concatenate(entries)
    entries.sort()
    again = np.zeros(len(entries) + 1, bool)
    again[1:-1] = (entries[1:] ^ entries[:-1]) < X.U(1 << 32)
    some = again[:-1] | again[1:]
    return (entries[some] & X.U(0xFFFFFFFF)).astype(np.int64), np.flatnonzero(~again[:-1][some])


def parts(value: np.ndarray, spare: np.ndarray, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, their spare flips, bits that are settled): the variants of a cell cut by further bits until ``VARIANTS`` at most are a part."""
    todo = [(np.arange(len(value)), spare, high)]
    while todo:
        own, spare, high = todo.pop()
        if len(own) < 2:
            continue
        counts = np.bincount(spare)
        if high == BITS or sum(int(n) * len(ball(BITS - high, k)) for k, n in enumerate(counts)) <= VARIANTS:
            yield own, spare, high
            continue
        bit = (value[own] >> X.U(BITS - 1 - high) & X.U(1)).astype(np.int8)
        for other in (bit, 1 - bit):
            left = spare - other
            todo.append((own[left >= 0], left[left >= 0], high + 1))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of all i, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes come to about ``most``, one item at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield slice(at, end)
        at = end


def meet(value: np.ndarray, spare: np.ndarray, sketch: np.ndarray, high: int, radius: int) -> np.ndarray:
    """Component labels of a cell's rows: those that share a variant and whose sketches are within the radius are joined, and what is joined to them.

    Every pair at a variant is verified unless a path joins it already.
    """
    label = np.arange(len(value))
    words = [np.ascontiguousarray(sketch[:, k]) for k in range(sketch.shape[1])]
    # Rows with one value meet as one item.
    _, lead, item = np.unique(value << X.U(8) | spare.astype(np.uint64), return_index=True, return_inverse=True)
    members, size = np.argsort(item, kind="stable"), np.bincount(item)
    heads = np.cumsum(size) - size

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label
        for k in range(0, len(x), PAIRS):
            a, b = x[k : k + PAIRS], y[k : k + PAIRS]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            off = np.zeros(len(a), np.int64)
            for w in words:
                off += np.bitwise_count(w[a] ^ w[b])
            label = united(label, a[off <= radius], b[off <= radius])

    def verify_items(x: np.ndarray, y: np.ndarray) -> None:
        """All pairs of a row of item x[i] and a row of y[i]."""
        low, top = spans()
        new = np.minimum(low[x], low[y]) != np.maximum(top[x], top[y])
        pairs = np.unique(np.minimum(x, y)[new] << 32 | np.maximum(x, y)[new])
        x, y = pairs >> 32, pairs & 0xFFFFFFFF
        for own in pieces(size[x] * size[y], PAIRS):
            # Each row of x[i] in turn beside all of y[i].
            a = ragged(heads[x[own]], size[x[own]])
            mate = np.repeat(y[own], size[x[own]])
            for few in pieces(size[mate], PAIRS):
                verify(members[np.repeat(a[few], size[mate[few]])], members[ragged(heads[mate[few]], size[mate[few]])])

    def spans() -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest label of each item's rows."""
        return np.minimum.reduceat(label[members], heads), np.maximum.reduceat(label[members], heads)

    def buckets(row: np.ndarray, first: np.ndarray, check: Callable[[np.ndarray, np.ndarray], None], labels: Callable[[], tuple[np.ndarray, np.ndarray]]) -> None:
        """Checks all pairs of each bucket: its first with the others, then all where that left some apart."""
        if not len(first):
            return
        count = np.diff(np.append(first, len(row)))
        place = np.arange(len(row)) - np.repeat(first, count)
        check(np.repeat(row[first], count)[place > 0], row[place > 0])
        low, top = labels()
        more = np.repeat((np.minimum.reduceat(low[row], first) != np.maximum.reduceat(top[row], first)) & (count > 2), count)
        row, place = row[more], place[more]
        for own in pieces(place, VARIANTS):
            n = place[own]
            check(np.repeat(row[own], n), row[ragged(np.arange(own.start, own.stop) - n, n)])

    if len(value):
        several = np.repeat(size > 1, size)
        buckets(members[several], (np.cumsum(size[size > 1]) - size[size > 1]), verify, lambda: (label, label))
    for own, left, settled in parts(value[lead], spare[lead].astype(np.int8), high):
        row, first = shared(value[lead[own]], left, settled)
        buckets(own[row], first, verify_items, spans)
    return label


def links(nodes: DataFrame, params: SimHashParams, high: int) -> DataFrame:
    """(a, b): in each cell, a link from every joined node to the first of its component."""
    names, flips, ways = params.words(), params.flips(), routes(params, high)

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        sketch = np.stack([table[s].to_numpy() for s in names]).view(np.uint64).T
        b, _, rest = ways[table["cell"][0].as_py() >> BITS]
        own = sketch[:, b // 2] >> X.U(32 * (b % 2))
        value, free = np.zeros(len(node), np.uint64), 0
        for shift, bits in rest:
            value, free = value | (own >> X.U(shift) & X.U((1 << bits) - 1)) << X.U(free), free + bits
        label = meet(value, np.full(len(node), flips[b], np.int8), sketch, BITS - free, params.radius)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[label[at]], "b": node[at]})

    return cells(nodes, params, high).groupBy("cell").applyInArrow(run, "a long, b long")


def components(pairs: DataFrame, place: str) -> DataFrame:
    """(node, root) of every node of the pairs: root is its component's least node.

    Large-star and small-star steps in turn, each written to ``place``, until no
    edge changes; the rounds grow with the logarithm of the nodes.
    """
    spark = pairs.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    edges = keep(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v"), "edges")
    mark, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = Window.partitionBy("u")
        star = both.withColumn("m", F.least(F.min("v").over(near), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.withColumn("m", F.min("v").over(near))
        small = lowest.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = keep(small, f"round-{turn}")
        turn += 1
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    own = edges.groupBy("u").agg(F.min("v").alias("root"))
    return own.select(F.explode(F.array("u", "root")).alias("node"), "root").distinct()


def grouped(docs: DataFrame, params: SimHashParams, place: str) -> DataFrame:
    """row, doc_id, t0, t1, first (the row of its group that stays) and size of every row; both are null where the row is alone."""
    spark = docs.sparkSession
    sketches(docs, params).write.parquet(f"{place}/sketches")
    rows = spark.read.parquet(f"{place}/sketches")
    nodes_of(rows, params).write.parquet(f"{place}/nodes")
    nodes = spark.read.parquet(f"{place}/nodes")
    high = max(0, (max(1, nodes.count()) - 1).bit_length() - (params.cell.bit_length() - 1))
    links(nodes, params, high).write.parquet(f"{place}/links")
    roots = components(spark.read.parquet(f"{place}/links").distinct(), place)
    linked = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked.filter((F.col("root") != F.col("node")) | (F.col("size") > 1)).select("root").distinct().write.parquet(f"{place}/roots")
    linked = linked.join(spark.read.parquet(f"{place}/roots"), "root", "left_semi")
    # Groups of few nodes each: sums of numbers, no texts.
    groups = linked.groupBy("root").agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    linked.select("root", *params.words()).join(groups, "root").drop("root").write.parquet(f"{place}/groups")
    known = spark.read.parquet(f"{place}/groups")
    worded = rows.filter("worded").join(known, params.words(), "left")
    # Texts without a word are alike if they are equal.
    bare = rows.filter(~F.col("worded"))
    equal = bare.filter(F.col("t0").isNotNull()).groupBy("t0", "t1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t0", "t1", "row")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    columns = ["row", "doc_id", "t0", "t1", "first", "size"]
    return worded.select(*columns).unionByName(bare.join(equal, ["t0", "t1"], "left").select(*columns))


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, group_id, group_size and keep of every row of ``docs``.

    ``group_id`` is the group's least doc_id, and one row of it is kept: the row
    of that id, of several texts with it that of the least text hash. Equal texts without a word (empty ones too) are a
    group; a null text is alone and kept. Null ids come last in
    their group, and a group of them has a null group_id. Of repeated rows
    (same id and text) one is kept. Extra columns are left out. Ids are whole numbers; others are cast to them.
    """
    place = scratch(docs.sparkSession, "simhash")
    grouped(docs, params, place).select(
        "doc_id", F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("group_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("keep"),
    ).write.parquet(f"{place}-found")
    delete(docs.sparkSession, place)
    return docs.sparkSession.read.parquet(f"{place}-found")


def drop_near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they were; null texts stay.

    The rows that go are known by 128 bits of their text and their id; only where a row was given
    twice does one of the equal rows have to be picked.
    """
    spark = docs.sparkSession
    place = scratch(spark, "simhash")
    found = grouped(docs, params, place).filter(F.col("first.row") != F.col("row"))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.t0") == F.col("t0")) & (F.col("first.t1") == F.col("t1"))
    r0, r1, twice, k = spare(docs, "_r0", "_r1", "_twice", "_k")
    found.select(F.xxhash64("doc_id", "t0").alias(r0), F.xxhash64("doc_id", "t1").alias(r1), same.alias(twice)).distinct().write.parquet(f"{place}-gone")
    delete(spark, place)
    gone = spark.read.parquet(f"{place}-gone")
    text = text_key("text")
    id_ = F.col("doc_id").cast("long")
    named = docs.withColumns({r0: F.xxhash64(id_, text[0]), r1: F.xxhash64(id_, text[1])})
    # Only rows that go, or come twice, have a partner.
    marked = named.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, [r0, r1], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.filter(F.col(twice).isNull()).select(*columns)
    several = marked.filter(F.col(twice)).withColumn(k, F.row_number().over(Window.partitionBy(r0, r1).orderBy(*by_all(docs, "text"))))
    return single.unionByName(several.filter(F.col(k) == 1).select(*columns))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies and whether it stays."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies; null texts stay, columns pass through."""
    return drop_near_duplicates(docs)
