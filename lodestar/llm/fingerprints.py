"""Document fingerprints: prefix polynomial hashes over code points.

``prefix_arrays`` holds H[i] = sum of c[k] * B**k for k < i, modulo the prime
2**31 - 1, for two bases. With it any two spans of a text compare in constant
time, and the longest common extension of two places takes a binary search.
A document's fingerprint joins both whole-text hashes and is the same wherever
the text lies. Repeated lines are found by span hashes and extended to the
longest common block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._spark import over_arrow, read, scratch

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
P64 = np.uint64(PRIME)
_powers: list[np.ndarray] = []


def modded(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62, by folding instead of dividing."""
    x = (x & P64) + (x >> np.uint64(31))
    x = (x & P64) + (x >> np.uint64(31))
    return np.where(x >= P64, x - P64, x)


def power(n: int) -> list[np.ndarray]:
    """B**k modulo the prime for k below n at least, for both bases; doubling keeps it to few numpy calls."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in BASES:
            p = np.ones(1, np.uint64)
            while len(p) < max(n, 1 << 16):
                p = np.concatenate([p, modded(p * np.uint64(pow(base, len(p), PRIME)))])
            _powers.append(p)
    return _powers


def prefix_arrays(codes: np.ndarray) -> list[np.ndarray]:
    """The prefix hashes of code points, for both bases; entry i covers the first i."""
    out = []
    for p in power(len(codes) + 1):
        h = np.zeros(len(codes) + 1, np.uint64)
        # Sums of up to 2**31 terms below 2**31 fit.
        np.cumsum(modded(codes.astype(np.uint64) * p[: len(codes)]), out=h[1:])
        out.append(modded(h))
    return out


def equal(h: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the spans of length n at a and at b (a <= b) are equal: a's hash is moved to b and compared."""
    same = np.ones(len(a), bool)
    for x, p in zip(h, power(int((b - a).max(initial=0)) + 1), strict=True):
        left = modded(x[a + n] + P64 - x[a])
        right = modded(x[b + n] + P64 - x[b])
        same &= modded(left * p[b - a]) == right
    return same


def extension(h: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest common extension of places a <= b of one text, by binary search over span equality."""
    low, high = np.zeros(len(a), np.int64), (len(h[0]) - 1) - b
    while (low < high).any():
        mid = (low + high + 1) // 2
        yes = equal(h, a, b, mid)
        low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
    return low


def in_order(text: str) -> np.ndarray:
    """The places of all lines of a text, ordered by what follows from there to the end, a line feed before all other characters: by doubling over the ranks of lines."""
    lines = text.split("\n")
    known = {x: k for k, x in enumerate(sorted(set(lines)))}
    rank = np.array([known[x] for x in lines])
    places = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])[:-1]])
    n, step = len(lines), 1
    while step < 2 * n:
        later = np.append(rank[step:], np.full(min(step, n), -1))
        _, rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)
        if rank.max() == n - 1:
            break
        step *= 2
    return places[np.argsort(rank)]


def summary(text: str) -> tuple[int, int, int, int, int, int, int]:
    """(code points, fingerprint, lines, repeated lines, and of the longest repeated block: first place, second place, length).

    Lines end at a line feed and the empty ones don't count. A line repeats if
    an equal one came before it. Of any two equal lines the common extension is
    taken, up to where it would run past the text; the longest counts, then the
    earliest second place, then the earliest first. Without repeated lines
    both places are -1 and the length is 0.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = prefix_arrays(codes)
    finger = (int(h[0][-1]) << 31) | int(h[1][-1])
    feeds = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [len(codes)]])
    full = ends > starts
    starts, ends = starts[full], ends[full]
    if len(starts) < 2:
        return len(codes), finger, len(starts), 0, -1, -1, 0
    # A span's key: its hashes moved to the end of the text, so that equal spans have equal keys.
    keys = np.zeros(len(starts), np.uint64)
    for x, p in zip(h, power(len(codes) + 1), strict=True):
        keys = (keys << np.uint64(31)) | modded(modded(x[ends] + P64 - x[starts]) * p[len(codes) - starts])
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[inverse] != np.arange(len(starts)))
    if len(again) == 0:
        return len(codes), finger, len(starts), 0, -1, -1, 0
    # In the order of what follows them, the best partner of a line is a neighbour, so those pairs alone are extended.
    order = in_order(text)
    order = order[(codes[np.minimum(order, len(codes) - 1)] != 10) & (order < len(codes))]
    line = inverse[np.searchsorted(starts, order)]
    beside = np.flatnonzero(line[1:] == line[:-1])
    x, y = order[beside], order[beside + 1]
    long = extension(h, np.minimum(x, y), np.maximum(x, y))
    most = int(long.max())
    # Neighbours that share the most make runs; any two of a run share it.
    hit = beside[long == most]
    run = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    b, a = min((int(p[1]), int(p[0])) for p in (np.sort(order[r[0] : r[-1] + 2]) for r in run))
    return len(codes), finger, len(starts), len(again), a, b, most


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint and repeats of every row of ``docs`` (doc_id, text), and how many rows share the fingerprint.

    Returns doc_id, n_chars, fingerprint, n_lines, n_repeated, first_at,
    again_at, block_chars, copies and first_doc (the least doc_id of the rows
    with this length and fingerprint). A null text has null everywhere but
    doc_id; an empty one has fingerprint 0. Repeated rows count as copies of
    each other; null ids are kept; other columns are left out. Ids are whole
    numbers; others are cast to them.
    """
    kinds = [("n_chars", pa.int64()), ("fingerprint", pa.int64()), ("n_lines", pa.int64()), ("n_repeated", pa.int64()), ("first_at", pa.int64()), ("again_at", pa.int64()), ("block_chars", pa.int64())]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None,) * 7 if t is None else summary(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds))], ["doc_id", *(n for n, _ in kinds)])

    own = over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), hashed, "doc_id long, " + ", ".join(f"{n} long" for n, _ in kinds))
    # Only the numbers are shuffled, never texts; copies are counted in parts, and rows without a copy need no partner.
    place = scratch(docs.sparkSession, "fingerprints")
    own.write.parquet(place)
    own = docs.sparkSession.read.parquet(place)
    key = ["n_chars", "fingerprint"]
    several = own.filter(F.col("fingerprint").isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")
    has = F.col("fingerprint").isNotNull()
    both = own.join(several, key, "left")
    return both.select(*own.columns, F.when(has, F.coalesce("copies", F.lit(1))).alias("copies"), F.when(has, F.when(F.col("copies").isNotNull(), F.col("first_doc")).otherwise(F.col("doc_id"))).alias("first_doc"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, repeated blocks and exact copies of all documents."""
    return fingerprints(read(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH coded AS (
  SELECT doc_id, text, list_transform(string_split(text, ''), lambda c: unicode(c)::HUGEINT) AS codes
  FROM documents WHERE text <> ''
), hashed AS (
  SELECT doc_id, length(text)::BIGINT AS n_chars,
    (list_reduce(list_reverse(codes), lambda x, c: (x * {BASES[0]} + c) % {PRIME}) * 2147483648
     + list_reduce(list_reverse(codes), lambda x, c: (x * {BASES[1]} + c) % {PRIME}))::BIGINT AS fingerprint
  FROM coded
), pieces AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, line, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM pieces
), lined AS (
  SELECT doc_id, line, place, min(place) OVER (PARTITION BY doc_id, line) AS first_at FROM placed WHERE line <> ''
), counted AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (place > first_at))::BIGINT AS n_repeated FROM lined GROUP BY doc_id
), extended AS (
  SELECT l.doc_id, f.place AS first_at, l.place AS again_at,
    coalesce(list_position(list_transform(range(1, length(d.text) - l.place + 1), lambda i: d.text[f.place + i] = d.text[l.place + i]), false) - 1, length(d.text) - l.place)::BIGINT AS block_chars
  FROM lined l JOIN lined f ON f.doc_id = l.doc_id AND f.line = l.line AND f.place < l.place JOIN documents d ON d.doc_id = l.doc_id
), best AS (
  SELECT * FROM extended QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_chars DESC, again_at, first_at) = 1
), whole AS (
  SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE h.n_chars END AS n_chars, CASE WHEN d.text = '' THEN 0 ELSE h.fingerprint END AS fingerprint,
    CASE WHEN d.text IS NOT NULL THEN coalesce(c.n_lines, 0) END AS n_lines, CASE WHEN d.text IS NOT NULL THEN coalesce(c.n_repeated, 0) END AS n_repeated,
    CASE WHEN d.text IS NOT NULL THEN coalesce(b.first_at, -1) END AS first_at, CASE WHEN d.text IS NOT NULL THEN coalesce(b.again_at, -1) END AS again_at,
    CASE WHEN d.text IS NOT NULL THEN coalesce(b.block_chars, 0) END AS block_chars
  FROM documents d LEFT JOIN hashed h USING (doc_id) LEFT JOIN counted c USING (doc_id) LEFT JOIN best b USING (doc_id)
)
SELECT *, CASE WHEN fingerprint IS NOT NULL THEN count(*) OVER (PARTITION BY n_chars, fingerprint) END AS copies,
  CASE WHEN fingerprint IS NOT NULL THEN min(doc_id) OVER (PARTITION BY n_chars, fingerprint) END AS first_doc
FROM whole
"""
