"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each worker keeps one DuckDB connection with the merge table. Per block of a
partition, the distinct words that are new to the worker become rows of (word,
position, token), one for each byte. A recursive query joins neighbouring rows
with the merges and contracts each word's leftmost pair of least rank, until no
word has a pair left. Documents are put together from their words' tokens, and
an ordered aggregation over (document, position, token) rows decodes them.

A long word, such as a line of Chinese or of base64, is cut into pieces first, which
are contracted on their own. A row of tokens is a word's encoding just where each
two neighbours are the encoding of their joint bytes, so only the seams have to be
tested; where one fails, a stretch about it is contracted anew, twice as wide each time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _tokens
from lodestar.llm._spark import over_arrow, read

#: Characters of text that are encoded, or tokens that are decoded, at once; a longer text is a block of its own.
BLOCK = 1_000_000
#: Chunks and words whose tokens a worker remembers between blocks.
REMEMBERED = 200_000
#: Words, and bytes of them, that one query contracts; all of its steps are in memory.
WORDS, BYTES = 40_000, 800_000
#: Bytes of a word that is contracted at once, and of the pieces of a longer one.
LONG, PIECE = 128, 64

#: Rows carry the token after theirs and its place. ``best`` is the code of a word's pair: its rank, then its
#: place, and null once there is none. A merged token has its rank as id. The steps' least codes are grouped and joined
#: back, which takes less than a window over all rows.
CONTRACT = """
WITH RECURSIVE steps(word, pos, id, next_id, next_pos, best) AS (
  SELECT word, pos, id, next_id, next_pos, min((m.rank::BIGINT << 32) + pos) OVER (PARTITION BY word)
  FROM (SELECT word, pos, id, lead(id) OVER o AS next_id, lead(pos) OVER o AS next_pos FROM start_rows WINDOW o AS (PARTITION BY word ORDER BY pos)) p
  LEFT JOIN merges m ON m.left_id = p.id AND m.right_id = p.next_id
  UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT word, pos, p.id, next_id, next_pos, (m.rank::BIGINT << 32) + pos AS code
    FROM (
      SELECT s.word, s.pos, CASE WHEN s.pos = s.best & 4294967295 THEN (s.best >> 32)::INTEGER ELSE s.id END AS id,
        CASE WHEN s.pos = s.best & 4294967295 THEN g.next_id WHEN s.next_pos = s.best & 4294967295 THEN (s.best >> 32)::INTEGER ELSE s.next_id END AS next_id,
        CASE WHEN s.pos = s.best & 4294967295 THEN g.next_pos ELSE s.next_pos END AS next_pos
      FROM (SELECT * FROM steps WHERE best IS NOT NULL) s
      JOIN (SELECT word, next_pos AS gone FROM steps WHERE pos = best & 4294967295) b USING (word)
      JOIN (SELECT word, pos, next_id, next_pos FROM steps WHERE best IS NOT NULL) g ON g.word = s.word AND g.pos = b.gone
      WHERE s.pos <> b.gone
    ) p LEFT JOIN merges m ON m.left_id = p.id AND m.right_id = p.next_id
  )
  SELECT word, pos, id, next_id, next_pos, best FROM pairs JOIN (SELECT word, min(code) AS best FROM pairs GROUP BY word) USING (word))
)
SELECT word, id FROM steps WHERE best IS NULL ORDER BY word, pos
"""

#: The same for long stretches: all places of a word's pair of least rank are contracted in one step, of overlapping
#: ones every other from the left. That is what one after the other gives: a merge's pairs with its neighbours rank above it.
CONTRACT_RUNS = """
WITH RECURSIVE steps(word, pos, id, hit, best) AS (
  SELECT word, pos, id, coalesce(rank = min(rank) OVER w, false), min(rank) OVER w
  FROM (SELECT s.word, s.pos, s.id, m.rank FROM (SELECT word, pos, id, lead(id) OVER o AS next_id FROM start_rows WINDOW o AS (PARTITION BY word ORDER BY pos)) s
        LEFT JOIN merges m ON m.left_id = s.id AND m.right_id = s.next_id) WINDOW w AS (PARTITION BY word)
  UNION ALL
  SELECT word, pos, id, coalesce(rank = min(rank) OVER w, false), min(rank) OVER w
  FROM (
    SELECT s.word, s.pos, s.id, m.rank
    FROM (
      SELECT word, pos, id, lead(id) OVER o AS next_id
      FROM (
        SELECT word, pos, CASE WHEN first THEN best ELSE id END AS id, coalesce(lag(first) OVER (PARTITION BY word ORDER BY pos), false) AS gone
        FROM (
          SELECT word, pos, id, best, hit AND row_number() OVER (PARTITION BY word, run, hit ORDER BY pos) % 2 = 1 AS first
          FROM (SELECT *, sum((NOT hit)::INTEGER) OVER (PARTITION BY word ORDER BY pos) AS run FROM steps WHERE best IS NOT NULL)
        )
      ) WHERE NOT gone WINDOW o AS (PARTITION BY word ORDER BY pos)
    ) s LEFT JOIN merges m ON m.left_id = s.id AND m.right_id = s.next_id
  ) WINDOW w AS (PARTITION BY word)
)
SELECT word, id FROM steps WHERE best IS NULL ORDER BY word, pos
"""

DECODE = "SELECT t.doc, string_agg(v.piece, '' ORDER BY t.pos) AS body FROM token_rows t JOIN vocabulary v USING (id) GROUP BY t.doc ORDER BY t.doc"


def merges_of(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left token, right token, rank) of every token that is the join of two others of lower rank.

    A token of more than one byte is made by the two parts that its own bytes
    contract to when only merges of lower rank apply.
    """
    out = []
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            low, i = min(pairs)
            if low >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return out


class Coder:
    """A worker's connection and the words that it has met."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]]):
        # What a query handles is bounded, so nothing is spilled.
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": "250MB", "temp_directory": "", "preserve_insertion_order": "false"})
        left, right, rank = zip(*merges, strict=True) if merges else ((), (), ())
        self.con.register("merge_rows", pa.table({"left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.con.register("piece_rows", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM piece_rows")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces = {i: t for t, i in ranks.items()}
        self.ids = np.zeros(max(ranks.values()) + 1, bool)
        self.ids[list(ranks.values())] = True
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.words = Runs(), Runs()

    def contract(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all byte strings, first token of each and the count of all)."""
        flat, firsts, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        sizes = np.array([len(r) for r in raw], np.int64)
        # Words of like length need like many steps.
        order = np.argsort(sizes, kind="stable")
        raw, sizes, back = [raw[k] for k in order], sizes[order], np.argsort(order)
        ends = np.cumsum(sizes)
        while at < len(raw):
            end = min(at + WORDS, max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BYTES, "right"))))
            own = sizes[at:end]
            starts = np.cumsum(own) - own
            word = np.repeat(np.arange(end - at, dtype=np.int32), own)
            place = (np.arange(own.sum()) - starts[word]).astype(np.int32)
            self.con.register("start_rows", pa.table({"word": word, "pos": place, "id": self.bytes[np.frombuffer(b"".join(raw[at:end]), np.uint8)]}))
            found = self.con.sql(CONTRACT_RUNS if own.max() > LONG else CONTRACT).to_arrow_table()
            self.con.unregister("start_rows")
            flat.append(found["id"].to_numpy().astype(np.int32))
            firsts.append(firsts[-1][-1] + np.cumsum(np.bincount(found["word"].to_numpy(), minlength=end - at)))
            at = end
        return ragged(np.concatenate(flat), np.concatenate(firsts), back)

    def contract_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``contract`` of words of any length."""
        raw = [w.encode() for w in words]
        cut = [[r] if len(r) <= LONG else [r[k : k + PIECE] for k in range(0, len(r), PIECE)] for r in raw]
        flat, firsts = self.contract([p for c in cut for p in c])
        edges = firsts[np.cumsum([0] + [len(c) for c in cut])]
        long = [k for k, c in enumerate(cut) if len(c) > 1]
        if not long:
            return flat, edges
        heads = np.cumsum([0] + [len(c) for c in cut])
        whole = self.repaired([[flat[firsts[p] : firsts[p + 1]].tolist() for p in range(heads[k], heads[k + 1])] for k in long])
        parts = [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for k, tokens in zip(long, whole, strict=True):
            parts[k] = np.array(tokens, np.int32)
        return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])

    def repaired(self, words: list[list[list[int]]]) -> list[list[int]]:
        """The tokens of words from those of their pieces."""
        tokens = [[t for p in w for t in p] for w in words]
        seams = [dict.fromkeys(np.cumsum([len(p) for p in w])[:-1].tolist(), 8) for w in words]
        while any(seams):
            pairs = list(dict.fromkeys((own[i - 1], own[i]) for own, s in zip(tokens, seams, strict=True) for i in s))
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            new = [p for p in pairs if p not in self.fits]
            flat, firsts = self.contract([self.pieces[a] + self.pieces[b] for a, b in new])
            for k, p in enumerate(new):
                self.fits[p] = flat[firsts[k] : firsts[k + 1]].tolist() == list(p)
            jobs = []
            for k, (own, s) in enumerate(zip(tokens, seams, strict=True)):
                spans: list[list[int]] = []
                for i, wide in sorted(s.items()):
                    if not self.fits[own[i - 1], own[i]]:
                        a, b = max(0, i - wide), min(len(own), i + wide)
                        if spans and a <= spans[-1][1]:
                            spans[-1] = [spans[-1][0], max(b, spans[-1][1]), max(wide, spans[-1][2])]
                        else:
                            spans.append([a, b, wide])
                jobs += [(k, *x) for x in spans]
            flat, firsts = self.contract([b"".join(self.pieces[t] for t in tokens[k][a:b]) for k, a, b, _ in jobs])
            seams = [{} for _ in words]
            # From the right, so that places to the left stay; seams already set move with what grows or shrinks.
            for j in range(len(jobs) - 1, -1, -1):
                k, a, b, wide = jobs[j]
                fresh = flat[firsts[j] : firsts[j + 1]].tolist()
                shift = len(fresh) - (b - a)
                seams[k] = {i + shift: w for i, w in seams[k].items()}
                if b < len(tokens[k]):
                    seams[k][b + shift] = 2 * wide
                if a > 0:
                    seams[k][a] = 2 * wide
                tokens[k][a:b] = fresh
        return tokens

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, first token of each text and the count of all)."""
        self.known.thin(REMEMBERED)
        self.words.thin(REMEMBERED)
        parts = [self.known.places(_tokens.chunks(t)) for t in texts]
        fresh = self.known.unfilled()
        if fresh:
            cut = [_tokens.WORD.findall(c) for c in fresh]
            own = self.words.places([w for c in cut for w in c])
            new = self.words.unfilled()
            if new:
                self.words.fill(*self.contract_all(new))
            tokens, ends = ragged(self.words.flat, self.words.firsts, own)
            self.known.fill(tokens, ends[np.cumsum([0] + [len(c) for c in cut])])
        every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        tokens, ends = ragged(self.known.flat, self.known.firsts, every)
        return tokens, ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]

    def decode(self, tokens: np.ndarray, firsts: np.ndarray) -> list[str]:
        """The texts of token runs. Bytes that aren't UTF-8 become the replacement character; unknown ids raise KeyError."""
        parts: list[list[bytes]] = [[] for _ in range(len(firsts) - 1)]
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(firsts))
        for k in range(0, len(tokens), BLOCK):
            ids = tokens[k : k + BLOCK].astype(np.int32)
            if ids.min() < 0 or ids.max() >= len(self.ids) or not self.ids[ids].all():
                raise KeyError("a token isn't in the vocabulary")
            self.con.register("token_rows", pa.table({"doc": doc[k : k + BLOCK], "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            found = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("token_rows")
            for d, body in zip(found["doc"].to_pylist(), found["body"].to_pylist(), strict=True):
                parts[d].append(body.encode("latin-1"))
        return [b"".join(p).decode("utf-8", "replace") for p in parts]


class Runs:
    """Strings numbered as they come, and the tokens of each, one run after the other."""

    def __init__(self) -> None:
        self.number([])
        self.flat, self.firsts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    def number(self, names: list[str]) -> None:
        """Numbers ``names`` from 0 on; a string that is looked up and new takes the next number."""
        self.place: dict[str, int] = defaultdict(count(len(names)).__next__, zip(names, range(len(names)), strict=True))

    def places(self, strings: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))
        self.again[out[out < len(self.again)]] = True
        return out

    def thin(self, most: int) -> None:
        """Beyond ``most`` strings keeps those that came again in a later block."""
        if len(self.place) > most:
            kept = np.flatnonzero(self.again)
            names = list(self.place)
            self.flat, self.firsts = ragged(self.flat, self.firsts, kept)
            self.number([names[k] for k in kept])
            self.again = np.zeros(len(kept), bool)

    def unfilled(self) -> list[str]:
        return list(islice(reversed(self.place), len(self.place) - len(self.firsts) + 1))[::-1]

    def fill(self, flat: np.ndarray, firsts: np.ndarray) -> None:
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + firsts[1:]])
        self.flat = np.concatenate([self.flat, flat])
        self.again = np.concatenate([self.again, np.zeros(len(self.place) - len(self.again), bool)])


def ragged(flat: np.ndarray, firsts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked runs of ``flat`` one after the other, and where each begins, with the count of all at the end."""
    sizes = firsts[picks + 1] - firsts[picks]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(ends[-1]) + np.repeat(firsts[picks] - ends[:-1], sizes)], ends


_coders: dict[str, Coder] = {}


def coder(name: str, shared) -> Coder:
    """This worker's coder for a vocabulary."""
    if name not in _coders:
        _coders[name] = Coder(*shared.value)
    return _coders[name]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str = _tokens.VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row.

    ``round_trip`` says whether decoding gives the text again. A null text has
    null in all three; an empty one has no tokens and its round trip is true.
    Repeated rows and null ids pass through, other columns are left out. Ids are whole numbers; others are cast to them.
    """
    ranks = _tokens.load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, shared)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in blocks(every):
                texts = [t or "" for t in every[a:b]]
                null = np.array([t is None for t in every[a:b]])
                tokens, firsts = own.encode(texts)
                again = own.decode(tokens, firsts)
                same = np.array([x == y for x, y in zip(texts, again, strict=True)])
                ids = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(tokens, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, pa.array(np.diff(firsts), pa.int64(), mask=null), pa.array(same, pa.bool_(), mask=null)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: str = _tokens.VOCABULARY) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text, an id that the vocabulary lacks is an error."""
    ranks = _tokens.load(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, shared)
        for batch in batches:
            lists = batch.column(1)
            rows = [np.array(x if x is not None else [], np.int32) for x in lists.to_pylist()]
            firsts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            texts = own.decode(np.concatenate(rows) if rows else np.zeros(0, np.int32), firsts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string(), mask=~np.asarray(lists.is_valid()))], ["doc_id", "text"])

    return over_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to it."""
    return encode_documents(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the tokens of what is left, as ``encode_documents`` gives them."""
    return encode_documents(docs)
