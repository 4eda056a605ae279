"""Trigram sets and their Jaccard similarity.

Words are runs of letters and digits in lower case, each with two spaces before
it and one after it; a text's trigrams are the distinct ones of all its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose sets a worker holds at once.
STEP = 256
_WORD = re.compile(r"[^\W_]+")


def trigrams_of(text: str | None) -> list[str]:
    """Distinct trigrams in the order they come."""
    out: dict[str, None] = {}
    for w in dict.fromkeys(_WORD.findall((text or "").lower())):
        padded = f"  {w} "
        out.update((padded[i : i + 3], None) for i in range(len(padded) - 2))
    return list(out)


def sets_of(texts: list[str | None]) -> pa.ListArray:
    """``trigrams_of`` for many texts at once, each set in the order of its characters; None stays null.

    All words are one text, in which a trigram is three characters side by side, the last two of which aren't both spaces.
    """
    padded = ["".join(f"  {w} " for w in dict.fromkeys(_WORD.findall((t or "").lower()))) for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) for p in padded])
    has = np.zeros(0x110000, bool)
    has[chars] = True
    letters = np.flatnonzero(has)
    rank = np.zeros(0x110000, np.int64)
    rank[letters] = np.arange(len(letters))
    c, n, space = rank[chars], max(1, len(letters)), rank[32]
    whole = np.flatnonzero((c[1:-1] != space) | (c[2:] != space)) if len(c) else np.zeros(0, np.int64)
    key = (np.searchsorted(ends, whole, "right") * n + c[whole]) * n * n + c[whole + 1] * n + c[whole + 2]
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row, gram = key // n**3, key % n**3
    grams, at = np.unique(gram, return_inverse=True)
    known = pa.array(["".join(chr(letters[x]) for x in (g // n // n, g // n % n, g % n)) for g in grams.tolist()], pa.string())
    sizes = np.bincount(row, minlength=len(texts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([*(t is None for t in texts), False]))
    return pa.ListArray.from_arrays(offsets, known.take(pa.array(at)))


def words(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def trigrams(text: Column | str) -> Column:
    """The distinct trigrams of a column; null stays null."""
    # Repeated words go before they are cut: they can't add a trigram.
    cut = F.transform(F.array_distinct(words(text)), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def with_trigrams(rows: DataFrame, text: str = "document") -> DataFrame:
    """``rows`` with their trigram sets in ``trigrams``, in one pass over the batches; null stays null.

    For tables: only the text goes to Python, and it is computed once, before the pass, however much later expressions use the set.
    """
    @F.arrow_udf("array<string>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [sets_of(batch.slice(a, STEP).to_pylist()) for a in range(0, len(batch), STEP)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return rows.withColumn("trigrams", sets(text))


def shared_with(sets: Column | str, query: list[str]) -> Column:
    """How many of a query's trigrams are in a stored set."""
    sets = F.col(sets) if isinstance(sets, str) else sets
    return F.size(F.array_intersect(sets, F.array(*map(F.lit, query))))


def least_shared(query: list[str], threshold: float) -> int:
    """The fewest common trigrams with which the similarity can reach the threshold."""
    return max(1, math.ceil(threshold * len(query) - 1e-9))
