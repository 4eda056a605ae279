"""Lexemes of documents and keyword queries: parsing, matching and cover-density rank.

A document's lexemes are an array with one entry for each word in its place;
a stop word's entry is null, so it keeps its place. ``simple`` has no stop words
and changes only the case. All of matching and ranking is built-in expressions
on that array, so neither shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scores import CONFIGS
from lodestar.functions.stem import stem

_WORD = re.compile(r"[^\W_]+")


@lru_cache(16)
def stop_words(config: str) -> frozenset[str]:
    """The stop words of a configuration, from Spark's own lists; none for ``simple``."""
    if config == "simple":
        return frozenset()
    SparkSession.builder.getOrCreate()
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords(config))


def lexemes_of(text: str | None, config: str = "simple", stops: frozenset[str] | None = None) -> list[str | None]:
    stops = stop_words(config) if stops is None else stops
    return [None if w in stops else stem(w, config) for w in _WORD.findall((text or "").lower())]


def lexemes(text: Column | str, config: str = "simple") -> Column:
    """The lexemes of a column; null stays null. Only configurations with a stemmer need Python."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    if config == "simple":
        return plain
    stops = stop_words(config)

    @F.pandas_udf("array<string>")
    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: lexemes_of(t, config, stops), na_action="ignore")

    return stemmed(c)


def lexemes_by_language(text: Column | str, language: Column | str) -> Column:
    """``lexemes`` under each row's own configuration, in one pass; only texts that need a stemmer go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    code = F.lower(F.trim(F.col(language) if isinstance(language, str) else language))
    known = F.coalesce(code.isin(*CONFIGS), F.lit(False))
    stops = {c: stop_words(name) for c, name in CONFIGS.items()}

    @F.pandas_udf("array<string>")
    def stemmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, codes in batches:
            yield pd.Series([lexemes_of(t, CONFIGS[c], stops[c]) if isinstance(t, str) else None for t, c in zip(texts, codes, strict=True)], dtype=object)

    return F.when(known, stemmed(F.when(known, text), code)).otherwise(lexemes(text))


def positions(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys``, lexeme and its positions, from 1, of every lexeme array: the postings of an inverted index.

    A key's words lie in one row, so they are grouped there, batch by batch, and nothing is shuffled.
    """
    own = rows.select(*keys, "lexemes")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(batch)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            has = np.asarray(words.is_valid())
            code = words.indices.fill_null(0).to_numpy(zero_copy_only=False)[has]
            row, place = row[has], place[has]
            order = np.lexsort((place, code, row))
            code, row, place = code[order], row[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
            spots = pa.ListArray.from_arrays(pa.array(np.append(head, len(code)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[head])) for k in range(len(keys))), words.dictionary.take(pa.array(code[head])), spots], [*keys, "lexeme", "positions"])

    return own.mapInArrow(run, f"{fields}, lexeme string, positions array<int>")


@dataclass(frozen=True)
class Phrase:
    """Lexemes with their distances from the first; one lexeme is a plain term."""

    words: tuple[str, ...]
    shifts: tuple[int, ...]
    negated: bool = False


#: Alternatives, each a list of phrases that must all hold.
Query = tuple[tuple[Phrase, ...], ...]


def parse(query: str, config: str = "simple") -> Query:
    """A keyword query: words are joined by AND, ``or`` separates alternatives, quotes make a phrase and ``-`` negates.

    Stop words drop out but keep their place in a phrase. An unfinished quote
    runs to the end. An empty query has no alternative and matches nothing.
    """
    out: list[list[Phrase]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)"([^"]*)"?|(\S+)', query):
        word = bare
        if bare:
            if bare.lower() == "or":
                out.append([])
                continue
            minus, word = ("-", bare.lstrip("-")) if bare.startswith("-") else ("", bare)
        else:
            word = quoted
        found = [(w, i) for i, w in enumerate(lexemes_of(word, config)) if w is not None]
        if found:
            first = found[0][1]
            out[-1].append(Phrase(tuple(w for w, _ in found), tuple(i - first for _, i in found), bool(minus)))
    return tuple(tuple(part) for part in out if part)


def _holds(words: Column, phrase: Phrase) -> Column:
    every = F.lit(True)
    for w in phrase.words:
        every = every & F.array_contains(words, F.lit(w))
    if len(phrase.words) > 1 and phrase.shifts == tuple(range(len(phrase.words))):
        # Neighbours stand side by side in the joined text; a lexeme has no space in it.
        every = F.when(every, F.contains(F.concat(F.lit(" "), F.array_join(words, " ", "\x00"), F.lit(" ")), F.lit(f" {' '.join(phrase.words)} "))).otherwise(F.lit(False))
    elif len(phrase.words) > 1:
        # Only where all words are there are places compared.
        heads = F.filter(F.transform(words, lambda w, i: F.when(w == phrase.words[0], i)), lambda i: i.isNotNull())

        def follows(i: Column) -> Column:
            ok = F.lit(True)
            for w, shift in zip(phrase.words[1:], phrase.shifts[1:], strict=True):
                ok = ok & F.coalesce(F.get(words, i + shift) == w, F.lit(False))
            return ok

        every = F.when(every, F.exists(heads, follows)).otherwise(F.lit(False))
    every = F.coalesce(every, F.lit(False))
    return ~every if phrase.negated else every


def matches(words: Column | str, query: Query) -> Column:
    """Whether a document matches; null lexemes don't, not even a negation."""
    words = F.col(words) if isinstance(words, str) else words
    out = F.lit(False)
    for part in query:
        own = F.lit(True)
        for phrase in part:
            own = own & _holds(words, phrase)
        out = out | own
    return words.isNotNull() & out


def _density(words: Column, terms: list[str]) -> Column:
    """Sum over the minimal covers of all ``terms`` of 0.1 / (1 + words between that are none of them), in one pass over the array."""
    at = F.transform(words, lambda w, i: F.struct(F.array_position(F.array(*[F.lit(t) for t in terms]), w).cast("int").alias("t"), i.alias("i")))
    hits = F.filter(at, lambda m: m["t"] > 0)
    if len(terms) == 1:
        return F.size(hits) * F.lit(0.1)
    start = F.struct(
        F.array_repeat(F.lit(-1), len(terms)).alias("last"), F.array_repeat(F.lit(0), len(terms)).alias("rank"), F.lit(0).alias("n"), F.lit(-1).alias("done"), F.lit(0.0).alias("score"),
    )

    def step(acc: Column, m: Column) -> Column:
        n = acc["n"] + 1
        last = F.transform(acc["last"], lambda x, k: F.when(k + 1 == m["t"], m["i"]).otherwise(x))
        rank = F.transform(acc["rank"], lambda x, k: F.when(k + 1 == m["t"], n).otherwise(x))
        first = F.array_min(last)
        noise = (m["i"] - first) - (n - F.array_min(rank))
        cover = first > acc["done"]
        return F.struct(last.alias("last"), rank.alias("rank"), n.alias("n"), F.when(cover, first).otherwise(acc["done"]).alias("done"), (acc["score"] + F.when(cover, F.lit(0.1) / (noise + 1)).otherwise(F.lit(0.0))).alias("score"))

    return F.aggregate(hits, start, step, lambda acc: acc["score"])


def cover_density(words: Column | str, query: Query) -> Column:
    """The rank of a document that matches: each alternative that holds adds the density of its covers.

    A term alone counts 0.1 for each place. The words of a phrase are taken as
    terms of their alternative; negated ones don't count, so a query of
    negations alone ranks 0.
    """
    words = F.col(words) if isinstance(words, str) else words
    total = F.lit(0.0)
    for part in query:
        terms = list(dict.fromkeys(w for p in part if not p.negated for w in p.words))
        if terms:
            density = _density(words, terms)
            if len(query) > 1:  # else the document matches just because this one holds
                holds = F.lit(True)
                for p in part:
                    holds = holds & _holds(words, p)
                density = F.when(holds, density).otherwise(F.lit(0.0))
            total = total + density
    return total
