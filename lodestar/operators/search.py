"""Hybrid search and typeahead over a documents table and a vectors table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.common import HIT, Scope, best, ranked
from lodestar.operators.fusion import best_of, fuse, union_lists
from lodestar.operators.keyword import keyword_search, native_search, trigram_search
from lodestar.operators.semantic import semantic_search

MODES = ("dual", "lexical", "semantic")


@dataclass(frozen=True)
class SearchOptions:
    """What a search may set; what is empty takes the searcher's default.

    ``entity_types`` stands for whichever of the two lists below it is empty.
    ``condition`` and its ``args`` reach the vectors alone.
    """

    language: str = ""
    mode: str = "dual"
    limit: int = 0
    model: str = ""
    entity_types: tuple[str, ...] = ()
    lexical_types: tuple[str, ...] = ()
    semantic_types: tuple[str, ...] = ()
    two_stage: bool = False
    oversample: int = 0
    rrf_k: float = 0.0
    weights: tuple[float, ...] = ()
    condition: str = ""
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Searcher:
    """``documents`` and ``vectors`` to search, and a callable (model, text) -> vector for queries.

    ``postings`` are the documents' trigrams, if they are stored. ``config`` is the
    text configuration that the lexemes were made with, where it isn't the language's own.
    """

    documents: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[str, str], Sequence[float]] | None = None
    language: str = "en"
    model: str = ""
    limit: int = 20
    rrf_k: float = 60.0
    postings: DataFrame | None = None
    config: str | None = None

    def _nothing(self) -> DataFrame:
        return self.documents.filter(F.lit(False)).select(*HIT[:3], F.lit(0.0).alias("score"))

    def _lexical(self, query: str, language: str, limit: int, types: tuple[str, ...]) -> list[DataFrame]:
        scope = Scope(language, types)
        if not T.is_cjk_language(language):
            return [keyword_search(self.documents, query, scope, limit, self.config)]
        out = []
        if T.has_ascii_word(query):
            out.append(trigram_search(self.documents, query, scope, limit, postings=self.postings))
        if T.has_cjk(query):
            out.append(native_search(self.documents, query, scope, limit).select(*HIT))
        return out

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """entity_type, entity_id, language and fused score, best first.

        Keyword and vector hits are fused by rank; in a mode with one list the
        scores are those of the fusion as well. A query without letters finds
        nothing; nor does a search with vectors whose query has an empty one.
        """
        text = T.for_embedding(query)
        if not text or not T.has_word(text):
            return self._nothing()
        if options.mode not in MODES:
            raise ValueError(f"unknown mode {options.mode!r}")
        language, limit = options.language.strip() or self.language, options.limit if options.limit > 0 else self.limit
        common = T.distinct_trimmed(list(options.entity_types)) or []
        lexical = tuple(T.distinct_trimmed(list(options.lexical_types)) or common)
        semantic = tuple(T.distinct_trimmed(list(options.semantic_types)) or common)
        if options.mode != "semantic" and not lexical or options.mode != "lexical" and not semantic:
            raise ValueError("entity types are required")
        lists = self._lexical(text, language, limit, lexical) if options.mode != "semantic" else []
        if options.mode != "lexical":
            model = options.model or self.model
            if self.embed is None or self.vectors is None:
                raise ValueError("an embedder is required")
            if not model:
                raise ValueError("model is required")
            vector = list(self.embed(model, text))
            if not vector:
                return self._nothing()
            scope = Scope(language, semantic, condition=options.condition, args=options.args)
            lists.append(semantic_search(self.vectors, model, vector, scope, limit, two_stage=options.two_stage, oversample=options.oversample))
        if not lists:
            return self._nothing()
        k = options.rrf_k if options.rrf_k > 0 else self.rrf_k
        fused = fuse(union_lists([ranked(x) for x in lists]), k, options.weights)
        return best(fused.select(*HIT), limit)

    def typeahead(self, query: str, entity_types: Sequence[str], language: str = "", limit: int = 0, least: float = 0.0) -> DataFrame:
        """Hits while a query is being typed: by trigrams, in Chinese, Japanese and Korean by the beginning of words as well.

        The greatest score of a key counts. ``least`` 0 is 0.1 for trigrams and
        no limit for native script.
        """
        text = T.for_embedding(query)
        if not text or not T.has_word(text):
            return self._nothing()
        language, types, limit = language.strip() or self.language, T.distinct_trimmed(list(entity_types)), limit if limit > 0 else 10
        if not types:
            raise ValueError("entity types are required")
        scope = Scope(language, tuple(types))
        if not T.is_cjk_language(language):
            return trigram_search(self.documents, text, scope, limit, least, self.postings)
        lists = []
        if T.has_ascii_word(text):
            lists.append(trigram_search(self.documents, text, scope, limit, least, self.postings))
        if T.has_cjk(text):
            hits = native_search(self.documents, text, scope, limit, prefix=True)
            lists.append(hits.filter(F.col("score") >= least) if least > 0 else hits)
        return best(best_of(lists), limit) if lists else self._nothing()
