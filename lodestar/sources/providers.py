"""Providers of embeddings: a deterministic one for tests, and HTTP services with the common embeddings API."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from lodestar.functions.vectors import unit_of

#: Texts that go out in one call.
TEXTS_PER_CALL = 25


class Provider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ProviderError(RuntimeError):
    """A call that failed, with its HTTP status if there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    def __reduce__(self):
        return ProviderError, (str(self), self.status)


@dataclass(frozen=True)
class HashProvider:
    """Vectors of length 1 made from hashed words: equal texts have equal vectors, texts that share words similar ones."""

    dims: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in t.lower().split():
                v += np.random.default_rng(int.from_bytes(hashlib.sha256(w.encode()).digest(), "little")).standard_normal(self.dims)
            out.append(unit_of(v.tolist()))
        return out


@dataclass(frozen=True)
class HttpProvider:
    """``POST base/embeddings`` with model, input and, if set, dimensions; vectors come back in the order of the texts.

    ``names`` maps a model's own name to the service's. A service that answers
    with another number of vectors is an error.
    """

    base: str
    model: str
    key: str = ""
    dimensions: int = 0
    timeout: float = 60.0
    names: tuple[tuple[str, str], ...] = ()
    opener: Callable | None = None

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        body = {"model": dict(self.names).get(self.model, self.model), "input": list(texts)} | ({"dimensions": self.dimensions} if self.dimensions > 0 else {})
        request = urllib.request.Request(f"{self.base.rstrip('/')}/embeddings", json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        try:
            with (self.opener or urllib.request.urlopen)(request, timeout=self.timeout) as answer:
                data = json.loads(answer.read())["data"]
        except urllib.error.HTTPError as e:
            raise ProviderError(str(e), e.code) from e
        except OSError as e:
            raise ProviderError(str(e)) from e
        if len(data) != len(texts):
            raise ProviderError(f"{len(data)} vectors for {len(texts)} texts")
        return [unit_of(x["embedding"]) for x in data]
