"""Scalar rules: bounded scores, text configurations, retry delays."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIGS = {"en": "english", "es": "spanish", "fr": "french", "de": "german", "it": "italian", "pt": "portuguese", "ru": "russian"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bounded(raw: Column | str, k: float = 1.0) -> Column:
    """raw / (raw + k) in [0, 1); 0 for raw <= 0 or null. k <= 0 counts as 1."""
    raw, k = _col(raw).cast("double"), k if k > 0 else 1.0
    return F.when(raw > 0, raw / (raw + F.lit(float(k)))).otherwise(F.lit(0.0))


def bounded_value(raw: float, k: float = 1.0) -> float:
    return raw / (raw + (k if k > 0 else 1.0)) if raw > 0 else 0.0


def text_config(language: Column | str) -> Column:
    """The name of a language's text configuration; ``simple`` for others and for null."""
    key = F.lower(F.trim(_col(language)))
    out = None
    for code, name in CONFIGS.items():
        out = F.when(key == code, F.lit(name)) if out is None else out.when(key == code, F.lit(name))
    return out.otherwise(F.lit("simple"))


def config_of(language: str | None) -> str:
    return CONFIGS.get((language or "").strip().lower(), "simple")


def slow_retry(status: Column | str) -> Column:
    """Whether an HTTP status says that the request itself is wrong: 4xx but 408 and 429. Null: no."""
    s = _col(status)
    return F.coalesce(s.between(400, 499) & ~s.isin(408, 429), F.lit(False))


def retry_seconds(attempt: Column | str, status: Column | str, base: float = 5.0, most: float = 600.0) -> Column:
    """base * 2 ** (attempt - 1), at most ``most``; where the request is wrong, base is 15 minutes and the limit 7 days at least."""
    slow = slow_retry(status)
    n = F.greatest(_col(attempt).cast("int"), F.lit(1))
    start = F.when(slow, F.lit(max(base, 900.0))).otherwise(F.lit(float(base)))
    limit = F.when(slow, F.lit(max(most, 604800.0))).otherwise(F.lit(float(most)))
    return F.least(start * F.pow(F.lit(2.0), n - 1), limit)


def retry_delay(attempt: int, base: float = 5.0, most: float = 600.0) -> float:
    return min(base * 2.0 ** (max(1, attempt) - 1), most)


def jittered(seconds: Column, seed: int | None = None) -> Column:
    """Up to a quarter more, after the limit."""
    return seconds * (F.lit(1.0) + F.rand(seed) / 4) if seed is not None else seconds * (F.lit(1.0) + F.rand() / 4)


def jittered_value(seconds: float, rng: random.Random) -> float:
    return seconds + rng.random() * seconds / 4
