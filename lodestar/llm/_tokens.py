"""Byte-level BPE vocabularies and the cut of a text into words.

The vocabulary file is read on the driver and sent to the tasks, so it needn't
lie on every machine.
"""

from __future__ import annotations

import base64
import re

import regex
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A coarser cut at white space; no token crosses it.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_CHUNK_EXACT = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that the two libraries don't both call white space.
_ODD = re.compile("[\x1c-\x1f]")
WORD = regex.compile(PATTERN)


def chunks(text: str) -> list[str]:
    """The text cut before each white space that begins a word; joined again they are the text."""
    return (_CHUNK_EXACT if _ODD.search(text) else _CHUNK).findall(text)


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ids, which are also the merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
