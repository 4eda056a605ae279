"""Text forms: the folded form that documents are matched in, and the forms that a query takes.

Each form exists for a Python string (a query, on the driver) and, where it is
applied to tables, as a Column.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SINGLE = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
    "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "ŧ": "t", "Ŧ": "T", "ĸ": "k", "ʼ": "'",
}
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e iu ia io".split(" "), strict=True))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_KANA = {}
for _row, _sounds in {
    "アイウエオ": "a i u e o", "カキクケコ": "ka ki ku ke ko", "ガギグゲゴ": "ga gi gu ge go", "サシスセソ": "sa shi su se so", "ザジズゼゾ": "za ji zu ze zo",
    "タチツテト": "ta chi tsu te to", "ダヂヅデド": "da ji zu de do", "ナニヌネノ": "na ni nu ne no", "ハヒフヘホ": "ha hi hu he ho", "バビブベボ": "ba bi bu be bo",
    "パピプペポ": "pa pi pu pe po", "マミムメモ": "ma mi mu me mo", "ヤユヨ": "ya yu yo", "ラリルレロ": "ra ri ru re ro", "ワヲン": "wa wo n", "ァィゥェォ": "a i u e o", "ャュョ": "ya yu yo", "ッヴ": "tsu vu",
}.items():
    for _c, _s in zip(_row, _sounds.split(), strict=True):
        _KANA[_c] = _s
        _KANA[chr(ord(_c) - 0x60)] = _s
_KANA["ー"] = "-"
_LEAD = "g kk n d tt r m b pp s ss  j jj c k t p h".split(" ")
_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split()
_TAIL = " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" ")


@cache
def other_letters() -> dict[str, str]:
    """ASCII forms of the letters and marks that no table here has, Han among them, as the ICU library among Spark's jars transliterates them.

    Made once, on the driver; what ICU doesn't know isn't in it. A Han character is a word of its own.
    """
    asked = [c for c in map(chr, [*range(0x250, 0xD800), *range(0xF900, 0x10000)]) if unicodedata.category(c)[0] in "LMN" and c not in _KANA and not "가" <= c <= "힣" and c.lower() not in _CYRILLIC | _GREEK]
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    found = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII").transliterate("\n".join(asked)).split("\n")
    forms = {c: "".join(x for x in f.strip().lower() if x.isascii()) for c, f in zip(asked, found, strict=True) if f != c}
    return {c: f"{f} " if "CJK" in unicodedata.name(c, "") else f for c, f in forms.items()}


def _letter(c: str, others: dict[str, str] | None = None) -> str:
    """One character in ASCII, where it has such a form; other characters stay, marks that are left over go."""
    if c < "\x80":
        return c
    if c in _SINGLE:
        return _SINGLE[c]
    low = c.lower()
    for table in (_CYRILLIC, _GREEK):
        if low in table:
            return table[low]
    if c in _KANA:
        return _KANA[c]
    if "가" <= c <= "힣":
        n = ord(c) - 0xAC00
        return _LEAD[n // 588] + _VOWEL[n % 588 // 28] + _TAIL[n % 28]
    if c < "\u0250" or c in "\u3099\u309a":
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        return bare if bare == c or not bare else "".join(_letter(x, others) for x in bare)
    if unicodedata.category(c)[0] not in "LMN":
        return c
    form = (other_letters() if others is None else others).get(c)
    if form is not None:
        return form
    if unicodedata.category(c)[0] == "M":
        return ""
    bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return bare if bare == c or not bare else "".join(_letter(x, others) for x in bare)


def fold(text: str | None, others: dict[str, str] | None = None) -> str:
    """Compatible characters unified, letters in ASCII where they have such a form, lower case, each run of other characters one space.

    None is empty. ``others`` is ``other_letters``, where it has been looked up already.
    """
    if not text or not text.strip():
        return ""
    plain = "".join(_letter(c, others) for c in unicodedata.normalize("NFKC", text.strip())).lower()
    return " ".join("".join(c if c.isalpha() or unicodedata.category(c)[0] == "N" else " " for c in plain).split())


def _latin_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters from U+00A0 to U+024F that fold to one letter, those letters, and the pairs that need a replacement."""
    one, to, many = [], [], []
    for code in range(0xA0, 0x250):
        c = chr(code)
        own = "".join(_letter(x, {}) for x in unicodedata.normalize("NFKC", c)).lower()
        own = "".join(x if x.isalpha() or unicodedata.category(x)[0] == "N" else " " for x in own)
        if own == c:
            continue
        if len(own) == 1:
            one.append(c)
            to.append(own)
        else:
            many.append((c, own if own.strip() else " "))
    return "".join(one), "".join(to), many


LATIN_FROM, LATIN_TO, LATIN_MANY = _latin_tables()
_OFTEN = "ßæÆœŒ"


def fold_latin(text: Column | str) -> Column:
    """``fold`` as built-in expressions, for texts in Latin script with composed accents; null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    # Each replacement is a pass over the text: only texts that hold such a character pay for it.
    replaced = lambda pairs: reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), pairs, c)
    one_of = lambda pairs: f"[{''.join(x for x, _ in pairs)}]"
    often, rest = ([pair for pair in LATIN_MANY if (pair[0] in _OFTEN) == x] for x in (True, False))
    spelt = F.when(~c.rlike(one_of(LATIN_MANY)), c).when(~c.rlike(one_of(rest)), replaced(often)).otherwise(replaced(LATIN_MANY))
    c = F.when(~c.rlike(r"[^\x00-\x7F]"), c).otherwise(F.translate(spelt, LATIN_FROM, LATIN_TO))
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def fold_latin_sql(column: str) -> str:
    """``fold_latin`` in DuckDB's SQL."""
    sql = f"translate({column}, '{LATIN_FROM}', '{LATIN_TO}')"
    for a, b in LATIN_MANY:
        sql = f"replace({sql}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower({sql}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def fold_any(text: Column | str) -> Column:
    """``fold`` in Python, for texts in any script; null stays null."""
    others = other_letters()

    @F.pandas_udf(StringType())
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: fold(t, others), na_action="ignore")

    return folded(text)


def fold_column(text: Column | str) -> Column:
    """``fold`` of a column, the same form that a query takes: built-in expressions for Latin script with composed accents, Python for texts with anything else; null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    latin = ~c.rlike(r"[^\x00-\x{24F}]")
    return F.when(latin, fold_latin(c)).otherwise(fold_any(F.when(~latin, c)))


def _solid(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "N"


def split_hyphens(query: str) -> str:
    """Hyphens between two letters or digits become spaces."""
    return "".join(" " if c == "-" and 0 < i < len(query) - 1 and _solid(query[i - 1]) and _solid(query[i + 1]) else c for i, c in enumerate(query))


def for_embedding(query: str | None) -> str:
    """The query as an embedder gets it: no hyphens in or before words, single spaces."""
    return " ".join(w for w in (t.lstrip("-") for t in split_hyphens(query or "").split()) if w)


def for_keywords(query: str | None) -> str:
    """The query as the keyword parser gets it: as ``for_embedding``, and ``not x`` is ``-x``.

    A last ``not`` stays; one before a word without letters goes with it.
    """
    words, out, k = split_hyphens(query or "").split(), [], 0
    while k < len(words):
        if words[k].lower() == "not" and k + 1 < len(words):
            bare = words[k + 1].lstrip("-")
            out += [f"-{bare}"] if bare else []
            k += 2
            continue
        bare = words[k].lstrip("-")
        out += [bare] if bare else []
        k += 1
    return " ".join(out)


def for_embedding_column(query: Column | str) -> Column:
    """``for_embedding`` of a column; null stays null."""
    c = F.col(query) if isinstance(query, str) else query
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<=[\p{L}\p{N}])-(?=[\p{L}\p{N}])", " "), r"\s+", " ")), " ")
    return F.array_join(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^-+", "")), lambda w: w != ""), " ")


CJK = r"[　-ヿㇰ-ㇿ一-鿿가-힯]"
_CJK = re.compile(CJK)


def has_cjk(query: str) -> bool:
    return bool(_CJK.search(query))


def has_ascii_word(query: str) -> bool:
    return bool(re.search("[A-Za-z0-9]", query))


def has_word(query: str) -> bool:
    """Whether there is a letter or a digit to look for."""
    return any(map(_solid, query))


def is_cjk_language(language: str | None) -> bool:
    return (language or "").strip().lower() in ("ja", "zh", "ko")


def only_words(query: str | None) -> str:
    """Letters and digits; everything else, marks too, separates."""
    return " ".join("".join(c if _solid(c) else " " for c in query or "").split())


def as_prefixes(query: str | None) -> str:
    """Each word with an asterisk at its end, once."""
    return " ".join(w if w.endswith("*") else w + "*" for w in (query or "").split())


def only_words_column(query: Column | str) -> Column:
    c = F.col(query) if isinstance(query, str) else query
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def as_prefixes_column(query: Column | str) -> Column:
    c = F.col(query) if isinstance(query, str) else query
    words = F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.endswith("*"), w).otherwise(F.concat(w, F.lit("*")))), " ")


def distinct_trimmed(values: list[str | None] | None) -> list[str] | None:
    """Trimmed values in the order they came, each once; None if none is left."""
    return list(dict.fromkeys(v.strip() for v in values or [] if v and v.strip())) or None
