"""The English stemmer of M. Porter's published second algorithm, and light stemmers for other languages.

Other configurations use short suffix lists (after J. Savoy's light stemming);
their lexemes needn't equal those of any database.
"""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = sorted(
    {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}.items(),
    key=lambda x: -len(x[0]),
)
_STEP3 = sorted({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}.items(), key=lambda x: -len(x[0]))
_STEP4 = sorted(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"], key=lambda x: -len(x))


def _region(w: str, start: int) -> int:
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


@lru_cache(200_000)
def english(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        if m[0] in ("eed", "eedly"):
            if m.start() >= r1:
                w = w[: m.start()] + "ee"
        elif re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_ENDS = {
    "french": ("issements", "issement", "atrices", "ateurs", "ations", "atrice", "ateur", "ation", "ements", "ement", "euses", "ences", "ances", "ence", "ance", "ismes", "isme", "istes", "iste", "ables", "able", "euse", "eux", "ives", "ive", "ifs", "if", "ités", "ité", "ées", "ée", "és", "er", "ez", "ent", "es", "e", "s", "é"),
    "german": ("erinnen", "erin", "heiten", "heit", "keiten", "keit", "ungen", "ung", "lich", "isch", "ern", "em", "en", "er", "es", "st", "e", "s", "n"),
    "spanish": ("amientos", "imientos", "amiento", "imiento", "aciones", "ación", "adoras", "adores", "ancias", "ancia", "adora", "ador", "mente", "idades", "idad", "ismos", "ismo", "ables", "able", "istas", "ista", "osos", "osas", "oso", "osa", "ando", "iendo", "ados", "adas", "idos", "idas", "ado", "ada", "ido", "ida", "ar", "er", "ir", "es", "os", "as", "a", "e", "o", "s"),
    "italian": ("azioni", "azione", "amenti", "amento", "imenti", "imento", "mente", "abili", "abile", "ità", "ismi", "ismo", "isti", "ista", "ando", "endo", "ati", "ate", "ato", "ata", "are", "ere", "ire", "i", "e", "o", "a"),
    "portuguese": ("amentos", "imentos", "amento", "imento", "ações", "ação", "adoras", "adores", "adora", "ador", "mente", "idades", "idade", "ismos", "ismo", "istas", "ista", "ando", "endo", "indo", "ados", "adas", "ado", "ada", "ar", "er", "ir", "es", "os", "as", "a", "e", "o", "s"),
    "russian": ("иями", "ями", "ами", "ией", "иям", "иях", "ого", "его", "ому", "ему", "ыми", "ими", "ость", "ости", "ать", "ить", "еть", "ный", "ная", "ное", "ые", "ие", "ый", "ий", "ой", "ей", "ов", "ев", "ам", "ям", "ах", "ях", "ая", "яя", "ое", "ее", "ом", "ем", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я"),
}


def stem(word: str, config: str) -> str:
    """The stem under a text configuration; ``simple`` changes nothing."""
    if config == "english":
        return english(word)
    for end in _ENDS.get(config, ()):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word
