"""English stemming (the public Porter2 rules) of distinct terms, and the analyzer of the search index."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# fixed values: English stop words of the index's analyzer
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
# fixed values: the stemmer's exceptions and suffixes
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_V, _NOT_V = "[aeiouy]", "[^aeiouy]"


def _regions(word: str) -> tuple[int, int]:
    start = re.match("gener|commun|arsen", word)
    first = start or re.search(f"{_V}{_NOT_V}", word)
    r1 = first.end() if first else len(word)
    second = re.compile(f"{_V}{_NOT_V}").search(word, r1)
    return r1, second.end() if second else len(word)


def _ends_short(word: str) -> bool:
    return re.search(f"{_NOT_V}{_V}[^aeiouywxY]$", word) is not None or re.fullmatch(f"{_V}{_NOT_V}", word) is not None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub("(?<=[aeiouy])y", "Y", re.sub("^y", "Y", word.lstrip("'")))
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # past and progressive
    if m := re.search("(eedly|eed)$", word):
        word = word[: m.start()] + "ee" if m.start() >= r1 else word
    elif (m := re.search("(ingly|edly|ing|ed)$", word)) and re.search(_V, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derived forms
    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    word = word[:-1] if word[at - 1 : at] == "l" else word
                elif suffix == "li":
                    word = word[:-2] if word[at - 1 : at] in tuple("cdeghkmnrt") else word
                else:
                    word = word[:at] + _STEP2[suffix]
            break
    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if suffix == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + _STEP3[suffix]
            break
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _ends_short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@pandas_udf(StringType())
def stem_term(term: pd.Series) -> pd.Series:
    """Stems; meant for a column of distinct terms."""
    return term.map(lambda t: stem(t) if isinstance(t, str) else None)


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def query_words(text: str) -> list[str]:
    """The same for a query on the driver."""
    found = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text.lower())
    return list(dict.fromkeys(w for w in found if w not in STOP_WORDS))
