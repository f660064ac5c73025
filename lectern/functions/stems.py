"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), word by word."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of the published algorithm.
_STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    shape = ""
    for i, c in enumerate(word):
        shape += "v" if c in "aeiou" or c == "y" and i and shape[-1] == "c" else "c"
    return shape


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif suffix := _longest(word, ["ed", "ing"]):
        if "v" in _shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        if suffix := _longest(word, [a for a, _ in table]):
            if _measure(word[: -len(suffix)]) > 0:
                word = word[: -len(suffix)] + dict(table)[suffix]
    suffix = _longest(word, _STEP_4)
    if word.endswith(("sion", "tion")) and len(suffix) < 3:
        suffix = "ion"
    if suffix and _measure(word[: -len(suffix)]) > 1:
        word = word[: -len(suffix)]
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or size == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stem of each word of an array."""
    return words.map(lambda own: None if own is None else [stem(w) for w in own])
