"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), for whole batches of tokens."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The endings of steps 2, 3 and 4 of the published algorithm and what takes their place.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful",
    ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for c in word:
        out.append(c not in "aeiou" and not (c == "y" and bool(out) and out[-1]))
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    c = _consonants(stem)
    return sum(b and not a for a, b in zip(c, c[1:]))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("s") and not word.endswith("ss"):  # plurals
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):  # past and present participles
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and not all(_consonants(word[: -len(end)])):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and not all(_consonants(word[:-1])):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """The tokens' stems; null for null."""
    return tokens.map(lambda words: None if words is None else [stem(w) for w in words])
