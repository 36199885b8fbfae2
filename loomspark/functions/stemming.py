"""Porter's suffix stripping (1980), applied to a vocabulary once rather than to every occurrence of its words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The suffixes of steps 2 to 4 of the published algorithm, with what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_LONGEST_2, _LONGEST_3, _LONGEST_4 = (tuple(sorted(t, key=len, reverse=True)) for t in (STEP_2, STEP_3, STEP_4))


def _consonants(word: str) -> str:
    """The word as c and v; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _consonants(stem).count("vc")


def _short(word: str) -> bool:
    return len(word) >= 3 and _consonants(word).endswith("cvc") and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], longest_first: tuple[str, ...], least: int) -> str:
    """The longest suffix of the table goes if what is before it measures more than ``least``."""
    if not word.endswith(longest_first):
        return word
    for suffix in longest_first:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and of more than 64 bytes stay."""
    if len(word) < 3 or len(word.encode("utf-8", "replace")) > 64:
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _consonants(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _consonants(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP_2, _LONGEST_2, 0)
    word = _replace(word, STEP_3, _LONGEST_3, 0)
    for suffix in _LONGEST_4 if word.endswith(_LONGEST_4) else ():
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(word: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _stems(rows: DataFrame, column: str) -> DataFrame:
    """(column, stem): each distinct word with its folded stem."""

    def stems(batches):
        for pdf in batches:
            yield pd.DataFrame({column: pdf[column], "stem": [stem(fold(w)) for w in pdf[column]]})

    return rows.select(column).distinct().mapInPandas(stems, f"{column} string, stem string")


def stemmed(rows: DataFrame, column: str = "term") -> DataFrame:
    """``rows`` with the folded stem in place of ``column``; each distinct word is stemmed once and joined back."""
    return rows.join(_stems(rows, column), column).withColumn(column, F.col("stem")).select(*rows.columns)


def asked_forms(words: DataFrame, stems: DataFrame, column: str = "term") -> DataFrame:
    """(column, stem): the distinct words whose stem is among ``stems`` (in ``column``)."""
    return _stems(words, column).join(stems.select(F.col(column).alias("stem")).distinct(), "stem", "left_semi").select(column, "stem")
