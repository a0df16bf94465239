"""Porter's suffix stripping (M. F. Porter, An algorithm for suffix stripping, 1980), of distinct words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The paper's suffixes of steps 2, 3 and 4.
_STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``v`` for each vowel of a word (y behind a consonant is one), ``c`` for the others."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, pairs: tuple[tuple[str, str], ...], least: int) -> str:
    """The longest suffix that fits is the only one tried."""
    fits = [p for p in pairs if word.endswith(p[0])]
    if not fits:
        return word
    old, new = max(fits, key=lambda p: len(p[0]))
    stem = word[: len(word) - len(old)]
    return stem + new if _measure(stem) >= least else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            if word.endswith(old):
                rest = word[: -len(old)]
                if "v" in _shape(rest):
                    if rest.endswith(("at", "bl", "iz")):
                        word = rest + "e"
                    elif _doubled(rest) and rest[-1] not in "lsz":
                        word = rest[:-1]
                    else:
                        word = rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP_2, 1)
    word = _swap(word, _STEP_3, 1)
    fits = [s for s in _STEP_4 if word.endswith(s)]
    if fits:
        rest = word[: -len(max(fits, key=len))]
        if _measure(rest) > 1 and (not word.endswith("ion") or len(max(fits, key=len)) != 3 or rest[-1:] in ("s", "t")):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short_end(rest):
            word = rest
    if _measure(word) > 1 and _doubled(word) and word[-1] == "l":
        word = word[:-1]
    return word


def stems(words: DataFrame, word: str = "w", least: int = 4) -> DataFrame:
    """Each distinct word with its ``stem``; words of fewer than ``least`` letters stay. A corpus has far fewer words than tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            made = [None if w is None else stem(w) if len(w) >= least else w for w in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([column, pa.array(made, pa.string())], names=[word, "stem"])

    return words.select(word).distinct().mapInArrow(run, f"{word} string, stem string")


def stemmed(tokens: DataFrame, word: str = "w", least: int = 4) -> DataFrame:
    """``tokens`` (rows of words) with the ``stem`` of each, by a join with the stems of the distinct words."""
    return tokens.join(stems(tokens, word, least), word, "left").withColumn("stem", F.coalesce("stem", word))
