"""The Porter stemmer (Porter 1980), for English words of letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

VOWELS = "aeiou"
#: Suffix rules of the published algorithm (fixed values): (suffix, replacement).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(w: str, i: int) -> bool:
    if w[i] in VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _replace(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and _has_vowel(w[: -len(x)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _double(cut) and cut[-1] not in "lsz":
                w = cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            cut = w[: -len(suffix)]
            if _measure(cut) > 1 and (suffix != "ion" or cut[-1:] in ("s", "t")):
                w = cut
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w[-1] == "l" else w


def stems(words: Column) -> Column:
    """Stems of an array of words."""

    @pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
