"""English stemming by the published Porter2 (Snowball English) algorithm.

Applied to distinct words and joined back, so its cost follows the vocabulary, not the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
# Words the algorithm lists as exceptions.
SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEEP_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of steps 2, 3 and 4, longest first where one ends another.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(w: str) -> tuple[int, int]:
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    # possessives
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in KEEP_AFTER_1A:
        return w.lower()
    # past tense and gerund
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if _has_vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, to in STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1:
                if s == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif s == "li":
                    w = w[:at] if w[at - 1 : at] and w[at - 1] in LI else w
                else:
                    w = w[:at] + to
            break
    for s, to in STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + to
            break
    for s in STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stem_terms(rows: DataFrame, term: str = "term") -> DataFrame:
    """Replace a column of words by their stems, stemming each distinct word once."""
    distinct = rows.select(F.col(term).alias("_word")).distinct().withColumn("_stem", stem_column(F.col("_word")))
    joined = rows.join(distinct, rows[term] == distinct["_word"], "left")
    return joined.withColumn(term, F.col("_stem")).drop("_word", "_stem")
