"""English suffix stripping by Porter's algorithm ("An algorithm for suffix stripping",
1980), and the function words a keyword index leaves out.

A word is a row of vowels and consonants: its measure is the number of times a vowel is
followed by a consonant. Each step takes the longest suffix of its table that the word
ends with, and replaces it if the rest of the word meets the step's condition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix tables of the published algorithm, (suffix, replacement).
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize"]

# English function words (articles, pronouns, prepositions, conjunctions,
# auxiliaries and common adverbs). A longer list may be given instead.
STOP_WORDS = tuple("""
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each either else ever every few for from further had has have having he her
here hers herself him himself his how however i if in into is it its itself just least less may me might more most
much must my myself neither no nor not now of off often on once only or other others ought our ours ourselves out over
own per rather same shall she should since so some such than that the their theirs them themselves then there these
they this those though through thus to too under until up upon us very was we were what when where whether which while
who whom whose why will with within without would yet you your yours yourself yourselves
""".split())

_VOWELS = frozenset("aeiou")


def _shape(word: str) -> str:
    """'v' or 'c' per letter: y is a vowel after a consonant."""
    out: list[str] = []
    for letter in word:
        out.append("v" if letter in _VOWELS or (letter == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last one none of w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: list[tuple[str, str]]) -> str:
    """The longest matching suffix is replaced if a measure above 0 is left."""
    for suffix, new in sorted(table, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            rest = word[:len(word) - len(suffix)]
            return rest + new if _measure(rest) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past_or_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        rest = word[:len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if _doubled(rest) and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest
    return word


def _drop(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[:len(word) - len(suffix)]
            allowed = _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t")))
            return rest if allowed else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _past_or_progressive(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_drop(_replace(_replace(word, STEP_2), STEP_3)))


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    """Stems of a column of distinct words."""
    return words.map(stem, na_action="ignore")
