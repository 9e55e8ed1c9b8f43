"""English stems by M. F. Porter's published rules (1980), once per distinct term of a table."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The suffixes of the published steps and what each becomes. The suffix that fits is the longest one.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_1B_REPAIR = {"at": "ate", "bl": "ble", "iz": "ize"}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_WORD = re.compile("[a-z]{3,}")


def _shape(word: str) -> str:
    """A letter a character: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How often a run of consonants follows a run of vowels."""
    return "".join(kind for kind, _ in groupby(_shape(word))).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x, y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix replaced, if what is before it has a measure over `least`."""
    suffix = _longest(word, rules)
    if suffix is None or measure(base := word[: -len(suffix)]) <= least:
        return word
    return base + rules[suffix]


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    if suffix is None or "v" not in _shape(base := word[: -len(suffix)]):
        return word
    if repair := _longest(base, STEP_1B_REPAIR):
        return base[: -len(repair)] + STEP_1B_REPAIR[repair]
    if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
        return base[:-1]
    return base + "e" if measure(base) == 1 and _short_end(base) else base


def stem(word: str) -> str:
    """The stem of a lower-case word; words with other letters than a-z, or of fewer than three, stay."""
    if not _WORD.fullmatch(word):
        return word
    word = _past(_replaced(word, STEP_1A, -1))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 0), STEP_3, 0)
    suffix = _longest(word, STEP_4)
    if suffix and measure(base := word[: -len(suffix)]) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
        word = base
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def fold(word: str) -> str:
    """Without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@pandas_udf(StringType())
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: stem(fold(t)), na_action="ignore")


def term_dictionary(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term: the stemmer runs once for each, however often it stands in texts."""
    return terms.select("term").distinct().withColumn("stem", _stems(F.col("term")))
