"""Text transforms as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> tuple[str, str]:
    """Lower-case letters that decompose into one of a to z and marks, and those letters."""
    whole = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Ll"}
    some = {c: d[0] for c, d in whole.items() if "a" <= d[0] <= "z" and all(unicodedata.category(m)[0] == "M" for m in d[1:])}
    return "".join(some), "".join(some.values())


FOLD_FROM, FOLD_TO = _folds()
# Latin letters without a decomposition, and what they are written with.
SINGLE = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t"}
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}

_UPPER, _OTHER = r"\p{Lu}\p{Lt}", r"\p{Ll}\p{Lo}\p{Lm}"
#: A run of capitals with the letters after it, a run of other letters, or a run of digits; marks stay with their letter.
TOKEN = rf"[{_UPPER}][{_UPPER}\p{{M}}]*[{_OTHER}\p{{M}}]*|[{_OTHER}][{_OTHER}\p{{M}}]*|\p{{Nd}}+"


def normalized_name(name: Column | str) -> Column:
    """Lower case, punctuation to spaces, runs of white space to one space, trimmed."""
    plain = F.regexp_replace(F.lower(name), r"\p{Punct}", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def folded(word: Column) -> Column:
    """Lower case; Latin letters without their marks, letters of other scripts as they are."""
    plain = F.translate(F.lower(word), FOLD_FROM + "".join(SINGLE), FOLD_TO + "".join(SINGLE.values()))
    for letter, two in DOUBLE.items():
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    return F.regexp_replace(plain, r"([a-z])\p{M}+", "$1")


def tokens(text: Column | str) -> Column:
    """Words of any script and numbers, split where the case rises and between letters and digits; folded. Null: null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), folded)


def char_ngrams(words: Column, least: int, most: int) -> Column:
    """All n-grams of least to most characters of each word."""
    grams = lambda t: F.flatten(
        F.transform(
            F.sequence(F.lit(least), F.lit(most)),
            lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.flatten(F.transform(words, grams))


def feature_name(prefix: str, category: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.lit("_"), F.regexp_replace(F.trim(category), r"\s+", "_"))


def hashed_order(seed: str, *ids: Column | str) -> Column:
    """A shuffle that any engine reproduces: rows in the order of the MD5 of seed and ids."""
    parts = [F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]
    return F.md5(F.concat_ws("#", F.lit(seed), *parts))
