"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten characters that are deleted, and the default stop words.
DELETED = "()[],.!?:;"
STOPWORDS = ("the", "of", "and", "a", "to", "in", "is", "it", "for", "that", "with", "as", "on", "are", "be", "this", "was", "by", "an", "or", "from", "at")


def delete_marks(text: Column) -> Column:
    """Without the ten marks; nothing takes their place."""
    return F.translate(text, DELETED, "")


def delete_punctuation_digits(text: Column) -> Column:
    """Without ASCII punctuation and digits."""
    return F.regexp_replace(text, r"[\p{Punct}0-9]", "")


def tokens(text: Column) -> Column:
    """Words between runs of Unicode white space, empty ones left out."""
    return F.filter(F.split(text, r"(?U)[\s\x1C-\x1F]+"), lambda w: w != "")


def clean_words(text: Column, stopwords=STOPWORDS, keep_empty: bool = True, strip=delete_marks) -> Column:
    """Lower-cased words without stop words. A text of stop words only yields one empty word if ``keep_empty``."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(tokens(F.lower(strip(text))), lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept) if keep_empty else kept


def categories(text: Column, separator: str = ",") -> Column:
    """Parts between separators, stripped; a part that repeats counts each time."""
    return F.transform(F.split(text, separator), lambda x: F.trim(x))


def every_other(text: Column, odd: bool = True) -> Column:
    """Characters at odd (or even) places, counted from 0."""
    return F.array_join(F.filter(F.split(text, ""), lambda c, i: (i % 2 == (1 if odd else 0)) & (c != "")), "")


def is_alpha(text: Column) -> Column:
    return text.rlike(r"^\p{L}+$")
