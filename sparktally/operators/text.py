"""Text normalisation on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed, lower case, underscores as spaces, only letters, digits and spaces, single spaces."""
    words = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" ")), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def clean_label(c: Column) -> Column:
    """Without the (greedy) parenthesised part, underscores as spaces, double spaces made single once."""
    return F.replace(F.replace(F.regexp_replace(c, r"\(.*\)", ""), F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" "))


def swap_words(c: Column, pairs: dict[str, str]) -> Column:
    """Whole words replaced by their counterparts, both ways in one pass."""
    both = {**pairs, **{v: k for k, v in pairs.items()}}
    table = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def swap_whole_words(c: Column, pairs: dict[str, str]) -> Column:
    """Words replaced by their counterparts, both ways, in one pass over any text; null stays null.

    A word ends where no letter, digit or underscore follows, so ``left`` is also found in ``left-hand``; where several fit,
    the longest is taken. Each pair holds as written, with a capital, and in capitals.
    """
    both = {**pairs, **{v: k for k, v in pairs.items()}}
    cased = {f(k): f(v) for k, v in both.items() for f in (str.upper, str.capitalize, str)}
    words = "|".join(rf"\Q{w}\E" for w in sorted(cased, key=lambda w: (-len(w), w)))
    word = r"[\p{L}\p{N}_]"
    pieces = F.regexp_extract_all(c, F.lit(rf"(?<!{word})(?:{words})(?!{word})|{word}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in cased.items() for x in kv])
    return F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")
