"""Text: normalised equality and overlap of words or characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.compare import absent_rule, flag

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def plain(x: Column, pattern: str = r"\s+", repl: str = " ", lower: bool = True, strip_ends: bool = True) -> Column:
    """The text once the pattern is replaced. Groups of ``repl`` are written as in Python."""
    java = re.sub(r"\\(\d)", r"$\1", repl.replace("$", r"\$"))
    x = F.lower(x) if lower else x
    if strip_ends and pattern == r"\s+" and repl == " ":  # runs of white space at the ends are single spaces then
        return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    x = strip(x) if strip_ends else x
    x = F.regexp_replace(x, F.lit("(?U)" + pattern), F.lit(java))
    return strip(x) if strip_ends else x


def regex_match(a: Column, e: Column, pattern: str = r"\s+", repl: str = " ", lower: bool = True, strip_ends: bool = True) -> Column:
    """1 if the texts agree once the pattern is replaced: see ``plain``."""
    form = lambda x: plain(x, pattern, repl, lower, strip_ends)
    return absent_rule(a, e, flag(form(a) == form(e)))


def _overlap_f1(a: Column, e: Column) -> Column:
    """F1 of two arrays as multisets; two empty ones agree."""
    shared = F.aggregate(F.array_intersect(a, e), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(e, lambda x: x == t))))
    return F.when((F.size(a) == 0) & (F.size(e) == 0), 1.0).otherwise(F.try_divide(2.0 * shared, F.size(a) + F.size(e)))


def token_f1(a: Column, e: Column, ignore_case: bool = True, ignore_punctuation: bool = True, ignore_articles: bool = True) -> Column:
    def tokens(x: Column) -> Column:
        x = F.lower(x) if ignore_case else x
        x = F.translate(x, PUNCTUATION, "") if ignore_punctuation else x
        x = F.regexp_replace(x, r"(?iU)\b(a|an|the)\b", " ") if ignore_articles else x
        return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")

    return absent_rule(a, e, _overlap_f1(tokens(a), tokens(e)))


def character_f1(a: Column, e: Column, ignore_case: bool = True, ignore_whitespace: bool = True, ignore_punctuation: bool = True) -> Column:
    def characters(x: Column) -> Column:
        x = F.lower(x) if ignore_case else x
        x = F.regexp_replace(x, r"(?U)\s+", "") if ignore_whitespace else x
        x = F.translate(x, PUNCTUATION, "") if ignore_punctuation else x
        return F.filter(F.split(x, ""), lambda t: t != "")

    return absent_rule(a, e, _overlap_f1(characters(a), characters(e)))
