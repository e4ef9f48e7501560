"""Scores of one value against another, as Column expressions."""

from fieldloom.functions.compare import exact_match, field_faithfulness, presence, type_match
from fieldloom.functions.dates import date_distance_score
from fieldloom.functions.fuzzy import fuzzy, levenshtein
from fieldloom.functions.numbers import exponential_numeric_score, numeric, numeric_closeness, parse_number
from fieldloom.functions.strings import character_f1, plain, regex_match, strip, token_f1
from fieldloom.functions.urls import url_match

__all__ = [
    "character_f1", "date_distance_score", "exact_match", "exponential_numeric_score", "field_faithfulness", "fuzzy", "levenshtein", "numeric",
    "numeric_closeness", "parse_number", "plain", "presence", "regex_match", "strip", "token_f1", "type_match", "url_match",
]
