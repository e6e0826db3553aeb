"""Scores of names and codes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from . import vocab as v


def _if(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def code_score(code: Column, text: Column | None = None) -> Column:
    """20 each for length 6, four digits in a row and a letter, 40 if it occurs in the text; 0 for none."""
    score = _if(F.length(code) >= 6, 20) + _if(F.rlike(code, F.lit(r"\p{Nd}{4}")), 20) + _if(F.rlike(code, F.lit("[A-Za-z]")), 20)
    return F.when(code == "", 0).otherwise(score + _if(F.contains(text if text is not None else F.lit(""), code), 40))


def name_score(name: Column) -> Column:
    """30 for more than 8 characters, 10 for each work word."""
    return F.when(name == "", 0).otherwise(F.least(_if(F.length(name) > 8, 30) + 10 * t.hits(name, v.WORK_WORDS), F.lit(100)))


def result_score(name: Column, code: Column) -> Column:
    """50 for a name, 40 for a code, 10 for a name of more than 8 characters."""
    return F.least(_if(name != "", 50) + _if(code != "", 40) + _if(F.length(name) > 8, 10), F.lit(100))


def code_confidence(code: Column) -> Column:
    """50 for a known prefix, 20 for four digits in a row, 20 for 5 to 20 characters."""
    return _if(t.starts_with_any(code, v.CODE_PREFIXES), 50) + _if(F.rlike(code, F.lit(r"\p{Nd}{4}")), 20) + _if(F.length(code).between(5, 20), 20)


def is_power_code(code: Column) -> Column:
    """Whether the plain code has a known prefix."""
    return t.starts_with_any(t.plain_code(code), v.CODE_PREFIXES)


def valid_power_code(code: Column) -> Column:
    """Whether the code as it is has a known prefix."""
    return t.starts_with_any(code, v.CODE_PREFIXES)


def candidate_score(clean: Column) -> Column:
    """Length and 20 for each work word."""
    return F.length(clean) + 20 * t.hits(clean, v.WORK_WORDS)


def percent(current: Column, total: Column) -> Column:
    """Whole percent done, cut off; 0 of nothing."""
    return F.when(total == 0, 0).otherwise((current / total * 100).cast("int"))


def should_retry(count: Column, times: int = 2) -> Column:
    return count < times
