"""Scalar text functions as Columns. Absent values are empty strings, as on ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v


def some(value: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def filled(*values: Column) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in values], F.lit(""))


def strip(value: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.btrim(value, F.lit(v.BLANK_CHARS))


def without(value: Column, words: list[str]) -> Column:
    """All occurrences of each word taken out, word after word."""
    return reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), words, value)


def before(value: Column, stops: list[str]) -> Column:
    """What stands before the first stop word, stop after stop."""
    return reduce(lambda x, w: F.substring_index(x, w, 1), stops, value)


def has_any(value: Column, words: list[str]) -> Column:
    """Whether any of the words occurs."""
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in words])


def hits(value: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    return reduce(lambda a, b: a + b, [F.contains(value, F.lit(w)).cast("int") for w in words])


def first_word(value: Column, words: list[str]) -> Column:
    """The first word of the list that occurs, else empty (find_key)."""
    return F.coalesce(*[F.when(F.contains(value, F.lit(w)), F.lit(w)) for w in words], F.lit(""))


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(value, F.lit(p)) for p in prefixes])


def squeezed(value: Column) -> Column:
    """Without spaces and line ends."""
    return F.translate(some(value), " \n", "")


def digits_fixed(value: Column) -> Column:
    """O, I and S as the digits that they are misread for."""
    return F.translate(value, "OIS", "015")


def stripped_code(code: Column) -> Column:
    """Digits fixed, blanks at the ends taken off."""
    return strip(digits_fixed(code))


def plain_code(code: Column) -> Column:
    """Upper case, digits fixed, only A-Z, 0-9 and dashes left."""
    return F.regexp_replace(digits_fixed(F.upper(code)), "[^A-Z0-9-]", "")


def power_code(code: Column, fixed: bool = False) -> Column:
    """Upper case, digits fixed; a leading 5513 becomes C13, or C513 with `fixed`."""
    c = digits_fixed(F.upper(code))
    return F.when(F.startswith(c, F.lit("5513")), F.concat(F.lit("C"), F.substring(c, 2 if fixed else 3, 1 << 30))).otherwise(c)


def merged_text(value: Column) -> Column:
    """Full-width O as 0, I as 1, stripped."""
    return strip(F.translate(value, "ＯI", "01"))


def report_name(value: Column) -> Column:
    """A name without labels, colons, commas, stops and spaces at the ends."""
    return F.btrim(without(value, v.LABEL_NOISE), F.lit(v.NAME_EDGES + " "))


def area_name(value: Column) -> Column:
    """A name found by position."""
    return F.btrim(without(F.translate(value, " \n", ""), v.NAME_LABELS), F.lit(v.NAME_EDGES))


def area_code(value: Column) -> Column:
    """A code found by position: letters, digits, # and dashes."""
    return F.regexp_replace(value, r"[^A-Za-z0-9#\-]", "")


def phrase_name(value: Column) -> Column:
    """A name without phrases of the form, up to the first stop word."""
    return F.btrim(F.replace(before(without(value, v.PHRASE_NOISE), v.PHRASE_STOPS), F.lit("："), F.lit(":")), F.lit(" ：:，。,. "))


def lite_text(value: Column) -> Column:
    """Up to the first stop word, without colons."""
    return strip(F.translate(before(value, v.LINE_STOPS), v.COLONS, ""))


def region_name(value: Column) -> Column:
    """Without name labels, up to the first stop word, without colons."""
    return strip(F.translate(before(without(value, v.NAME_LABELS), v.NAME_STOPS), v.COLONS, ""))


def safe_name(value: Column) -> Column:
    """Without characters that file names mustn't hold."""
    return strip(F.translate(value, v.FILE_CHARS, ""))


def name_then_code(name: Column, code: Column, ext: Column) -> Column:
    """File name of a renamed report."""
    return F.concat(safe_name(name), safe_name(code), ext)


def code_then_name(name: Column, code: Column) -> Column:
    """File name in the other order, without an extension."""
    return F.concat(safe_name(code), safe_name(name))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """From the last dot on, if something stands on both sides of it."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """The base name without its suffix."""
    return F.substring(base_name(path), F.lit(1), F.length(base_name(path)) - F.length(suffix(path)))


def longest(values: Column) -> Column:
    """The longest text, the first of equals; empty if there is none."""
    ranks = F.transform(values, lambda x, i: F.struct(F.length(x).alias("l"), (-i).alias("i"), x.alias("v")))
    return F.coalesce(F.array_max(ranks)["v"], F.lit(""))
