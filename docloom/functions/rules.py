"""Fields of a whole text by ordered patterns, as Columns. The first pattern that matches decides, even if its value cleans to nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from . import vocab as v


def _first_match(text: Column, patterns: list[str], clean) -> Column:
    out = None
    for p in patterns:
        value = clean(F.regexp_extract(text, p, 1))
        out = F.when(F.rlike(text, F.lit(p)), value) if out is None else out.when(F.rlike(text, F.lit(p)), value)
    return out.otherwise(F.lit(""))


def open_report_name(text: Column) -> Column:
    return _first_match(text, v.OPEN_PATTERNS, t.report_name)


def completion_name(text: Column, fixed: bool = False) -> Column:
    """Name after its label; with `fixed`, the text's end closes it too and a code label never is one."""
    if not fixed:
        return _first_match(text, v.COMPLETION_PATTERNS, t.report_name)
    patterns = [rf"{label}[：:]?((?:(?!工程编号|项目编号|编号|建设单位|施工单位)[^\n])+)" for label in v.NAME_LABELS]
    return _first_match(text, patterns, t.report_name)


def project_name(text: Column, fixed: bool = False) -> Column:
    return t.filled(completion_name(text, fixed), open_report_name(text))


def project_code(text: Column, fixed: bool = False) -> Column:
    """Code after its label, which no colon may separate unless `fixed`."""
    patterns = [p.replace("([", "[：:]?([", 1) for p in v.CODE_PATTERNS] if fixed else v.CODE_PATTERNS
    return _first_match(text, patterns, lambda c: F.regexp_replace(c, r"[^A-Za-z0-9\-]", ""))


def report_fields(text: Column, fixed: bool = False) -> Column:
    """Struct of project_name and project_code."""
    flat = t.squeezed(text)
    return F.struct(project_name(flat, fixed).alias("project_name"), project_code(flat, fixed).alias("project_code"))


def has_result(name: Column) -> Column:
    """Whether an extraction counts: it has a name."""
    return t.some(name) != ""


def report_type(code: Column, text: Column) -> Column:
    """finish, start or empty; `text` still has its line ends."""
    return F.when(code != "", "finish").when(t.has_any(text, v.START_PHRASES), "start").otherwise("")


def after_key(text: Column, keys: list[str]) -> Column:
    """What follows the first key whose cleaned value isn't empty."""
    return t.filled(*[t.phrase_name(F.regexp_extract(text, rf"{k}[：:]?[{v.BLANKS}]*([^\n]+)", 1)) for k in keys])


def engineering_code(text: Column) -> Column:
    """Longest of the value after a code key and all runs of six letters or digits."""
    value = after_key(text, v.CODE_LABELS)
    found = F.concat(F.filter(F.array(value), lambda x: x != ""), F.regexp_extract_all(text, F.lit(v.LONG_CODE), F.lit(0)))
    return t.longest(F.filter(F.transform(found, lambda x: F.translate(x, "OI", "01")), lambda x: F.length(x) >= 6))


def sentence_name(text: Column) -> Column:
    """The work named in a sentence of completion."""
    return t.phrase_name(F.regexp_extract(text, v.SENTENCE_PATTERN, 1))


def engineering_fields(text: Column) -> Column:
    """Struct of project_name and project_code by keys, then by sentence."""
    return F.struct(t.filled(after_key(text, v.NAME_KEYS), sentence_name(text)).alias("project_name"), engineering_code(text).alias("project_code"))


def serial_codes(text: Column) -> Column:
    """All codes of the two serial patterns, one pattern after the other, digits fixed."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in v.SERIAL_PATTERNS])
    return F.transform(found, t.digits_fixed)


def has_field(text: Column, field: str) -> Column:
    return t.has_any(text, v.PAGE_WORDS[field])


def is_report_page(text: Column) -> Column:
    return has_field(text, "project_name") | has_field(text, "project_code")


def template(text: Column) -> Column:
    """startup or completion by keyword hits; ties are startup."""
    return F.when(t.hits(text, v.TEMPLATE_WORDS["completion"]) > t.hits(text, v.TEMPLATE_WORDS["startup"]), "completion").otherwise("startup")
