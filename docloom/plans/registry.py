"""All queries over the driver's tables, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import pipeline
from ..functions import rules, scoring
from ..functions import text as t
from ..functions import vocab as v
from ..operators import geometry, lines, merge, naming, ranks, report
from ..sources import images, tokens
from . import fixtures
from . import oracles as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, relation: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """Register a query over one derived relation; its SQL sees that relation as `r`."""
    QUERIES[name] = lambda spark, sf_dir: build(fixtures.relation(spark, sf_dir, relation))
    if sql is not None:
        ORACLE_SQL[name] = f"WITH r AS ({fixtures.duck(relation)}) {sql}" if not sql.lstrip().startswith(",") else f"WITH r AS ({fixtures.duck(relation)}){sql}"


def _columns(name: str, relation: str, keys: list[str], columns: dict[str, tuple]) -> None:
    """A projection: each output as a Column (made when the query is, as it needs a session) and as SQL."""
    _add(name, relation, lambda r: r.select(*keys, *[c().alias(n) for n, (c, _) in columns.items()]), f"SELECT {', '.join([*keys, *[f'{s} AS {n}' for n, (_, s) in columns.items()]])} FROM r")


def text() -> Column:
    return F.col("text")


def flat() -> Column:
    return t.squeezed("text")


def name() -> Column:
    return F.col("project_name")


def code() -> Column:
    return F.col("project_code")


def fields() -> Column:
    return rules.report_fields(text())


def engineering() -> Column:
    return rules.engineering_fields(text())


# Whole texts
_columns("clean_text", "report_text", ["doc_id"], {"cleaned": (lambda: flat(), o.FLAT)})
_columns("parse_report_text", "report_text", ["doc_id"], {"project_name": (lambda: fields()["project_name"], o.REPORT_NAME), "project_code": (lambda: fields()["project_code"], o.REPORT_CODE)})
_columns("open_report_name", "report_text", ["doc_id"], {"name": (lambda: rules.open_report_name(flat()), o.OPEN_NAME)})
_columns("completion_name", "report_text", ["doc_id"], {"name": (lambda: rules.completion_name(flat()), o.COMPLETION_NAME)})
_columns("project_code", "report_text", ["doc_id"], {"code": (lambda: rules.project_code(flat()), o.REPORT_CODE)})
_columns("report_type", "report_text", ["doc_id"], {"report_type": (lambda: rules.report_type(fields()["project_code"], text()), o.REPORT_TYPE)})
_columns("engineering_text", "report_text", ["doc_id"], {"project_name": (lambda: engineering()["project_name"], o.ENGINEERING_NAME), "project_code": (lambda: engineering()["project_code"], o.ENGINEERING_CODE)})
_columns("sentence_name", "report_text", ["doc_id"], {"name": (lambda: rules.sentence_name(text()), o.SENTENCE_NAME)})
_columns("extract_codes", "report_text", ["doc_id"], {"codes": (lambda: F.array_join(rules.serial_codes(text()), ","), o.SERIAL_CODES), "n_codes": (lambda: F.size(rules.serial_codes(text())).cast("long"), o.SERIAL_COUNT)})
_columns("best_code", "report_text", ["doc_id"], {"code": (lambda: t.longest(rules.serial_codes(text())), o.BEST_CODE)})
_columns("detect_template", "report_text", ["doc_id"], {"template": (lambda: rules.template(text()), o.TEMPLATE)})
_columns("is_report_page", "report_text", ["doc_id"], {"is_page": (lambda: rules.is_report_page(text()), o.any_of("text", v.PAGE_WORDS["project_name"] + v.PAGE_WORDS["project_code"]))})
_columns("find_key", "report_text", ["doc_id"], {"name_key": (lambda: t.first_word(text(), v.NAME_KEYS), o.first_of("text", v.NAME_KEYS)), "code_key": (lambda: t.first_word(text(), v.CODE_LABELS), o.first_of("text", v.CODE_LABELS))})
_columns("find_field", "report_text", ["doc_id"], {"has_name": (lambda: rules.has_field(text(), "project_name"), o.any_of("text", v.PAGE_WORDS["project_name"])), "has_code": (lambda: rules.has_field(text(), "project_code"), o.any_of("text", v.PAGE_WORDS["project_code"]))})
_columns("check_result", "report_text", ["doc_id"], {"valid": (lambda: rules.has_result(fields()["project_name"]), f"({o.REPORT_NAME}) <> ''")})
_columns("clean_project_name", "report_text", ["doc_id"], {"name": (lambda: t.phrase_name(text()), o.phrase("text"))})
_columns("clean_lite_text", "report_text", ["doc_id"], {"cleaned": (lambda: t.lite_text(text()), o.lite("text"))})
_columns("clean_region_name", "report_text", ["doc_id"], {"name": (lambda: t.region_name(text()), o.region_name("text"))})

# Candidates: names and codes
_columns("fix_power_code", "candidates", ["seq"], {"code": (lambda: t.power_code(code()), o.POWER_CODE)})
_columns("normalize_codes", "candidates", ["seq"], {"digits": (lambda: t.digits_fixed(code()), o.digits("project_code")), "plain": (lambda: t.plain_code(code()), o.PLAIN_CODE), "merged": (lambda: t.merged_text(code()), o.strip("translate(project_code, 'ＯI', '01')")), "stripped": (lambda: t.stripped_code(code()), o.strip(o.digits("project_code")))})
_columns("code_confidence", "candidates", ["seq"], {"score": (lambda: scoring.code_confidence(t.power_code(code())), o.CONFIDENCE)})
_columns("code_score", "candidates", ["seq"], {"score": (lambda: scoring.code_score(code(), F.concat(name(), code())), o.CODE_SCORE), "alone": (lambda: scoring.code_score(code()), o.CODE_SCORE_ALONE)})
_columns("name_score", "report_text", ["doc_id"], {"score": (lambda: scoring.name_score(text()), o.name_score("text"))})
_columns("result_score", "candidates", ["seq"], {"score": (lambda: scoring.result_score(name(), code()), o.RESULT_SCORE)})
_columns("power_code_filter", "candidates", ["seq"], {"normal": (lambda: scoring.is_power_code(code()), o.starts(o.PLAIN_CODE)), "valid": (lambda: scoring.valid_power_code(code()), o.starts("project_code"))})
_columns("build_filename", "candidates", ["seq"], {"filename": (lambda: t.name_then_code(name(), code(), F.lit(".jpg")), f"concat({o.safe('project_name')}, {o.safe('project_code')}, '.jpg')")})
_columns("build_filename_code_first", "candidates", ["seq"], {"filename": (lambda: t.code_then_name(name(), code()), f"concat({o.safe('project_code')}, {o.safe('project_name')})")})
_columns("safe_name", "candidates", ["seq"], {"safe": (lambda: t.safe_name(F.concat(F.lit(' a<b>:"'), name(), F.lit("/\\|?* "))), o.safe("""concat(' a<b>:"', project_name, '/\\|?* ')"""))})
_columns("should_retry", "candidates", ["seq"], {"again": (lambda: scoring.should_retry(F.col("seq") % 4), "seq % 4 < 2")})
_columns("progress_percent", "candidates", ["seq"], {"percent": (lambda: scoring.percent(F.col("seq") % 7, F.col("seq") % 9), "CASE WHEN seq % 9 = 0 THEN 0 ELSE CAST(trunc((seq % 7) / (seq % 9) * 100) AS INTEGER) END")})
_add("choose_name", "candidates", merge.chosen_name, o.CHOOSE_NAME)
_add("choose_work_name", "report_text", lambda r: merge.chosen_name(r.select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("seq"), text().alias("project_name"))), o.CHOOSE_WORK_NAME)
_add("merge_results", "candidates", merge.merged_results, o.MERGE_RESULTS)
_add("dedupe_names", "candidates", lambda r: naming.deduplicated(r.select("seq", F.concat(t.safe_name(name()), F.lit(".jpg")).alias("filename"))), o.DEDUPE)
_add("duplicate_suffix", "candidates", lambda r: naming.deduplicated(r.select("seq", t.safe_name(name()).alias("filename")), whole=True), o.DUPLICATE_SUFFIX)

# Files
_columns("file_type", "input_files", ["seq"], {"kind": (lambda: images.kind(F.col("path")), o.KIND)})
_columns("path_parts", "input_files", ["seq"], {"base": (lambda: t.base_name(F.col("path")), o.BASE), "suffix": (lambda: t.suffix(F.col("path")), o.SUFFIX), "stem": (lambda: t.stem(F.col("path")), o.STEM)})
_add("image_scan_filter", "input_files", lambda r: r.where(images.is_image(F.col("path"))), f"SELECT seq, path FROM r WHERE lower({o.SUFFIX}) IN ({o.listed(v.IMAGE_SUFFIXES)})")
_add("image_scan_narrow", "input_files", lambda r: r.where(images.is_image(F.col("path"), v.NARROW_SUFFIXES)), f"SELECT seq, path FROM r WHERE lower({o.SUFFIX}) IN ({o.listed(v.NARROW_SUFFIXES)})")
_add("input_union", "input_files", lambda r: r.unionByName(r.where(images.is_image(F.col("path")))), f"SELECT seq, path FROM r UNION ALL SELECT seq, path FROM r WHERE lower({o.SUFFIX}) IN ({o.listed(v.IMAGE_SUFFIXES)})")
_add("input_count", "input_files", lambda r: r.agg(F.count(F.lit(1)).alias("n_files")), "SELECT count(*) AS n_files FROM r")
_add("waiting_status", "input_files", lambda r: report.waiting(r), "SELECT seq, path, '等待OCR' AS status FROM r")

# Tokens
_add("tsv_token_filter", "ocr_tokens", lambda r: geometry.kept_tokens(r).select("doc_id", "in_pos", "text"), "SELECT doc_id, in_pos, text FROM r WHERE trim(text) <> '' AND conf <> '-1'")
_add("token_text", "ocr_tokens", geometry.token_text, "SELECT doc_id, string_agg(text, chr(10) ORDER BY in_pos) AS raw_text FROM r GROUP BY doc_id")
_add("token_order", "ocr_tokens", lambda r: r.select("doc_id", "in_pos", F.row_number().over(geometry.reading_order()).alias("pos")), "SELECT doc_id, in_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, x, in_pos) AS INTEGER) AS pos FROM r")
_add("field_region_name", "ocr_tokens", lambda r: geometry.field_text(r, "project_name"), o.located("project_name"))
_add("field_region_code", "ocr_tokens", lambda r: geometry.field_text(r, "project_code"), o.located("project_code"))
_add("field_region_values", "ocr_tokens", lambda r: geometry.located(r, "project_name"), o.located_rows("project_name"))
_add("nearby_value", "ocr_tokens", lambda r: geometry.nearby_value(r, "工程名称"), o.NEARBY)
_add("merge_region_text", "ocr_tokens", lambda r: merge.extracted(geometry.kept_tokens(r)), o.EXTRACTED)



def _tsv_files(r: DataFrame) -> DataFrame:
    """path, content: a TSV file per document."""
    line = F.concat_ws("\t", "text", "conf", "x", "y", "w", "h")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("in_pos", line.alias("line")))), lambda t_: t_["line"]), "\n")
    return r.groupBy(F.col("doc_id").cast("string").alias("path")).agg(F.encode(F.concat(F.lit("text\tconf\tleft\ttop\twidth\theight\n"), body), "UTF-8").alias("content"))


def _read(path: str, content: bytes) -> list[tuple]:
    """A recogniser of images that are token files."""
    return tokens.parsed_tsv(content.decode())


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An archive of two members per file: the file itself and a note."""
    for batch in batches:
        out = []
        for seq, path in zip(batch["seq"], batch["path"], strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(path.lstrip("/"), path)
                z.writestr("note.txt", str(seq))
            out.append((f"{seq}.zip", held.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def _members(r: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Members of one archive per file."""
    found = images.members(r.select("seq", "path").mapInPandas(_zipped, "path string, content binary"), suffixes)
    return found.select("path", "member", F.decode("content", "UTF-8").alias("text"))


_add("image_run", "ocr_tokens", lambda r: pipeline.from_images(_tsv_files(r).withColumn("seq", F.col("path").cast("long")), _read), o.IMAGE_RUN)
_add("tsv_tokens", "ocr_tokens", lambda r: tokens.tsv_tokens(_tsv_files(r)), "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY in_pos) - 1 AS INTEGER) AS in_pos, text, conf, x, y, w, h FROM r WHERE trim(text) <> '' AND conf <> '-1'")
_MEMBERS = "SELECT concat(seq, '.zip') AS path, ltrim(path, '/') AS member, path AS text FROM r"
_add("archive_members", "input_files", _members, f"{_MEMBERS} UNION ALL SELECT concat(seq, '.zip'), 'note.txt', CAST(seq AS VARCHAR) FROM r")
_add("archive_images", "input_files", lambda r: _members(r, v.IMAGE_SUFFIXES), f"{_MEMBERS} WHERE lower({o.SUFFIX}) IN ({o.listed(v.IMAGE_SUFFIXES)})")
_add("recognised_tokens", "input_files", lambda r: tokens.recognised(r.select("path", F.encode("path", "UTF-8").alias("content")), _shout).select("path", "in_pos", "text", "error"), "SELECT path, CASE WHEN path LIKE '%.zip' THEN NULL ELSE CAST(0 AS INTEGER) END AS in_pos, CASE WHEN path LIKE '%.zip' THEN NULL ELSE upper(path) END AS text, CASE WHEN path LIKE '%.zip' THEN concat('no image: ', path) ELSE '' END AS error FROM r")

# Lines
_add("regions", "text_lines", lambda r: lines.regions(r).select("doc_id", "pos", "key_rank", F.array_join("region", "\n").alias("region")), o.REGIONS)
_add("region_text", "text_lines", lambda r: lines.region_text(lines.regions(r)), o.REGION_TEXT)
_add("field_value_next_line", "text_lines", lambda r: lines.next_line_value(r, v.CODE_LABELS, "value"), o.next_line(v.CODE_LABELS))
_add("report_lines", "text_lines", lines.report_lines, o.REPORT_LINES)
_add("merge_lines", "text_lines", lines.merged_lines, o.MERGE_LINES)
_add("window_code", "text_lines", lines.window_codes, o.WINDOW_CODE)
_add("table_fields", "text_lines", lines.table_fields, o.TABLE_FIELDS)


def _parsed(r: DataFrame) -> DataFrame:
    """Texts with their fields, which come out of a generator: it evaluates the patterns once however often they are used."""
    return r.select(F.col("doc_id").alias("seq"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), "text", F.lit("").alias("error"), F.inline(F.array(fields())))


def _shout(path: str, content: bytes) -> list[tuple]:
    """A recogniser that reads an image's bytes as its text and fails on archives."""
    if path.endswith(".zip"):
        raise ValueError(f"no image: {path}")
    return [(content.decode().upper(), "90", 0, 0, 0, 0)]


def _results(r: DataFrame) -> DataFrame:
    """Results of the text-only pipeline, as rename results with their targets."""
    return merge.rename_results(_parsed(r))


def _plan_beside(fields: DataFrame) -> DataFrame:
    """The rename plan into a folder where every name that the run would give is taken already."""
    taken = naming.planned(merge.rename_results(fields).where("status = 'success'")).select("filename").distinct()
    return pipeline.rename_plan(fields, "/out/", taken).select("seq", "project_name", "project_code", "status", "source", "target")


def _sheet(r: DataFrame, file_too: bool = True) -> DataFrame:
    """The listing of a whole run: names made unique among the successes."""
    rows = ranks.shared(_results(r), "seq")
    names = naming.deduplicated(naming.planned(rows.where("status = 'success'")).select("seq", "filename")).select(F.col("seq").alias("_s"), "target")
    rows = rows.join(names, F.col("seq") == F.col("_s"), "left").withColumn("source", F.when(F.col("status") == "success", F.col("path"))).withColumn("file", F.col("path"))
    return report.result_sheet(rows, file_too).toDF("seq", "source", "project_name", "project_code", "target", "status")


_add("status_report", "report_text", lambda r: report.status_report(_results(r)), o.STATUS)
_add("report_status", "report_text", lambda r: merge.rename_results(_parsed(r).withColumn("report_type", rules.report_type(code(), text())), "report_type").groupBy("report_type", "status").agg(F.count(F.lit(1)).alias("n"), F.max(t.name_then_code(name(), code(), F.lit(".jpg"))).alias("last_filename")), o.REPORT_STATUS)
_add("rename_results", "report_text", _results, o.RENAME)
_add("result_sheet", "report_text", _sheet, o.SHEET)
_add("rename_sheet", "report_text", lambda r: _sheet(r, file_too=False), o.RENAME_SHEET)
_add("rename_plan_existing", "report_text", lambda r: _plan_beside(pipeline.from_texts(r.select(F.col("doc_id").alias("seq"), F.lit("/in/a.jpg").alias("path"), "text"))), o.RENAME_BESIDE)
_add("error_struct", "report_text", lambda r: _results(r).select("seq", report.error(F.when(F.col("status") != "success", F.col("path")), F.nullif("message", F.lit(""))).alias("e")).select("seq", "e.file", "e.reason"), f"{o.RESULTS} SELECT doc_id AS seq, CASE WHEN status <> 'success' THEN concat('/in/', doc_id, '.jpg') ELSE '' END AS file, '' AS reason FROM s")
_add("error_records", "report_text", lambda r: report.error_records(_results(r.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(text()))).withColumn("source", F.col("path")).withColumn("file", F.col("path"))), o.ERRORS)
