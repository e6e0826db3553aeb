"""DuckDB SQL of the queries. It shares word lists and patterns with the library, and nothing else."""

from __future__ import annotations

from functools import reduce

from ..functions import vocab as v


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(map(q, words))


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{v.BLANKS}]+|[{v.BLANKS}]+$')}, '', 'g')"


def without(x: str, words: list[str]) -> str:
    return reduce(lambda a, w: f"replace({a}, {q(w)}, '')", words, x)


def before(x: str, stops: list[str]) -> str:
    return reduce(lambda a, w: f"string_split({a}, {q(w)})[1]", stops, x)


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def count_of(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INTEGER)" for w in words) + ")"


def first_of(x: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(w)}" for w in words) + " ELSE '' END"


def digits(x: str) -> str:
    return f"replace(replace(replace({x}, 'O', '0'), 'I', '1'), 'S', '5')"


def safe(x: str) -> str:
    return strip(without(x, list(v.FILE_CHARS)))


def starts(x: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in v.CODE_PREFIXES) + ")"


def phrase(x: str) -> str:
    return f"trim(replace({before(without(x, v.PHRASE_NOISE), v.PHRASE_STOPS)}, '：', ':'), ' ：:，。,. ')"


def lite(x: str) -> str:
    return strip(without(before(x, v.LINE_STOPS), list(v.COLONS)))


def region_name(x: str) -> str:
    return strip(without(before(without(x, v.NAME_LABELS), v.NAME_STOPS), list(v.COLONS)))


def _matched(x: str, patterns: list[str], clean) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {clean(f'regexp_extract({x}, {q(p)}, 1)')}" for p in patterns) + " ELSE '' END"


def _report_name(x: str) -> str:
    return f"trim({without(x, v.LABEL_NOISE)}, {q(v.NAME_EDGES + ' ')})"


def _filled(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in values) + ", '')"


def longest(x: str) -> str:
    return f"coalesce(list_max(list_transform({x}, lambda e, i: {{'l': length(e), 'i': -i, 'v': e}}))['v'], '')"


FLAT = "replace(replace(text, ' ', ''), chr(10), '')"
OPEN_NAME = _matched(FLAT, v.OPEN_PATTERNS, _report_name)
COMPLETION_NAME = _matched(FLAT, v.COMPLETION_PATTERNS, _report_name)
REPORT_NAME = _filled(COMPLETION_NAME, OPEN_NAME)
REPORT_CODE = _matched(FLAT, v.CODE_PATTERNS, lambda c: f"replace({c}, '_', '')")
REPORT_TYPE = f"CASE WHEN ({REPORT_CODE}) <> '' THEN 'finish' WHEN {any_of('text', v.START_PHRASES)} THEN 'start' ELSE '' END"


def _after_key(x: str, keys: list[str]) -> str:
    return _filled(*[phrase(f"regexp_extract({x}, {q(f'{k}[：:]?[{v.BLANKS}]*([^\\n]+)')}, 1)") for k in keys])


SENTENCE_NAME = phrase(f"regexp_extract(text, {q(v.SENTENCE_PATTERN)}, 1)")
ENGINEERING_NAME = _filled(_after_key("text", v.NAME_KEYS), SENTENCE_NAME)
_CODES = f"list_concat(list_filter([{_after_key('text', v.CODE_LABELS)}], lambda c: c <> ''), regexp_extract_all(text, {q(v.LONG_CODE)}))"
ENGINEERING_CODE = longest(f"list_filter(list_transform({_CODES}, lambda c: replace(replace(c, 'O', '0'), 'I', '1')), lambda c: length(c) >= 6)")
_SERIAL = "list_transform(list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)})" for p in v.SERIAL_PATTERNS) + f"), lambda c: {digits('c')})"
SERIAL_CODES = f"array_to_string({_SERIAL}, ',')"
SERIAL_COUNT = f"CAST(len({_SERIAL}) AS BIGINT)"
BEST_CODE = longest(_SERIAL)
TEMPLATE = f"CASE WHEN {count_of('text', v.TEMPLATE_WORDS['completion'])} > {count_of('text', v.TEMPLATE_WORDS['startup'])} THEN 'completion' ELSE 'startup' END"


def power(x: str) -> str:
    c = digits(f"upper({x})")
    return f"CASE WHEN starts_with({c}, '5513') THEN concat('C', substr({c}, 3)) ELSE {c} END"


POWER_CODE = power("project_code")
PLAIN_CODE = f"regexp_replace({digits('upper(project_code)')}, '[^A-Z0-9-]', '', 'g')"


def _points(*parts: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for test, n in parts) + ")"


_FOUR = r"'\p{Nd}{4}'"
CONFIDENCE = _points((starts(f"({POWER_CODE})"), 50), (f"regexp_matches({POWER_CODE}, {_FOUR})", 20), (f"length({POWER_CODE}) BETWEEN 5 AND 20", 20))
_CODE_POINTS = ("length(project_code) >= 6", 20), (f"regexp_matches(project_code, {_FOUR})", 20), ("regexp_matches(project_code, '[A-Za-z]')", 20)
CODE_SCORE = f"CASE WHEN project_code = '' THEN 0 ELSE {_points(*_CODE_POINTS, ('contains(concat(project_name, project_code), project_code)', 40))} END"
CODE_SCORE_ALONE = f"CASE WHEN project_code = '' THEN 0 ELSE {_points(*_CODE_POINTS)} END"


def name_score(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE least({_points((f'length({x}) > 8', 30))} + 10 * {count_of(x, v.WORK_WORDS)}, 100) END"


RESULT_SCORE = f"least({_points(('project_name <> ' + q(''), 50), ('project_code <> ' + q(''), 40), ('length(project_name) > 8', 10))}, 100)"
MERGE_RESULTS = "SELECT doc_id, " + ", ".join(strip(f"replace(replace(max_by({c}, row(length({c}), -seq)), 'Ｏ', '0'), 'I', '1')") + f" AS {c}" for c in ("project_name", "project_code")) + " FROM r GROUP BY doc_id"
_CHOOSE = "SELECT doc_id, max_by(name, row(length(name) + 20 * " + count_of("name", v.WORK_WORDS) + ", -seq)) AS name FROM ({}) GROUP BY doc_id"
CHOOSE_NAME = _CHOOSE.format(f"SELECT doc_id, seq, {region_name('project_name')} AS name FROM r")
CHOOSE_WORK_NAME = _CHOOSE.format(f"SELECT doc_id % 50 AS doc_id, doc_id AS seq, {region_name('text')} AS name FROM r")


def _numbered(stem: str, ext: str) -> str:
    k = f"row_number() OVER (PARTITION BY {stem} ORDER BY seq)"
    return f"SELECT seq, concat({stem}, {q(ext)}) AS filename, concat({stem}, CASE WHEN {k} = 1 THEN '' ELSE concat('_', CAST({k} AS VARCHAR)) END, {q(ext)}) AS target FROM r"


#: No name of these ends in _number, so no two families meet.
DEDUPE = _numbered(safe("project_name"), ".jpg")
DUPLICATE_SUFFIX = _numbered(safe("project_name"), "")

BASE = "regexp_extract(path, '([^/]*)$', 1)"
SUFFIX = r"regexp_extract(path, '[^/.](\.[^./]+)$', 1)"
STEM = f"left({BASE}, length({BASE}) - length({SUFFIX}))"
KIND = f"CASE WHEN path LIKE '%/' THEN 'folder' WHEN lower({SUFFIX}) = '.zip' THEN 'zip' WHEN lower({SUFFIX}) IN ({listed(v.IMAGE_SUFFIXES)}) THEN 'image' ELSE 'unsupported' END"


def located_rows(field: str, source: str = "r") -> str:
    """A self-join of tokens on the document, with the stop looked up for each anchor."""
    name = field == "project_name"
    left, below = (50, 260) if name else (30, 180)
    value = f"trim({without('t.text', [' ', chr(10), *v.NAME_LABELS])}, {q(v.NAME_EDGES)})" if name else r"regexp_replace(t.text, '[^A-Za-z0-9#\-]', '', 'g')"
    return f""", {source}p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, in_pos) AS pos FROM {source}),
{source}s AS (SELECT doc_id, pos FROM {source}p WHERE {any_of('text', v.AREA_STOPS)}),
{source}a AS (SELECT p.doc_id, p.x, p.y, p.pos, (SELECT min(s.pos) FROM {source}s s WHERE s.doc_id = p.doc_id AND s.pos > p.pos) AS stop FROM {source}p p WHERE {any_of('p.text', v.NAME_LABELS if name else v.CODE_LABELS)}),
{source}v AS (SELECT a.doc_id, a.pos AS anchor, t.pos AS pos, {value} AS value FROM {source}a a JOIN {source}p t ON t.doc_id = a.doc_id AND t.pos > a.pos AND t.pos < coalesce(a.stop, 2147483647)
  WHERE (t.x > a.x AND abs(t.y - a.y) <= 60) OR (t.x - a.x >= -{left} AND t.y > a.y AND t.y - a.y < {below}))
SELECT doc_id, CAST(anchor AS INTEGER) AS anchor, CAST(pos AS INTEGER) AS pos, value FROM {source}v WHERE value <> ''"""


def located(field: str) -> str:
    rows = located_rows(field)
    head, _, body = rows.rpartition("\nSELECT ")
    return f"""{head}, g AS (SELECT {body})
SELECT d.doc_id, coalesce(string_agg(g.value, '' ORDER BY g.anchor, g.pos), '') AS {field} FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""


NEARBY = """, k AS (SELECT doc_id, min(in_pos) AS kp FROM r WHERE contains(text, '工程名称') GROUP BY doc_id),
c AS (SELECT t.doc_id, t.text, t.x, t.in_pos FROM k JOIN r a ON a.doc_id = k.doc_id AND a.in_pos = k.kp JOIN r t ON t.doc_id = a.doc_id AND t.in_pos <> a.in_pos AND t.y = a.y AND abs(t.x - a.x) < 300)
SELECT d.doc_id, coalesce(max_by(c.text, row(c.x, c.in_pos)), '') AS value FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""


def _extracted() -> str:
    """By position, then by text, over kept tokens."""
    kept = ", k AS (SELECT * FROM r WHERE trim(text) <> '' AND conf <> '-1')"
    parts = []
    for field, tag in (("project_name", "n"), ("project_code", "c")):
        head, _, body = located_rows(field, "k").rpartition("\nSELECT ")
        for s in ("kp", "ks", "ka", "kv"):
            head, body = head.replace(f"{s} ", f"{s}{tag} "), body.replace(f"{s} ", f"{s}{tag} ")
        parts.append(f"{head}, g{tag} AS (SELECT doc_id, string_agg(value, '' ORDER BY anchor, pos) AS value FROM (SELECT {body}) GROUP BY doc_id)")
    return f"""{kept}{parts[0]}{parts[1]},
t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY in_pos) AS text FROM k GROUP BY doc_id),
f AS (SELECT t.doc_id, t.text, coalesce(nullif(gn.value, ''), {REPORT_NAME}) AS project_name, coalesce(nullif(gc.value, ''), {REPORT_CODE}) AS project_code
  FROM t LEFT JOIN gn ON gn.doc_id = t.doc_id LEFT JOIN gc ON gc.doc_id = t.doc_id)
SELECT doc_id, project_name, project_code, 'field_region' AS source, CASE WHEN project_code <> '' THEN 'finish' WHEN {any_of('text', v.START_PHRASES)} THEN 'start' ELSE '' END AS report_type, project_name <> '' AS valid, '' AS error FROM f"""


EXTRACTED = _extracted()

_WORDS = ", ".join(f"({i}, {q(w)})" for i, w in enumerate(v.REGION_WORDS))
_REGION_ROWS = f"""SELECT doc_id, pos, CAST(k.key_rank AS INTEGER) AS key_rank, array_to_string(a, chr(10)) AS region
FROM (SELECT *, list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS a FROM r) x JOIN (VALUES {_WORDS}) k(key_rank, word) ON contains(x.line, k.word)"""
REGIONS = _REGION_ROWS
REGION_TEXT = f"SELECT doc_id, string_agg(region, chr(10) ORDER BY pos, key_rank) AS text FROM ({_REGION_ROWS}) GROUP BY doc_id"


def _keyed(key: str) -> str:
    return strip(f"replace(replace(replace(line, {key}, ''), ':', ''), '：', '')")


def _next_line(keys: list[str]) -> str:
    words = ", ".join(f"({i}, {q(w)})" for i, w in enumerate(keys))
    return f"""SELECT d.doc_id, coalesce(min_by(h.value, row(h.pos, h.i)), '') AS value FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN (
SELECT doc_id, pos, k.i, coalesce(nullif({_keyed('k.w')}, ''), {strip('nxt')}) AS value
FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM r) x JOIN (VALUES {words}) k(i, w) ON contains(x.line, k.w)) h ON h.doc_id = d.doc_id AND h.value IS NOT NULL GROUP BY d.doc_id"""


def next_line(keys: list[str]) -> str:
    return _next_line(keys)




def _dashed(x: str) -> str:
    return f"regexp_extract_all({x}, {q(v.DASHED_CODE)})"


REPORT_LINES = f""", n AS ({_next_line(v.NAME_LABELS)}), c AS ({_next_line(v.CODE_LABELS)})
SELECT n.doc_id, {strip(before('n.value', v.LINE_STOPS))} AS project_name, {strip(digits(longest(_dashed('c.value'))))} AS project_code FROM n JOIN c ON c.doc_id = n.doc_id"""
MERGE_LINES = f"""SELECT doc_id, pos, CASE WHEN b IS NOT NULL AND length(a) < 25 AND NOT {any_of('b', v.JOIN_STOPPERS)} THEN concat(a, b) ELSE a END AS merged
FROM (SELECT doc_id, pos, {strip('line')} AS a, {strip('lead(line) OVER (PARTITION BY doc_id ORDER BY pos)')} AS b FROM r)"""
WINDOW_CODE = f"""SELECT doc_id, pos, {power('best')} AS code FROM (SELECT doc_id, pos, {longest(_dashed('area'))} AS best
FROM (SELECT doc_id, pos, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), ' ') AS area FROM r))"""


def _table_field(field: str) -> str:
    words = ", ".join(f"({i}, {q(w)})" for i, w in enumerate(v.PAIR_KEYS[field]))
    return f"(SELECT doc_id, max_by(value, row(pos, i)) AS value FROM (SELECT doc_id, pos, k.i, {_keyed('k.w')} AS value FROM r JOIN (VALUES {words}) k(i, w) ON contains(line, k.w)) WHERE value <> '' GROUP BY doc_id)"


TABLE_FIELDS = f"""SELECT d.doc_id, coalesce(n.value, '') AS project_name, coalesce(c.value, '') AS project_code FROM (SELECT DISTINCT doc_id FROM r) d
LEFT JOIN {_table_field('project_name')} n ON n.doc_id = d.doc_id LEFT JOIN {_table_field('project_code')} c ON c.doc_id = d.doc_id"""

RESULTS = f", f AS (SELECT doc_id, text, {REPORT_NAME} AS project_name, {REPORT_CODE} AS code FROM r), s AS (SELECT doc_id, text, code AS any_code, project_name, CASE WHEN project_name <> '' THEN code ELSE '' END AS project_code, CASE WHEN project_name <> '' THEN 'success' ELSE 'failed' END AS status FROM f)"
STATUS = f"{RESULTS} SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS failed FROM s"
_TYPE = f"CASE WHEN any_code <> '' THEN 'finish' WHEN {any_of('text', v.START_PHRASES)} THEN 'start' ELSE '' END"
REPORT_STATUS = f"{RESULTS} SELECT {_TYPE} AS report_type, status, count(*) AS n, max(concat({safe('project_name')}, {safe('project_code')}, '.jpg')) AS last_filename FROM s GROUP BY ALL"
RENAME = f"{RESULTS} SELECT doc_id AS seq, concat('/in/', doc_id, '.jpg') AS path, project_name, project_code, status, '' AS message FROM s"
_FILE = f"concat({safe('project_name')}, {safe('project_code')})"
SHEET = f"""{RESULTS}, u AS (SELECT doc_id, {_FILE} AS stem, row_number() OVER (PARTITION BY {_FILE} ORDER BY doc_id) AS k FROM s WHERE status = 'success')
SELECT s.doc_id AS seq, concat('/in/', s.doc_id, '.jpg') AS source, project_name, project_code, coalesce(concat(u.stem, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, CASE WHEN u.stem IS NOT NULL THEN '.jpg' END), '') AS target, status
FROM s LEFT JOIN u ON u.doc_id = s.doc_id"""
ERRORS = f"""SELECT concat('/in/', doc_id, '.jpg') AS file, '无法识别工程信息' AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {REPORT_NAME} END AS name FROM r) WHERE name = ''"""
#: Without the file, a failure has no source.
RENAME_SHEET = SHEET.replace("concat('/in/', s.doc_id, '.jpg') AS source", "CASE WHEN status = 'success' THEN concat('/in/', s.doc_id, '.jpg') ELSE '' END AS source")
#: Every first name is taken, so counting begins at 2.
RENAME_BESIDE = f"""{RESULTS}, u AS (SELECT doc_id, concat('/out/', {_FILE}, '_', row_number() OVER (PARTITION BY {_FILE} ORDER BY doc_id) + 1, '.jpg') AS target FROM s WHERE status = 'success')
SELECT s.doc_id AS seq, project_name, project_code, status, CASE WHEN status = 'success' THEN '/in/a.jpg' END AS source, u.target FROM s LEFT JOIN u ON u.doc_id = s.doc_id"""
_HEAD, _, _BODY = EXTRACTED.rpartition("\nSELECT ")
IMAGE_RUN = f"""{_HEAD}, e AS (SELECT {_BODY})
SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS path, coalesce(e.project_name, '') AS project_name, coalesce(e.project_code, '') AS project_code, coalesce(e.source, '') AS source,
  coalesce(e.report_type, '') AS report_type, coalesce(e.valid, false) AS valid, '' AS error FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN e ON e.doc_id = d.doc_id"""
