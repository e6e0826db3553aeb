"""Relations derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPORT_TEXT = """
SELECT o_orderkey AS doc_id,
  CASE o_orderstatus
    WHEN 'F' THEN concat('工程名称', chr(10), '示范', cast(o_custkey AS string), '线#0', cast(o_orderkey % 40 AS string), '改造工程', chr(10),
                         '工程编号', chr(10), 'B113', cast(o_orderkey AS string), '-', cast(o_custkey % 20 AS string), chr(10), '施工单位')
    WHEN 'O' THEN concat('我方完成示范', cast(o_custkey AS string), '线路大修工程项目开工前各项准备工作')
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN concat('工程名称', chr(10), '工程编号', chr(10), 'C513', cast(o_orderkey AS string))
         ELSE concat('项目名称：示范', cast(o_custkey AS string), '迁改', chr(10), '编号：GD', cast(o_orderkey AS string)) END
  END AS text
FROM {orders}"""

OCR_TOKENS = """
SELECT doc_id, cast(in_pos AS int) AS in_pos, cast(100 + (l_partkey * 37) % 400 AS int) AS x, cast(l_linenumber * 50 AS int) AS y, 40 AS w, 20 AS h,
  CASE WHEN l_suppkey % 10 = 0 THEN '-1' ELSE '90' END AS conf,
  CASE (l_partkey + l_linenumber) % 8
    WHEN 0 THEN '工程名称' WHEN 1 THEN '工程编号' WHEN 2 THEN '施工单位' WHEN 3 THEN '编号'
    WHEN 4 THEN concat('B113', cast(l_partkey AS string)) WHEN 5 THEN concat('示范', cast(l_partkey % 100 AS string), '线') WHEN 6 THEN '改造工程'
    ELSE concat('#', cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) END AS text
FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS in_pos
      FROM {lineitem}) t"""

_LINE = """doc_id, cast(pos AS bigint) AS pos,
  CASE WHEN pos % 5 = 1 THEN concat('项目名称：', line) WHEN pos % 5 = 2 THEN '工程编号：' ELSE line END AS line"""
TEXT_LINES = f"SELECT {_LINE} FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {{documents}}) t"
TEXT_LINES_DUCK = f"""SELECT {_LINE} FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {{documents}})) t"""

INPUT_FILES = """
SELECT doc_id AS seq, concat('/in/', source, '/', cast(doc_id AS string),
  CASE doc_id % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png'
    WHEN 4 THEN '.bmp' WHEN 5 THEN '.tif' WHEN 6 THEN '.zip' ELSE '.txt' END) AS path
FROM {documents}"""

CANDIDATES = """
SELECT p_brand AS doc_id, p_partkey AS seq, p_name AS project_name,
  CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN concat('B113', cast(p_partkey AS string)) WHEN 2 THEN concat('c513', p_type, cast(p_size * 1000 AS string))
    WHEN 3 THEN concat('181320', cast(p_partkey AS string), '-', cast(p_size AS string)) WHEN 4 THEN concat('5Z ', p_brand, 'OI') WHEN 5 THEN concat('B', cast(p_size AS string))
    ELSE concat('5513', p_type, 'OIS', cast(p_size AS string)) END AS project_code
FROM {part}"""

SPARK = {"report_text": (REPORT_TEXT, "orders"), "ocr_tokens": (OCR_TOKENS, "lineitem"), "text_lines": (TEXT_LINES, "documents"), "input_files": (INPUT_FILES, "documents"), "candidates": (CANDIDATES, "part")}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of a data folder."""
    sql, table = SPARK[name]
    return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(name: str) -> str:
    """The same relation in DuckDB's SQL over its views."""
    sql, table = SPARK[name]
    return (TEXT_LINES_DUCK if name == "text_lines" else sql).replace("{" + table + "}", table)
