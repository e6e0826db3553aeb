"""Sinks: spreadsheets, archives, text files, and the renaming of files itself."""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocab as v

_TYPES = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>"""
_RELS = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>"""
_BOOK = """<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{}" sheetId="1" r:id="rId1"/></sheets></workbook>"""
#: A worksheet holds no more rows.
SHEET_ROWS = 1_048_576


def write_xlsx(rows: DataFrame, path: str, title: str = v.RESULT_SHEET, order: str = "seq") -> int:
    """Write all columns but `order` as one sheet with a heading, rows in that order; an existing file is replaced.

    Rows come to the driver partition by partition; more than a worksheet holds are refused.
    """
    names = [c for c in rows.columns if c != order]
    cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if x is None else str(x))}</t></is></c>'
    n = 1
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", _BOOK.format(escape(title, {'"': "&quot;"})))
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(f"<row>{''.join(map(cell, names))}</row>".encode())
            for r in rows.orderBy(order).select(*names).toLocalIterator():
                n += 1
                if n > SHEET_ROWS:
                    raise ValueError(f"more than {SHEET_ROWS} rows; write Parquet or CSV instead")
                f.write(f"<row>{''.join(map(cell, r))}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return n - 1


def write_zip(files: DataFrame, path: str) -> int:
    """Write files (member, content) as one deflated archive in order of their names, streamed through the driver."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.select("member", "content").orderBy("member").toLocalIterator():
            z.writestr(r.member, bytes(r.content))
            n += 1
    return n


def write_texts(rows: DataFrame, path: str) -> None:
    """One UTF-8 text per stem, in a folder of its own under `path`."""
    rows.select("stem", "text").write.mode("overwrite").partitionBy("stem").text(path)


def write_by_outcome(results: DataFrame, path: str) -> None:
    """Results under a folder of the renamed and one of the unrecognised."""
    outcome = F.when(F.col("status").eqNullSafe(F.lit("success")), v.DONE_FOLDER).otherwise(v.FAILED_FOLDER)
    results.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_text_files(rows: DataFrame, folder: str) -> None:
    """One UTF-8 file `stem`.txt per row, straight in the folder, on a file system that all executors mount; a file that is there is replaced."""

    def put(part) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in part:
            with open(f"{folder}/{r.stem}.txt", "w", encoding="utf-8") as f:
                f.write(r.text or "")

    rows.select("stem", "text").foreachPartition(put)


def write_members(files: DataFrame, folder: str, clear: bool = True) -> None:
    """Unpack files (member, content) into a folder that all executors mount; what was there before goes, unless it is to stay.

    A member that would lie outside the folder is refused.
    """
    top = os.path.realpath(local_path(folder))
    if clear and os.path.isdir(top):
        shutil.rmtree(top)
    os.makedirs(top, exist_ok=True)

    def put(part) -> None:
        for r in part:
            target = os.path.realpath(f"{top}/{r.member}")
            if not target.startswith(f"{top}/"):
                raise ValueError(f"{r.member} leads out of {top}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(r.content)

    files.select("member", "content").foreachPartition(put)


def local_path(url: str) -> str:
    """A path as the operating system knows it, of one that Spark writes as file:/x or file:///x."""
    if re.match("file:/", url):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"{url} isn't on a mounted file system")
    return url


def existing_names(spark: SparkSession, folder: str) -> DataFrame:
    """filename of every file in a folder; none of a folder that isn't there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "filename string")
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"))


def _placed(source: str, target: str, size: int | None) -> int:
    """Give a file its new name beside its old one, or copy an archive's member out; gives its size. Nothing is ever overwritten."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    archive, _, member = source.partition(".zip!") if ".zip!" in source else (source, "", "")
    if not os.path.exists(source) and member and os.path.exists(f"{archive}.zip"):
        with zipfile.ZipFile(f"{archive}.zip") as z:
            content = z.read(member)
        if os.path.exists(target):
            with open(target, "rb") as f:
                if f.read() != content:
                    raise FileExistsError(target)
            return len(content)
        part = f"{target}.{uuid.uuid4().hex}"
        with open(part, "xb") as f:
            f.write(content)
        try:
            os.link(part, target)
        finally:
            os.unlink(part)
        return len(content)
    if not os.path.exists(source):
        if size is not None and os.path.exists(target) and os.path.getsize(target) == size:
            return size  # moved by a run before, as its list says
        raise FileNotFoundError(source)
    try:
        os.link(source, target)
    except FileExistsError:
        if not os.path.samefile(source, target):
            raise
    return os.path.getsize(source)


def move_files(plan: DataFrame, listing: str | None = None) -> None:
    """Carry out a plan (source, target) on a file system that all executors mount. Never part of a query.

    First every file gets its new name beside the old one, which fails where another file has that name;
    the moves are listed in `listing` (else beside the target folder, as its name and .moves); then old
    names are taken away. A task may be repeated at any point. A run whose moves are in the list already
    finds its work done, if the targets are there with the sizes listed. Sources may be paths as Spark
    writes them, or archive.zip!member, which is copied out of its archive and stays there.
    """
    spark = plan.sparkSession
    first = plan.select("target").first()
    if first is None:
        return
    listing = local_path(listing or f"{os.path.dirname(first.target)}.moves")
    run = uuid.uuid4().hex
    known = "source string, target string, size long, run string"
    done = spark.read.schema(known).parquet(listing) if os.path.isdir(listing) else spark.createDataFrame([], known)
    done = done.groupBy(F.col("source").alias("_s"), F.col("target").alias("_t")).agg(F.max("size").alias("size"))
    rows = plan.select("source", "target").join(done, (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t")), "left")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, t, _placed(local_path(s), local_path(t), None if pd.isna(n) else int(n)), run) for s, t, n in zip(batch["source"], batch["target"], batch["size"], strict=True)]
            yield pd.DataFrame(rows, columns=["source", "target", "size", "run"])

    rows.select("source", "target", "size").mapInPandas(place, known).write.mode("append").parquet(listing)

    def leave(part) -> None:
        for r in part:
            old, new = local_path(r.source), local_path(r.target)
            if os.path.exists(old) and os.path.samefile(old, new):
                os.unlink(old)

    spark.read.schema(known).parquet(listing).where(F.col("run") == run).foreachPartition(leave)
