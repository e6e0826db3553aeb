"""Sources, sinks, whole runs, streams and the environment check."""

import io
import os
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import environment, pipeline, service, sinks
from docloom.sources import images, preprocess, tokens
from docloom.streaming import reports


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in members.items():
            z.writestr(n.replace("__", "/").replace("DOT", "."), d)
    return out.getvalue()


def cells(path):
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        book = z.read("xl/workbook.xml").decode()
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    return book, [["".join(t.text or "" for t in c.iter(f"{ns}t")) for c in r] for r in root.iter(f"{ns}row")]


def test_scan_takes_images_of_either_case(spark, tmp_path):
    for n in ("a.jpg", "d/b.JPEG", "d/e/c.Tif", "d/x.txt", "y.zip"):
        put(f"{tmp_path}/{n}")
    names = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    assert names(images.scanned(spark, str(tmp_path))) == ["a.jpg", "b.JPEG", "c.Tif"]
    assert names(images.scanned(spark, str(tmp_path), [".jpg", ".jpeg", ".png"])) == ["a.jpg", "b.JPEG"]
    assert names(images.scanned(spark, f"{tmp_path}/a.jpg")) == ["a.jpg"]
    assert names(images.scanned(spark, f"{tmp_path}/d/x.txt")) == [] == names(images.scanned(spark, f"{tmp_path}/none"))


def test_load_is_a_bag_union_in_order(spark, tmp_path):
    put(f"{tmp_path}/a.zip", archive(iDOTjpg=b"1", d__jDOTPNG=b"2", kDOTtxt=b"3"))
    put(f"{tmp_path}/f/q.bmp", b"4")
    put(f"{tmp_path}/t.txt")
    found = images.loaded(spark, [f"{tmp_path}/a.zip", f"{tmp_path}/f", f"{tmp_path}/f", f"{tmp_path}/t.txt"]).collect()
    assert sorted((r.load_seq, r.member, bytes(r.content)) for r in found) == [(0, "d/j.PNG", b"2"), (0, "i.jpg", b"1"), (1, "", b"4"), (2, "", b"4")]
    assert images.loaded(spark, []).count() == 0


@pytest.mark.parametrize(
    ("tsv", "want"),
    [
        ("text\tconf\tleft\ttop\twidth\theight\n a \t90\t1\t2\t3\t4\n\t90\t1\t2\t3\t4\nb\t-1\t1\t2\t3\t4\nc\t-1.0\t5\t6\t7\t8\n", ["a", "c"]),
        ("text\tconf\tleft\ttop\twidth\theight\na\t90\t1\t2\t3\t4\nb\t90\tx\t2\t3\t4\nc\t90\t1\t2\t3\t4\n", ["a"]),
        ('text\tconf\tleft\ttop\twidth\theight\n"two\nlines"\t90\t1\t2\t3\t4\n', ["two\nlines"]),
        ("conf\ttext\tleft\ttop\twidth\theight\n90\ta\t1\t2\t3\t4\n90\n90\tb\t1\t2\t3\t4\n", ["a"]),
        ("", []),
    ],
)
def test_tsv(spark, tsv, want):
    files = spark.createDataFrame([("p", bytearray(tsv.encode()))], "path string, content binary")
    assert [r.text for r in tokens.tsv_tokens(files).orderBy("in_pos").collect()] == want


def backend(path, content):
    """Tokens written into the image itself, one per line: text x y."""
    if content == b"broken":
        raise RuntimeError("can't read")
    return [(t, "90", int(x), int(y), 1, 1) for t, x, y in (line.split() for line in content.decode().splitlines())]


def test_a_whole_run(spark, tmp_path):
    page = "工程名称 100 100\n示范线路 300 110\n工程编号 100 200\nB113-6 300 205\n".encode()
    for n, d in (("1.jpg", page), ("2.JPG", page), ("3.png", page), ("4.jpg", b"broken"), ("5.jpg", "无 1 1".encode()), ("6.jpg", page)):
        put(f"{tmp_path}/in/{n}", d)
    files = images.scanned(spark, f"{tmp_path}/in", content=True)
    fields = pipeline.from_images(pipeline.numbered(files), backend)
    plan = pipeline.rename_plan(fields, f"{tmp_path}/out").cache()
    rows = plan.orderBy("seq").collect()
    assert [(os.path.basename(r.target) if r.target else None, r.status, r.message) for r in rows] == [
        ("示范线路B113-6.jpg", "success", ""),
        ("示范线路B113-6.JPG", "success", ""),
        ("示范线路B113-6.png", "success", ""),
        (None, "failed", "can't read"),
        (None, "failed", ""),
        ("示范线路B113-6_2.jpg", "success", ""),
    ]
    assert pipeline.listed(plan, f"{tmp_path}/list.xlsx") == 6
    book, sheet = cells(f"{tmp_path}/list.xlsx")
    assert "处理结果" in book and sheet[0] == ["原文件", "工程名称", "工程编号", "新文件名", "状态"]
    assert sheet[1][0].endswith("/in/1.jpg") and sheet[4][0].endswith("/in/4.jpg") and sheet[4][4] == "failed"
    moves = plan.where("status = 'success'")
    sinks.move_files(moves)
    sinks.move_files(moves)  # a retry finds its work done
    assert sorted(os.listdir(f"{tmp_path}/out")) == sorted(os.path.basename(r.target) for r in rows if r.target)
    assert sorted(os.listdir(f"{tmp_path}/in")) == ["4.jpg", "5.jpg"]
    packed = spark.read.format("binaryFile").load(f"{tmp_path}/out").select(F.regexp_extract("path", "[^/]+$", 0).alias("member"), "content")
    assert sinks.write_zip(packed, f"{tmp_path}/out.zip") == 4
    assert zipfile.ZipFile(f"{tmp_path}/out.zip").testzip() is None


def test_moves_never_overwrite_and_tell_what_an_earlier_run_did(spark, tmp_path):
    """Present files survive, names avoid them, and a target that another file holds is no proof of a move."""
    page = "工程名称 100 100\n甲线 300 110".encode()
    put(f"{tmp_path}/in/1.jpg", page)
    put(f"{tmp_path}/in/2.jpg", page + b"\nx 1 1")
    put(f"{tmp_path}/out/甲线.jpg", b"present")
    w = service.Workflow(spark, f"{tmp_path}/out")
    w.add(f"{tmp_path}/in")
    plan = w.run(backend).where("status = 'success'").select("source", "target").collect()
    assert sorted(os.path.basename(r.target) for r in plan) == ["甲线_2.jpg", "甲线_3.jpg"]
    plan = spark.createDataFrame(plan)
    sinks.move_files(plan)
    sinks.move_files(plan)
    read = lambda n: open(f"{tmp_path}/out/{n}", "rb").read()
    assert read("甲线.jpg") == b"present" and {read("甲线_2.jpg"), read("甲线_3.jpg")} == {page, page + b"\nx 1 1"} and os.listdir(f"{tmp_path}/in") == []
    put(f"{tmp_path}/in/3.jpg", b"new")
    clash = lambda s, t: spark.createDataFrame([(f"{tmp_path}/in/{s}", f"{tmp_path}/out/{t}")], "source string, target string")
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.move_files(clash("3.jpg", "甲线.jpg"))
    with pytest.raises(Exception, match="FileNotFoundError"):
        sinks.move_files(clash("gone.jpg", "甲线.jpg"))
    assert read("甲线.jpg") == b"present" and os.path.exists(f"{tmp_path}/in/3.jpg")
    os.link(f"{tmp_path}/in/3.jpg", f"{tmp_path}/out/half.jpg")  # an attempt that got half way
    sinks.move_files(clash("3.jpg", "half.jpg"))
    assert read("half.jpg") == b"new" and not os.path.exists(f"{tmp_path}/in/3.jpg")
    with pytest.raises(ValueError):
        sinks.local_path("hdfs://host/x")


def test_archive_members_are_copied_out(spark, tmp_path):
    page = "工程名称 1 1\n乙线 9 1"
    put(f"{tmp_path}/a.zip", archive(d__iDOTjpg=page, jDOTpng=page, kDOTpng="无 1 1"))
    c = service.Controller(spark, f"{tmp_path}/out")
    assert c.start() == [] and c.load_file(f"{tmp_path}/a.zip") == 3 == c.load_file(f"{tmp_path}/a.zip")
    plan = c.start(backend).where("status = 'success'")
    sinks.move_files(plan)
    sinks.move_files(plan.withColumn("target", F.regexp_replace("target", "_2", "")))  # the same run, had the folder been empty
    assert {n: open(f"{tmp_path}/out/{n}").read() for n in os.listdir(f"{tmp_path}/out") if "_" not in n} == {"乙线.jpg": page, "乙线.png": page}
    files = images.members(spark.read.format("binaryFile").load(f"{tmp_path}/a.zip"))
    put(f"{tmp_path}/x/old.txt")
    sinks.write_members(files, f"{tmp_path}/x")
    assert sorted(os.listdir(f"{tmp_path}/x")) == ["d", "j.png", "k.png"]
    with pytest.raises(Exception, match="leads out"):
        sinks.write_members(spark.createDataFrame([("../y", bytearray(b""))], "member string, content binary"), f"{tmp_path}/x", clear=False)
    sinks.write_text_files(spark.createDataFrame([("p", "甲"), ("q", None)], "stem string, text string"), f"{tmp_path}/texts")
    assert {n: open(f"{tmp_path}/texts/{n}", encoding="utf-8").read() for n in os.listdir(f"{tmp_path}/texts")} == {"p.txt": "甲", "q.txt": ""}


def test_numbers_follow_paths(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "SAMPLED_PATHS", 40)
    paths = [f"/in/{i * 7919 % 500:04}.jpg" for i in range(500)] + ["/in/0007.jpg"]
    rows = pipeline.numbered(spark.createDataFrame([(p, bytearray(p.encode())) for p in paths], "path string, content binary")).orderBy("seq").collect()
    assert [r.path for r in rows] == sorted(paths) and [r.seq for r in rows] == list(range(501)) and all(r.content.decode() == r.path for r in rows)
    assert pipeline.numbered(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_a_program_as_recogniser(spark, tmp_path):
    """A stub that is called as the program is, with prepared bytes; a missing one and a failing one are the image's own error."""
    stub = tmp_path / "ocr"
    stub.write_text('#!/bin/sh\n[ "$3" = "-l" ] && [ "$5" = "tsv" ] || exit 3\ngrep -q bad "$1" && { echo "no image" >&2; exit 1; }\nprintf "text\\tconf\\tleft\\ttop\\twidth\\theight\\n%s\\t90\\t1\\t2\\t3\\t4\\n\\t-1\\t0\\t0\\t0\\t0\\n" "$(cat "$1")" > "$2.tsv"\n')
    stub.chmod(0o755)
    pages = spark.createDataFrame([("a.jpg", bytearray(b"one")), ("b.png", bytearray(b"bad"))], "path string, content binary")
    found = {r.path: (r.text, r.x, r.error) for r in tokens.recognised(pages, tokens.ProgramBackend(str(stub), languages="eng"), lambda c: c[::-1] if c == b"one" else c).collect()}
    assert found == {"a.jpg": ("eno", 1, ""), "b.png": (None, None, "no image")}
    assert {r.error for r in tokens.recognised(pages, tokens.ProgramBackend("no-such-program")).collect()} == {"OCR组件不存在"}
    fields = pipeline.from_images(pages.selectExpr("0L AS seq", "*"), backend, prepare=lambda c: 1 / 0).collect()
    assert {r.error for r in fields} == {"division by zero"}


def test_text_run_and_partitioned_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(0, "/a.jpg", "我方完成甲项目开工前"), (1, "/b.jpg", "")], "seq long, path string, text string")
    plan = pipeline.rename_plan(pipeline.from_texts(texts), "/out", spark.createDataFrame([("甲.jpg",)], "filename string"))
    assert {r.seq: r.target for r in plan.collect()} == {0: "/out/甲_2.jpg", 1: None}
    sinks.write_by_outcome(plan, f"{tmp_path}/r")
    assert {r.outcome for r in spark.read.parquet(f"{tmp_path}/r").collect()} == {"已重命名图片", "未识别"}
    sinks.write_texts(texts.select(F.col("seq").cast("string").alias("stem"), "text"), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t/stem=0").collect()[0].value == "我方完成甲项目开工前"


def test_recognition_from_a_table(spark):
    pages = spark.createDataFrame([("p", bytearray(b"")), ("q", bytearray(b""))], "path string, content binary")
    known = spark.createDataFrame([("p", 0, "t", "9", 1, 2, 3, 4)], tokens.TOKENS)
    assert {(r.path, r.text) for r in tokens.from_table(pages, known).collect()} == {("p", "t"), ("q", None)}


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "我方完成甲项目开工前"), ("2024-01-01 00:00:02", "工程名称乙工程编号A1"), ("2024-01-01 00:06:00", "x")]
    spark.createDataFrame(rows, "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    q = reports.status_counts(reports.extracted(stream)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        found = sorted((r.report_type, r.status, r.n) for r in spark.sql("SELECT * FROM counts").collect())
    finally:
        q.stop()
    assert found == [("", "failed", 1), ("finish", "success", 1), ("start", "success", 1)]


def test_environment(tmp_path):
    assert environment.checked([f"{tmp_path}/new"])["ok"]
    put(f"{tmp_path}/file")
    found = environment.checked([f"{tmp_path}/file/below"], ["no-such-program"])
    assert not found["ok"] and len(found["errors"]) == 2


def test_workflow_counts_all_that_was_loaded(spark, tmp_path):
    put(f"{tmp_path}/a.zip", archive(iDOTjpg="无 1 1", jDOTpng="工程名称 1 1\n甲线 9 1"))
    put(f"{tmp_path}/f/q.bmp", "x 1 1".encode())
    w = service.Workflow(spark, "/out")
    assert w.load(f"{tmp_path}/a.zip") == {"count": 2, "message": "已加载 2 张图片"} and w.add(f"{tmp_path}/f") == 3 == w.add(f"{tmp_path}/none")
    assert {r.status for r in w.run().collect()} == {"等待OCR"}
    assert sorted(r.target or "" for r in w.run(backend).collect()) == ["", "", "/out/甲线.png"]
    assert w.finished() == "处理完成，输出目录：/out" and service.progress(spark)["percent"] == 0
    w.clear()
    assert w.files().count() == 0


def test_line_engines_load_once_or_not_at_all(spark):
    made = []
    b = tokens.LineBackend(lambda: made.append(1) or (lambda content: content.decode().split(",")))
    assert [t[0] for t in b("p", b"x,y") + b("q", b"z")] == ["x", "y", "z"] and made == [1]
    assert tokens.LineBackend(lambda: 1 / 0)("p", b"x") == []
    pages = spark.createDataFrame([("p", bytearray("工程名称,甲线,工程编号,A1".encode()))], "path string, content binary")
    found = pipeline.from_images(pages.selectExpr("0L AS seq", "*"), tokens.LineBackend(lambda: lambda c: c.decode().split(","))).collect()[0]
    assert (found.project_name, found.project_code, found.report_type) == ("甲线", "A1", "finish")


def test_borders_and_headers(spark):
    page = np.full((10, 8, 3), 7, np.uint8)
    assert preprocess.border(page) == (0, 0, 8, 10)
    page[3:5, 2] = 0
    page[4, 6, 1] = 9
    assert preprocess.border(page) == (2, 3, 7, 5) and preprocess.header(100, 99) == (0, 0, 100, 27)
    bad = spark.createDataFrame([("p", bytearray(b"no image"))], "path string, content binary")
    row = preprocess.applied(bad).collect()[0]
    assert bytes(row.content) == b"no image" and row.error
    assert preprocess.applied(bad, lambda c: c[::-1]).collect()[0].error == ""


def test_prepared_images(spark):
    image = pytest.importorskip("PIL.Image")
    out = io.BytesIO()
    page = np.full((50, 40, 3), 255, np.uint8)
    page[10:30, 5:25] = 0
    image.fromarray(page).save(out, "PNG")
    assert image.open(io.BytesIO(preprocess.prepared(out.getvalue()))).size == (40, 40)
    assert image.open(io.BytesIO(preprocess.strengthened(out.getvalue()))).size == (80, 100)
    assert image.open(io.BytesIO(preprocess.cropped_header(out.getvalue()))).size == (40, 14)


def test_log(tmp_path):
    log = service.logger(f"{tmp_path}/app.log", "docloom-test")
    assert service.logger("/nowhere", "docloom-test") is log
    log.info("done")
    assert "[INFO] docloom-test: done" in open(f"{tmp_path}/app.log").read()
