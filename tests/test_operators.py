"""Operators over lines, tokens, candidates and names."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import geometry, lines, merge, naming, ranks, report

TOKENS = "doc_id string, in_pos int, text string, x int, y int, conf string"


def tokens(spark, *docs):
    return spark.createDataFrame([(d, i, text, x, y, "90") for d, rows in docs for i, (text, x, y) in enumerate(rows)], TOKENS)


def test_fields_by_position(spark):
    a = ("a", [("工程名称", 100, 100), ("示范线路", 300, 110), ("改造工程", 300, 150), ("工程编号", 100, 200), ("B1132025-6", 300, 205), ("施工单位", 100, 300)])
    b = ("b", [("工程编号", 100, 100), ("B113-6", 300, 100), ("工程名称", 100, 150), ("10kV#1线", 300, 150), ("施工单位", 100, 300)])
    c = ("c", [("无", 1, 1)])
    rows = tokens(spark, a, b, c)
    for shuffled in (rows, rows.repartition(3), rows.orderBy(F.desc("x"))):
        found = {r.doc_id: (r.project_name, r.project_code) for r in geometry.region_fields(shuffled).collect()}
        assert found == {"a": ("示范线路改造工程", "B1132025-6"), "b": ("10kV#1线", "B113-610kV#1"), "c": ("", "")}


def test_a_label_with_its_value_in_one_token_yields_nothing(spark):
    assert geometry.field_text(tokens(spark, ("a", [("工程名称：甲", 0, 0)])), "project_name").collect()[0].project_name == ""


def test_nearby_value(spark):
    rows = tokens(spark, ("a", [("项目名称", 100, 200), ("XXX工程", 350, 200)]), ("b", [("项目名称", 100, 200), ("x", 400, 200)]), ("c", [("左", 50, 5), ("项目名称", 100, 5), ("p", 120, 5), ("q", 120, 5)]))
    assert {r.doc_id: r.value for r in geometry.nearby_value(rows, "项目名称").collect()} == {"a": "XXX工程", "b": "", "c": "q"}


def test_kept_tokens_and_text(spark):
    rows = spark.createDataFrame([("a", 0, " x ", 0, 0, "-1"), ("a", 2, "z", 0, 0, "90"), ("a", 1, "y", 0, 0, "-1.0"), ("a", 3, "　", 0, 0, "1"), ("a", 4, None, 0, 0, None)], TOKENS)
    kept = geometry.kept_tokens(rows)
    assert geometry.token_text(kept).collect()[0].raw_text == "y\nz"


def of(spark, *docs):
    return spark.createDataFrame([(d, i, x) for d, rows in docs for i, x in enumerate(rows)], "doc_id string, pos long, line string")


def test_lines(spark):
    rows = of(spark, ("a", ["a", "工程名称x", "b", "c", "d"]), ("b", ["工程名称：", "甲线"]), ("c", ["项目名称：甲", "工程名称：乙", "工程名称："]), ("d", ["编号", " "]), ("e", ["工程编号"]))
    assert [(r.doc_id, r.region) for r in lines.regions(rows).where("doc_id = 'a'").collect()] == [("a", ["a", "工程名称x", "b", "c"])]
    named = {r.doc_id: r.value for r in lines.next_line_value(rows, ["工程名称", "项目名称"], "value").collect()}
    assert named == {"a": "x", "b": "甲线", "c": "甲", "d": "", "e": ""}
    fields = {r.doc_id: (r.project_name, r.project_code) for r in lines.table_fields(rows).collect()}
    assert fields["c"] == ("乙", "") and fields["b"] == ("", "")
    assert {r.doc_id: r.text for r in lines.region_text(lines.regions(rows)).collect()}["b"] == "工程名称：\n甲线"


def test_merged_lines_and_window_codes(spark):
    rows = of(spark, ("a", [" short ", "next", "工程编号 5513OIS", "x" * 25, "y"]))
    assert [r.merged for r in lines.merged_lines(rows).orderBy("pos").collect()] == ["shortnext", "next", "工程编号 5513OIS" + "x" * 25, "x" * 25, "y"]
    assert [r.code for r in lines.window_codes(rows).orderBy("pos").collect()] == ["C13015", "X" * 25, "X" * 25, "X" * 25, ""]


def test_candidates(spark):
    rows = spark.createDataFrame([("a", 0, "ab", "O1I"), ("a", 1, "cd", ""), ("b", 0, "工程名称:甲线路改造", None), ("b", 1, "乙", None)], "doc_id string, seq long, project_name string, project_code string")
    assert {tuple(r) for r in merge.merged_results(rows).collect()} == {("a", "ab", "O11"), ("b", "工程名称:甲线路改造", "")}
    assert {tuple(r) for r in merge.chosen_name(rows).collect()} == {("a", "ab"), ("b", "甲线路改造")}


def greedy(names, existing=(), whole=False):
    taken, out = set(existing), []
    for n in names:
        stem, dot, ext = (n, "", "") if whole or "." not in n.lstrip(".") else n.rpartition(".")
        target, k = n, 2
        while target in taken:
            target, k = f"{stem}_{k}{dot}{ext}", k + 1
        taken.add(target)
        out.append(target)
    return out


@pytest.mark.parametrize("existing", [(), ("A.jpg", "B_2.jpg", "Z.jpg")])
def test_names_are_the_greedy_ones(spark, existing):
    r = random.Random(7)
    names = ["A.jpg", "A.jpg", "A_2.jpg", "A.png"] + [r.choice(["A", "B", "C", "A_2", "B_2_2", "D_x", ""]) + r.choice([".jpg", ".png"]) for _ in range(300)] + ["C.gif"] * 3000
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, filename string").repartition(5)
    have = spark.createDataFrame([(x,) for x in existing], "filename string") if existing else None
    found = [r.target for r in naming.deduplicated(rows, have).orderBy("seq").collect()]
    assert found == greedy(names, existing) and len(set(found)) == len(found)


def test_names_do_not_depend_on_how_unions_are_dealt(spark):
    """A union that claims its sides' partitioning used to lose the exchange that brings a family together."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    rows, have = spark.createDataFrame([(0, "甲.jpg")], "seq long, filename string"), spark.createDataFrame([("甲.jpg",)], "filename string")
    assert {naming.deduplicated(rows, have).collect()[0].target for _ in range(3)} == {"甲_2.jpg"}


def test_names_without_extensions_and_none_at_all(spark):
    names = ["a.b", "a.b", "a.b_2", "a"]
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, filename string")
    assert [r.target for r in naming.deduplicated(rows, whole=True).orderBy("seq").collect()] == greedy(names, whole=True)
    assert naming.deduplicated(rows.where("seq < 0")).count() == 0


def test_ranks_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("k"), "id")
    found = ranks.ranked(rows, "k", F.floor(F.col("id") / 3), [F.col("id")], "r").collect()
    for k in {r.k for r in found}:
        mine = sorted(r.id for r in found if r.k == k)
        assert {r.id: r.r for r in found if r.k == k} == {i: n for n, i in enumerate(mine)}


def test_reports(spark):
    rows = spark.createDataFrame([(0, "success", "/a", None, "n", "c", "t", ""), (1, "failed", None, "/b", None, None, None, ""), (2, None, None, "/c", None, None, None, "why")], "seq long, status string, source string, file string, project_name string, project_code string, target string, message string")
    assert tuple(report.status_report(rows).collect()[0]) == (1, 2)
    assert [tuple(r) for r in report.result_sheet(rows).orderBy("seq").collect()] == [(0, "/a", "n", "c", "t", "success"), (1, "/b", "", "", "", "failed"), (2, "/c", "", "", "", "")]
    assert report.result_sheet(rows, file_too=False).where("seq = 1").collect()[0][1] == ""
    assert {tuple(r) for r in report.error_records(rows).collect()} == {("/b", "无法识别工程信息"), ("/c", "why")}
    made = spark.range(1).select(report.error(F.lit(None).cast("string"), F.lit("r")).alias("e")).collect()[0].e
    assert (made.file, made.reason) == ("", "r")
