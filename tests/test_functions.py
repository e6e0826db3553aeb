"""Hand-traced expectations of rules, scores and text functions."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules, scoring
from docloom.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    ("text", "name", "code"),
    [
        ("我方完成莆田市110kV线路改造工程项目开工前各项准备工作", "莆田市110kV线路改造工程", ""),
        ("工程名称\n莆田10kV吴江线#035B杆工程\n工程编号\n18132024015D-15", "莆田10kV吴江线#035B杆工程", "18132024015D-15"),
        ("工程名称\n莆田荔城井头变10kV吴江线城龙线\n#035B分界开关新装业扩配套工程", "", ""),
        ("工程名称：XXX工程\n工程编号：GD20260001", "XXX工程", ""),
        ("工程名称\n工程编号\nABC1", "工程", "ABC1"),
        ("工程编号\nABC123\n2026", "", "ABC1232026"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_report_fields(spark, text, name, code):
    found = value(spark, rules.report_fields(F.lit(text).cast("string")))
    assert (found.project_name, found.project_code) == (name, code)


def test_fixed_mode_reads_colons_open_ends_and_blank_names(spark):
    fixed = lambda s: tuple(value(spark, rules.report_fields(F.lit(s), fixed=True)))
    assert fixed("工程名称：XXX工程\n工程编号：GD20260001") == ("XXX工程", "GD20260001")
    assert fixed("工程名称\n甲线\n#035B工程") == ("甲线#035B工程", "")
    assert fixed("工程名称\n工程编号\nABC1") == ("", "ABC1")


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: t.power_code(F.lit("5513ab")), "C13AB"),
        (lambda: t.power_code(F.lit("s513")), "C13"),
        (lambda: t.power_code(F.lit("5513ab"), fixed=True), "C513AB"),
        (lambda: t.plain_code(F.lit(" b1-o i/s")), "B1-015"),
        (lambda: t.digits_fixed(F.lit("OISx")), "015x"),
        (lambda: t.merged_text(F.lit(" ＯIO ")), "01O"),
        (lambda: t.stripped_code(F.lit("\tO1S　")), "015"),
        (lambda: rules.template(F.lit("")), "startup"),
        (lambda: rules.template(F.lit("开工报告工程名称")), "startup"),
        (lambda: rules.template(F.lit("工程名称工程编号")), "completion"),
        (lambda: rules.sentence_name(F.lit("我方完成甲线路改造工程，")), "甲线路"),
        (lambda: t.region_name(F.lit("工程名称:甲线路改造")), "甲线路改造"),
        (lambda: t.lite_text(F.lit(" 甲：乙:丙施工单位丁 ")), "甲乙丙"),
        (lambda: scoring.name_score(F.lit("110kV线路改造工程")), 60),
        (lambda: scoring.code_score(F.lit("B1132025"), F.lit("xxB1132025")), 100),
        (lambda: scoring.code_score(F.lit("")), 0),
        (lambda: scoring.result_score(F.lit("示范线路改造工程"), F.lit("A1")), 90),
        (lambda: scoring.code_confidence(F.lit("B1132025")), 90),
        (lambda: scoring.percent(F.lit(1), F.lit(3)), 33),
        (lambda: scoring.percent(F.lit(1), F.lit(0)), 0),
        (lambda: t.safe_name(F.lit(' a<b>:"/\\|?*c　')), "abc"),
        (lambda: t.name_then_code(F.lit("n/"), F.lit("c"), F.lit(".JPG")), "nc.JPG"),
        (lambda: t.code_then_name(F.lit("n"), F.lit("c")), "cn"),
        (lambda: t.suffix(F.lit("/a/.hidden")), ""),
        (lambda: t.suffix(F.lit("/a/b.tar.GZ")), ".GZ"),
        (lambda: t.suffix(F.lit("/a.b/c")), ""),
        (lambda: t.stem(F.lit("/a/b.tar.gz")), "b.tar"),
        (lambda: t.longest(F.array(F.lit("a"), F.lit("bc"), F.lit("de"))), "bc"),
        (lambda: t.longest(F.array().cast("array<string>")), ""),
        (lambda: t.first_word(F.lit("x编号y"), ["工程编号", "编号"]), "编号"),
        (lambda: F.array_join(rules.serial_codes(F.lit("A123456O 12345678I")), ","), "A1234560,123456781"),
        (lambda: scoring.is_power_code(F.lit("b113 x")), True),
        (lambda: scoring.valid_power_code(F.lit("b113")), False),
        (lambda: scoring.should_retry(F.lit(2)), False),
        (lambda: rules.is_report_page(F.lit("无")), False),
        (lambda: rules.report_type(F.lit(""), F.lit("我方\n完成")), ""),
    ],
)
def test_values(spark, column, want):
    assert value(spark, column()) == want


def test_cleaners_are_idempotent(spark):
    texts = ["", " 工程名称：甲:，", "O I S", "a<b>", "工程名称工程编号编号", "：，。x。，："]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for clean in (t.report_name, t.area_code, t.plain_code, t.safe_name, t.region_name, t.merged_text, t.strip):
        once = df.select(clean(F.col("x")).alias("x"))
        assert once.collect() == once.select(clean(F.col("x")).alias("x")).collect()
