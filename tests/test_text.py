from pyspark.sql import functions as F

from paperloom.functions import text as t


def values(spark, expression, *texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r.v for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_strip_removes_all_white_space(spark):
    assert values(spark, t.strip_ws, "  a b\x1c", "\u2003x\u00a0", None, "") == ["a b", "x", None, ""]
    assert values(spark, t.blank_to_null, " \t", "a", None) == [None, "a", None]


def test_code_norms_differ(spark):
    assert values(spark, t.code_listed, " e11.9 ", "a.b") == ["E119", "AB"]
    assert values(spark, t.code_stored, " e11.9 ") == [" E119 "]
    assert values(spark, t.code_scored, " e-11.9 ", None) == ["E119", ""]


def test_code_list_forms(spark):
    got = values(spark, t.code_list, '["e11.9", "", null, "e11.9"]', "a1; b2|c3", "a\rb", "a\rb,c", "  ", None, "[broken, x")
    assert got == [["E119", "E119"], ["A1", "B2", "C3"], ["AB"], ["A", "B", "C"], [], [], ["BROKEN", "X"]]


def test_integer_text(spark):
    assert values(spark, t.integer_text, " 12 ", "-3", "+4", "null", "", "1.5", "x", None, "99999999999") == [12, -3, 4, None, None, None, None, None, None]


def test_spaces_and_markup(spark):
    assert values(spark, t.normal_space, " a \t b\r\n\r\n\r\n\r\nc\r ", None) == ["a b\n\nc", None]
    assert values(spark, t.strip_html, "<p>A&amp;B<!-- x\ny --> <b>c</b></p><br>d", "") == ["A&B c \n\nd", ""]
    assert values(spark, t.guideline_text, "“a”\n\nb’s ") == ["\"a\" b's"]
    assert values(spark, t.one_line, " a\n\t b ") == ["a b"]
    assert values(spark, t.nonblank_lines, "a\r\n \n\nb", "", None)[:2] == [2, 0]


def test_token_estimate(spark):
    assert values(spark, t.token_estimate, "", "abcd", "abcde") == [1, 1, 2]


def test_chunk_id_is_bounded_and_unique(spark):
    long = "x" * 500
    rows = spark.createDataFrame([("u", "p/a.pdf", long), ("u", "p/a.pdf", long + "y"), ("u", "", "")], "a string, b string, c string")
    got = [r.v for r in rows.select(t.chunk_id(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()]
    assert all(len(x) <= 200 for x in got) and len(set(got)) == 3


def test_citations(spark):
    assert values(spark, t.guideline_citation, "§2K2.1. Receipt", "see §2K2.1") == ["§2K2.1", None]
    assert values(spark, t.title18_citation, "§ 793. Gathering", "[§ 1111]", "none") == ["18 U.S.C. § 793", "18 U.S.C. § 1111", None]
    assert values(spark, t.chapter_number, "CHAPTER TWO - X", "Chapter 7", "Part A") == [2, 7, None]
    assert values(spark, t.statute_variants, "18 U.S.C. § 793(g)", "1546", "") == [["18usc793g", "18usc793", "793"], ["1546"], []]
    assert values(spark, lambda c: t.query_citation(c)[1], "what of §2k2.1(b)(1)?", "2K2.1") == ["(b)(1)", None]
    assert values(spark, lambda c: t.query_citation(c)[0], "what of §2k2.1(b)(1)?", "no") == ["2K2.1", None]


def test_parent_token_needs_a_non_digit(spark):
    rows = spark.createDataFrame([("924c", "924"), ("9245", "924"), ("924", "924")], "a string, b string")
    assert [r.v for r in rows.select(t.is_parent_token(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False]


def test_json_object(spark):
    got = values(spark, t.json_object, '```json\n{"a": 1}\n```', 'So: {"a": 2}. Done', "[1]", "none", '{"a": ', None)
    assert got == ['{"a": 1}', '{"a": 2}', None, None, None, None]
    assert values(spark, t.flat_content, "plain", '["a", {"text": "b"}]') == ["plain", "a\nb"]


def test_stale_claims(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert values(spark, lambda c: t.stale(c, now, 45), "2024-01-01T11:30:00+00:00", "2024-01-01T11:00:00Z", None, "never", "2024-01-01T11:14:59") == [False, True, True, True, True]


def test_display(spark):
    rows = spark.createDataFrame([(3661.5,), (-1.0,), (None,), (360000.0,)], "x double")
    assert [r.v for r in rows.select(t.hhmmss(F.col("x")).alias("v")).collect()] == ["01:01:01", "00:00:00", "00:00:00", "100:00:00"]
    blocks = spark.sql("select array(named_struct('a', 1, 'text', 'x'), named_struct('a', 2, 'text', 'y')) as b")
    assert blocks.select(t.numbered_blocks(F.col("b"), "a").alias("v")).first().v == "[1] a=1\nx\n\n[2] a=2\ny"
    assert blocks.select(t.bullets(F.array(F.lit("p"), F.lit("q"))).alias("v")).first().v == "- p\n- q"


def test_diagnosis_lines(spark):
    text = "Intro\nDischarge Diagnosis:\nA\nA\nB\n\nC\nDischarge Condition: x"
    assert values(spark, lambda c: t.diagnosis_lines(c, "(?i)^discharge diagnos[ie]s:?", "(?i)^discharge condition"), text, "none", "") == [["A", "B"], [], []]


def test_paths(spark):
    assert values(spark, lambda c: t.docket_of_path(c, "/V/s"), "/V/s/123/a.pdf", "dbfs:/V/s/9/a/b.pdf", "/V/s/x/a.pdf") == ["123", "9", None]
    assert values(spark, t.volume_path, "C:\\a\\\\b.pdf", "dbfs:/Volumes/a") == ["/a/b.pdf", "/Volumes/a"]


def test_year_bounds(spark):
    rows = spark.createDataFrame([("2017 - 2019", 1), ("2011", 0), ("none", 0), (None, 0)], "g string, o int")
    first, last = t.year_bounds(F.col("g"), F.col("o"))
    assert [tuple(r) for r in rows.select(first, last).collect()] == [(2018, 2020), (2011, 2011), (None, None), (None, None)]


def test_snippet(spark):
    text = "x" * 200 + "needle" + "y" * 400
    got = values(spark, lambda c: t.snippet(c, F.lit("absent"), F.lit("needle")), text, "short", "")
    assert "needle" in got[0] and len(got[0]) == 340 and got[1:] == ["short", ""]
