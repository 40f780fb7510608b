from pyspark.sql import functions as F

from paperloom.operators import hierarchy, manuals


def pages(spark, *texts):
    return spark.createDataFrame([("m.pdf", i, t) for i, t in enumerate(texts, 1)], "source_path string, page int, text string")


def test_guideline_chunks(spark):
    p = pages(spark, "front\nSection I Conventions\n1. Chapter 1: Infections\na. First rule\nline one\nline two", "line three\nb. Empty\nSection II Other\nnot kept\nc. Last\nend")
    got = manuals.guideline_chunks(p).orderBy("semantic_path").collect()
    assert [(r.chunk_title, r.semantic_path) for r in got] == [("a. First rule", "Section I Conventions > 1. Chapter 1: Infections > a. First rule"), ("c. Last", "Section II Other > c. Last")]
    assert got[0].text.endswith("line one\nline two\nline three") and "Top heading: Section I Conventions" in got[0].text


def test_ussg_chunks(spark):
    p = pages(spark, "CHAPTER TWO\nGuidelines Manual (November 1, 2020)\nPART A\n12\n§2A1.1. Murder\nbase text\nCommentary\nnote text", "*\nmore note\nPART B\norphan\n§2B1.1\nsecond")
    got = {(r.chunk_title, r.citation): r.text for r in manuals.ussg_chunks(p, 2020).collect()}
    assert set(got) == {("§2A1.1. Murder", "§2A1.1."), ("§2A1.1. Murder - Commentary", "§2A1.1."), ("§2B1.1", "§2B1.1")}
    assert got["§2A1.1. Murder - Commentary", "§2A1.1."].endswith("Subsection: Commentary\n\nnote text\nmore note")


HTML = """<h1 class="usc-title-head">TITLE 18</h1><h2 class="part-head">PART I</h2><h3 class="chapter-head">CHAPTER 1</h3>
<h4 class="section-head">§ 1. First</h4><p>body one</p><h4 class="section-head">§ 2. Empty</h4><h5 class="x">no heading level</h5>
<h3 class="chapter-head">CHAPTER 2</h3><h4 class="section-head">§ 3. Third</h4>text<h4 class="note-head">Notes</h4>lost
<h2 class="part-head">PART II</h2><h4 class="section-head">§ 4. Fourth</h4>four"""


def test_title18(spark):
    p = spark.createDataFrame([("t.html", HTML), ("empty.html", "")], "source_path string, html string")
    got = [(r.part_heading, r.chapter_heading, r.heading, r.body) for r in manuals.title18_sections(p).orderBy("ord").collect()]
    assert got == [("PART I", "CHAPTER 1", "§ 1. First", "body one"), ("PART I", "CHAPTER 1", "§ 2. Empty", "no heading level"), ("PART I", "CHAPTER 2", "§ 3. Third", "text"), ("PART II", None, "§ 4. Fourth", "four")]
    chunks = {r.chunk_title: r for r in manuals.title18_chunks(p, 2020).collect()}
    assert chunks["§ 3. Third"].citation == "18 U.S.C. § 3" and chunks["§ 3. Third"].semantic_path == "TITLE 18 > PART I > CHAPTER 2 > § 3. Third"
    structure = manuals.title18_structure(p)
    asked = spark.createDataFrame([(1, "chapter-1"), (2, "chapter-9")], "request_id int, chapter_id string")
    assert sorted((r.request_id, r.status, r.section_count) for r in manuals.open_chapters(structure, asked).collect()) == [(1, "found", 2), (2, "not_found", None)]


def test_appendix(spark):
    p = pages(spark, "18 U.S.C. § 1 before\n2A1.1", "APPENDIX A\n18 U.S.C. § 2\nheading\n2A1.1, 2B1.1 2A1.1\n2C1.1\n18 U.S.C. § 3\n18 U.S.C. § 4\n2D1.1", "2E1.1\n18 U.S.C. § 2\n2A1.1, 2B1.1", "INDEX TO GUIDELINES MANUAL\n18 U.S.C. § 9\n2Z1.1")
    got = {(r.statute_citation, tuple(r.guideline_sections)) for r in manuals.appendix_entries(p, 2020).collect()}
    assert got == {("18 U.S.C. § 2", ("2A1.1", "2B1.1")), ("18 U.S.C. § 4", ("2D1.1",))}


def test_contents(spark):
    p = pages(spark, "title page", "TABLE OF CONTENTS\nCHAPTER ONE\nIntroduction ....3\nPART A - General\nPrinciples 4\n1. Basics\n|5\n2. More on\nbasics ...... 6", "iv\nCHAPTER TWO\nOffenses\nPART B — Theft 9", "§1A1.1 Authority\nCHAPTER THREE")
    got = [(r.chapter, r.title, r.part, r.subheading) for r in manuals.table_of_contents(p).orderBy("chapter_ord", "part_ord", "sub_ord").collect()]
    assert got == [
        ("CHAPTER ONE", "Introduction", None, None),
        ("CHAPTER ONE", "Introduction", "PART A - General Principles", None),
        ("CHAPTER ONE", "Introduction", "PART A - General Principles", "1. Basics"),
        ("CHAPTER ONE", "Introduction", "PART A - General Principles", "2. More on basics"),
        ("CHAPTER TWO", "Offenses", None, None),
        ("CHAPTER TWO", "Offenses", "PART B — Theft", None),
    ]


def test_outline(spark):
    text = "Section I. Rules\nintro\nA. One\na text\n1. Deep\nd text\nB. Two\nb text\nSection II. Next\nn text"
    lines = hierarchy.lines_of(spark.createDataFrame([("g", text)], "doc string, text string"), "doc", "text")
    entries = manuals.outline(lines.select("doc", F.col("line").alias("ord"), F.col("text").alias("title")), "doc")
    assert [(r.alias, r.level) for r in manuals.list_outline(entries).collect()] == [("I", 0), ("I.A", 1), ("I.A.1", 2), ("I.B", 1), ("II", 0)]
    assert manuals.list_outline(entries, "section", 0, 1).count() == 1
    asked = spark.createDataFrame([(1, "I.A"), (2, "B. Two"), (3, "IX")], "request_id int, wanted string")
    got = {r.request_id: (r.found, r.text) for r in manuals.open_outline(entries, lines, asked, "doc").collect()}
    assert got == {1: (True, "A. One\na text\n1. Deep\nd text"), 2: (True, "B. Two\nb text"), 3: (False, None)}
