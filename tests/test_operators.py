import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks, citations, cohort, hierarchy, lookups, metrics, retrieval, review, selection, store, tree
from paperloom.functions import text as t
from paperloom.operators import orphans as o


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- problem 2


def brute(refs, parents):
    out = set()
    for table_name, row_id, key, at in refs:
        if key is None:
            continue
        own = [(a, b) for k, a, b in parents if k == key and a is not None]
        if not own:
            out.add((table_name, row_id, "missing"))
        elif at is not None and not any(a <= at and (b is None or at < b) for a, b in own):
            out.add((table_name, row_id, "deleted" if any(a <= at for a, _ in own) else "late"))
    return out


REFS = "table_name string, row_id long, key long, at string"


def frames(spark, refs, parents):
    r = spark.createDataFrame(refs, REFS).withColumn("at", F.to_timestamp("at"))
    p = spark.createDataFrame(parents, "key long, loaded_at string, withdrawn_at string")
    return r, p.withColumns({"loaded_at": F.to_timestamp("loaded_at"), "withdrawn_at": F.to_timestamp("withdrawn_at")})


def test_orphans_agree_with_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(o, "ROWS_PER_SALT", 7)
    rng = random.Random(5)
    when = lambda: f"2020-01-{rng.randint(1, 4):02d} {rng.randint(0, 23):02d}:{rng.choice(['00', '30'])}:00"
    parents = []
    for _ in range(60):
        a, b = sorted((when(), when()))
        parents.append((rng.choice([1, 1, 2, 3, 4]), a, rng.choice([None, b])))
    parents += parents[:5] + [(9, None, None), (None, when(), None)]
    refs = [("t", i, rng.choice([1, 1, 1, 2, 3, 4, 7, 9, None]), rng.choice([None] + [when() for _ in range(9)])) for i in range(300)]
    r, p = frames(spark, refs, parents)
    got = {(x.table_name, x.row_id, x.reason) for x in o.direct_orphans(r, p).collect()}
    assert got == brute(refs, parents)


def test_orphan_borders(spark):
    t = "2020-01-02 10:00:00"
    parents = [(1, t, "2020-01-03 10:00:00"), (2, t, t)]
    refs = [("a", 1, 1, t), ("a", 2, 1, "2020-01-02 09:59:59"), ("a", 3, 1, "2020-01-03 10:00:00"), ("a", 4, 2, t), ("a", 5, 8, t)]
    r, p = frames(spark, refs, parents)
    assert {(x.row_id, x.reason) for x in o.direct_orphans(r, p).collect()} == {(2, "late"), (3, "deleted"), (4, "deleted"), (5, "missing")}


def test_orphans_of_empty_tables(spark):
    r, p = frames(spark, [], [])
    assert o.direct_orphans(r, p).count() == 0
    r, p = frames(spark, [("a", 1, 1, None)], [])
    assert rows(o.direct_orphans(r, p).select("row_id", "reason")) == [(1, "missing")]


def test_cascade_reaches_its_fixpoint(spark):
    direct = spark.createDataFrame([("a", 1, None, "missing")], "table_name string, row_id long, at timestamp, reason string")
    provides = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 1, "y"), ("b", 10, "z"), ("c", 20, "w")], "table_name string, row_id long, link string")
    uses = spark.createDataFrame([("b", 10, "x"), ("b", 11, "y"), ("c", 20, "z"), ("d", 30, "w"), ("d", 31, "nowhere"), ("d", 32, None)], "table_name string, row_id long, link string")
    all_ = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 10, None), ("b", 11, None), ("c", 20, None), ("d", 30, None), ("d", 31, None)], "table_name string, row_id long, at timestamp")
    got = {(x.table_name, x.row_id, x.inherited, x["round"]) for x in o.cascade(direct, provides, uses, all_).collect()}
    assert got == {("a", 1, False, 0), ("b", 10, True, 1), ("c", 20, True, 2), ("d", 30, True, 3)}


def test_docket_numbers(spark):
    df = spark.createDataFrame([(" 0012\t",), ("",), (None,), ("x1",), ("7",), ("\u00a08 ",)], "x string")
    assert [r[0] for r in df.select(o.docket_number(F.col("x"))).collect()] == [12, None, None, None, 7, 8]


# --- guards and selection


def test_columns_and_changes(spark):
    df = spark.createDataFrame([(1, "x")], "A int, b string")
    with pytest.raises(ValueError, match="c, d"):
        checks.require_columns(df, ["A", "d", "c"])
    assert checks.resolve_column(df, ["z", "a"]) == "A"
    assert checks.align(df, spark.createDataFrame([], "b string, q double")).columns == ["b", "q"]
    assert checks.add_missing(df, {"B": "int", "n": "int"}).columns == ["A", "b", "n"]
    lines = ["Add: A00.0 Cholera", "Revise from: B01 old", "Revise to: B01 new", "Revise from: C01 x", "Revise to: C02 y", "noise", "Delete:", "Revise from: D01 z"]
    changes = checks.change_lines(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, text string"))
    assert {(r.line, r.problem) for r in checks.unpaired_revisions(changes).collect()} == {(3, "mismatched"), (6, "no code"), (7, "unclosed")}
    assert {r.code for r in checks.touched_codes(changes).collect()} == {"A000", "B01", "C01", "C02", "D01"}


def test_selection_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"))
    for parts in (1, 5):
        x = df.repartition(parts)
        assert [r.id for r in selection.sample(x, ["id"], 10).collect()] == [r.id for r in selection.sample(df, ["id"], 10).collect()]
    assert selection.cap_per_group(df, ["g"], [F.col("id")], 2).count() == 14
    assert rows(selection.page(df, [F.col("id").desc()], 3, 2).select("id")) == [(496,), (495,)]
    with pytest.raises(ValueError):
        selection.page(df, [F.col("id")], -1)
    sizes = {r["count"] for r in selection.batches(df, ["id"], 32).groupBy("batch").count().collect()}
    assert sizes == {32, 500 % 32}


# --- cohort


def test_cohort(spark):
    admissions = spark.createDataFrame([(1, 10, "2101-05-01 00:00:00"), (1, 11, "2101-06-01 00:00:00"), (2, 20, None), (3, 30, "2100-01-01 00:00:00")], "subject_id long, hadm_id long, dischtime string")
    patients = spark.createDataFrame([(1, 2100, "2016 - 2018"), (2, 2100, "2016 - 2018"), (3, 2100, "none")], "subject_id long, anchor_year int, anchor_year_group string")
    dx = spark.createDataFrame([(1, 10, 2, "b.1", 10), (1, 10, 1, "a.1", 10), (1, 10, 1, "a.1", 10), (1, 10, None, "c", 10), (1, 11, 1, "x1", 10), (1, 11, 2, "a1", 10), (1, 12, 1, "z", 9), (1, None, 1, "q", 10)], "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int")
    notes = spark.createDataFrame([(10, "n2", 2, "second"), (10, "n1", 1, "first"), (None, "n0", 1, "x")], "hadm_id long, note_id string, note_seq int, text string")
    codes = spark.createDataFrame([("X1",)], "code string")
    d = cohort.diagnoses_of(dx)
    got = cohort.strict_cohort(admissions, patients, d, notes, codes, 2017, 2019).collect()
    assert [(r.hadm_id, r.note_id, r.output_icd_codes, r.real_discharge_year_min) for r in got] == [(10, "n1", ["c", "a.1", "a.1", "b.1"], 2017)]
    assert {r.hadm_id for r in cohort.touched_admissions(d, codes).collect()} == {11}


# --- lookups and metrics


def test_lookup_statuses(spark):
    cases = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "docket_id string")
    source = spark.createDataFrame([("1", 2010, "b"), ("1", 2010, None), ("2", 2010, "c"), ("2", 2011, "d")], "docket_id string, year int, document_id string")
    years = spark.createDataFrame([("3", 2012), ("3", None)], "docket_id string, sentencing_year int")
    assert rows(lookups.case_year(cases, source, years).select("docket_id", "case_year", "document_id", "status"), "docket_id") == [("1", 2010, "b", "matched"), ("2", None, None, "ambiguous"), ("3", 2012, None, "mapped"), ("4", None, None, "missing")]
    values = spark.createDataFrame([("1", 2010, True), ("1", 2011, False), ("2", 2010, True), ("2", 2010, False), ("3", 2009, True), ("4", 2010, None)], "docket_id string, year int, value boolean")
    asked = spark.createDataFrame([("1", 2010), ("1", 2015), ("2", 2010), ("3", 2010), ("4", 2010)], "docket_id string, year int")
    assert rows(lookups.resolve_value(asked, values).select("docket_id", "year", "value", "status"), "docket_id", "year") == [("1", 2010, True, "exact"), ("1", 2015, None, "docket_conflict"), ("2", 2010, None, "exact_conflict"), ("3", 2010, True, "docket"), ("4", 2010, None, "missing")]


def test_set_metrics_edges(spark):
    data = [(1, ["A", "A", "B"], ["B", "C"]), (2, [], ["A"]), (3, ["A"], []), (4, [], []), (5, None, ["A"]), (6, ["B", "A"], ["A", "B"])]
    got = rows(metrics.set_metrics(spark.createDataFrame(data, "k int, predicted array<string>, expected array<string>")).select("k", "precision", "recall", "exact_match", "primary_match"), "k")
    assert got == [(1, 0.5, 0.5, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0, 0.0), (5, 0.0, 0.0, 0.0, 0.0), (6, 1.0, 1.0, 1.0, 0.0)]


def test_summary_without_ok_rows(spark):
    df = spark.createDataFrame([("error", None)], "status string, precision double")
    assert rows(metrics.macro_summary(df, ["precision"])) == [(1, 0, 1, 0.0)]
    levels = spark.createDataFrame([(1, " 12 ", "12"), (2, None, "12"), (3, "12", " "), (4, "0", "0")], "k int, p string, e string")
    assert rows(metrics.level_match(levels, "p", "e").select("k", "exact_match", "answered"), "k") == [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 1.0), (4, 1.0, 1.0)]


def test_budget_and_tools(spark):
    assert metrics.budget_exhausted(spark, "hadm_id", 5).first().error == "step budget exhausted"
    calls = spark.createDataFrame([(1, ["a", "b"]), (1, None), (2, [])], "run int, tool_calls array<string>")
    assert rows(metrics.tool_calls(calls, "run"), "run") == [(1, 2), (2, 0)]


# --- hierarchy


def mirror_split(text, limit):
    if len(text) <= limit:
        return [text]
    blocks = [b.strip() for b in text.split("\n\n") if b.strip()]
    pieces, current, size = [], [], 0
    for b in blocks:
        if current and size + len(b) + 2 > limit:
            pieces.append("\n\n".join(current))
            current, size = [b], len(b)
        else:
            current.append(b)
            size += len(b) + 2
    return pieces + (["\n\n".join(current)] if current else []) or [text]


def test_split_greedy_agrees_with_its_rule(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bb", " ", "\n\n", "\n", "ccc ccc"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "x" * 100, "\n\n" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    for r in df.select("x", hierarchy.split_greedy(F.col("x"), 20).alias("p")).collect():
        assert list(r.p) == mirror_split(r.x, 20)


def test_headings_reset_inner_levels(spark):
    text = "front\nCHAPTER ONE\nintro\nPART A\n§1\nbody1\nCHAPTER TWO\nx\n§2\nPART B\nbody2"
    lines = hierarchy.lines_of(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    grammar = [("chapter", F.col("text").startswith("CHAPTER")), ("part", F.col("text").startswith("PART")), ("section", F.col("text").startswith("§"))]
    headed = hierarchy.with_headings(lines, "k", grammar)
    got = rows(hierarchy.sections(headed, "k", ["chapter", "part", "section"]).select("first_line", "chapter", "part", "section", "body"), "first_line")
    assert got == [(1, None, None, None, "front"), (3, "CHAPTER ONE", None, None, "intro"), (6, "CHAPTER ONE", "PART A", "§1", "body1"), (8, "CHAPTER TWO", None, None, "x"), (11, "CHAPTER TWO", "PART B", None, "body2")]


def test_html_headings(spark):
    html = '<h1 class="usc-title-head">T&amp;1</h1>a<h2 class="part-head">P</h2><p>b</p><h5 class="x">no</h5><h4 class="section-head">§ 1. S</h4> c <b>d</b>'
    got = rows(hierarchy.html_headings(spark.createDataFrame([(1, html), (2, ""), (3, "no heading")], "k int, h string"), "k", "h"), "k", "ord")
    assert [(r[2], r[3], r[4], r[5]) for r in got] == [(1, "usc-title-head", "T&1", "a"), (2, "part-head", "P", "b\n\nno"), (4, "section-head", "§ 1. S", "c d")]


def test_chunks_and_header_block(spark):
    df = spark.createDataFrame([("u", "D", "T", "a > b", "p", "x" * 15 + "\n\n" + "y" * 15), ("u", "D", "S", "a > c", "p", "short")], "source_type string, document_title string, chunk_title string, semantic_path string, source_path string, text string")
    got = hierarchy.to_chunks(df, 20).orderBy("text").collect()
    assert [(r.chunk_title, r.text) for r in got] == [("S", "short"), ("T (part 1)", "x" * 15), ("T (part 2)", "y" * 15)] and len({r.chunk_id for r in got}) == 3
    head = spark.range(1).select(hierarchy.header_block({"Document": F.lit("D"), "Part": F.lit(" "), "Section": F.lit(None).cast("string"), "Chapter": F.lit("C")}).alias("h"))
    assert head.first().h == "Document: D\nChapter: C"


def test_merge_citations(spark):
    blocks = spark.createDataFrame([(1, 1, "§1", "first", None, "a"), (1, 3, "§1", "later", "Commentary", "c"), (1, 2, "§2", "h2", None, "b")], "k int, ord int, citation string, heading string, subheading string, text string")
    got = hierarchy.merge_citations(blocks, "k").orderBy("ord").collect()
    assert [(r.citation, r.heading, [b.text for b in r.blocks]) for r in got] == [("§1", "first", ["a", "c"]), ("§2", "h2", ["b"])]


# --- trees and citations

XML = """<root><chapter><name>1</name><desc>Infections (A00-B99)</desc><includes><note>n1</note><note>n2</note></includes>
<section id="A00-A09"><desc>Intestinal</desc><diag><name>A00</name><desc>Cholera</desc><diag><name>A00.0</name><desc>classic</desc></diag><diag><name>A00.1</name><desc>eltor</desc></diag></diag></section></chapter></root>"""
INDEX = "<root><letter><title>A</title><mainTerm><title>Abscess</title><code>L02</code><term level='1'><title>of lung</title><code>J85</code></term></mainTerm><mainTerm><title>Acne</title><see>Skin</see></mainTerm></letter></root>"


def test_tree(spark):
    files = spark.createDataFrame([("tab", XML), ("idx", INDEX), ("bad", "<x")], "doc_id string, content string")
    nodes = tree.parse_xml(files).cache()
    assert nodes.where("tag = 'error'").count() == 1
    chapter = nodes.where("tag = 'chapter'").first()
    assert chapter.notes["includes"] == ["n1", "n2"] and chapter.depth == 0
    asked = spark.createDataFrame([(1, "a000"), (2, "A00.7")], "request_id int, code string")
    got = {r.request_id: r for r in tree.open_codes(nodes, asked).collect()}
    assert got[1].found and [a.name for a in got[1].ancestors] == ["1", "A00-A09", "A00"] and got[1].suggestions is None
    assert not got[2].found and got[2].suggestions == ["A00", "A00.0", "A00.1"]
    assert [(r.entry_id, r.child_count) for r in tree.list_main_terms(nodes, "a").collect()] == [("A|Abscess", 1), ("A|Acne", 0)]
    with pytest.raises(ValueError):
        tree.list_main_terms(nodes, "ab")
    assert [(r.chapter_id, r.code_range, r.section_count) for r in tree.list_chapters(nodes, "A").collect()] == [("1", "A00-A09", 1)]
    opened = tree.open_nodes(nodes, spark.createDataFrame([(nodes.where("name = 'A00'").first().node_id,), ("none",)], "node_id string")).collect()
    assert sorted((r.found, r.n_children) for r in opened if r.found) == [(True, 2)] and not all(r.found for r in opened)
    text = tree.render(nodes, nodes.where("title = 'Abscess'")).first().text
    assert text == "Abscess (code=L02)\nof lung (code=J85)"


def test_opened_nodes_stay_off_the_driver(spark, tmp_path):
    # small files that become many nodes: neither nodes nor requests are broadcast, and the documents are parsed once
    from paperloom.plans import surface_queries

    kids = "".join(f"<diag><name>A{i}</name><desc>kid {i}</desc></diag>" for i in range(100))
    content = f"<t><chapter><name>1</name><desc>Ch</desc><section id='s'><desc>Sec</desc><diag><name>A</name><desc>top</desc>{kids}</diag></section></chapter></t>"
    spark.range(20).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(content).alias("content")).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([("d3/0/0/0",), ("d3/0/0/0",), ("d4/0",), ("d5/0/0/0/99",), ("none",), (None,)], "node_id string").write.parquet(f"{tmp_path}/asked.parquet")
    opened = tree.open_nodes(tree.parse_xml(spark.read.parquet(f"{tmp_path}/files.parquet")), spark.read.parquet(f"{tmp_path}/asked.parquet"))
    got = {(r.node_id, r.found, r.title, r.n_children, tuple(a.title for a in r.ancestors or ()), len(r.children or ()), r.children_truncated, r.n_descendants, len(r.descendants or ()), r.descendants_truncated) for r in opened.collect()}
    assert opened.count() == 6 and got == {
        ("d3/0/0/0", True, "top", 100, ("Ch", "Sec"), 40, True, 100, 80, True),
        ("d4/0", True, "Ch", 1, (), 1, False, 101, 80, True),
        ("d5/0/0/0/99", True, "kid 99", None, ("Ch", "Sec", "top"), 0, False, None, 0, False),
        ("none", False, None, None, (), 0, False, None, 0, False),
        (None, False, None, None, (), 0, False, None, 0, False),
    }
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" not in plan
    spark.range(50).selectExpr("id AS c_custkey", "'a' AS c_name", "1 AS c_nationkey", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(500).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "'F' AS o_orderstatus", "'1' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    entries = surface_queries._entries(spark, str(tmp_path))
    assert entries.count() == 50 and "Broadcast" not in entries._jdf.queryExecution().executedPlan().toString()


def test_citation_tiers(spark):
    entries = spark.createDataFrame([("e1", "18 U.S.C. § 924(c)"), ("e2", "18 U.S.C. § 9245"), ("e3", "18 U.S.C. § 1546"), ("e4", "21 U.S.C. § 841")], "entry_id string, statute_citation string")
    asked = spark.createDataFrame([(1, "18 U.S.C. § 924(c)"), (2, "18 USC 924"), (3, "1546"), (4, "18 U.S.C. § 1"), (5, "")], "request_id int, query string")
    got = rows(citations.match_statutes(asked, entries), "request_id", "entry_id")
    assert got == [(1, 1, "e1"), (2, 2, "e1"), (3, 3, "e3")]
    sections = spark.createDataFrame([("s1", 2024, "§2K2.1", "§2K2.1. Firearms", [("", "base (b)(1) text"), ("Commentary", "note")])], "entry_id string, source_year int, citation string, section_heading string, blocks array<struct<subheading:string,text:string>>")
    looked = {r.request_id: r for r in citations.lookup_guideline(sections, spark.createDataFrame([(1, "§2k2.1(b)(1)?"), (2, "hello"), (3, "2B1.1")], "request_id int, query string")).collect()}
    assert looked[1].status == "found" and looked[1].subsection == "(b)(1)" and looked[1].text_length == len("base (b)(1) text\n\nCommentary\nnote")
    assert looked[2].status == "unsupported_query" and looked[3].status == "not_found"
    prefixes = spark.createDataFrame([("2K", "§2K"), ("2", "§2K2")], "id string, prefix string")
    assert citations.by_prefix(prefixes, sections).count() == 2


# --- retrieval


def test_nearest_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[10] = v[11]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "chunk_id int, content_vector array<float>")
    queries = df.where("chunk_id in (10, 20)").withColumnRenamed("chunk_id", "query_id")
    n = v.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for q in (10, 20):
        want = sorted(range(60), key=lambda i: (-round(float(n[q] @ n[i]), 12), i))[:5]
        assert [r.chunk_id for r in retrieval.nearest(df, queries, 5).where(f"query_id = {q}").orderBy("rank").collect()] == want
    assert retrieval.nearest(df, queries.limit(0)).count() == 0
    assert retrieval.clamp_k(None) == 8 and retrieval.clamp_k(50) == 8 and retrieval.clamp_k(0) == 1


def test_bm25_edges(spark):
    index = spark.createDataFrame([(1, "fire arms"), (2, "fire"), (3, None), (4, "")], "chunk_id int, text string")
    got = rows(retrieval.bm25(index, spark.createDataFrame([(1, "Fire!"), (2, "water"), (3, None)], "query_id int, query string")).select("query_id", "chunk_id", "rank"), "rank")
    assert got == [(1, 2, 1), (1, 1, 2)]


# --- store and review

DECISIONS = "docket_id string, reviewer_name string, claim_status string, claim_token string, claimed_at_utc string, updated_at_utc string, review_version int, review_decision string, review_notes string, verification_json string"


def test_upserts_are_idempotent(spark, tmp_path):
    final = "docket_id string, review_version int, generated_at_utc string, level int, approved boolean, review_decision string, reviewed_at_utc string, approved_by string"
    target = spark.createDataFrame([("1", None, "g0", 5, True, "approved", "t", "me"), ("2", 1, "g0", 6, False, None, None, None)], final)
    source = spark.createDataFrame([("1", 0, "g1", 7, False, None, None, None), ("3", 0, "g1", 8, False, None, None, None)], final)
    once = store.upsert(target, source)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, source).collect())) and once.count() == 3
    kept = {r.docket_id: r for r in store.upsert_preserving(target, source).collect()}
    assert kept["1"].approved and kept["1"].level == 7 and kept["1"].generated_at_utc == "g0" and kept["3"].approved is False and kept["2"].level == 6
    with pytest.raises(ValueError):
        store.require_unique(source.unionByName(source))
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.commit(target, 0) == 1
    t.change(lambda df: store.upsert(df, source))
    assert t.current() == 2 and t.read().count() == 3
    with pytest.raises(store.Conflict):
        t.commit(target, 1)
    waits = []
    with pytest.raises(store.Conflict):
        store.retry(lambda: (_ for _ in ()).throw(store.Conflict()), sleep=waits.append)
    assert waits == [0.25, 0.5, 0.75, 1.0]


def test_claims_and_carry_forward(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    reviews = spark.createDataFrame(
        [("1", "a", "claimed", "t1", "2024-01-01T11:50:00Z", "u", 1, None, None, None), ("2", "b", "claimed", "t2", "2024-01-01T10:00:00Z", "u", 1, None, None, None), ("3", "c", "completed", "t3", None, "u", 0, "Approved", None, "{}"), ("3", "c", "completed", "t3", None, "v", 2, "rejected", None, None)], DECISIONS
    )
    artifacts = spark.createDataFrame([("1", "q", 1, " Supported", 9), ("2", "q", 1, "supported", 0), ("3", "q", 1, "supported", 1), ("4", "q", 1, "supported", 1), ("5", "q", None, "supported", 1), ("6", "q", 1, "no", 1), ("7", "q", 1, "supported", None)], "docket_id string, queue_label string, review_version int, docket_support_status string, final_total_offense_level int")
    assert {r.docket_id for r in review.review_queue(artifacts, reviews, 1, supported_only=False).collect()} == {"1", "2", "3", "4", "6"}
    queue = review.review_queue(artifacts, reviews, 1)
    got = {r.docket_id: r for r in queue.collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["3"].review_carried_forward and got["3"].review_decision == "rejected" and got["4"].claim_status is None
    assert {r.docket_id for r in review.claimable(queue, "other", now).collect()} == {"2", "4"}
    assert {r.docket_id for r in review.claimable(queue, "t1", now).collect()} == {"1", "2", "4"}
    assert review.claim_next(queue, "other", "me", now).first().claim_status == "claimed"
    asked = lambda *pairs: spark.createDataFrame(pairs, "docket_id string, claim_token string")
    freed = {(r.docket_id, r.review_version): r for r in review.release(reviews, asked(("1", "t9"), ("2", "t9"), ("3", "t9"), ("4", " ")), 1, now).collect()}
    assert freed["1", 1].claim_status == "claimed"  # held by another token
    assert freed["2", 1].claim_status == "available" and freed["2", 1].claim_token == "" and freed["2", 1].updated_at_utc == "2024-01-01T12:00:00+00:00" and freed["2", 1].verification_json == ""
    assert freed["3", 0].review_decision == "Approved" and freed["3", 2].review_decision == "rejected"  # other versions
    again = {(r.docket_id, r.review_version): r for r in review.release(reviews, asked((" 1 ", "t1"), ("3", "x")), 2, now).collect()}
    assert again["1", 1].claim_status == "claimed" and again["3", 2].review_decision == "" and again["3", 2].claim_status == "available"
    assert [r.approved_by for r in review.completed(reviews).collect()] == ["c", "c"]


def test_final_records(spark):
    import json

    def artifact(level=12, strength="strong", included=True, facts=("A  b", "a b", "the total offense level is 3", "")):
        return json.dumps({"docket_support_status": "Supported", "queue_label": "ready_for_review", "case_facts": [{"fact": f} for f in facts], "offense_level_steps": [{"included_in_total_offense_level": included, "support_strength": strength}], "final_total_offense_level": level})

    raw = [("1", "```json\n" + artifact() + "\n```"), ("2", artifact(strength=" Weak ")), ("3", artifact(level=None)), ("4", artifact(facts=("",))), ("5", "no json"), ("6", artifact(strength="weak", included=False)), ("7", artifact(level=0))]
    df = spark.createDataFrame([(k, "t", None, "r", a) for k, a in raw], "docket_id string, generated_at_utc string, review_version int, source_run_id string, answer string")
    records = review.artifact_records(df)
    assert records.count() == 6 and records.first().review_version == 0
    got = {r.docket_id: r for r in review.final_records(records, ["total offense level is"]).collect()}
    assert set(got) == {"1", "6", "7"} and got["1"].input_case_facts_text == "- A b" and got["7"].ground_truth_offense_level == 0


def test_export_status(spark):
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "source_pdf_path string")
    done = spark.createDataFrame([("a", 3, 9)], "source_pdf_path string, page_count int, content_length int")
    bad = spark.createDataFrame([("b", "E", "m")], "source_pdf_path string, error_type string, error_message string")
    assert rows(review.export_status(s, done, bad).select("source_pdf_path", "status"), "source_pdf_path") == [("a", "skipped_existing"), ("b", "failed"), ("c", "exported")]


def test_more_queries_than_a_block(spark, monkeypatch):
    from paperloom.operators import retrieval

    rows = [(i, f"w{i % 5} w{i % 7} x", [float(i % 5), 1.0, float(i % 7)]) for i in range(30)]
    index = spark.createDataFrame(rows, "chunk_id long, text string, content_vector array<float>")
    asked = index.where("chunk_id < 9").selectExpr("chunk_id AS query_id", "text AS query", "content_vector")
    searches = (lambda: retrieval.nearest(index, asked, 3), lambda: retrieval.bm25(index, asked, 3))
    rounded = lambda df: {(r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in df.collect()}
    whole = [rounded(f()) for f in searches]
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    assert [rounded(f()) for f in searches] == whole and all(len(x) == 27 for x in whole)


def test_orphans_on_deep_chains(spark):
    import inspect

    import pytest

    from paperloom.operators import orphans

    n = 4
    rows = spark.range(n).selectExpr("'t' AS table_name", "id AS row_id", "timestamp'2020-01-01' AS at")
    provides, uses = rows.selectExpr("table_name", "row_id", "row_id AS link"), rows.where("row_id > 0").selectExpr("table_name", "row_id", "row_id - 1 AS link")
    direct = rows.where("row_id = 0").selectExpr("*", "'missing' AS reason")
    assert sorted(r["round"] for r in orphans.cascade(direct, provides, uses, rows).collect()) == list(range(n))
    assert inspect.signature(orphans.cascade).parameters["max_rounds"].default is None
    with pytest.raises(RuntimeError):
        orphans.cascade(direct, provides, uses, rows, max_rounds=2)


def test_merged_facts_keep_other_fields(spark):
    import json

    old = {"kept": {"deep": [1, {"x": None}]}, "case_facts": [{"fact": "old"}], "n": 1.5, "text": "a\nb"}
    df = spark.createDataFrame([(json.dumps(old), '[{"fact": "new"}]'), (json.dumps({"a": 1}), None), ("no json", "[]")], "a string, f string")
    got = [r[0] for r in df.select(review.merge_facts(F.col("a"), review.facts_of(F.col("f")))).collect()]
    first = json.loads(got[0])
    assert first["kept"] == old["kept"] and first["n"] == 1.5 and first["text"] == "a\nb" and [f["fact"] for f in first["case_facts"]] == ["new"]
    assert json.loads(got[1]) == {"a": 1, "case_facts": []} and got[2] is None


def test_release_order_is_by_version(spark):
    final = spark.createDataFrame([("1", "old", 5, 1, "2024-02-01", "u", "g", "r"), ("1", "new", 6, 2, "2024-01-01", "u", "g", "r")], "docket_id string, input_case_facts_text string, ground_truth_offense_level int, review_version int, reviewed_at_utc string, updated_at_utc string, generated_at_utc string, source_run_id string")
    said = spark.createDataFrame([("1", "Approved ")], "docket_id string, review_decision string")
    assert tuple(review.approved_release(final, said).first()) == ("1", "new", 6)


def test_case_texts_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(str(d), f"{i:03}", rng.choice([None, "", f"f{i}"]), rng.choice([None, f"/p/{i}"]), rng.choice([None, " ", "word " * rng.randint(0, 40), "a" + " " * 60 + "b", "\n\nx\n"])) for d in range(30) for i in range(rng.randint(1, 9))]

    def plain(docs, most):
        parts, used = [], 0
        for i, (_, doc, name, path, text) in enumerate(docs, 1):
            block = f"Document {i}: {name or doc}\nSource PDF: {path or 'unknown'}\nFull text:\n{(text or '').strip()}".strip()
            if most is not None:
                if most - used <= 0:
                    break
                if len(block) > most - used:
                    block = block[: most - used].rstrip()
            parts.append(block)
            used += len(block) + 2
        return "\n\n".join(parts).strip()

    df = spark.createDataFrame(rows, "docket_id string, document_id string, source_file_name string, source_pdf_path string, text string")
    for most in (None, 1, 37, 150, 400):
        got = {r.docket_id: r.text for r in review.case_texts(df, most).collect()}
        assert got == {d: plain([r for r in rows if r[0] == d], most) for d in {r[0] for r in rows}}


def test_salted_joins_are_plain_joins(spark, monkeypatch):
    from paperloom.operators import skew

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "k string, v int")
    salts = skew.salts_for(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], rows_per_salt=20)
    for how in ("inner", "left", "left_semi", "left_anti"):
        names = ["i", "k", "v"] if how in ("inner", "left") else ["i", "k"]
        assert sorted(map(str, skew.salted_join(left, right, ["k"], how, salts).select(names).collect())) == sorted(map(str, left.join(right, "k", how).select(names).collect()))
    assert skew.salted_join(left.limit(0), right, ["k"]).count() == 0


def test_long_chains_of_orphans(spark):
    n = 60
    direct = spark.createDataFrame([("t", 0, None, "missing")], "table_name string, row_id long, at timestamp, reason string")
    provides = spark.createDataFrame([("t", i, f"l{i}") for i in range(n)], "table_name string, row_id long, link string")
    uses = spark.createDataFrame([("t", i, f"l{i - 1}") for i in range(1, n)] + [("t", 3, "nowhere"), ("t", 4, None)], "table_name string, row_id long, link string")
    every = provides.select("table_name", "row_id", F.lit(None).cast("timestamp").alias("at"))
    from paperloom.operators import orphans

    assert orphans.cascade(direct, provides, uses, every).agg(F.max("round"), F.count("*")).first() == (n - 1, n)
    assert [tuple(r) for r in orphans.unprovided(provides, uses, every).select("row_id", "link").collect()] == [(3, "nowhere")]


def test_entities_as_the_standard_library_reads_them(spark):
    import html

    texts = ["&#8217;&eacute;&nbsp;x", "&amp;lt; &lt &copy2 &#x41;&#65 &#0; &#128; &#xD800; &#x110000; &bogus; & &;", "no entity", "&#99999999999999999999;&notit; &notin; &sect", "&#x1F600;&CounterClockwiseContourIntegral;", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(t.unescape(F.col("x"))).collect()] == [None if x is None else html.unescape(x) for x in texts]


def test_chunks_of_trees(spark):
    xml = """<t><introduction><introSection><title>T  L</title></introSection></introduction><chapter><name>1</name><desc>Ch</desc><section id="A"><desc>Sec</desc>
      <diag><name>A00</name><desc>Cholera</desc><excludes1><note>x</note><note>y</note></excludes1><sevenChrNote><note>z</note></sevenChrNote>
        <diag><name>A00.0</name><desc>one</desc><includes><note>i</note></includes><diag><name>A00.01</name><desc>deep</desc><includes><note>d</note></includes></diag></diag></diag>
      <diag><name>A01</name></diag></section></chapter></t>"""
    nodes = tree.parse_xml(spark.createDataFrame([("f.xml", xml)], "doc_id string, content string"))
    whole = {r.code: r for r in tree.tabular_chunks(nodes).collect()}
    assert set(whole) == {"A00", "A01"} and whole["A00"].document_title == "T L"
    assert whole["A00"].text == "Document: T L\nChapter: Ch\nSection: Sec\n\nA00 Cholera\nexcludes1: x | y\nsevenChrNote: z\nA00.0 one\n includes: i\nA00.01 deep\n includes: d"
    cut = {r.code: r for r in tree.tabular_chunks(nodes, 60).collect()}
    assert set(cut) == {"A00.0", "A01"} and cut["A00.0"].semantic_path == "Ch > Sec > A00 > A00.0" and cut["A00.0"].chunk_title == "A00 Cholera > A00.0 one"
    assert cut["A00.0"].text == "Document: T L\nChapter: Ch\nSection: Sec\nParent code: A00 Cholera\n\nA00.0 one\nincludes: i\nA00.01 deep\n includes: d"
    assert tree.tabular_chunks(nodes.limit(0)).count() == 0 and tree.index_chunks(nodes).count() == 0
    assert "excludes1: x | y" in tree.render(nodes, nodes.where("name = 'A00'")).first().text


def test_stages_and_selectors(spark):
    from paperloom.operators import evaluation as e

    items = spark.createDataFrame([(1, None), (2, "kept"), (3, None)], "i int, old string")

    def primary(row):
        if row["i"] == 3:
            raise ValueError("no")
        return "made"

    got = {r.i: r for r in e.two_stages(items, primary, lambda row: 1 / 0, "old").collect()}
    assert (got[1].artifact, got[1].facts_status, got[1].facts_error) == ("made", "error", "ZeroDivisionError: division by zero")
    assert (got[2].artifact, got[2].primary_status) == ("kept", "skipped") and (got[3].primary_error, got[3].facts_status, got[3].artifact) == ("ValueError: no", "skipped", None)
    strict = spark.createDataFrame([(2011, "2", "s", "9"), (None, "1", "t", "8"), (2010, "10", "u", "7"), (2010, "9", "v", "6"), (2010, "9", None, "6")], "year int, docket_id string, case_facts_summary string, offense_level_total string")
    assert [r.docket_id for r in e.legal_selectors(strict).collect()] == ["10", "9", "2", "1"]
    with pytest.raises(ValueError):
        e.legal_selectors(items)
    with pytest.raises(ValueError):
        e.experiment_views("none", items)
    assert e.prompt_fields(spark.createDataFrame([(" yes ", 1)], "acceptance_of_responsibility string, secret int")).first().asDict() == {"acceptance_of_responsibility": "yes"}


def test_best_rows_are_kept_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    scores = rng.integers(0, 5, (3, 400)).astype(float)  # full of ties
    keys = list(map(int, rng.permutation(400)))
    best = retrieval._Best(3, 8)
    for a in range(0, 400, 37):
        best.add(scores[:, a : a + 37], pa.array(keys[a : a + 37]))
        if a % 2:
            best.settle()
    out = best.batch(pa.array(["x", "y", "z"]), "key", "query", pa.int64()).to_pandas()
    for i, q in enumerate("xyz"):
        want = sorted(zip(-scores[i], keys))[:8]
        assert [(-s, k) for s, k in zip(out[out["query"] == q]["score"], out[out["query"] == q]["key"])] == want
    assert retrieval._Best(2, 3).batch(pa.array([1, 2]), "key", "query", pa.string()).num_rows == 0


def test_waiting_markers_of_contents():
    from paperloom.operators.manuals import _Contents

    c = _Contents()
    assert c.title(["Section I. Rules."]) == "Section I. Rules" and c.title(["7."]) is None and c.waiting == ["7."]
    assert c.title(["A.", "Chapter 1: X"]) == "A. Chapter 1: X" and c.waiting == []  # the chapter voids what waited longest
    assert c.title(["B.", "Chapter 2:"]) == "B. Chapter 2:" and c.title(["3)"]) is None
    assert c.title(["words", "more"]) == "3) words more" and c.title([]) is None and c.title(["plain"]) == "plain"
