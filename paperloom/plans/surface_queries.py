"""Readers, writers, guards, trees, navigation, scalar rules and evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.operators import checks, citations, evaluation, hierarchy, manuals, metrics, retrieval, review, selection, store, tree
from paperloom.plans import frames
from paperloom.plans.frames import REVIEW_SQL
from paperloom.plans.review_queries import LEAKY
from paperloom.plans.text_queries import _C, _chunks
from paperloom.session import scratch_path, table
from paperloom.sources import readers, writers

# --- readers and writers


def csv_read(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, commas and line breaks written as CSV and read back."""
    path = scratch_path(spark, "csv")
    rows = table(spark, d, "docket_review_input").dropDuplicates(["input_id"]).where("case_summary is not null and case_summary <> ''")
    rows.select("input_id", "case_summary").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.read_csv(spark, path, "input_id bigint, case_summary string", multiline=True)
    return back.select("input_id", F.md5(F.regexp_replace("case_summary", r"\r\n?", "\n")).alias("digest"))


def json_read(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as one JSON array per nation and read back."""
    path = scratch_path(spark, "json", ".json")
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("value"))
    rows.write.partitionBy("s_nationkey").text(path)
    return readers.read_table(spark, path, schema="s_suppkey bigint, s_name string, s_acctbal double").select("s_suppkey", "s_name", "s_acctbal")


def tsv_registered(spark: SparkSession, d: str) -> DataFrame:
    """A tab-separated table registered as a view; every column is text until cast."""
    path = scratch_path(spark, "tsv", ".tsv")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").write.option("header", True).option("sep", "\t").csv(path)
    readers.register(spark, path, "surface_customers")
    return checks.require_table(spark, "surface_customers").select(checks.optional(spark.table("surface_customers"), "c_custkey", "bigint").alias("c_custkey"), "c_mktsegment", F.col("c_nationkey").cast("int").alias("nation"), checks.optional(spark.table("surface_customers"), "absent", "string").alias("absent"))


def _exports(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Inputs written as exported documents, one folder per docket; every third without pages."""
    rows = frames.inputs(spark, d).where("docket_id is not null")
    page = F.struct(F.lit(1).alias("page_number"), F.coalesce("case_summary", F.lit("")).alias("text"))
    more = F.struct(F.lit(2).alias("page_number"), F.coalesce("source_run_id", F.lit("")).alias("text"))
    docs = rows.select("docket_id", F.concat(F.lit("s"), F.col("input_id").cast("string")).alias("source_file_name"), F.concat(F.lit("whole "), F.col("input_id").cast("string")).alias("full_text"), F.when(F.col("input_id") % 3 == 0, F.array().cast("array<struct<page_number:int,text:string>>")).otherwise(F.array(page, more)).alias("pages"))
    path = scratch_path(spark, "exports")
    writers.write_exports(docs.repartition(8, "docket_id"), path, rows.select("docket_id", "input_id"))
    return docs, path


def exports_pages(spark: SparkSession, d: str) -> DataFrame:
    _, path = _exports(spark, d)
    back = readers.read_exports(spark, f"{path}/documents", lines=True).withColumn("docket_id", F.col("docket_id").cast("string"))
    return readers.pages_of(back).select("docket_id", "source_file_name", "page", F.md5("text").alias("digest"))


def manifest_read(spark: SparkSession, d: str) -> DataFrame:
    _, path = _exports(spark, d)
    lines = spark.read.schema("docket_id string, input_id bigint").json(f"{path}/manifest_jsonl")
    sheet = readers.read_csv(spark, f"{path}/manifest_csv", "docket_id string, input_id bigint")
    return lines.join(sheet, ["docket_id", "input_id"])


def paths_listed(spark: SparkSession, d: str) -> DataFrame:
    """Files of an export by docket: how many dockets have files, and whether every listed one can be opened."""
    _, path = _exports(spark, d)
    found = readers.read_binary(spark, f"{path}/documents", "*.json", recursive=True).select(F.regexp_extract("path", r"docket_id=([0-9]+)/", 1).alias("docket_id"), F.col("length") > 0)
    return found.select("docket_id").distinct()


def years_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Per year folder the scanned file if there is one, else any other, the first by path."""
    paths = _chunks(spark, d).where("source_path is not null").select(F.concat(F.lit("/"), F.translate("source_path", "\\", "/")).alias("path")).distinct()
    return readers.resolve_years(paths, [r"\.pdf$", r"."])


def parquet_written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "written")
    writers.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    writers.write_parquet(table(spark, d, "orders").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus"), path, "append")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table with two commits: the artifacts of version 0, then an upsert of all."""
    a = frames.artifacts(spark, d).drop("case_facts")
    kept = store.VersionedTable(spark, scratch_path(spark, "versions"))
    kept.commit(a.where("review_version = 0").withColumn("queue_label", F.lit("old")), 0)
    kept.change(lambda now: store.upsert(now, a.where("review_version <> 2 or queue_label = 'ready_for_review'")))
    return kept.read().select("docket_id", "review_version", "queue_label")


def summary_row(spark: SparkSession, d: str) -> DataFrame:
    made = hierarchy.chunk_summary(hierarchy.enabled(_chunks(spark, d), {"usc_title18": True, "ussg": True, "memo": False}), 0.02)
    text = writers.summary_json(made)
    return spark.createDataFrame([(text,)], "j string").select(F.get_json_object("j", "$.n_chunks").cast("bigint").alias("n_chunks"), F.get_json_object("j", "$.tokens").cast("bigint").alias("tokens"))


# --- guards and change files


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Order lines written as lines of change files."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    verb = F.element_at(F.array(*(F.lit(x) for x in (" Add:", "Delete:", "Revise from:", "Revise to:", "Note:"))), (F.col("p") % 5 + 1).cast("int"))
    code = F.when(F.col("p") % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("f"), F.lit("0"), (F.col("l_orderkey") % 2).cast("string"), F.lit(".x tail")))
    return rows.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.concat(verb, code).alias("text"))


def changes_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return checks.unpaired_revisions(checks.change_lines(_changes(spark, d)))


def changes_touched(spark: SparkSession, d: str) -> DataFrame:
    return checks.touched_codes(checks.change_lines(_changes(spark, d)))


def columns_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Rows brought into another table's columns, with columns added that it lacks."""
    target = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("nation"))
    rows = checks.require_columns(table(spark, d, "supplier"), ["s_suppkey", "s_name"]).select(F.col("s_suppkey").cast("string").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("x").alias("other"))
    return checks.add_missing(checks.align(rows, target), {"c_extra": "int", "C_NAME": "string"})


# --- scalar rules


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Small rules over every input: blanks, first words, one line, curly quotes, paths, file names, numbers, blocks."""
    rows = frames.inputs(spark, d)
    raw = F.coalesce("case_summary", F.lit(""))
    number = F.when(F.col("input_id") % 3 == 0, F.concat(F.lit(" "), F.col("input_id").cast("string"), F.lit(" "))).when(F.col("input_id") % 3 == 1, "null").otherwise("12x")
    path = F.concat(F.lit("dbfs:\\Volumes//a\\"), F.col("input_id").cast("string"), F.lit(".docintel.json"))
    item = F.array(F.struct(F.col("input_id").alias("id"), F.col("docket_id").alias("docket"), F.lit("body").alias("text")))
    return rows.select(
        "input_id", t.blank_to_null(F.col("source_run_id")).alias("run"), t.first_token(F.concat(F.lit("  "), F.coalesce("source_run_id", F.lit("")), F.lit(" x"))).alias("first"), F.md5(t.one_line(raw)).alias("one_line"), t.guideline_text(F.concat(F.lit("“a”  ‘b’\n\n"), F.col("input_id").cast("string"))).alias("straight"), t.integer_text(number).alias("number"),
        t.volume_path(path).alias("path"), t.file_document_id(t.volume_path(path)).alias("document"), t.numbered_blocks(item, "id", "docket").alias("block"), t.bullets(F.array(F.lit("a"), F.col("input_id").cast("string"))).alias("bullets"), F.array_join(t.code_list(F.concat(F.lit(" a.b, "), F.col("input_id").cast("string"), F.lit(" | c")), clean=False), "/").alias("codes"),
        F.length(F.substring(raw, 1, 500)).alias("preview"), t.stale(F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("2020-01-01").cast("timestamp"), 45).alias("stale"),
    )


def messages_flat(spark: SparkSession, d: str) -> DataFrame:
    """Message contents as text: strings, lists of strings and of objects."""
    name = F.col("p_name")
    content = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.to_json(F.array(name, F.col("p_brand")))).otherwise(F.to_json(F.array(F.struct(name.alias("text")), F.struct(F.col("p_brand").alias("text")))))
    return table(spark, d, "part").select("p_partkey", t.flat_content(content).alias("text"))


def entities_read(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("&#8217;&eacute;&amp;lt;&#x41;&copy "), F.col("p_partkey").cast("string"), F.lit("&bogus; &&sect;"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", t.unescape(raw).alias("text"))


def headings_numbered(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*(F.lit(w.upper()) for w in t.CHAPTER_WORDS))
    k = F.col("p_partkey")
    chapter = F.concat(F.lit("CHAPTER "), F.element_at(words, (k % 10 + 1).cast("int")), F.lit(" - "), F.col("p_name"))
    part = F.when(k % 7 != 0, F.concat(F.lit("PART "), F.chr(65 + k % 26), F.lit(" - x")))
    return table(spark, d, "part").select("p_partkey", t.chapter_number(chapter).alias("chapter"), t.heading_prefix(chapter, part, F.concat((k % 9).cast("string"), F.lit(". y"))).alias("prefix"))


def empty_dropped(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.inputs(spark, d)
    nested = F.struct(F.col("source_run_id").alias("a"), F.array(F.lit(" "), F.col("docket_id")).alias("b"), F.create_map(F.lit("k"), F.when(F.col("input_id") % 2 == 0, "  ").otherwise(" v ")).alias("m"), F.struct(F.lit("").alias("x")).alias("s"))
    kind = rows.select(nested.alias("n")).schema["n"].dataType
    n = t.drop_empty(nested, kind)
    return rows.select("input_id", n["a"].alias("a"), F.array_join(n["b"], ",").alias("b"), n["m"]["k"].alias("k"), n["s"].isNull().alias("s_empty"))


# --- trees


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as an XML document of a tabular list: a chapter per segment, a section, the customer as an entry
    with notes, the customer's orders as entries below."""
    text = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    order = F.concat(F.lit("<diag><name>O"), F.col("o_orderkey").cast("string"), F.lit("</name><desc>order  "), F.col("o_orderstatus"), F.lit("</desc><includes><note>"), text("o_orderpriority"), F.lit("</note><note>n2</note></includes></diag>"))
    below = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("x")))), lambda o: o["x"]), "").alias("below"))
    head = F.concat(F.lit("<tabular><chapter><name>1</name><desc>"), text("c_mktsegment"), F.lit("</desc><section id=\"s\"><desc>Section "), F.col("c_nationkey").cast("string"), F.lit("</desc><diag><name>C"), F.col("c_custkey").cast("string"), F.lit("</name><desc>"), text("c_name"), F.lit("</desc><excludes1><note>not this</note></excludes1>"))
    joined = table(spark, d, "customer").join(below.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left")  # estimated without the length of its texts
    return joined.select(F.concat(F.lit("t/"), F.col("c_custkey").cast("string")).alias("doc_id"), F.concat(head, F.coalesce("below", F.lit("")), F.lit("</diag></section></chapter></tabular>")).alias("content"))


def tabular_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = tree.tabular_chunks(tree.parse_xml(_entries(spark, d)), 400)
    return made.select("chunk_id", "chunk_title", "semantic_path", "code", F.md5("text").alias("digest"), "estimated_tokens")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier as an XML document of an index: a letter, a main term with a code, a see reference and a term."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    name = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Abscess", "burn", "Cyst"))), (k % 3 + 1).cast("int")), F.lit(" "), k.cast("string"))
    term = F.concat(F.lit("<term level=\"1\"><title>acute "), F.col("s_nationkey").cast("string"), F.lit("</title><code>Z"), k.cast("string"), F.lit("</code></term>"))
    return s.select(F.concat(F.lit("i/"), k.cast("string")).alias("doc_id"), F.concat(F.lit("<index><title>INDEX</title><letter><title>L</title><mainTerm><title>"), name, F.lit("</title>"), F.when(k % 2 == 0, F.lit("<code>A1</code>")).otherwise(F.lit("<see>Other</see>")), F.when(k % 5 != 0, term).otherwise(F.lit("")), F.lit("</mainTerm></letter></index>")).alias("content"))


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = tree.index_chunks(tree.parse_xml(_terms(spark, d)), 80)
    return made.select("document_title", "chunk_title", "semantic_path", "code", "text")


def main_terms(spark: SparkSession, d: str) -> DataFrame:
    made = tree.list_main_terms(tree.parse_xml(_terms(spark, d)), "b", "burn")
    return made.select("entry_id", "code", "see", "child_count")


def chapters_listed(spark: SparkSession, d: str) -> DataFrame:
    made = tree.list_chapters(tree.parse_xml(_entries(spark, d)))
    return made.select("node_id", "chapter_id", "title", "section_count")


def nodes_opened(spark: SparkSession, d: str) -> DataFrame:
    """Every second customer opened by node, and one that does not exist."""
    nodes = tree.parse_xml(_entries(spark, d))
    asked = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("t/"), F.col("c_custkey").cast("string"), F.lit("/0/0/0")).alias("node_id")).unionByName(spark.createDataFrame([("none",)], "node_id string"))
    made = tree.open_nodes(nodes, asked)
    return made.select("node_id", "found", "title", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.array_join(F.transform("ancestors", lambda a: a["title"]), "/").alias("way"), "children_truncated")


def trees_rendered(spark: SparkSession, d: str) -> DataFrame:
    nodes = tree.parse_xml(_terms(spark, d))
    return tree.render(nodes, nodes.where("tag = 'mainTerm'")).select(F.split("node_id", "/")[1].alias("key"), "text")


# --- manuals and citations


def guideline_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunk texts as pages of coding guidelines with a heading of each level."""
    rows = _chunks(spark, d).where("text is not null")
    clean = F.regexp_replace("text", r"(?m)^\s*(?:Section [IVX]|\d+\.\s+Chapter\s+\d|[a-z]\.\s)", "-")
    page = F.concat(F.lit("Section II. Rules\n1. Chapter 1: First\na. Sub "), F.length("text").cast("string"), F.lit("\n"), clean)
    made = manuals.guideline_chunks(rows.select(F.col("chunk_id").alias("source_path"), F.lit(1).alias("page"), page.alias("text")), limit=10**9)
    return made.select("source_path", "chunk_title", "semantic_path")


def guideline_toc(spark: SparkSession, d: str) -> DataFrame:
    """Contents written from the regions' and nations' names, a manual per supplier, and read back."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    text = F.concat(F.lit("FY 2019\nSection I. "), F.col("n_name"), F.lit("\n3\nA.\n7.\nChapter 2: "), F.col("n_name"), F.lit("\n"), (k % 90 + 10).cast("string"), F.lit("\nmore words\nof it\n12\nno marker\n13\nPage 2 of 90\n"))
    made = manuals.guideline_contents(rows.select(k.alias("source_path"), F.lit(2).alias("page"), text.alias("text")))
    return made.select("source_path", "ord", "section_id", "title", "level", "target_page")


def outlines_listed(spark: SparkSession, d: str) -> DataFrame:
    """Outlines over order lines: levels, aliases and ends of the entries."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"))
    title = F.when(F.col("p") % 4 == 0, F.concat(F.lit("Section "), F.lit("IV"), F.lit(" x"))).when(F.col("p") % 4 == 1, F.concat(F.chr(64 + F.col("ord")), F.lit(". y"))).when(F.col("p") % 4 == 2, F.concat(F.col("ord").cast("string"), F.lit(". z"))).otherwise("none")
    made = manuals.outline(rows.select("l_orderkey", "ord", title.alias("title")), "l_orderkey")
    return made.select("l_orderkey", "ord", "level", "marker", "next_ord")


def sections_opened(spark: SparkSession, d: str) -> DataFrame:
    """Sections merged from the chunks' blocks and opened by citation in another spelling."""
    blocks = _chunks(spark, d).where("citation is not null").select(F.lit(1).alias("manual"), F.col("citation"), F.dense_rank().over(_by_id()).alias("ord"), F.col("chunk_title").alias("heading"), F.lit("").alias("subheading"), F.col("chunk_id").alias("text"))
    merged = hierarchy.merge_citations(blocks, "manual").withColumns({"entry_id": F.concat(F.lit("e|"), F.col("citation")), "section_heading": F.col("heading"), "source_year": F.lit(2018)})
    asked = merged.select(F.col("citation").alias("request_id"), F.upper(F.replace("citation", F.lit(" "), F.lit(""))).alias("citation")).unionByName(spark.createDataFrame([("?", "no such")], "request_id string, citation string"))
    made = citations.open_sections(merged, asked)
    return made.groupBy("request_id").agg(F.max("status").alias("status"), F.max(F.size("blocks")).alias("n_blocks"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("citation").orderBy("chunk_id")


def sections_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    sections = _chunks(spark, d).where("chunk_title rlike '^§[0-9][A-Z]'").select(F.col("chunk_id").alias("entry_id"), F.regexp_extract("chunk_title", r"^§(\S+)", 1).alias("citation"))
    heads = sections.select(F.substring("citation", 1, 3).alias("prefix")).distinct()
    return citations.by_prefix(heads, sections).groupBy("prefix").agg(F.count("*").alias("n"))


# --- searches, evaluation, review


def search_answers(spark: SparkSession, d: str) -> DataFrame:
    """Searches of every twentieth part over all parts: status, calls and numbers of hits."""
    parts = table(spark, d, "part")
    index = parts.select(F.col("p_partkey").alias("chunk_id"), F.element_at(F.array(*(F.lit(x) for x in retrieval.SOURCE_TYPES)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("source_type"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    k = F.col("p_partkey")
    asked = parts.where("p_partkey % 20 = 0").select((k % 7).alias("session_id"), k.alias("request_id"), F.when(k % 100 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("query_text"), F.lit("focused").alias("query_mode"), F.when(k % 3 == 0, (k % 12).cast("int")).alias("top_k"), F.when(k % 80 == 0, "other").when(k % 8 == 0, " Index ").alias("source_type"))
    made = retrieval.search_requests(index, asked)
    return made.select("request_id", "query_text", "top_k", "source_type", "status", "error_message", "call_count", "count")


def final_selected(spark: SparkSession, d: str) -> DataFrame:
    """Selectors of the final schema in their order, with the years of the map."""
    final = evaluation.final_dataset(frames.final_table(spark, d))
    years = table(spark, d, "sentencing_year_map").select("docket_id", "sentencing_year", "year_lookup_status")
    rows = evaluation.legal_selectors(final, years)
    keyed = rows.withColumn("key", evaluation.case_key(F.col("year"), F.col("docket_id")))
    return keyed.select("docket_id", "year", "case_summary", "expected_offense_level_total", "case_year_lookup_status", F.concat_ws("|", F.col("key.year").cast("string"), "key.docket_id").alias("key"))


def selectors_first(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred selectors: known years first, then the docket as text."""
    final = evaluation.final_dataset(frames.final_table(spark, d))
    years = table(spark, d, "sentencing_year_map").select("docket_id", "sentencing_year", "year_lookup_status")
    return evaluation.legal_selectors(final, years, limit=100).select("docket_id", "year")


def experiment_cases(spark: SparkSession, d: str) -> DataFrame:
    """What the review experiment reads: the release with its years."""
    views = evaluation.experiment_views("legal-react-style-tool-use", frames.final_table(spark, d), table(spark, d, "sentencing_year_map"), 3)
    safe = evaluation.prompt_fields(views["case_source"])
    assert safe.columns == list(evaluation.SAFE_FIELDS)
    return views["cases"].select("docket_id", "guideline_year", "input_case_fact_count", "ground_truth_offense_level", "review_version")


def stages_run(spark: SparkSession, d: str) -> DataFrame:
    """Two stages over every input; some items fail, the rest goes on."""
    rows = frames.inputs(spark, d).select("input_id", "docket_id", F.when(F.col("input_id") % 5 == 0, "kept").alias("existing"))

    def primary(row: dict) -> str:
        if row["docket_id"] is None:
            raise ValueError("no docket")
        return f"artifact {row['docket_id']}"

    def facts(row: dict) -> str:
        if row["input_id"] % 7 == 0:
            raise KeyError("facts")
        return f"facts {row['input_id']}"

    return evaluation.two_stages(rows, primary, facts, "existing").select("input_id", "artifact", "primary_status", "primary_error", "facts", "facts_status", "facts_error")


def records_final(spark: SparkSession, d: str) -> DataFrame:
    """Answers written from the inputs, read as artifacts and filtered to final records."""
    k = F.col("input_id")
    steps = F.array(F.struct((k % 2 == 0).alias("included_in_total_offense_level"), F.when(k % 3 == 0, " Weak").otherwise("strong").alias("support_strength")))
    facts = F.array(F.struct(F.concat(F.lit("fact  "), k.cast("string")).alias("fact")), F.struct(F.when(k % 5 == 0, "The total offense level is 9").otherwise("other").alias("fact")))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.when(k % 11 != 0, " Supported").otherwise("no").alias("docket_support_status"), facts.alias("case_facts"), steps.alias("offense_level_steps"), F.when(k % 13 != 0, (k % 40).cast("int")).alias("final_total_offense_level"))), F.lit("\n```"))
    raw = frames.inputs(spark, d).where("docket_id is not null").select(k.cast("string").alias("docket_id"), F.lit("t").alias("generated_at_utc"), F.lit(None).cast("int").alias("review_version"), "source_run_id", answer.alias("answer"))
    made = review.final_records(review.artifact_records(raw), LEAKY)
    return made.select("docket_id", "input_case_facts_text", "input_case_fact_count", "ground_truth_offense_level", "review_version")


def claim_taken(spark: SparkSession, d: str) -> DataFrame:
    """The one docket that a token gets: the first eligible one in hash order."""
    rows = selection.latest(frames.reviews(spark, d), ["docket_id"], selection.newest_first("updated_at_utc", "review_version", "decision_id"))
    return review.claim_next(rows, "none", "me", F.lit("2020-01-01").cast("timestamp")).select("docket_id", "reviewer_name", "claim_status", "claim_token", "claimed_at_utc")


def calls_counted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_linenumber") % 3 != 0, F.array_repeat(F.lit("c"), F.col("l_linenumber").cast("int"))).alias("tool_calls"))
    return metrics.tool_calls(rows, "run")


def years_enabled(spark: SparkSession, d: str) -> DataFrame:
    made = hierarchy.enabled(_chunks(spark, d), {"usc_title18": True, "ussg": True, "docintel_memo": False}, {2012, 2015, 2018})
    return made.groupBy("source_type", "source_year").agg(F.count("*").alias("n"))


def chunk_years(spark: SparkSession, d: str) -> DataFrame:
    made = hierarchy.chunk_summary(_chunks(spark, d), 0.13)
    return made.select(F.explode("by_year").alias("year", "n"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_read, json_read, tsv_registered, exports_pages, manifest_read, paths_listed, years_resolved, parquet_written, versioned_table, summary_row, changes_unpaired, changes_touched, columns_aligned, text_forms, messages_flat, entities_read, headings_numbered, empty_dropped,
        tabular_chunks, index_chunks, main_terms, chapters_listed, nodes_opened, trees_rendered, guideline_sections, guideline_toc, outlines_listed, sections_opened, sections_by_prefix, search_answers, final_selected, selectors_first, experiment_cases, stages_run, records_final, claim_taken, calls_counted, years_enabled, chunk_years,
    )
}

_W = f"WITH {REVIEW_SQL}"
_ONE_INPUT = "i AS (SELECT * FROM docket_review_input QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY ingested_at DESC) = 1)"
_CHANGES = """r AS (SELECT l_orderkey AS file, l_linenumber AS line, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
ch AS (SELECT file, line, CASE p % 5 WHEN 0 THEN 'Add' WHEN 1 THEN 'Delete' WHEN 2 THEN 'Revise from' WHEN 3 THEN 'Revise to' END AS kind, CASE WHEN p % 7 <> 0 THEN upper(f || '0' || file % 2 || 'x') END AS code FROM r WHERE p % 5 < 4)"""
_SPACED = r"regexp_replace({0}, '[ \t]+', ' ', 'g')"
_TAB = """o AS (SELECT o_custkey, o_orderkey, 'O' || o_orderkey AS c, 'O' || o_orderkey || ' order ' || o_orderstatus AS head, 'includes: ' || o_orderpriority || ' | n2' AS note FROM orders),
b AS (SELECT c_custkey AS k, 'Document: ICD-10-CM TABULAR LIST of DISEASES and INJURIES' || chr(10) || 'Chapter: ' || c_mktsegment || chr(10) || 'Section: Section ' || c_nationkey AS head, 'C' || c_custkey AS c, 'C' || c_custkey || ' ' || c_name AS title, c_mktsegment || ' > Section ' || c_nationkey || ' > C' || c_custkey AS path FROM customer),
w AS (SELECT b.*, coalesce(n, 0) AS n, b.head || chr(10) || chr(10) || title || chr(10) || 'excludes1: not this' || coalesce(below, '') AS text FROM b LEFT JOIN (SELECT o_custkey AS bk, count(*) AS n, string_agg(chr(10) || head || chr(10) || ' ' || note, '' ORDER BY o_orderkey) AS below FROM o GROUP BY 1) ON bk = k),
t AS (SELECT k, title AS chunk_title, path, c AS code, text FROM w WHERE length(text) <= 400 OR n = 0
 UNION ALL SELECT w.k, w.title || ' > ' || o.head, path || ' > ' || o.c, o.c, w.head || chr(10) || 'Parent code: ' || w.title || chr(10) || chr(10) || o.head || chr(10) || note FROM (SELECT k, b.head, title, path FROM b) w JOIN o ON o_custkey = w.k WHERE w.k IN (SELECT k FROM w x WHERE length(x.text) > 400 AND x.n > 0))"""
_TERM = """s AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Abscess ' WHEN 1 THEN 'burn ' ELSE 'Cyst ' END || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'A1' END AS code, CASE WHEN s_suppkey % 2 = 1 THEN 'Other' END AS see, CASE WHEN s_suppkey % 5 <> 0 THEN 'acute ' || s_nationkey END AS term FROM supplier)"""
_FINAL = "fd AS (SELECT CAST(docket_id AS BIGINT) AS docket_id, facts, CAST(level AS VARCHAR) AS level FROM final QUALIFY row_number() OVER (PARTITION BY CAST(docket_id AS BIGINT) ORDER BY facts, CAST(level AS VARCHAR)) = 1), ym AS (SELECT docket_id, sentencing_year, year_lookup_status FROM sentencing_year_map QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY sentencing_year DESC NULLS LAST, year_lookup_status ASC NULLS LAST) = 1)"
ORACLES = {
    "csv_read": r"SELECT DISTINCT input_id, md5(regexp_replace(case_summary, '\r\n?', chr(10), 'g')) AS digest FROM docket_review_input WHERE case_summary IS NOT NULL AND case_summary <> ''",
    "json_read": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "tsv_registered": "SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS INT) AS nation, CAST(NULL AS VARCHAR) AS absent FROM customer",
    "exports_pages": f"{_W} SELECT docket_id, 's' || input_id AS source_file_name, CAST(p AS INT) AS page, md5(CASE WHEN input_id % 3 = 0 THEN 'whole ' || input_id WHEN p = 1 THEN coalesce(case_summary, '') ELSE coalesce(source_run_id, '') END) AS digest FROM latest_inputs, (SELECT unnest([1, 2]) AS p) WHERE docket_id IS NOT NULL AND (p = 1 OR input_id % 3 <> 0)",
    "manifest_read": f"{_W} SELECT docket_id, input_id FROM latest_inputs WHERE docket_id IS NOT NULL",
    "paths_listed": f"{_W} SELECT DISTINCT docket_id FROM latest_inputs WHERE docket_id IS NOT NULL",
    "years_resolved": rf"WITH {_C}, p AS (SELECT DISTINCT '/' || replace(source_path, '\', '/') AS path FROM c WHERE source_path IS NOT NULL), y AS (SELECT TRY_CAST(nullif(regexp_extract(path, '/(\d{{4}})/', 1), '') AS INT) AS year, path, CASE WHEN ends_with(path, '.pdf') THEN 0 ELSE 1 END AS r FROM p) SELECT year, arg_min(path, (r, path)) AS path FROM y WHERE year IS NOT NULL GROUP BY 1",
    "parquet_written": "SELECT o_orderstatus, 2 * count(*) AS n, CAST(0 AS BIGINT) AS total FROM orders GROUP BY 1",
    "versioned_table": f"{_W}, s AS (SELECT docket_id, review_version, queue_label FROM artifacts WHERE review_version <> 2 OR queue_label = 'ready_for_review') SELECT * FROM s",
    "summary_row": f"WITH {_C} SELECT count(*) AS n_chunks, CAST(coalesce(sum(estimated_tokens), 0) AS BIGINT) AS tokens FROM c WHERE source_type IN ('usc_title18', 'ussg')",
    "changes_unpaired": f"""WITH {_CHANGES}, x AS (SELECT *, lead(kind) OVER o AS nk, lead(code) OVER o AS nc, lag(kind) OVER o AS lk FROM ch WINDOW o AS (PARTITION BY file ORDER BY line))
 SELECT * FROM (SELECT file, line, kind, code, CASE WHEN code IS NULL THEN 'no code' WHEN kind = 'Revise from' AND nk IS NULL THEN 'unclosed' WHEN kind = 'Revise from' AND nk <> 'Revise to' THEN 'unpaired' WHEN kind = 'Revise from' AND nc <> code THEN 'mismatched' WHEN kind = 'Revise to' AND coalesce(lk, '') <> 'Revise from' THEN 'unpaired' END AS problem FROM x) WHERE problem IS NOT NULL""",
    "changes_touched": f"WITH {_CHANGES} SELECT DISTINCT code FROM ch WHERE code IS NOT NULL",
    "columns_aligned": "SELECT s_suppkey AS c_custkey, s_name AS c_name, CAST(NULL AS INT) AS nation, CAST(NULL AS INT) AS c_extra FROM supplier",
    "text_forms": rf"""{_W} SELECT input_id, nullif(trim(source_run_id), '') AS run, coalesce(nullif(regexp_extract(source_run_id, '^\s*(\S+)', 1), ''), 'x') AS first, md5(regexp_replace(regexp_replace(coalesce(case_summary, ''), '[\s\pZ\x0b\x85\x1c-\x1f]+', ' ', 'g'), '^ | $', '', 'g')) AS one_line, '"a" ''b'' ' || input_id AS straight,
 CASE WHEN input_id % 3 = 0 THEN CAST(input_id AS INT) END AS number, '/Volumes/a/' || input_id || '.docintel.json' AS path, '/Volumes/a/' || input_id AS document, '[1] id=' || input_id || ' | docket=' || coalesce(docket_id, '') || chr(10) || 'body' AS block, '- a' || chr(10) || '- ' || input_id AS bullets, 'a.b/' || input_id || '/c' AS codes,
 least(500, length(coalesce(case_summary, ''))) AS preview, submitted_at IS NULL OR submitted_at < TIMESTAMP '2020-01-01' - INTERVAL 45 MINUTE AS stale FROM latest_inputs""",
    "messages_flat": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || chr(10) || p_brand END AS text FROM part",
    "entities_read": "SELECT p_partkey, '’é&lt;A© ' || p_partkey || '&bogus; &§' || p_name AS text FROM part",
    "headings_numbered": "SELECT p_partkey, CAST(p_partkey % 10 + 1 AS INT) AS chapter, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 10 + 1) || chr(CAST(65 + p_partkey % 26 AS INT)) || (p_partkey % 9) || '.' END AS prefix FROM part",
    "empty_dropped": f"{_W} SELECT input_id, nullif(trim(source_run_id), '') AS a, docket_id AS b, CASE WHEN input_id % 2 = 1 THEN 'v' END AS k, true AS s_empty FROM latest_inputs",
    "tabular_chunks": f"""WITH {_TAB} SELECT regexp_replace(substr(regexp_replace(regexp_replace('tabular|t/' || k || '|' || path, '[^a-zA-Z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 187), '-+$', '') || '-' || substr(sha1('tabular|t/' || k || '|' || path), 1, 12) AS chunk_id, chunk_title, path AS semantic_path, code, md5(text) AS digest, CAST(greatest(1, floor(length(text) / 4.0 + 0.9999)) AS INT) AS estimated_tokens FROM t""",
    "index_chunks": f"""WITH {_TERM}, x AS (SELECT *, 'Document: INDEX' || chr(10) || 'Letter: L' || chr(10) || 'Main term: ' || name AS head, name || CASE WHEN code IS NOT NULL THEN ' (code=A1)' ELSE ' (see=Other)' END AS line, term || ' (code=Z' || k || ')' AS sub FROM s), y AS (SELECT *, head || chr(10) || chr(10) || line || coalesce(chr(10) || sub, '') AS text FROM x)
 SELECT 'INDEX' AS document_title, CASE WHEN f THEN name ELSE name || ' > ' || term END AS chunk_title, 'L > ' || name || CASE WHEN f THEN '' ELSE ' > ' || term END AS semantic_path, CASE WHEN f THEN code ELSE 'Z' || k END AS code, CASE WHEN f THEN text ELSE head || chr(10) || chr(10) || sub END AS text FROM (SELECT *, length(text) <= 80 OR term IS NULL AS f FROM y)""",
    "main_terms": f"WITH {_TERM} SELECT 'B|' || name AS entry_id, code, see, CAST(term IS NOT NULL AS INT) AS child_count FROM s WHERE k % 3 = 1",
    "chapters_listed": "SELECT 't/' || c_custkey || '/0' AS node_id, '1' AS chapter_id, c_mktsegment AS title, CAST(1 AS BIGINT) AS section_count FROM customer",
    "nodes_opened": "SELECT 't/' || c_custkey || '/0/0/0' AS node_id, true AS found, c_name AS title, count(o_orderkey) AS n_children, c_mktsegment || '/Section ' || c_nationkey AS way, count(o_orderkey) > 40 AS children_truncated FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY c_custkey, c_name, c_mktsegment, c_nationkey UNION ALL SELECT 'none', false, NULL, 0, NULL, false",
    "trees_rendered": f"WITH {_TERM} SELECT CAST(k AS VARCHAR) AS key, name || CASE WHEN code IS NOT NULL THEN ' (code=A1)' ELSE ' (see=Other)' END || coalesce(chr(10) || term || ' (code=Z' || k || ')', '') AS text FROM s",
    "guideline_sections": f"WITH {_C} SELECT chunk_id AS source_path, 'a. Sub ' || length(text) AS chunk_title, 'Section II. Rules > 1. Chapter 1: First > a. Sub ' || length(text) AS semantic_path FROM c WHERE text IS NOT NULL AND trim(text, ' ' || chr(10) || chr(13) || chr(9)) <> ''",
    "guideline_toc": """WITH n AS (SELECT s_suppkey AS k, n_name AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT k AS source_path, 1 AS ord, 'guidelines|3|section-i-' || regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g') AS section_id, 'Section I. ' || x AS title, 1 AS level, 3 AS target_page FROM n
 UNION ALL SELECT k, 2, 'guidelines|' || (k % 90 + 10) || '|a-chapter-2-' || regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), 'A. Chapter 2: ' || x, 2, CAST(k % 90 + 10 AS INT) FROM n
 UNION ALL SELECT k, 3, 'guidelines|12|7-more-words-of-it', '7. more words of it', 3, 12 FROM n""",
    "outlines_listed": """WITH r AS (SELECT l_orderkey, l_linenumber AS ord, min(l_partkey) % 4 AS p FROM lineitem GROUP BY ALL), e AS (SELECT *, CAST(p AS INT) AS level, CASE p WHEN 0 THEN 'IV' WHEN 1 THEN chr(CAST(64 + ord AS INT)) ELSE CAST(ord AS VARCHAR) END AS marker FROM r WHERE p < 3)
 SELECT a.l_orderkey, a.ord, a.level, a.marker, min(b.ord) AS next_ord FROM e a LEFT JOIN e b ON b.l_orderkey = a.l_orderkey AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL""",
    "sections_opened": f"WITH {_C} SELECT citation AS request_id, 'found' AS status, CAST(count(*) AS INT) AS n_blocks FROM c WHERE citation IS NOT NULL GROUP BY 1 UNION ALL SELECT '?', 'not_found', NULL",
    "sections_by_prefix": rf"WITH {_C}, s AS (SELECT regexp_extract(chunk_title, '^§(\S+)', 1) AS x FROM c WHERE regexp_matches(chunk_title, '^§[0-9][A-Z]')) SELECT substr(x, 1, 3) AS prefix, count(*) AS n FROM s GROUP BY 1",
    "search_answers": """WITH a AS (SELECT p_partkey AS k, p_partkey % 7 AS s, CASE WHEN p_partkey % 100 = 0 THEN '' ELSE p_brand END AS q, CAST(CASE WHEN p_partkey % 3 = 0 THEN greatest(1, least(8, p_partkey % 12)) ELSE 8 END AS INT) AS top_k, CASE WHEN p_partkey % 80 = 0 THEN 'other' WHEN p_partkey % 8 = 0 THEN 'index' END AS t FROM part WHERE p_partkey % 20 = 0),
 e AS (SELECT *, CASE WHEN q = '' THEN 'query_text must not be blank' WHEN t = 'other' THEN 'source_type must be one of [''guidelines'', ''index'', ''tabular''], got ''other''' END AS m FROM a),
 w AS (SELECT DISTINCT k, t, unnest(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM e WHERE m IS NULL),
 d AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'guidelines' WHEN 1 THEN 'index' ELSE 'tabular' END AS t, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM part),
 h AS (SELECT k, count(DISTINCT id) AS n FROM w JOIN d ON d.term = w.term AND (w.t IS NULL OR w.t = d.t) GROUP BY 1)
 SELECT k AS request_id, q AS query_text, top_k, t AS source_type, CASE WHEN m IS NULL THEN 'ok' ELSE 'error' END AS status, m AS error_message, CASE WHEN m IS NULL THEN CAST(count(*) FILTER (WHERE m IS NULL) OVER (PARTITION BY s ORDER BY k) AS INT) END AS call_count, CAST(CASE WHEN m IS NULL THEN least(top_k, coalesce(n, 0)) END AS INT) AS count FROM e LEFT JOIN h USING (k)""",
    "final_selected": f"{_W}, {_FINAL} SELECT CAST(docket_id AS VARCHAR) AS docket_id, sentencing_year AS year, facts AS case_summary, level AS expected_offense_level_total, coalesce(year_lookup_status, 'missing') AS case_year_lookup_status, concat_ws('|', CAST(sentencing_year AS VARCHAR), CAST(docket_id AS VARCHAR)) AS key FROM fd LEFT JOIN ym USING (docket_id)",
    "selectors_first": f"{_W}, {_FINAL} SELECT CAST(docket_id AS VARCHAR) AS docket_id, sentencing_year AS year FROM fd LEFT JOIN ym USING (docket_id) ORDER BY sentencing_year IS NULL, coalesce(sentencing_year, 0), CAST(docket_id AS VARCHAR) LIMIT 100",
    "experiment_cases": f"{_W}, {_FINAL}, known AS (SELECT docket_id, max(sentencing_year) AS y FROM sentencing_year_map WHERE sentencing_year IS NOT NULL GROUP BY 1) SELECT docket_id, y AS guideline_year, CAST(1 AS INT) AS input_case_fact_count, CAST(level AS INT) AS ground_truth_offense_level, 3 AS review_version FROM fd JOIN known USING (docket_id)",
    "stages_run": f"""{_W} SELECT input_id, CASE WHEN input_id % 5 = 0 THEN 'kept' ELSE 'artifact ' || docket_id END AS artifact, CASE WHEN input_id % 5 = 0 THEN 'skipped' WHEN docket_id IS NULL THEN 'error' ELSE 'ok' END AS primary_status, CASE WHEN input_id % 5 <> 0 AND docket_id IS NULL THEN 'ValueError: no docket' END AS primary_error,
 CASE WHEN good AND input_id % 7 <> 0 THEN 'facts ' || input_id END AS facts, CASE WHEN NOT good THEN 'skipped' WHEN input_id % 7 = 0 THEN 'error' ELSE 'ok' END AS facts_status, CASE WHEN good AND input_id % 7 = 0 THEN 'KeyError: ''facts''' END AS facts_error FROM (SELECT *, input_id % 5 = 0 OR docket_id IS NOT NULL AS good FROM latest_inputs)""",
    "records_final": f"{_W} SELECT CAST(input_id AS VARCHAR) AS docket_id, '- fact ' || input_id || CASE WHEN input_id % 5 = 0 THEN '' ELSE chr(10) || '- other' END AS input_case_facts_text, CASE WHEN input_id % 5 = 0 THEN 1 ELSE 2 END AS input_case_fact_count, CAST(input_id % 40 AS INT) AS ground_truth_offense_level, 0 AS review_version FROM latest_inputs WHERE docket_id IS NOT NULL AND input_id % 11 <> 0 AND input_id % 13 <> 0 AND NOT (input_id % 2 = 0 AND input_id % 3 = 0)",
    "claim_taken": f"""{_W}, r AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY updated_at_utc DESC NULLS LAST, review_version DESC NULLS LAST, decision_id DESC NULLS LAST) = 1)
 SELECT docket_id, 'me' AS reviewer_name, 'claimed' AS claim_status, 'none' AS claim_token, '2020-01-01T00:00:00+00:00' AS claimed_at_utc FROM r WHERE lower(trim(coalesce(claim_status, ''))) <> 'completed' AND (trim(coalesce(reviewer_name, '')) = '' OR lower(trim(coalesce(claim_status, ''))) <> 'claimed' OR claim_token = 'none' OR claimed_at_utc IS NULL OR CAST(claimed_at_utc AS TIMESTAMPTZ) < TIMESTAMPTZ '2020-01-01 00:00:00+00' - INTERVAL 45 MINUTE) ORDER BY sha256('0:' || docket_id), docket_id LIMIT 1""",
    "calls_counted": "SELECT l_orderkey AS run, CAST(sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber ELSE 0 END) AS BIGINT) AS n_tool_calls FROM lineitem GROUP BY 1",
    "years_enabled": f"WITH {_C} SELECT source_type, source_year, count(*) AS n FROM c WHERE source_type IN ('usc_title18', 'ussg') AND source_year IN (2012, 2015, 2018) GROUP BY ALL",
    "chunk_years": f"WITH {_C} SELECT coalesce(CAST(source_year AS VARCHAR), '') AS year, count(*) AS n FROM c GROUP BY 1",
}
