"""Trees as edge tables: (doc_id, node_id, parent_id, tag, depth, ords, path, name, title, code, see, see_also, notes,
note_lines, document_title).

``ords`` are the positions from the root, so ordering by it is pre-order and a prefix test is a subtree test; ``path`` are
the ancestors' ids, root first. Opening and listing are filters and joins, for one request or a table of them.

Joins of nodes are hinted as merges: sizes are estimated from the documents, of which each becomes many nodes, so that
otherwise millions of nodes would be broadcast through the driver.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import chunk_id, code_scored, normal_space, token_estimate
from paperloom.session import materialize

SCHEMA = "doc_id string, node_id string, parent_id string, tag string, depth int, ords array<int>, path array<string>, name string, title string, code string, see string, see_also string, notes map<string,array<string>>, note_lines array<string>, document_title string"
_S, _L = pa.string(), pa.list_(pa.string())
NODE_TYPES = {"doc_id": _S, "node_id": _S, "parent_id": _S, "tag": _S, "depth": pa.int32(), "ords": pa.list_(pa.int32()), "path": _L, "name": _S, "title": _S, "code": _S, "see": _S, "see_also": _S, "notes": pa.map_(_S, _L), "note_lines": _L, "document_title": _S}
# Titles of documents that name none.
TABULAR_TITLE, INDEX_TITLE = "ICD-10-CM TABULAR LIST of DISEASES and INJURIES", "ICD-10-CM INDEX TO DISEASES and INJURIES"
# The note groups of the tabular list.
NOTE_TAGS = ("includes", "inclusionTerm", "excludes1", "excludes2", "codeFirst", "useAdditionalCode", "codeAlso", "sevenChrNote", "notes")
NODE_TAGS = ("chapter", "section", "diag", "letter", "mainTerm", "term")
#: Limits of an opened heading.
MOST_CHILDREN, MOST_DESCENDANTS, MOST_SUGGESTIONS = 40, 80, 10


def _text(e: ET.Element | None) -> str | None:
    if e is None:
        return None
    t = " ".join(part.strip() for part in e.itertext() if part.strip()).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip() or None


def xml_nodes(doc_id: str, root: ET.Element) -> Iterator[tuple]:
    """The nodes of one document in pre-order, without recursion."""
    stack = [(root, None, [], [])]
    document = _text(root.find("./introduction/introSection/title")) or (_text(root.find("title")) if root.tag not in NODE_TAGS else None)
    while stack:
        e, parent, ords, path = stack.pop()
        inside = e.tag in NODE_TAGS
        node = parent
        if inside:
            node = "/".join([doc_id, *map(str, ords)])
            notes = {t: [n for n in (_text(x) for x in e.findall(f"{t}/note")) if n] for t in NOTE_TAGS if e.find(t) is not None}
            yield (doc_id, node, parent, e.tag, len(path), ords, path, _text(e.find("name")) or e.get("id"), _text(e.find("desc")) or _text(e.find("title")), _text(e.find("code")) or (_text(e.find("name")) if e.tag == "diag" else None), _text(e.find("see")), _text(e.find("seeAlso")), notes, [f"{g.tag}: {' | '.join(n)}" for g in e if g.tag in NOTE_TAGS[:-1] and (n := [x for x in map(_text, g.findall(".//note")) if x])], document)
        below = path + [node] if inside else path
        kids = [c for c in e if c.tag in NODE_TAGS]
        for i in range(len(kids) - 1, -1, -1):
            stack.append((kids[i], node, ords + [i], below))


def parse_xml(files: DataFrame) -> DataFrame:
    """Edge table of the XML files (doc_id, content). A document that does not parse gives one node with tag ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(NODE_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, NODE_TYPES.values())], names=list(NODE_TYPES))

        for batch in batches:
            rows: list[tuple] = []
            for doc, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += ((*r[:12], list(r[12].items()), *r[13:]) for r in xml_nodes(doc, ET.fromstring(content)))
                except (ET.ParseError, TypeError) as problem:
                    rows.append((doc, f"{doc}/error", None, "error", 0, [], [], None, str(problem), None, None, None, [], [], None))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return files.select("doc_id", "content").mapInArrow(run, SCHEMA)


def _first_of_each(rows: DataFrame, group: str, order: str, value: Column, most: int, n: str, listed: str) -> DataFrame:
    """(group, n, listed): how many rows each group has and the values of the first ``most`` in order. The limit is taken
    inside each task before the shuffle, so the root's list is no longer than any other's."""
    w = Window.partitionBy(group).orderBy(order)
    top = rows.select(group, order, value.alias("_v")).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    kept = top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_v"))), lambda x: x["_v"]).alias(listed))
    return rows.groupBy(group).agg(F.count("*").alias(n)).join(kept.hint("merge"), group)


def children(nodes: DataFrame) -> DataFrame:
    """(node_id, n_children, children): the direct children in order, ``MOST_CHILDREN`` of them listed."""
    entry = F.struct("ords", F.col("child_id").alias("node_id"), "name", "title", "code")
    rows = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), "ords", "name", "title", "code")
    return _first_of_each(rows, "node_id", "ords", entry, MOST_CHILDREN, "n_children", "children")


def ancestors(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node_id, ancestors): structs of the ancestors, root first, of the nodes in ``of`` or of all."""
    above = nodes.select(F.col("node_id").alias("ancestor_id"), "tag", "name", "title")
    up = (nodes if of is None else of).select("node_id", F.posexplode("path").alias("pos", "ancestor_id")).join(above.hint("merge"), "ancestor_id")
    return up.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ancestor_id", "tag", "name", "title"))).alias("ancestors"))


def descendants(nodes: DataFrame, condition: Column | None = None) -> DataFrame:
    """(node_id, n_descendants, descendants): matching nodes below each, in pre-order, ``MOST_DESCENDANTS`` listed."""
    below = nodes.where(condition) if condition is not None else nodes
    rows = below.select(F.explode("path").alias("node_id"), F.col("node_id").alias("id"), "ords", "name", "title", "code")
    return _first_of_each(rows, "node_id", "ords", F.struct("ords", "id", "name", "title", "code"), MOST_DESCENDANTS, "n_descendants", "descendants")


def open_nodes(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (node_id): the node, its ancestors, children and truncation flags; unknown ids have found = false."""
    nodes = materialize(nodes, "tree-nodes")  # read several times, parsed once
    node = nodes.join(requests.select("node_id").hint("merge"), "node_id", "left_semi")
    for found in (children(nodes), ancestors(nodes, node), descendants(nodes, F.col("code").isNotNull())):
        node = node.join(found.hint("merge"), "node_id", "left")
    opened = requests.join(node.hint("merge"), "node_id", "left")
    return opened.withColumns({"found": F.col("tag").isNotNull(), "children_truncated": F.coalesce(F.col("n_children") > MOST_CHILDREN, F.lit(False)), "descendants_truncated": F.coalesce(F.col("n_descendants") > MOST_DESCENDANTS, F.lit(False))})


def list_main_terms(nodes: DataFrame, letter: str | None = None, prefix: str | None = None) -> DataFrame:
    """Main terms with id ``L|title`` and number of children, in document order; filters are optional."""
    if letter is not None and not (len(letter) == 1 and letter.isalpha()):
        raise ValueError("letter must be a single letter")
    out = nodes.where("tag = 'mainTerm'")
    first = F.upper(F.substring("title", 1, 1))
    if letter:
        out = out.where(first == letter.upper())
    if prefix:
        out = out.where(F.lower("title").startswith(prefix.lower()))
    return out.join(children(nodes).select("node_id", "n_children"), "node_id", "left").select(F.concat(first, F.lit("|"), F.col("title")).alias("entry_id"), "node_id", "title", "code", "see", "see_also", F.coalesce("n_children", F.lit(0)).alias("child_count"), "ords").orderBy("ords")


def list_chapters(nodes: DataFrame, prefix: str | None = None) -> DataFrame:
    """Chapters with their code range and number of sections; a prefix keeps those whose range of first letters holds it
    or whose id it is."""
    sections = nodes.where("tag = 'section'").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("section_count"), F.min_by("name", "ords").alias("first"), F.max_by("name", "ords").alias("last"))
    out = nodes.where("tag = 'chapter'").join(sections, "node_id", "left")
    low, high = F.substring(F.split("first", "-")[0], 1, 1), F.substring(F.element_at(F.split("last", "-"), -1), 1, 1)
    if prefix:
        p = prefix.strip().upper()
        out = out.where((F.col("name") == p) | (low <= p[:1]) & (F.lit(p[:1]) <= high))
    return out.select("node_id", F.col("name").alias("chapter_id"), "title", F.concat_ws("-", F.split("first", "-")[0], F.element_at(F.split("last", "-"), -1)).alias("code_range"), F.coalesce("section_count", F.lit(0)).alias("section_count"))


def open_codes(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested code: the entry by its letters and digits, its ancestors and children; for an unknown one
    ``found`` is false and ``suggestions`` lists codes of the same first three characters in document order."""
    diag = nodes.where("tag = 'diag'").withColumn("token", code_scored(F.col("code")))
    asked = requests.select("request_id", "code").withColumn("token", code_scored(F.col("code")))
    entry = asked.join(diag.drop("code"), "token", "left").join(children(nodes), "node_id", "left").join(ancestors(nodes), "node_id", "left")
    # the first codes of each three characters serve every request with them
    heads = _first_of_each(diag.where("token <> ''").select(F.substring("token", 1, 3).alias("head"), "ords", F.col("code").alias("c")), "head", "ords", F.col("c"), MOST_SUGGESTIONS, "n", "suggestions")
    hints = asked.withColumn("head", F.substring("token", 1, 3)).join(heads, "head").select("request_id", "suggestions")
    return entry.join(hints, "request_id", "left").withColumn("found", F.col("node_id").isNotNull()).withColumn("suggestions", F.when(~F.col("found"), F.coalesce("suggestions", F.array().cast("array<string>"))))


def render(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, text): each root's subtree in pre-order: one line per node with its code, see and see-also, its note lines
    below it."""
    said = F.concat_ws(", ", F.concat(F.lit("code="), F.col("code")), F.concat(F.lit("see="), F.col("see")), F.concat(F.lit("see_also="), F.col("see_also")))
    line = F.concat_ws(" ", "name", "title", F.nullif(F.concat(F.lit("("), said, F.lit(")")), F.lit("()")))
    whole = F.array_join(F.concat(F.array(line), F.coalesce("note_lines", F.array().cast("array<string>"))), "\n")
    rows = nodes.select(F.explode(F.concat("path", F.array("node_id"))).alias("node_id"), F.struct("ords", whole.alias("line")).alias("l")).join(roots.select("node_id"), "node_id", "left_semi")
    return rows.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


# --- chunks of trees


def _subtree_chunks(rows: DataFrame, context: Column, parent_context: Column, limit: int, kind: str, per_token: float) -> DataFrame:
    """One chunk per top entry, or one per child where the whole is longer than ``limit`` and has children.

    ``rows`` has a row per node of an entry: doc_id, document_title, ords, top, child (the ids of the entry and of the
    child the node is in or under, null for the entry itself), what the entry and the child are called (top_title,
    child_title, path, child_path, top_code, child_code) and its lines as first of a chunk and inside one.
    """

    def text(head: Column, lines: Column) -> Column:
        return normal_space(F.concat(head, F.lit("\n\n"), F.array_join(F.transform(F.array_sort(lines), lambda x: x["t"]), "\n")))

    about = ("doc_id", "document_title", "top_title", "path", "top_code", "first", "second", "third")
    whole = rows.groupBy("top").agg(*(F.min_by(c, "ords").alias(c) for c in about), F.count("child").alias("n_below"), F.collect_list(F.struct("ords", F.when(F.col("child").isNull(), F.col("outer")).otherwise(F.col("inner")).alias("t"))).alias("lines"))
    whole = whole.withColumn("text", text(context, F.col("lines"))).drop("lines")
    fits = (F.length("text") <= limit) | (F.col("n_below") == 0)
    parts = rows.where("child is not null").join(whole.where(~fits).select("top"), "top", "left_semi")
    parts = parts.groupBy("top", "child").agg(*(F.min_by(c, "ords").alias(c) for c in (*about, "child_title", "child_path", "child_code")), F.collect_list(F.struct("ords", F.when(F.col("is_child"), F.col("outer")).otherwise(F.col("inner")).alias("t"))).alias("lines"))
    parts = parts.withColumn("text", text(normal_space(parent_context), F.col("lines")))
    one = whole.where(fits).select("doc_id", "document_title", F.col("top_title").alias("chunk_title"), F.col("path").alias("semantic_path"), F.col("top_code").alias("code"), "text")
    many = parts.select("doc_id", "document_title", F.concat_ws(" > ", "top_title", "child_title").alias("chunk_title"), F.col("child_path").alias("semantic_path"), F.coalesce("child_code", "top_code").alias("code"), "text")
    out = one.unionByName(many)
    return out.select(chunk_id(F.lit(kind), F.col("doc_id"), F.col("semantic_path")).alias("chunk_id"), F.lit(kind).alias("source_type"), "document_title", "chunk_title", "semantic_path", "code", F.col("doc_id").alias("source_path"), "text", token_estimate(F.col("text"), per_token).alias("estimated_tokens"))


def _inside(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of entries at a depth, with the entry (top) and its child they are in or under, and what stands above."""
    own = F.concat("path", F.array("node_id"))
    return nodes.withColumns({"top": F.try_element_at(own, F.lit(depth + 1)), "child": F.try_element_at(own, F.lit(depth + 2)), "is_child": F.size(own) == depth + 2, **{f"up{i}": F.try_element_at(own, F.lit(i + 1)) for i in range(depth)}})


def _named(rows: DataFrame, nodes: DataFrame, id_: str, out: dict[str, Column]) -> DataFrame:
    return rows.join(nodes.select(F.col("node_id").alias(id_), *(c.alias(n) for n, c in out.items())), id_, "left")


def tabular_chunks(nodes: DataFrame, limit: int = 12000, per_token: float = 4.0) -> DataFrame:
    """Chunks of a tabular list: an entry of a section with everything below it, its codes and note lines; an entry longer
    than ``limit`` gives one chunk per child. Entries without a code or description keep the part they have."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    heading = F.trim(F.concat(blank("code"), F.lit(" "), blank("title")))
    nodes = materialize(nodes, "tree-nodes")  # read several times, parsed once
    diags = _inside(nodes.where("tag = 'diag'"), 2)
    rows = _named(_named(diags, nodes, "up0", {"first": F.col("title")}), nodes, "up1", {"second": F.col("title")})
    rows = _named(rows, nodes, "top", {"top_title": heading, "top_code": F.col("code")})
    rows = _named(rows, nodes, "child", {"child_title": heading, "child_code": F.col("code")})
    notes = lambda indent: F.coalesce(F.concat(F.lit("\n" + indent), F.array_join("note_lines", "\n" + indent)), F.lit(""))
    line = lambda indent: F.concat(heading, F.when(F.size("note_lines") > 0, notes(indent)).otherwise(F.lit("")))
    path = F.concat_ws(" > ", F.col("first"), F.col("second"), F.col("top_code"))
    rows = rows.withColumns({"document_title": F.coalesce("document_title", F.lit(TABULAR_TITLE)), "third": F.col("top_title"), "path": path, "child_path": F.concat(path, F.lit(" > "), F.coalesce("child_code", F.lit(""))), "outer": line(""), "inner": line(" ")})
    head = F.concat(F.lit("Document: "), F.col("document_title"), F.lit("\nChapter: "), blank("first"), F.lit("\nSection: "), blank("second"))
    return _subtree_chunks(rows, head, F.concat(head, F.lit("\nParent code: "), F.col("top_title")), limit, "tabular", per_token)


def index_chunks(nodes: DataFrame, limit: int = 12000, per_token: float = 4.0) -> DataFrame:
    """Chunks of an alphabetic index: a main term with its terms, codes and references; a term longer than ``limit`` gives
    one chunk per child."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    nodes = materialize(nodes, "tree-nodes")  # read several times, parsed once
    said = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.col(n)) for n in ("code", "see", "see_also")))
    line = F.trim(F.concat(blank("title"), F.when(said != "", F.concat(F.lit(" ("), said, F.lit(")"))).otherwise(F.lit(""))))
    rows = _named(_inside(nodes.where("tag in ('mainTerm', 'term')"), 1), nodes, "up0", {"first": F.col("title")})
    rows = _named(rows, nodes, "top", {"top_title": blank("title"), "top_code": F.col("code")})
    rows = _named(rows, nodes, "child", {"child_title": blank("title"), "child_code": F.col("code")})
    path = F.concat(blank("first"), F.lit(" > "), F.col("top_title"))
    rows = rows.withColumns({"document_title": F.coalesce("document_title", F.lit(INDEX_TITLE)), "second": F.col("top_title"), "third": F.lit(None).cast("string"), "path": path, "child_path": F.concat(path, F.lit(" > "), blank("child_title")), "outer": line, "inner": line})
    head = F.concat(F.lit("Document: "), F.col("document_title"), F.lit("\nLetter: "), blank("first"), F.lit("\nMain term: "), F.col("top_title"))
    return _subtree_chunks(rows, head, head, limit, "index", per_token)
