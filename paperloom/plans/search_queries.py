"""Retrieval, evaluation, traces and trees over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.operators import hierarchy, metrics, retrieval, selection, tree
from paperloom.session import table, tune

#: Rows whose number divides evenly are the queries of a search, all rows the index.
EVERY = 20


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(tune(spark), d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("content_vector"), "label")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "content_vector")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(_vectors(spark, d), _queries(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same among the rows of one label, filtered before ranking."""
    return retrieval.nearest(_vectors(spark, d).where("label = 3"), _queries(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(tune(spark), d, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_brand", "p_type").alias("query"))
    return retrieval.bm25(_parts(spark, d), asked).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings of part texts under the hashed embedder, fused."""
    index = retrieval.hashed_embedding(_parts(spark, d), size=64)
    asked = index.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"), "content_vector")
    return retrieval.hybrid(index, asked).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def hybrid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings of the parts that have an embedding, fused."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("content_vector"))
    index = _parts(spark, d).join(vectors, "chunk_id")
    asked = index.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"), "content_vector")
    return retrieval.hybrid(index, asked).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Per order what two halves of its lines say: brands of lines up to the third against those from the second on."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    at = F.struct("l_linenumber", "p_brand")
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 3, at))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") >= 2, at))).alias("e"))
    pick = lambda c: F.transform(c, lambda x: x["p_brand"])
    return lists.select("l_orderkey", pick("p").alias("predicted"), pick("e").alias("expected"), F.when(F.col("l_orderkey") % 11 == 0, "error").otherwise("ok").alias("status"))


def set_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.set_metrics(_predictions(spark, d)).select("l_orderkey", "true_positives", "predicted_count", "expected_count", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "exact_match", "primary_match")


def macro_summary(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.macro_summary(metrics.set_metrics(_predictions(spark, d)), ["precision", "recall", "exact_match", "primary_match"])
    return made.select(*(F.round(c, 6).alias(c) if c.startswith("mean") else c for c in made.columns))


def comparison_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.comparison_grid(_predictions(spark, d), "l_orderkey").groupBy("l_orderkey", "outcome").agg(F.count("*").alias("n"))


def exact_match_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1)).alias("predicted"), F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 5 + 1).cast("string")).alias("expected"), F.lit("ok").alias("status"))
    made = metrics.macro_summary(metrics.level_match(rows, "predicted", "expected"), ["exact_match", "answered"])
    return made.select("n_rows", F.round("mean_exact_match", 6).alias("exact"), F.round("mean_answered", 6).alias("answered"))


def variant_rank(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.set_metrics(_predictions(spark, d)).withColumns({"variant": F.concat(F.lit("v"), (F.col("l_orderkey") % 6).cast("string")), "seconds": (F.col("l_orderkey") % 17).cast("double")})
    return metrics.rank_variants(scored).select("variant", "n_ok", F.round("f1", 6).alias("f1"), "rank", "finalist")


def span_summary(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.span_summary(table(spark, d, "events").select(F.col("event_type").alias("span_type"), F.col("value").alias("seconds")))
    return made.select("span_type", "n", *(F.round(c, 4).alias(c) for c in ("total", "mean", "longest", "share")))


def early_late(spark: SparkSession, d: str) -> DataFrame:
    return metrics.early_late(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"))


def spans_flat(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as one trace, each the child of the user's event two numbers of three before it."""
    e = table(spark, d, "events")
    spans = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_id") - 3).alias("parent_span_id"), F.col("event_type").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value"))
    spans = spans.withColumns({"start_ns": F.col("us") * 1000, "end_ns": F.col("us") * 1000 + (F.col("value") * 1e6).cast("long")})
    return metrics.flatten_spans(spans).select("trace_id", "span_id", "parent_name", "order")


def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.hhmmss(F.col("value") * 100).alias("text"))


def _world(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree."""
    from paperloom.operators.tree import SCHEMA

    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    rid, nid, cid = F.concat(F.lit("r"), F.col("r_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("c"), F.col("c_custkey"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = [
        r.select(rid.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("region").alias("tag"), F.array(F.col("r_regionkey").cast("int")).alias("ords"), F.array().cast("array<string>").alias("path"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("code")),
        up.select(nid.alias("node_id"), rid.alias("parent_id"), F.lit("nation").alias("tag"), F.array(F.col("r_regionkey").cast("int"), F.col("n_nationkey").cast("int")).alias("ords"), F.array(rid).alias("path"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("code")),
        c.join(up, F.col("c_nationkey") == F.col("n_nationkey")).select(cid.alias("node_id"), nid.alias("parent_id"), F.lit("diag").alias("tag"), F.array(F.col("r_regionkey").cast("int"), F.col("n_nationkey").cast("int"), F.col("c_custkey").cast("int")).alias("ords"), F.array(rid, nid).alias("path"), F.col("c_name").alias("name"), F.concat(F.lit("Q"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("code")),
    ]
    all_ = nodes[0].unionByName(nodes[1]).unionByName(nodes[2])
    return all_.withColumns({"doc_id": F.lit("world"), "depth": F.size("path"), "title": F.col("name"), "see": F.lit(None).cast("string"), "see_also": F.lit(None).cast("string"), "notes": F.lit(None).cast("map<string,array<string>>"), "note_lines": F.lit(None).cast("array<string>"), "document_title": F.lit(None).cast("string")}).select(*(x.split()[0] for x in SCHEMA.split(", ")))


def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return tree.ancestors(_world(spark, d)).select("node_id", F.array_join(F.transform("ancestors", lambda a: a["name"]), "/").alias("way"))


def children_truncated(spark: SparkSession, d: str) -> DataFrame:
    made = tree.children(_world(spark, d))
    return made.select("node_id", "n_children", F.array_join(F.transform("children", lambda c: c["node_id"]), ",").alias("listed"))


def descendants_listed(spark: SparkSession, d: str) -> DataFrame:
    made = tree.descendants(_world(spark, d), F.col("code").isNotNull())
    return made.select("node_id", "n_descendants", F.array_join(F.transform("descendants", lambda c: c["id"]), ",").alias("listed"))


def code_suggest(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("q"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))).otherwise(F.concat(F.lit("Q00."), F.col("s_suppkey").cast("string"), F.lit("x"))).alias("code"))
    made = tree.open_codes(_world(spark, d).where("code is not null or tag <> 'diag'"), asked)
    return made.select("request_id", "found", "node_id", F.array_join("suggestions", ",").alias("suggestions"))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of the old half of the chunks updated with all deliveries."""
    from paperloom.sources.writers import upsert_index

    rows = table(spark, d, "chunks_legal").select("chunk_id", "loaded_at", "estimated_tokens").distinct()
    old = selection.latest(rows, ["chunk_id"], [F.col("loaded_at")]).where(F.length("chunk_id") % 2 == 0)
    return upsert_index(old, rows, "loaded_at").select("chunk_id", "loaded_at")


def rollup_extension(spark: SparkSession, d: str) -> DataFrame:
    """An extension: chunk counts rolled up by type and year."""
    rows = table(spark, d, "chunks_legal").dropDuplicates(["chunk_id"])
    return rows.rollup(F.lower(F.trim("source_type")).alias("kind"), "source_year").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


QUERIES = {
    f.__name__: f
    for f in (vector_topk, filtered_topk, bm25_topk, hybrid_rrf, hybrid_vectors, set_metrics, macro_summary, comparison_grid, exact_match_rate, variant_rank, span_summary, early_late, spans_flat, durations, tree_ancestors, children_truncated, descendants_listed, code_suggest, index_upsert, rollup_extension)
}

_COSINE = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS chunk_id, array_cosine_similarity(v, CAST(embedding AS DOUBLE[64])) AS score FROM q, embeddings {0})
 SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 8"""
_LISTS = """b AS (SELECT l_orderkey, l_linenumber AS n, p_brand AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT l_orderkey, coalesce(list(c ORDER BY n, c) FILTER (WHERE n <= 3), []) AS p, coalesce(list(c ORDER BY n, c) FILTER (WHERE n >= 2), []) AS e, l_orderkey % 11 <> 0 AS ok FROM b GROUP BY l_orderkey),
k AS (SELECT *, len(list_intersect(list_distinct(p), list_distinct(e))) AS tp, len(list_distinct(p)) AS np, len(list_distinct(e)) AS ne FROM x),
m AS (SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS pr, CASE WHEN ne = 0 THEN 0.0 ELSE tp / ne END AS rc, CASE WHEN list_sort(list_distinct(p)) = list_sort(list_distinct(e)) THEN 1.0 ELSE 0.0 END AS ex, CASE WHEN len(p) > 0 AND len(e) > 0 AND p[1] = e[1] THEN 1.0 ELSE 0.0 END AS pm FROM k)"""
_TREE = """world AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, [r_regionkey] AS ords, r_name AS way, NULL AS code FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, [n_regionkey, n_nationkey], r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, [n_regionkey, n_nationkey, CAST(c_custkey AS INT)], r_name || '/' || n_name, 'Q' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ORACLES = {
    "vector_topk": _COSINE.format(""),
    "filtered_topk": _COSINE.format("WHERE label = 3"),
    "bm25_topk": r"""WITH d AS (SELECT p_partkey AS chunk_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM part),
 st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d), w AS (SELECT DISTINCT p_partkey AS query_id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', p_brand, p_type)), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM part WHERE p_partkey % 20 = 0),
 po AS (SELECT chunk_id, len(t) AS l, unnest(t) AS term FROM d), tf AS (SELECT chunk_id, l, term, count(*) AS tf FROM po GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 s AS (SELECT query_id, chunk_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM w JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)
 SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 8""",
    "set_metrics": f"WITH {_LISTS} SELECT l_orderkey, tp AS true_positives, np AS predicted_count, ne AS expected_count, round(pr, 9) AS precision, round(rc, 9) AS recall, ex AS exact_match, pm AS primary_match FROM m",
    "macro_summary": f"WITH {_LISTS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_errors, round(avg(pr) FILTER (WHERE ok), 6) AS mean_precision, round(avg(rc) FILTER (WHERE ok), 6) AS mean_recall, round(avg(ex) FILTER (WHERE ok), 6) AS mean_exact_match, round(avg(pm) FILTER (WHERE ok), 6) AS mean_primary_match FROM m",
    "comparison_grid": f"WITH {_LISTS}, g AS (SELECT l_orderkey, p, e, unnest(list_distinct(list_concat(p, e))) AS c FROM x) SELECT l_orderkey, CASE WHEN list_contains(p, c) AND list_contains(e, c) THEN 'correct' WHEN list_contains(e, c) THEN 'missed' ELSE 'unexpected' END AS outcome, count(*) AS n FROM g GROUP BY ALL",
    "exact_match_rate": "SELECT count(*) AS n_rows, round(avg(CASE WHEN o_orderkey % 9 <> 0 AND substr(o_orderpriority, 1, 1) = CAST(o_orderkey % 5 + 1 AS VARCHAR) THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN trim(substr(o_orderpriority, 1, 1)) <> '' THEN 1.0 ELSE 0.0 END), 6) AS answered FROM orders",
    "variant_rank": f"WITH {_LISTS}, v AS (SELECT 'v' || (l_orderkey % 6) AS variant, count(*) FILTER (WHERE ok) AS n_ok, avg(pr) FILTER (WHERE ok) AS pr, avg(rc) FILTER (WHERE ok) AS rc, avg(CAST(l_orderkey % 17 AS DOUBLE)) FILTER (WHERE ok) AS s FROM m GROUP BY 1), f AS (SELECT *, 2 * pr * rc / (pr + rc) AS f1 FROM v) SELECT variant, n_ok, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, rc DESC, s, variant) AS INT) AS rank, row_number() OVER (ORDER BY f1 DESC, rc DESC, s, variant) <= 2 AS finalist FROM f",
    "span_summary": "SELECT event_type AS span_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(max(value), 4) AS longest, round(sum(value) / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY 1",
    "early_late": "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS d FROM events) SELECT user_id, round(avg(value) FILTER (WHERE u <= 5), 6) AS early, round(avg(value) FILTER (WHERE d <= 5), 6) AS late FROM r GROUP BY 1",
    "spans_flat": "SELECT e.user_id AS trace_id, e.event_id AS span_id, p.event_type AS parent_name, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS INT) AS \"order\" FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_id = e.event_id - 3",
    "durations": "SELECT event_id, printf('%02d:%02d:%02d', CAST(s // 3600 AS BIGINT), CAST(s % 3600 // 60 AS BIGINT), CAST(s % 60 AS BIGINT)) AS text FROM (SELECT event_id, CAST(floor(greatest(value * 100, 0)) AS BIGINT) AS s FROM events)",
    "tree_ancestors": f"WITH {_TREE} SELECT id AS node_id, way FROM world WHERE parent IS NOT NULL",
    "children_truncated": f"WITH {_TREE} SELECT parent AS node_id, count(*) AS n_children, array_to_string(list_slice(list(id ORDER BY ords), 1, 40), ',') AS listed FROM world WHERE parent IS NOT NULL GROUP BY 1",
    "descendants_listed": f"WITH {_TREE}, up AS (SELECT parent AS node_id, id, ords FROM world WHERE code IS NOT NULL UNION ALL SELECT 'r' || ords[1], id, ords FROM world WHERE code IS NOT NULL) SELECT node_id, count(*) AS n_descendants, array_to_string(list_slice(list(id ORDER BY ords), 1, 80), ',') AS listed FROM up GROUP BY 1",
    "code_suggest": f"""WITH {_TREE}, a AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Q' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') ELSE 'Q00' || s_suppkey || 'X' END AS k FROM supplier)
 SELECT request_id, id IS NOT NULL AS found, id AS node_id, CASE WHEN id IS NULL THEN (SELECT array_to_string(list_slice(list(code ORDER BY ords), 1, 10), ',') FROM world h WHERE substr(h.code, 1, 3) = substr(a.k, 1, 3)) END AS suggestions FROM a LEFT JOIN world w ON w.code = a.k""",
    "index_upsert": "SELECT chunk_id, max(loaded_at) AS loaded_at FROM chunks_legal GROUP BY 1",
    "rollup_extension": "SELECT kind, source_year, count(*) AS n, CAST(grouping(kind) * 2 + grouping(source_year) AS BIGINT) AS g FROM (SELECT DISTINCT ON (chunk_id) lower(trim(source_type)) AS kind, source_year FROM chunks_legal) GROUP BY ROLLUP (kind, source_year)",
    "hybrid_vectors": r"""WITH x AS (SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand, p_type) AS txt, CAST(embedding AS DOUBLE[64]) AS v FROM part JOIN embeddings ON vec_id = p_partkey),
 d AS (SELECT id, list_filter(regexp_split_to_array(lower(txt), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM x), st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
 w AS (SELECT DISTINCT id AS q, unnest(t) AS term FROM d WHERE id % 20 = 0), tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 b AS (SELECT q, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS s FROM w JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
 rb AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS r FROM b QUALIFY r <= 50),
 rc AS (SELECT a.id AS q, c.id, row_number() OVER (PARTITION BY a.id ORDER BY array_cosine_similarity(a.v, c.v) DESC, c.id) AS r FROM x a, x c WHERE a.id % 20 = 0 QUALIFY r <= 50),
 f AS (SELECT q, id, sum(1.0 / (60 + r)) AS s FROM (FROM rb UNION ALL FROM rc) GROUP BY ALL)
 SELECT q AS query_id, id AS chunk_id, CAST(row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, id) AS INT) AS rank, round(s, 9) AS score FROM f QUALIFY rank <= 8""",
}
