"""Retrieval over chunk tables: exact cosine, BM25 and their fusion, for tables of queries; embeddings are pluggable.

The fusion is reciprocal rank with k = 60, the analyser splits at anything but letters and digits, lower case: choices of
this library, documented because no reference fixes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.functions.text import strip_ws

K1, B, RRF = 1.2, 0.75, 60
#: Columns of an index table by role.
ROLES = {"chunk_id": "key", "source_type": "filter", "source_year": "filter", "chunk_title": "search", "text": "search", "content_vector": "vector"}


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")


def hashed_embedding(df: DataFrame, text: str = "text", out: str = "content_vector", size: int = 256) -> DataFrame:
    """The offline embedder: signed hashed term counts, normalised; null and empty texts give zeros."""

    @F.pandas_udf("array<float>")
    def embed(slots: pd.Series, signs: pd.Series) -> pd.Series:
        def one(at: np.ndarray, sign: np.ndarray) -> np.ndarray:
            v = np.bincount(np.asarray(at, dtype=np.int64), weights=np.asarray(sign, dtype=np.float64), minlength=size) if len(at) else np.zeros(size)
            return (v / max(np.linalg.norm(v), 1e-30)).astype(np.float32)

        return pd.Series([one(a, g) for a, g in zip(slots, signs)])

    t = terms(F.col(text))
    slots = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int"))
    signs = F.transform(t, lambda x: F.when(F.pmod(F.xxhash64(x, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    return df.withColumn(out, embed(slots, signs))


#: Queries scored at once; more are taken in several blocks.
MOST_QUERIES = 4096


def in_blocks(queries: DataFrame, score: Callable[[list], DataFrame]) -> DataFrame:
    """The union of ``score`` over the rows of ``queries`` in blocks of at most ``MOST_QUERIES``; once for no rows."""
    made, rows = [], []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == MOST_QUERIES:
            made.append(score(rows))
            rows = []
    if rows or not made:
        made.append(score(rows))
    return reduce(DataFrame.unionByName, made)


class _Best:
    """The best ``k`` rows of each query that a task has seen, ties by key: what it hands on is no more than that."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.rows = pd.DataFrame({"q": np.zeros(0, np.int64), "key": np.zeros(0, object), "score": np.zeros(0)})
        self.new: list[pd.DataFrame] = []
        self.size = 0

    def add(self, scores: np.ndarray, keys: pa.Array, least: float = -np.inf) -> None:
        """Scores of all queries (rows) for some keys (columns), rounded; only those above ``least`` count."""
        n = min(self.k, scores.shape[1])
        own = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        q, at = np.nonzero((scores >= np.maximum(own, self.floor)[:, None]) & (scores > least))
        self.new.append(pd.DataFrame({"q": q, "key": np.asarray(keys.take(pa.array(at)).to_pylist(), dtype=object), "score": scores[q, at]}))
        self.size += len(q)
        if self.size > 4 * self.k * len(self.floor) + 100_000:
            self.settle()

    def settle(self) -> pd.DataFrame:
        rows = pd.concat([self.rows, *self.new], ignore_index=True) if self.new else self.rows
        rows = rows.sort_values(["q", "score", "key"], ascending=[True, False, True], kind="stable")
        place = rows.groupby("q").cumcount()
        self.rows = rows[place < self.k]
        full = self.rows[place[self.rows.index] == self.k - 1]
        self.floor[full["q"].to_numpy(dtype=np.int64)] = full["score"].to_numpy()
        self.new, self.size = [], 0
        return self.rows

    def batch(self, ids: pa.Array, key: str, query_key: str, key_type: pa.DataType) -> pa.RecordBatch:
        rows = self.settle()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows["q"].to_numpy(dtype=np.int64))), pa.array(list(rows["key"]), key_type), pa.array(rows["score"].to_numpy(dtype=np.float64))], names=[query_key, key, "score"])


def nearest(index: DataFrame, queries: DataFrame, k: int = 8, key: str = "chunk_id", vector: str = "content_vector", query_key: str = "query_id") -> DataFrame:
    """Exact cosine top ``k`` of the index for each query: (query_id, key, score, rank), ties by key.

    The queries are taken in blocks of at most ``MOST_QUERIES``; each task scores its rows against the block of queries as one
    matrix product and keeps the best k per query over all its batches, so what is shuffled is k rows per query and task.
    """
    return in_blocks(queries.select(query_key, vector), lambda rows: _nearest(index, queries, rows, k, key, vector, query_key))


def _nearest(index: DataFrame, queries: DataFrame, rows: list, k: int, key: str, vector: str, query_key: str) -> DataFrame:
    if not rows:
        return index.select(F.lit(None).cast(queries.schema[query_key].dataType).alias(query_key), F.col(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    matrix = np.asarray([r[vector] for r in rows], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
    shared = index.sparkSession.sparkContext.broadcast((pa.array([r[query_key] for r in rows], to_arrow_type(queries.schema[query_key].dataType)), matrix))

    key_type = to_arrow_type(index.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = _Best(len(q), k)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                v = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                best.add(q @ v.T, batch.column(0))
        yield best.batch(ids, key, query_key, key_type)

    types = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, score double"
    scored = index.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, types)
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(index: DataFrame, queries: DataFrame, k: int = 8, key: str = "chunk_id", text: str = "text", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """BM25 top ``k`` per query: (query_id, key, score, rank), ties by key; rows that share no term with a query are not
    ranked for it.

    The queries are scored in blocks of at most ``MOST_QUERIES``: a task turns its rows into weights of the
    query terms and multiplies them with the queries, so a term that every row has costs no join. Document frequencies
    of the query terms and the mean length come from one aggregation before.
    """
    docs = index.select(key, terms(F.col(text)).alias("_t"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("mean")).first()
    asked = queries.select(query_key, F.array_distinct(terms(F.col(query_text))).alias("_t"))
    return in_blocks(asked, lambda rows: _bm25(index, queries, docs, stats, rows, k, key, query_key))


def _bm25(index: DataFrame, queries: DataFrame, docs: DataFrame, stats, asked: list, k: int, key: str, query_key: str) -> DataFrame:
    names = sorted({t for r in asked for t in r["_t"]})
    types = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, score double"
    wanted = queries.sparkSession.createDataFrame([(t,) for t in names], "term string")
    frequency = {r["term"]: r["n"] for r in docs.select(F.explode(F.array_distinct("_t")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")).collect()}
    idf = np.asarray([np.log(1 + (stats["n"] - frequency.get(t, 0) + 0.5) / (frequency.get(t, 0) + 0.5)) for t in names])
    place = {t: i for i, t in enumerate(names)}
    matrix = np.zeros((len(asked), len(names)), dtype=np.float64)
    for i, r in enumerate(asked):
        matrix[i, [place[t] for t in r["_t"]]] = 1.0
    shared = index.sparkSession.sparkContext.broadcast((pa.array([r[query_key] for r in asked], to_arrow_type(queries.schema[query_key].dataType)), matrix, place, idf, stats["mean"] or 1.0))

    key_type = to_arrow_type(index.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, at, weight, mean = shared.value
        best = _Best(len(q), k)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                w = np.zeros((len(at), batch.num_rows))
                for j, words in enumerate(batch.column(1).to_pylist()):
                    for t in words:
                        i = at.get(t)
                        if i is not None:
                            w[i, j] += 1
                    length = K1 * (1 - B + B * len(words) / mean)
                    column = w[:, j]
                    w[:, j] = weight * column * (K1 + 1) / (column + length)
                used = np.flatnonzero(w.any(axis=1))
                if len(used):
                    best.add(np.round(q[:, used] @ w[used], 9), batch.column(0), 0.0)
        yield best.batch(ids, key, query_key, key_type)

    if not names:
        return index.sparkSession.createDataFrame([], f"{types}, rank int")
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), F.asc(key))
    return docs.mapInArrow(run, types).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(first: DataFrame, second: DataFrame, k: int = 8, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    both = first.select(query_key, key, "rank").unionByName(second.select(query_key, key, "rank"))
    scored = both.groupBy(query_key, key).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 12)), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(index: DataFrame, queries: DataFrame, k: int = 8, filters: dict[str, object] | None = None, depth: int = 50) -> DataFrame:
    """Filtered hybrid search: the predicate first, then both rankings to ``depth``, then their fusion to ``k``."""
    own = index
    for column, value in (filters or {}).items():
        own = own.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == F.lit(value))
    return fuse(nearest(own, queries, depth), bm25(own, queries, depth), k)


def clamp_k(k: int | None, default: int = 8, most: int = 8) -> int:
    return max(1, min(most, default if k is None else int(k)))


# Source types a search may name, and hits at most.
SOURCE_TYPES, MOST_HITS = ("guidelines", "index", "tabular"), 8


def search_requests(index: DataFrame, requests: DataFrame, default_k: int = MOST_HITS, source_types: tuple[str, ...] = SOURCE_TYPES, key: str = "chunk_id") -> DataFrame:
    """Answers to a table of search requests (session_id, request_id, query_text, top_k, source_type, query_mode), one row each.

    An answer echoes what was asked in its normal form and holds status ``ok``, the number of the call in its session
    (refused ones do not count), the number of hits and the hits in order; a blank query or an unknown source type is
    status ``error`` with type and message. ``top_k`` lies between 1 and ``MOST_HITS``; a null one is the default.
    The index has ``key``, source_type and text.
    """
    query = strip_ws(F.coalesce("query_text", F.lit("")))
    kind = F.lower(strip_ws(F.col("source_type")))
    known = F.coalesce(kind, F.lit("")).isin("", *source_types)
    field = F.when(F.col("query_mode") == "full_case", "case_summary").otherwise("query_text")
    message = F.when(query == "", F.concat(field, F.lit(" must not be blank"))).when(~known, F.concat(F.lit(f"source_type must be one of {sorted(source_types)}, got '"), kind, F.lit("'")))
    asked = requests.select("session_id", "request_id", query.alias("query_text"), "query_mode", F.greatest(F.lit(1), F.least(F.lit(MOST_HITS), F.coalesce(F.col("top_k"), F.lit(default_k)))).alias("top_k"), kind.alias("source_type"), message.alias("error_message"))
    good = asked.where("error_message is null")
    calls = good.select("session_id", "request_id", F.row_number().over(Window.partitionBy("session_id").orderBy("request_id")).alias("call_count"))  # calls of one session
    hits = None
    for one in (None, *source_types):
        own = index if one is None else index.where(F.col("source_type") == one)
        these = good.where(F.coalesce("source_type", F.lit("")) == (one or "")).select(F.col("request_id").alias("query_id"), F.col("query_text").alias("query"), "top_k")
        found = bm25(own, these, MOST_HITS, key).join(these.select("query_id", "top_k"), "query_id").where(F.col("rank") <= F.col("top_k")).drop("top_k")
        hits = found if hits is None else hits.unionByName(found)
    listed = hits.groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key), "score"))).alias("results"))  # MOST_HITS at most
    answered = asked.join(calls, ["session_id", "request_id"], "left").join(listed, "request_id", "left")
    failed = F.col("error_message").isNotNull()
    return answered.select(
        "session_id", "request_id", "query_text", "query_mode", "top_k", "source_type", F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "ValueError").alias("error_type"), "error_message",
        "call_count", F.when(~failed, F.coalesce(F.size("results"), F.lit(0))).alias("count"), "results",
    )
