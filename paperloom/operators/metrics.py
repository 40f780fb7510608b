"""Evaluation: set metrics per case, macro averages over the cases that ran, rankings, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import f1, ratio, strip_ws


def set_metrics(df: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """Adds true_positives, predicted_count, expected_count, precision, recall, exact_match and primary_match.

    Both lists count as sets; null counts as empty. Nothing predicted: precision 0; nothing expected: recall 0; both empty:
    exact match 1, primary 0. The primary code is the first non-empty one.
    """
    empty = F.array().cast("array<string>")
    p, e = F.coalesce(predicted, empty), F.coalesce(expected, empty)
    ps, es = F.array_distinct(p), F.array_distinct(e)
    tp, np_, ne = F.size(F.array_intersect(ps, es)), F.size(ps), F.size(es)

    def first(a: Column) -> Column:
        return F.try_element_at(F.filter(a, lambda x: x != ""), F.lit(1))

    same = F.array_sort(ps) == F.array_sort(es)
    return df.withColumns(
        {
            "true_positives": tp,
            "predicted_count": np_,
            "expected_count": ne,
            "precision": ratio(tp.cast("double"), np_.cast("double")),
            "recall": ratio(tp.cast("double"), ne.cast("double")),
            "exact_match": F.when(same, 1.0).otherwise(0.0),
            "primary_match": F.when(first(p) == first(e), 1.0).otherwise(0.0),
        }
    )


def level_match(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Adds exact_match (1 if the stripped texts agree; 0 if nothing is expected) and answered (a non-blank prediction)."""
    p, e = strip_ws(F.coalesce(F.col(predicted).cast("string"), F.lit(""))), strip_ws(F.coalesce(F.col(expected).cast("string"), F.lit("")))
    return df.withColumns({"exact_match": F.when((e != "") & (p == e), 1.0).otherwise(0.0), "answered": F.when(p != "", 1.0).otherwise(0.0)})


def comparison_grid(df: DataFrame, key: str, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """One row per case and code of either list: correct, missed or unexpected."""
    both = F.array_union(F.coalesce(predicted, F.array().cast("array<string>")), F.coalesce(expected, F.array().cast("array<string>")))
    rows = df.select(key, F.explode(both).alias("code"), predicted, expected)
    in_p, in_e = F.coalesce(F.array_contains(predicted, F.col("code")), F.lit(False)), F.coalesce(F.array_contains(expected, F.col("code")), F.lit(False))
    return rows.select(key, "code", F.when(in_p & in_e, "correct").when(in_e, "missed").otherwise("unexpected").alias("outcome"))


def macro_summary(df: DataFrame, metrics: list[str], status: str = "status") -> DataFrame:
    """One row: rows, ok rows, error rows and the mean of each metric over the ok rows, 0 if there are none."""
    ok = F.col(status) == "ok"
    return df.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_errors"), *(F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.0)).alias(f"mean_{m}") for m in metrics))


def rank_variants(df: DataFrame, finalists: int = 2) -> DataFrame:
    """Variants by F1 of their mean precision and recall, then recall, then run time; the first ones are finalists."""
    ok = F.col("status") == "ok"
    means = df.groupBy("variant").agg(F.count_if(ok).alias("n_ok"), *(F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(c) for c in ("precision", "recall", "seconds")))
    scored = means.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), F.desc("recall"), F.asc("seconds"), F.asc("variant"))  # a row per variant
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("finalist", F.col("rank") <= finalists)


def span_summary(spans: DataFrame) -> DataFrame:
    """Per span type: count, total, mean and longest seconds and the share of the trace's time."""
    per = spans.groupBy("span_type").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest"))
    return per.withColumn("share", ratio(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))))  # a row per type


def early_late(calls: DataFrame, group: str, order: list[str], value: str, n: int = 5) -> DataFrame:
    """Per group the mean of the first and of the last ``n`` calls."""
    up = Window.partitionBy(group).orderBy(*order)
    down = Window.partitionBy(group).orderBy(*(F.col(c).desc() for c in order))
    edge = calls.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    return edge.where((F.col("_up") <= n) | (F.col("_down") <= n)).groupBy(group).agg(F.avg(F.when(F.col("_up") <= n, F.col(value))).alias("early"), F.avg(F.when(F.col("_down") <= n, F.col(value))).alias("late"))


def flatten_spans(spans: DataFrame) -> DataFrame:
    """Spans with their parent's name, their order in the trace by start and their seconds."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"))
    w = Window.partitionBy("trace_id").orderBy("start_ns", "span_id")
    return spans.join(parent, ["trace_id", "parent_span_id"], "left").withColumns({"order": F.row_number().over(w), "seconds": (F.col("end_ns") - F.col("start_ns")) / 1e9})


def tool_calls(messages: DataFrame, group: str) -> DataFrame:
    """Tool calls of each run; a message without any, or with null, counts none."""
    return messages.groupBy(group).agg(F.sum(F.when(F.col("tool_calls").isNull(), 0).otherwise(F.size("tool_calls"))).alias("n_tool_calls"))


def budget_exhausted(spark, key: str, value) -> DataFrame:
    """The row a run gives that used up its steps."""
    return spark.createDataFrame([(value, [], "", "step budget exhausted")], f"{key} {'bigint' if isinstance(value, int) else 'string'}, predicted array<string>, rationale string, error string")
