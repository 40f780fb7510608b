"""Readers: tables by format, listings by path, exported documents, text and markup files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGES = "docket_id string, source_pdf_path string, source_file_name string, docintel_model string, page_count int, content_length int, full_text string, pages array<struct<page_number:int,text:string>>"
# Formats by file suffix; anything else is Parquet.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".csv.gz": "csv"}


def infer_format(path: str) -> str:
    low = path.lower().rstrip("/")
    return next((f for s, f in FORMATS.items() if low.endswith(s)), "parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, multiline: bool = False, separator: str = ",") -> DataFrame:
    """Delimited text with a header and doubled quotes; without a schema every column is a string, so no inference pass runs.

    Compressed and multiline files are read whole by one task each; the rows are spread afterwards.
    """
    reader = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    df = (reader.schema(schema) if schema else reader).csv(path)
    whole = multiline or any(str(p).endswith(".gz") for p in ([path] if isinstance(path, str) else path))
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if whole else df


def read_table(spark: SparkSession, path: str, format_hint: str | None = None, schema: str | StructType | None = None) -> DataFrame:
    """A file of any of the known formats."""
    kind = format_hint or infer_format(path)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, schema, separator="\t" if kind == "tsv" else ",")
    if kind == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    return (spark.read.schema(schema) if schema else spark.read).format(kind).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def register(spark: SparkSession, path: str, view: str, format_hint: str | None = None) -> DataFrame:
    """A file as a temporary view; an error if it is missing."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    df = read_table(spark, path, format_hint)
    df.createOrReplaceTempView(view)
    return df


def read_binary(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, content) of whole files; the content is read only by plans that use it."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(path).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 are replaced."""
    return read_binary(spark, path, glob).select("path", F.decode("content", "UTF-8").alias("text"))


def list_paths(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False, dockets: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(docket_id, path, ord) of files below per-docket folders, in order; without file contents.

    Blank docket names are dropped; None means all. ``ord`` counts from 1.
    """
    wanted = sorted({d.strip() for d in dockets or [] if d and d.strip()})
    roots = [path] if isinstance(path, str) else list(path)
    if dockets is not None:
        # folders of other dockets are never listed
        roots = [p for root in roots for d in wanted for p in (f"{root.rstrip('/*')}/{d}", f"{root.rstrip('/*')}/{d}/*") if path_exists(spark, p)]
    empty = spark.createDataFrame([], "docket_id string, path string, ord bigint")
    if not roots:
        return empty
    found = read_binary(spark, roots, glob, recursive).select("path").distinct()
    docket = F.regexp_extract("path", r"/([0-9]+)/[^/]*(?:/[^/]*)?$", 1)
    rows = found.select(docket.alias("docket_id"), "path").where("docket_id <> ''")
    if limit is not None:
        rows = rows.orderBy("path").limit(limit)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("docket_id").orderBy("path")))


def preview_paths(found: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` listed files by path with their place ``index``, from 1, and the number of all."""
    total = found.agg(F.count("*").alias("n")).first()["n"]
    first = found.orderBy("path").limit(n)  # as many rows as are shown
    return first.withColumns({"index": F.row_number().over(Window.orderBy("path")), "n_files": F.lit(total)})


def first_of_many(files: DataFrame, *extractors: Callable[[bytes], list[str]]) -> DataFrame:
    """``extract_pages`` with a chain of plug-ins: a file goes to the next one where the last failed; if all fail, the row
    holds the last error."""

    def chain(content: bytes) -> list[str]:
        problem: Exception = ValueError("no extractor")
        for one in extractors:
            try:
                return one(content)
            except Exception as failed:  # the next one may read it
                problem = failed
        raise problem

    return extract_pages(files, chain)


def read_exports(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Exported documents: one JSON object a file, or one a line as ``write_exports`` writes them."""
    return spark.read.schema(PAGES).option("multiLine", not lines).json(path)


def pages_of(exports: DataFrame) -> DataFrame:
    """(docket_id, source_file_name, page, text): the pages of exported documents; the full text is page 1 where they have
    none."""
    pages = F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.array(F.struct(F.lit(1).alias("page_number"), F.col("full_text").alias("text"))))
    return exports.select("docket_id", "source_file_name", F.explode(pages).alias("p")).select("docket_id", "source_file_name", F.col("p.page_number").alias("page"), F.col("p.text").alias("text"))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text, error) of binary files by a plug-in, such as a PDF or OCR library; a file that fails gives one row
    with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(extractor(bytes(content)), 1)]
                except Exception as problem:
                    out.append((path, 0, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def resolve_years(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """(year, path): per four-digit year folder the path that matches the earliest of the ordered patterns."""
    rank = None
    for i, p in enumerate(patterns):
        rank = F.when(F.col("path").rlike(p), i) if rank is None else rank.when(F.col("path").rlike(p), i)
    year = F.nullif(F.regexp_extract("path", r"/(\d{4})/", 1), F.lit("")).try_cast("int")
    hits = paths.select(year.alias("year"), "path", rank.alias("rank")).where("year is not null and rank is not null")
    return hits.groupBy("year").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def change_file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of line-oriented change files, lines numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
