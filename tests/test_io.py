import json
import time

import pandas as pd
from pyspark.sql import functions as F

from paperloom.operators.store import VersionedTable
from paperloom.sources import readers, writers
from paperloom.streaming import incremental


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"x ""y""\nz"\n')
    (tmp_path / "b.tsv").write_text("id\ttext\n1\ta,b\n")
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert readers.read_csv(spark, f"{tmp_path}/a.csv", multiline=True).first().text == 'x "y"\nz'
    assert readers.register(spark, f"{tmp_path}/b.tsv", "b").first().text == "a,b"
    assert readers.read_table(spark, f"{tmp_path}/c.json").count() == 2
    assert readers.infer_format("x.parquet") == "parquet" and not readers.path_exists(spark, f"{tmp_path}/none")


def test_listing_and_exports(spark, tmp_path):
    for docket in ("12", "34"):
        (tmp_path / docket).mkdir()
        for n in (1, 2):
            (tmp_path / docket / f"d{n}.docintel.json").write_text(json.dumps({"docket_id": docket, "source_file_name": f"d{n}", "full_text": "whole", "pages": [{"page_number": 1, "text": "p"}] if n == 1 else []}))
    found = readers.list_paths(spark, f"{tmp_path}/*", "*.json", dockets=["12", " "]).orderBy("ord").collect()
    assert [(r.docket_id, r.ord) for r in found] == [("12", 1), ("12", 2)]
    assert readers.list_paths(spark, f"{tmp_path}", "*.json", dockets=["99"]).count() == 0 and readers.list_paths(spark, f"{tmp_path}/*", "*.json").count() == 4
    shown = readers.preview_paths(readers.list_paths(spark, f"{tmp_path}/*", "*.json"), 3).collect()
    assert [r["index"] for r in shown] == [1, 2, 3] and shown[0].n_files == 4
    pages = readers.pages_of(readers.read_exports(spark, f"{tmp_path}/*/*.json"))
    assert sorted(r.text for r in pages.collect()) == ["p", "p", "whole", "whole"]
    assert readers.read_texts(spark, f"{tmp_path}/12", "*.json").count() == 2

    def extract(content):
        if b'"d1"' in content:
            raise ValueError("no")
        return ["one", "two"]

    got = readers.extract_pages(readers.read_binary(spark, f"{tmp_path}/12", "*.json"), extract).collect()
    both = readers.first_of_many(readers.read_binary(spark, f"{tmp_path}/12", "*.json"), extract, lambda _: ["other"]).collect()
    assert sorted(r.text for r in both) == ["one", "other", "two"] and all(r.error is None for r in both)
    assert sorted((r.page, r.text, r.error) for r in got if r.page) == [(1, "one", None), (2, "two", None)] and sum(r.error is not None for r in got) == 1


def test_years_and_change_files(spark, tmp_path):
    paths = spark.createDataFrame([("/m/2019/b.html",), ("/m/2019/a.htm",), ("/m/2020/x.pdf",), ("/m/readme",)], "path string")
    assert [tuple(r) for r in readers.resolve_years(paths, [r"\.html$", r"\.htm$"]).collect()] == [(2019, "/m/2019/b.html")]
    (tmp_path / "c.txt").write_text("Add: A00\r\nDelete: B00")
    assert [(r.line, r.text) for r in readers.change_file_lines(spark, f"{tmp_path}/c.txt").orderBy("line").collect()] == [(1, "Add: A00"), (2, "Delete: B00")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "docket_id string, text string")
    assert not writers.write_parquet(df, f"{tmp_path}/p", skip=True)
    assert writers.write_parquet(df, f"{tmp_path}/p", "overwrite") and spark.read.parquet(f"{tmp_path}/p").count() == 1
    writers.write_exports(df, f"{tmp_path}/e", df)
    assert spark.read.json(f"{tmp_path}/e/documents").count() == 1
    assert json.loads(writers.summary_json(df.agg(F.count("*").alias("n")))) == {"n": 1}
    index = spark.createDataFrame([("c1", 1, "old")], "chunk_id string, ord int, text string")
    new = spark.createDataFrame([("c1", 2, "x"), ("c1", 3, "y"), ("c2", 1, "z")], "chunk_id string, ord int, text string")
    assert sorted((r.chunk_id, r.text) for r in writers.upsert_index(index, new, "ord").collect()) == [("c1", "y"), ("c2", "z")]


def run(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    schema = "docket_id string, claim_token string, claim_status string, at timestamp, review_version int"

    def put(name, *rows):
        frame = pd.DataFrame(rows, columns=["docket_id", "claim_token", "claim_status", "at", "review_version"])
        frame["at"] = pd.to_datetime(frame["at"], utc=True).dt.as_unit("us")
        frame["review_version"] = frame["review_version"].astype("int32")
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        time.sleep(0.05)

    put("1", ("1", "t", "claimed", "2024-01-01 10:00", 0), ("2", "u", "claimed", "2024-01-01 10:00", 0), ("1", "t", "claimed", "2024-01-01 10:00", 0))
    put("2", ("2", "u", "completed", "2024-01-01 10:05", 0))
    put("3", ("3", "w", "claimed", "2024-01-01 12:00", 0))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run(incremental.claim_expiry(stream()).writeStream.format("memory").queryName("claims").outputMode("append").start())
    got = {(r.docket_id, r.outcome) for r in spark.table("claims").collect()}
    assert ("2", "completed") in got and ("1", "expired") in got
    run(incremental.progress(stream(), "at", "claim_status").writeStream.format("memory").queryName("progress").outputMode("append").start())
    assert sum(r.n for r in spark.table("progress").collect()) == 4
    run(incremental.unseen(stream(), ["docket_id", "claim_status"], "at").writeStream.format("memory").queryName("unseen").outputMode("append").start())
    assert spark.table("unseen").count() == 4
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.commit(spark.createDataFrame([], schema), 0)
    run(incremental.flush_into(stream(), table, lambda b: b.groupBy("docket_id", "review_version").agg(*(F.max(c).alias(c) for c in ("claim_token", "claim_status", "at")))).option("checkpointLocation", f"{tmp_path}/cp").start())
    assert {r.docket_id for r in table.read().collect()} == {"1", "2", "3"}
