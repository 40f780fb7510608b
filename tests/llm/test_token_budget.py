import random

from pyspark.sql import functions as F

from paperloom.llm import token_budget as b


def longest_match(word, vocabulary, most):
    i = n = 0
    while i < len(word):
        i += next((k for k in range(min(most, len(word) - i), 0, -1) if word[i : i + k] in vocabulary), 1)
        n += 1
    return n


def test_counter_agrees_with_longest_match():
    rng = random.Random(1)
    for _ in range(400):
        vocabulary = {b"a", b"b", b"c"} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 15))}
        counter = b.LongestMatchCounter(list(vocabulary))
        for _ in range(20):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40)))
            assert counter.count(word) == longest_match(word, vocabulary, 8)


CHUNKS = "chunk_id string, source_type string, source_year int, lang string, text string, estimated_tokens int, loaded_at timestamp, n_tokens string"
CONFIG = "source_type string, max_chunk_chars int, overlap_chars int, chars_per_token_estimate double"


def test_chunk_tokens(spark):
    rows = [
        ("a", "USSG ", 2010, "en-US", "x" * 9, 3, 1, "clash"),
        ("b", "ussg", 2010, "eng", "x" * 8, None, 1, None),
        ("c", "usc-title18", None, None, "", 1, 1, None),
        ("d", "ussg", None, "EN", None, None, 1, None),
        ("e", "unknown", 2010, "es-MX", "abc", 7, 1, None),
        ("f", "ussg", 2010, "en", "x" * 8, 2, 1, None),
        ("f", "ussg", 2010, "en", "x" * 8, 9, 2, None),
        ("g", None, 2010, "en", "x", 1, 1, None),
        ("h", "Appendix_A", 2010, "en", "x" * 7, 2, 1, None),
    ]
    df = spark.createDataFrame([(*r[:6], None, r[7]) for r in rows], CHUNKS).withColumn("loaded_at", F.lit("2020-01-01").cast("timestamp"))
    latest = spark.createDataFrame([(*r[:6], None, r[7]) for r in rows if r[6] == 2], CHUNKS).withColumn("loaded_at", F.lit("2020-01-02").cast("timestamp"))
    df = df.where("not (chunk_id = 'f' and estimated_tokens = 9)").unionByName(latest)
    config = spark.createDataFrame([("ussg", 10, 1, 4.0), ("usc_title18", 10, 1, 4.0), ("appendix_a", 10, 1, 3.5)], CONFIG)
    got = {r.chunk_id: r for r in b.chunk_tokens(df, config).collect()}
    assert {k: r.wrong for k, r in got.items()} == {"a": False, "b": True, "c": False, "d": False, "e": None, "f": True, "g": None, "h": False}
    assert got["a"].lang == "en" and got["a"].source_type == "ussg" and got["e"].lang == "es" and got["d"].n_tokens == 0 and got["c"].estimate == 1
    total = b.chunk_budget(b.chunk_tokens(df, config)).agg(F.sum("n_chunks"), F.sum("n_wrong")).first()
    assert tuple(total) == (8, 2)
    assert b.chunk_budget(b.chunk_tokens(df.limit(0), config)).count() == 0


def test_document_budget(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "s", "d"), (2, None, "ENG", "s", "d"), (3, "", "en", "s", None)], "doc_id long, text string, lang string, source string, domain string")
    got = {(r.lang, r.domain): (r.n_docs, r.n_empty, r.counted_tokens) for r in b.document_budget(df).collect()}
    assert got == {("en", "d"): (2, 1, 2), ("en", None): (1, 1, 0)}
