import random

import pytest

from paperloom.llm import splitting as s


def check(text, limit, overlap):
    spans = s.split_text(text, limit, overlap)
    o = max(0, min(overlap, limit - 1))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= limit for a, b in spans)
    assert all(y[0] == x[1] - o and y[1] > x[1] for x, y in zip(spans, spans[1:]))
    assert text[: spans[0][1]] + "".join(text[a + o : b] for a, b in spans[1:]) == text
    return spans


def test_random_texts():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\n\n", ".", ". ", "\r\n", "é", "。", "\u0301"]) for _ in range(rng.randint(0, 250)))
        check(text, rng.randint(1, 60), rng.randint(0, 80))


def test_cuts_fall_on_the_best_boundaries():
    paragraphs = ["word " * 18 + "end." for _ in range(6)]
    text = "\n\n".join(paragraphs)
    spans = check(text, 220, 10)
    assert all(text[:b].endswith("\n\n") for _, b in spans[:-1])
    sentences = "Aaa bbb ccc. " * 40
    assert all(sentences[:b].endswith(". ") for _, b in check(sentences, 100, 5)[:-1])
    assert len(check("x" * 1000, 100, 10)) >= 11


def test_pieces_are_even():
    spans = check("Some words here. " * 200, 1500, 100)
    sizes = [b - a for a, b in spans]
    assert max(sizes) - min(sizes) < 400


def test_limit_must_be_positive():
    with pytest.raises(ValueError):
        s.split_text("abc", 0, 0)


def test_table(spark):
    schema = "chunk_id string, semantic_path string, source_type string, text string, loaded_at timestamp, piece_no string"
    rows = [("a", "p > q", "USSG", "one two. " * 10, None, "clash"), ("a", "p > q", "ussg", "one two. " * 10, None, None), ("b", None, "ussg", "x" * 50, None, None), ("c", "p", "ussg", "x" * 51, None, None), ("d", "p", "other", "x" * 999, None, None), ("e", "p", None, "x" * 99, None, None), ("f", "p", "ussg", None, None, None)]
    config = spark.createDataFrame([("ussg", 50, 5, 4.0)], "source_type string, max_chunk_chars int, overlap_chars int, chars_per_token_estimate double")
    got = s.split_oversized(spark.createDataFrame(rows, schema), config).orderBy("chunk_id", "piece_no").collect()
    assert [(r.chunk_id, r.piece_no, r.n_pieces) for r in got] == [("a", 1, 2), ("a", 2, 2), ("c", 1, 2), ("c", 2, 2)]
    assert got[0].text + got[1].text[5:] == "one two. " * 10 and got[0].semantic_path == "p > q"
    assert s.split_oversized(spark.createDataFrame([], schema), config).count() == 0


def test_pieces_give_their_text_back(spark):
    from paperloom.llm import splitting

    text = "One sentence here. Another one follows.\n\n" * 40
    chunks = spark.createDataFrame([("a", "p", "memo", text, 1), ("b", "p", "memo", "short", 1), ("c", "p", "memo", None, 1), ("d", None, "memo", "x" * 500, 1)], "chunk_id string, semantic_path string, source_type string, text string, loaded_at int")
    config = spark.createDataFrame([("memo", 200, 30)], "source_type string, max_chunk_chars int, overlap_chars int")
    got = {r.chunk_id: r for r in splitting.reassembled(splitting.split_oversized(chunks, config)).collect()}
    assert set(got) == {"a", "d"} and got["a"].text == text and got["d"].text == "x" * 500
    assert all(r.longest <= 200 and r.overlaps == [30] for r in got.values())
