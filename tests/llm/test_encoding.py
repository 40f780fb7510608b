import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import encoding as e

tiktoken = pytest.importorskip("tiktoken")
RANKS = e.parse_ranks(e.read_ranks(e.vocabulary_path()))
ENCODER = e.TrieEncoder(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "\n\n", "a  b", "it's we'LL don't", "<|endoftext|>", "naïve — “quoted”…", "数据 处理", "👩🏽‍⚕️⚖️", "\x1c\x85\u00a0x", "123456789012", "a" * 3000, "ab" * 2000, "\t\tif x:\n\t\t\treturn 1\n", "Ünïcödé", "\u2028\u200b", "é", "   x", "x   "]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ENCODER.encode_batch([text])[0] == REFERENCE.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
def test_any_text(text):
    assert ENCODER.encode_batch([text])[0] == REFERENCE.encode_ordinary(text)


def test_words_rebuild_the_text():
    for text in HARD:
        assert "".join(e.words_of(text)) == text


def test_small_vocabularies_agree_with_plain_merging():
    rng = random.Random(2)
    for _ in range(60):
        ranks = {b"a": 0, b"b": 1, b"c": 2}
        while len(ranks) < rng.randint(3, 14):
            x, y = rng.choice(list(ranks)), rng.choice(list(ranks))
            ranks.setdefault(x + y, len(ranks))
        encoder = e.TrieEncoder(ranks)
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(40)}
        encoder.learn(words)
        for w in words:
            assert [encoder.tokens[i] for i in encoder.cache[w]] == encoder.merge(w.encode())


def test_corpus(spark, monkeypatch):
    monkeypatch.setattr(e, "CHARS_AT_ONCE", 50)
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(100, None, None), (None, "null id", None), (1, " ", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in e.encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, REFERENCE.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    counted = {(r.doc_id, r.n_tokens) for r in e.count_tokens(df, ["doc_id"]).collect()}
    assert counted == {(i, len(ids)) for i, ids in got}
    assert e.encode_corpus(df.limit(0)).count() == 0


def test_ids_give_their_text_back(spark):
    from paperloom.llm import encoding

    texts = ["plain text", "", None, "naïve 十月 \U0001f600 <|endoftext|>", "a" * 3000, "\n\n  tabs\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in encoding.decode_corpus(encoding.encode_corpus(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert encoding.decode_corpus(encoding.encode_corpus(df.limit(0))).count() == 0
