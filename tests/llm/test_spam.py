import random

from paperloom.llm import spam as s

SUBJECTS = ["the court", "a clerk", "the officer", "one reader", "our office", "the defendant", "counsel", "the panel"]
VERBS = ["considered", "rejected", "explained", "reviewed", "described", "postponed", "accepted", "filed"]
OBJECTS = ["the motion", "a long letter", "the written record", "an appeal", "the schedule", "a short note", "the report", "two exhibits"]
TAILS = ["without delay", "after the hearing", "in spring", "for good reasons", "as expected", "on the same day", "before noon", "with some doubt"]
SCHEMA = "doc_id long, text string, lang string, judged string"


def prose(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(TAILS)}." for _ in range(n))


def pages(rng):
    rows = [(i, prose(rng, rng.randint(6, 40)), rng.choice(["en", "EN", "eng", None]), None) for i in range(400)]
    bad = {
        1000: " ".join(rng.choice(["cheap pills", "bail bonds"]) for _ in range(80)),
        1001: "\n".join(f"https://www.shop{i}.example/buy-{i}" for i in range(30)),
        1002: "\n".join(rng.choice(["Home", "Login", "Cart (0)", "Sitemap", "Next »"]) for _ in range(80)),
        1003: " ".join(f"#labcoat{i} #scrubs" for i in range(40)),
        1004: "Our sofa outlet is the best sofa outlet of all sofa outlet offers. " * 12,
    }
    good = {2000: "Records\n" + "\n".join(f"{i}. The motion ...... {i}\n{i}. An appeal ...... {i}" for i in range(20)), 2001: prose(rng, 20) + "\nhttps://a.example/x\nhttps://b.example/y", 2002: "", 2003: None, 2004: "too short"}
    return rows + [(k, v, "en", None) for k, v in {**bad, **good}.items()], bad, good


def test_found(spark):
    rows, bad, good = pages(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id for r in s.spam_pages(df).collect()}
    assert found == set(bad)
    judged = s.judge_pages(df.repartition(3)).collect()
    assert len({r.doc_id for r in judged}) == len(judged) and {2002, 2003, 2004}.isdisjoint(r.doc_id for r in judged)


def test_no_documents(spark):
    assert s.spam_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_curves_agree_with_a_direct_fit(spark):
    import numpy as np

    text = "a a a a b b c c d e f g"
    df = spark.createDataFrame([(1, text, "en", None)], SCHEMA)
    got = s.curves(s.fingerprints(df)).first()
    f, ranks = np.array([4, 2, 2, 1, 1, 1, 1]), np.array([1, 2.5, 2.5, 5.5, 5.5, 5.5, 5.5])
    x, y, w = np.log(ranks), np.log(f), f / f.sum()
    mx, my = (w * x).sum(), (w * y).sum()
    slope = (w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum()
    residual = np.sqrt((w * (y - my - slope * (x - mx)) ** 2).sum())
    assert abs(got.slope - slope) < 1e-9 and abs(got.residual - residual) < 1e-9 and abs(got.types - np.log(7)) < 1e-9


def test_page_words():
    assert s.page_words("See https://x.example/a?b=1 or docs.y.test/z, now 12 Times") == ["see", "\x01", "or", "\x01", "now", "times"]
    assert s.page_words("十月 d'été") == ["十", "月", "d", "été"]


def test_copies_do_not_make_their_own_norms(spark):
    rng = random.Random(2)
    spam = " ".join(rng.choice(["cheap pills", "bail bonds", "court forms"]) for _ in range(64))
    rows = [(i, prose(rng, rng.randint(6, 40)), "en", None) for i in range(240)]
    rows += [(1000 + i, f"{spam} {i}".upper() if i % 2 else f"{i} {spam}", "en" if i % 3 else None, None) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in s.spam_pages(df).collect()) == [1000 + i for i in range(160)]


def test_a_page_is_held_against_the_other_pages(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 12), "en", None) for i in range(21)] + [(99, "quick brown foxes never jump over many lazy hounds today", "en", None)]
    prints = s.fingerprints(spark.createDataFrame(rows, SCHEMA)).cache()
    columns = ["lang", "n", "words", "counts"]
    of = lambda among: {r.doc_id: r for r in s.divergences(prints, *s.prose_reference(prints.where(among).select(*columns))).collect()}
    whole, without = of("true"), of("doc_id <> 99")
    assert whole[99].divergence < 3.2 < 4.15 < whole[99].from_others
    assert abs(whole[99].from_others - without[99].divergence) < 1e-5
    prints.unpersist()


def test_spam_in_a_small_language(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 12), "en", None) for i in range(24)] + [(99, "foxes hounds foxes berry hounds lawn berry " * 2 + " ".join(f"shed{c}" for c in "abcdefghijklmnopqrstu"), "en", None)]
    judged = {r.doc_id: r for r in s.judge_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k, r in judged.items() if r.spam] == [99]


def test_page_keys_ignore_order(spark):
    rows = [(1, "a b c d a b c a b a", "en", None), (2, "D c b a; c b a 7 b a a!", None, None), (3, "a b c d a b c a b b", "en", None)]
    key = {r.doc_id: r.page for r in s.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert key[1] == key[2] != key[3]


def test_repeated_words_of_the_corpus(spark):
    rng = random.Random(5)
    letters = "bcdfghklmnprstvw"
    usual, rest = [a + "o" for a in letters[:10]], [a + "a" + b for a in letters for b in letters][:160]
    rows = [(i, " ".join(rng.choice(usual if rng.random() < 0.5 else rest) for _ in range(rng.randint(50, 120))) + ".", "en", None) for i in range(300)]
    words = [w for w in rest[20:30] for _ in range(8)]
    rng.shuffle(words)
    rows += [(1000, " ".join(words), "en", None), (1001, ". ".join(" ".join(words[i : i + 5]).capitalize() for i in range(0, 80, 5)), "en", None)]
    rows += [(2000, "\n".join(f"{i + 1}. {' '.join(words[i : i + 5])} ..... {i}" for i in range(0, 80, 5)), "en", None)]
    judged = {r.doc_id: r for r in s.judge_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert judged[1000].divergence < s.FAR_WITH_CURVE and judged[1000].curve > s.EXTREME
    assert sorted(k for k, r in judged.items() if r.spam) == [1000, 1001]


def test_divergences_do_not_move_with_the_size(spark):
    """The same pages against ten times as many pages of prose with ten times as many rare words."""
    rng = random.Random(9)
    common = [f"word{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(300)]

    def text(n, start):
        rare = lambda: "".join(rng.choice("ijklmnopqrstuvwxyz") for _ in range(9))
        return [(start + i, "en", " ".join(rng.choice(common) if rng.random() < 0.9 else rare() for _ in range(80))) for i in range(n)]

    seen = {}
    for n in (60, 600):
        pages = [(1, "en", "cheap watches online " * 27), (2, "en", " ".join(common[:80]))]
        prints = s.fingerprints(spark.createDataFrame(text(n, 100) + pages, "doc_id long, lang string, text string"))
        reference, count = s.prose_reference(prints.where("doc_id >= 100").select("lang", "n", "words", "counts"))
        assert len(reference[0]) <= 2 / s.UNKNOWN and (reference[0][1:] > reference[0][:-1]).all()
        got = s.divergences(prints.where("doc_id < 100"), reference, count)
        seen[n] = {r.doc_id: r.divergence for r in got.collect()}
    for doc in (1, 2):
        assert abs(seen[60][doc] - seen[600][doc]) < 0.3
