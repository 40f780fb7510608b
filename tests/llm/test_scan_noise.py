import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import scan_noise as s
from paperloom.llm.filters import build, prefixes

WORDS = "procedural errors concerning the discharged portion of the sentence are harmless unless substantial rights were affected evidence excluded at trial may nevertheless establish the prescribed reporting period by a preponderance standard examples include concealment of the organizational structure and interference with inspection information".split()


def body(rng, n=40):
    return [rng.choice(WORDS) for _ in range(n)]


def lines_of(words, width=60):
    out, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def corpus():
    rng = random.Random(7)
    rows, truth, clean = [], set(), {}
    headers = {f: f"{rng.choice(['Reading Copy', 'Working Papers'])} of Volume {f}" for f in range(20)}
    for n in range(600):
        f = n % 40
        scanned = f < 30
        words = body(rng)
        lines = lines_of([*words, "self-reported", "end."])
        name = f"c{n}"
        if not scanned:
            rows.append((name, f"ussg/2010/t{f}.html", "\n".join(lines)))
            continue
        if n % 5 == 0:
            w = lines[1].split()
            k = rng.choice([i for i in range(len(w)) if len(w[i]) > 4])
            wrong = w[k]
            for meant, read in rng.sample([("o", "0"), ("e", "c"), ("i", "|")], 2 if n % 20 == 0 else 1):
                wrong = wrong.replace(meant, read, 1)
            if wrong != w[k]:
                w[k] = wrong
                lines[1] = " ".join(w)
                truth.add((name, "misread"))
        if n % 7 == 0:
            lines[2:3] = [lines[2] + " proce-", "dural " + "errors"]
            truth.add((name, "hyphen"))
        if n % 11 == 0:
            lines[3:3] = [lines[3] + " self-", "reported information"]
        if f < 20 and n % 3 == 0:
            head = headers[f] if n % 9 else headers[f].replace("o", "|", 1)
            lines.insert(2, head)
            truth.add((name, "header"))
        if n % 13 == 0:
            lines.insert(4, rng.choice(["- 12 -", "Page 7", "xiv", "3 of 9", "[l1]", "   44"]))
            truth.add((name, "page_number"))
        lines.append("Commentary")
        rows.append((name, rng.choice([f"ussg/2010/f{f}.pdf", f"/Volumes/x/ussg\\2010\\f{f}.PDF"]), "\r\n".join(lines)))
    return rows, truth


SCHEMA = "chunk_id string, source_path string, text string, line string"


def test_found(spark):
    rows, truth = corpus()
    extra = [("n1", None, "text"), ("n2", "a/b/c.pdf", None), ("n3", "a/b/c.pdf", ""), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows + extra], SCHEMA)
    got = {(r.chunk_id, r.noise) for r in s.noise_kinds(s.find_noise(df)).collect()}
    for kind in ("hyphen", "header", "page_number"):
        assert {x for x in got if x[1] == kind} == {x for x in truth if x[1] == kind}
    want, have = ({x for x in y if x[1] == "misread"} for y in (truth, got))
    assert have <= want and len(have) >= 0.9 * len(want)
    assert s.find_noise(df.limit(0)).count() == 0


@pytest.mark.parametrize("line, is_one", [("- 303 -", True), ("pg. 110", True), ("[341]", True), ("386 |", True), ("PAGE  304", True), ("399 of 439", True), ("— 31 —", True), ("xxiv", True), ("- l03 -", True), ("28.", False), ("11  37-44  44-55", False), ("two.", False), ("mix", False), ("", False), ("level 4", False)])
def test_page_numbers(line, is_one):
    assert s.is_page_number(line) == is_one


def test_divided_words_skip_noise():
    lines = ["the applica¬", "", "- 12 -", "SENTENCING MANUAL", "ble provision -", "was well-", "Known"]
    assert s.divided_words(lines) == [(0, 4, "applica", "ble")]


def test_repair():
    text = "Document: D\nThe first sen-\nReading Copy 3\ntence is misreod here and\n12\ngoes on.\n\nCommentary\nThe second one."
    got = s.repaired(text, {2, 4}, {1: 3}, {(3, "misreod"): "misread"})
    assert got == "Document: D\n\nThe first sentence is misread here and goes on.\n\nCommentary\n\nThe second one."
    assert s.repaired("", set(), {}, {}) == ""


def undone():
    undo = {}
    for n, (meant, read) in enumerate(s.CONFUSIONS):
        undo.setdefault(read, []).append((meant, n))
    return undo


def test_meanings_undo_confusions(spark):
    words = ["information", "modern", "clear", "in", "supercalifragilisticexpialidocious" * 3]
    df = spark.createDataFrame([(w,) for w in words], "word string").select(F.explode(prefixes(F.col("word"))).alias("p"))
    known = build(df, "p", 1000).may_hold
    assert "information" in s.meanings("inforrnati0n", undone(), 3, known)
    assert "modern" in s.meanings("modem", undone(), 3, known)
    assert {"in"} == set(s.meanings("1n", undone(), 3, known))
    assert s.meanings("", undone(), 3, known) == {}
    # a long word with many misread characters: neither its length nor their number matters
    long = words[-1]
    assert long in s.meanings(long.replace("i", "l").replace("o", "0"), undone(), 3, known)
    assert s.meanings("rnodem", undone(), 3, known, 1) == {}


def test_meanings_equal_enumeration(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aeoirnmcluv") for _ in range(rng.randint(2, 7))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string").select(F.explode(prefixes(F.col("word"))).alias("p"))
    known = build(df, "p", 4000).may_hold
    undo = undone()

    def every(word):
        """All texts by any number of confusions undone."""
        if not word:
            return {""}
        out = {word[0] + r for r in every(word[1:])}
        for k in (1, 2, 3):
            for meant, _ in undo.get(word[:k], ()) if k <= len(word) else ():
                out |= {meant + r for r in every(word[k:])}
        return out

    for w in rng.sample(words, 60):
        assert {x for x in s.meanings(w, undo, 3, known) if x in words} == (every(w) - {w}) & set(words)


@pytest.mark.parametrize("damage", [0.1, 0.2])
def test_near_headers_equal_all_pairs(spark, damage):
    rng = random.Random(5)
    headers = ["# guidelines reading edition #", "filed under seal #:#", "vol #", "a note", "sentencing manual reading copy", "office of sentence review working papers and other things that make a long line of more than one hundred letters in all"]

    def damaged(h, n):
        h = list(h)
        for _ in range(n):
            k = rng.randrange(len(h))
            h[k : k + 1] = rng.choice([[rng.choice("|,.'l#")], [], [h[k], "l"], ["r", "n"]])
            h = h or ["x"]
        return "".join(h)

    templates = sorted({damaged(h, n) for h in headers for n in range(12) for _ in range(40)})
    t = spark.createDataFrame([("", x) for x in templates] + [("f", "vol |"), ("g", "vol |")], "scope string, template string")
    h = spark.createDataFrame([("", x) for x in headers] + [("f", "vol #")], "scope string, header string")
    got = {tuple(r) for r in s.near_headers(t, h, damage).collect()}
    near = t.join(h, "scope").where(F.levenshtein("template", "header") <= s.damage_of(F.length("header"), damage)).select("scope", "template").distinct()
    assert got == {tuple(r) for r in near.collect()}
    assert ("f", "vol |") in got and ("g", "vol |") not in got and len(got) > 150


@pytest.mark.parametrize("direct", [0, 10_000])
def test_one_file_holds_a_tenth(spark, monkeypatch, direct):
    """Damaged headers of a busy file, and of files that show theirs damaged only; compared directly or by pieces."""
    monkeypatch.setattr(s, "PAIRS_OF_FILE", direct)
    rng = random.Random(11)
    rows, truth = [], set()
    for n in range(900):
        f = 0 if n % 10 == 0 else 1 + n % 30
        lines = lines_of(body(rng, 30))
        head = f"Compilation of Records, Volume {f}"
        if n % 4 == 0 or f == 0:
            if n % 3 == 0:
                k = rng.randrange(14)
                head = head[:k] + "#" + head[k + 1 :]
            lines.insert(1, head)
            truth.add(f"c{n}")
        if f == 0:
            lines.append(f"Heading {''.join(rng.choice('abcdefghijklmnop') for _ in range(12)).title()}")
        rows.append((f"c{n}", f"m/2011/f{f}.pdf", "\n".join(lines)))
    got = s.find_noise(spark.createDataFrame(rows, "chunk_id string, source_path string, text string")).where("noise = 'header'")
    assert {r.chunk_id for r in got.collect()} == truth


def test_filters_grow_with_their_entries(spark):
    df = spark.range(20_000).select(F.concat(F.lit("wort"), "id").alias("w"))
    f = build(df, "w", 20_000)
    assert all(f.may_hold_text(f"wort{n}") for n in range(0, 20_000, 37))
    assert sum(f.may_hold_text(f"other{n}") for n in range(20_000)) < 800
    assert build(df.limit(0), "w", 0).may_hold_text("wort1") is False
