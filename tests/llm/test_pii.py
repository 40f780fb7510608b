import json
import random

from paperloom.llm import pii as p

SCHEMA = "input_id long, case_summary string, case_facts string, kind string"
GIVEN, FAMILY = ["Ada", "Boris", "Clara", "Dario"], ["Fennick", "Marlowe", "Quist", "Tarrant"]
FILLER = ["The motion was filed in Harrow Falls.", "Agents bought 23 tablets @ $339 each.", "See docket 5:16-cr-00661 and exhibit DISC-8871909.", "Tracking number 7427 1887 0921 was noted.", "The car went 16 miles along Cinder Street.", "Quill & Sons Hauling paid $5 for storage.", "On 4 May 2019 the clerk was told that nothing had been moved.", "Contact details were withheld: [EMAIL]."]


def corpus():
    rng = random.Random(3)
    rows, truth = [], set()
    n = 0

    def add(kind, sentence, field="case_summary"):
        nonlocal n
        text = f"{rng.choice(FILLER)} {sentence} {rng.choice(FILLER)}"
        row = [n, None, None, "clash"]
        row[1 if field == "case_summary" else 2] = text if field == "case_summary" else json.dumps([{"fact": text}])
        rows.append(tuple(row))
        if kind:
            truth.add((n, field, kind))
        n += 1

    names = [(g, f) for g in GIVEN for f in FAMILY]
    for i in range(160):
        g, f = names[i % len(names)]
        form = [f"Ms. {g} {f}", f"{g} {f}", f"{g} “Duke” {f}", f"{g.lower()} {f.lower()}", f"{f.upper()}, {g.upper()}", f"{g[0]}. {f}", f"Dr. {f}", f"{g} R. {f} Jr."][i // 4 % 8]
        add("name", rng.choice(["Victim: {}. Loss unknown.", "The letter was signed by {} last week.", "The caseworker spoke with {} about housing."]).format(form), rng.choice(p.FIELDS))
        area, last = rng.randint(200, 999), rng.randint(100, 199)
        phone = [f"({area}) 555-0{last}", f"+1 {area} 555 0{last}", f"{area}.555.0{last}", f"555-0{last}", "six six four, five five five, zero one six three", f"+44 20 7946 0{last}"][i % 6]
        add("phone", rng.choice(["The handset used {}.", "He left {} with the clerk.", "Toll records for {} cover two months."]).format(phone), rng.choice(p.FIELDS))
        ident = [f"SSN {area}-12-3456", f"{area}-12-3456", f"passport no. X{area}4567", f"MRN 2{area}123", f"inmate register number 86{area}-768"][i % 5]
        add("id_number", rng.choice(["The report cites {} on its first page.", "Loan papers carried {} for the borrower.", "A copy of {} was found."]).format(ident), rng.choice(p.FIELDS))
        place = [f"{area} Old Pellmire Street", f"{area} OAK ST", f"{area}-B N. Ferry Rd.", f"Calle Verdona {last}", f"P.O. Box {last}", f"number {last}, Tarrow Close"][i % 6]
        add("address", rng.choice(["Mail was returned from {} as undeliverable.", "The van was registered at {}, it seems.", "Site visited: {}, twice."]).format(place), rng.choice(p.FIELDS))
        mail = [f"{g}.{f}@mail.example", f"{g} (at) mail dot example", f"{g}＠mail.example", f"{g}&#64;mail.example"][i % 4].lower()
        add("email", f"Reply was requested at {mail} before noon.", rng.choice(p.FIELDS))
    for _ in range(100):
        add(None, rng.choice(FILLER))
    return rows, truth


def test_found(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([*rows, rows[0], (9001, None, "", None), (9002, "  ", "[]", None)], SCHEMA)
    got = {(r.id, r.field, r.kind) for r in p.personal_kinds(p.find_personal(df)).collect()}
    assert got == truth, (sorted(got - truth)[:5], sorted(truth - got)[:5])


def test_redacted(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([*rows, rows[0], (9001, None, "", None)], SCHEMA)
    got = {r.input_id: r for r in p.redact(df).collect()}
    assert len(got) == len(rows) + 1 and got[9001].case_summary is None and got[9001].case_facts == ""
    for n, summary, facts, _ in rows:
        text = (got[n].case_summary or "") + (got[n].case_facts or "")
        kinds = {k for i, _, k in truth if i == n}
        assert all(f"[{k.upper()}]" in text for k in kinds)
        if not kinds:
            assert text == (summary or "") + (facts or "")
        if facts:
            json.loads(got[n].case_facts)


def test_empty(spark):
    assert p.find_personal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plain_text_maps_back():
    raw = '[{"fact": "a \\u00e9 \\"b\\" &#64; \\uff20 x\\ny"}]'
    text, at, raw_at = p.plain(raw)
    assert 'a é "b" @ @ x\ny' in text
    for i, c in enumerate(text):
        a, b = p.raw_span(i, i + 1, at, raw_at)
        assert p.plain(raw[a:b])[0] == c or c == p.CUT or raw[a:b] in ("\\n", '\\"')
    assert p.plain('say "x" \\n')[0] == 'say "x" \\n'


def test_masked_values_are_no_candidates():
    for text in ("XXX-XX-1234", "j***@example.com", "[NAME REDACTED]", "(***) ***-0171"):
        assert not [x for x in p.candidates_of(f"It says {text} here.") if x[0] in ("number", "email")]


def test_titles_alone_make_a_name(spark):
    rows, truth = corpus()
    titled = ["Ms. Okafor spoke first.", "According to Dr. Halvern, it was late.", "Mr. de la Cruz and two others left."]
    more = [(9100 + i, x, None, None) for i, x in enumerate(titled)] + [(9110, "We miss Harbor days. Mr. Pell & Sons Hauling paid.", None, None)]
    df = spark.createDataFrame([*rows, *more], SCHEMA)
    got = {(r.id, r.field, r.kind) for r in p.personal_kinds(p.find_personal(df)).collect()}
    assert got == truth | {(9100 + i, "case_summary", "name") for i in range(len(titled))}, (sorted(got - truth)[:8], sorted(truth - got)[:5])
