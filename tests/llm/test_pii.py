import hashlib
import random
import re
import time

from treelens.llm import pii

CASES = [
    "a@b.c_d@e.f x@y@z.w 1.2.3.4.5 999.1.1.1 0001.2.3.4 4111 1111-1111 1111 4111111111111111 5 4111  1111", "+1 (234) 567-8901) +12 +1234567890123456789 +44 20.7946-0958é é 1.2.3.4",
    "é𝄞 joe@x.org, +1-202-555-0143", "", None, "a" * 5000 + "@b.cd " + "1.2." * 3000 + "9" * 3000, "x@y.z" * 3, "4111111111111111 4111111111111111", "-@-.-.- +1 +1 +1234567890 ",
]


def brute(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(CASES)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(CASES)
    for i, text in enumerate(CASES):
        want = ",".join(f"{k}:{b}:{e}" for k, b, e in brute(text))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text[:80]
        assert got[i].spans.startswith(want)
        assert got[i].n_email == sum(k == "email" for k, *_ in brute(text))


def test_bootstrapping_finds_what_no_pattern_knows(spark):
    seeds = [(i, f"please write to contact address: user{i}@mail.org today") for i in range(8)]
    new = [(100, "please write to contact address: KX-99-ZZ12 today"), (101, "on page 77 of KX-99-ZZ12 there is nothing of the sort")]
    docs = spark.createDataFrame(seeds + new + [(None, None), (100, new[0][1])], "doc_id long, text string")
    got = pii.find(docs).collect()
    assert len(got) == 12
    found = [r for r in got if r.n_id]
    assert [r.doc_id for r in found] == [100, 100] and all(r.spans == "id:33:43" for r in found)
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[100] == "please write to contact address: <ID> today"
    assert redacted[3] == "please write to contact address: <EMAIL> today" and redacted[None] is None


def test_redaction_merges_overlaps_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "call +1-4111-1111-1111 now é joe@x.org", "a", 5), (2, None, "b", 0), (3, "", "c", 0)], "doc_id long, text string, source string, n_chars long")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "call <PHONE> now é <EMAIL>" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == ""
    assert pii.find(docs.limit(0)).count() == 0


def test_redaction_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "to joe@x.org", 3, "k", "b", "m")], "doc_id long, text string, `a.b` int, _key string, _base string, _merged string")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "to <EMAIL>", 3, "k", "b", "m")]


def test_planted_identifiers_are_found_and_little_else(spark):
    """Secrets of three kinds among prose with harmless numbers: recall and precision by document and span."""
    dice = random.Random(9)
    words = ["".join(dice.choice("abcdefghilmnoprstu") for _ in range(dice.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(dice.choice(words) if dice.random() > 0.06 else dice.choice([str(dice.randint(1900, 2030)), f"{dice.randint(1, 99)}.50", f"v{dice.randint(1, 9)}.{dice.randint(10, 30)}"]) for _ in range(n))

    def plant(k):
        if k % 3 == 0:
            return 'api_token = "', "".join(dice.choice("0123456789abcdef") for _ in range(40)), '"'
        if k % 3 == 1:  # most look like secrets, every fifth is short
            return "password=", "".join(dice.choice("0123456789abcdef") for _ in range(8 if k % 5 == 0 else 18)) + "a1", ""
        return "key ", "ZQXW" + "".join(dice.choice("ABCDEFGH0123456789") for _ in range(16)) + "0A1", ""

    rows, want = [], {}
    for k in range(600):
        text = prose(40)
        if k < 180:
            before, value, after = plant(k)
            begin = len(text) + 1 + len(before)
            want[k] = f"id:{begin}:{begin + len(value)}"
            text = f"{text} {before}{value}{after} {prose(10)}"
        rows.append((k, text))
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {(d, s) for d, spans in got.items() for s in spans.split(",") if s.startswith("id:")}
    right = found & set(want.items())
    assert len(right) >= 0.9 * len(want) and len(right) >= 0.9 * len(found)
    assert any(k % 3 == 1 and k % 5 == 0 and s in got[k] for k, s in want.items())  # short ones are discovered by their context


def test_very_many_candidates_in_one_text(spark):
    text = " ".join(f"w{i} 12{i}4 a{i}@b.cd" for i in range(30_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    row = pii.find(docs).first()
    out = pii.redact(docs).first().text
    assert row.n_email == 30_000 and out.count("<EMAIL>") == 30_000 and "@" not in out and out.startswith("w0 1204 <EMAIL> w1 1214 <EMAIL>")
    assert time.monotonic() - began < 90
