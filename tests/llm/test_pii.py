import hashlib
import re

from tests.llm.helpers import clashing, documents, prose
from tracetrim.llm import pii

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(t):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, t or "", re.ASCII) if passes(k, m.group())]
    return ",".join(f"{PLAIN[i][0]}:{s}:{e}" for s, i, e in sorted(found)), [sum(x[1] == i for x in found) for i in range(4)]


CASES = ["x a.b@c.de%x@y.org z", "1.2.3.4.5.6.7.8 and 256.1.1.1, 001.02.255.0", "4111 1111-1111 1111 and 4111 1111 1111 1112", "+1 (499) 555-6503. +49 30 123",
         "é😀 me@x.com 😀", None, "", "+12345678901234567890 0000000000255.0.0.1", "4111111111111111 4111111111111111", "a" * 30000 + "@", "1" * 20000,
         "a@" + "b." * 5000 + "c", "+" + "1(" * 4000, "9.9.9.9@host.org", "5555-5555 5555 4444", "mail@mail@mail.com", "1.1.1.1.1.1.1.1.1", prose(4, 200)]


def test_base_spans_against_python(spark):
    got = {r.doc_id: r for r in pii.find(clashing(documents(spark, CASES))).collect()}
    for i, t in enumerate(CASES):
        text, counts = brute(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t and t[:60]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_added_spans(spark):
    texts = ["mail me: john (at) example (dot) org now", "call 555-123-4567 please", "card 4111.1111.1111.1111 x", prose(6, 80),
             "ip 2001:0db8:0000:0000:0000:ff00:0042:8329 ok", "Meet at noon. We met at home, dot by dot."]
    texts += [f"{prose(i, 9)} user{i}@mail.com +1 (212) 555-01{i:02d} 10.0.0.{i}" for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, texts)).collect()}
    assert got[0].startswith("email:9:") and got[1] == "phone:5:17" and got[2] == "card:5:24" and got[4].startswith("ip:3:")
    assert got[3] == "" and got[5] == ""


def test_redaction(spark):
    df = clashing(documents(spark, ["hi a@b.co and +1 (499) 555-6503!", "none here", None, "", "9.9.9.9@host.org tail", "a@b.co"]))
    out = pii.redact(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text == {0: "hi [EMAIL] and [PHONE]!", 1: "none here", 2: None, 3: "", 4: "[EMAIL] tail", 5: "[EMAIL]"}
    assert {r.doc_id: r.n_chars for r in out.collect()}[0] == len(text[0])


def test_expectation_maximisation_finds_the_reliable_labelers():
    rows = [("email", [1, 1, 1, 0, 1], 500), ("email", [-1, 1, -1, 0, -1], 400), ("email", [1, -1, 1, 0, 1], 300), ("email", [-1, -1, -1, 0, -1], 200)]
    p = pii.reliabilities(rows)
    assert p["email", (1, -1, 1, 0, 1)] > 0.9 and p["email", (-1, 1, -1, 0, -1)] < 0.1
    assert pii.reliabilities([]) == {}


def test_empty(spark):
    assert pii.find(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0


def plain_choice(spans):
    """Base spans and the looser ones that meet none, nor a looser one (itself clear of base spans) before them."""
    def meet(a, b):
        return a[0] < b[2] and b[0] < a[2]

    base, loose = ([s for s in spans if s[3] == b] for b in (True, False))
    clear = [m for m in loose if not any(meet(m, b) for b in base)]
    return set(base) | {m for m in clear if not any(meet(m, o) and (o[0], o[1]) < (m[0], m[1]) for o in clear)}


def test_choice_of_spans_against_all_pairs(spark):
    import random

    r, rows, want = random.Random(3), [], {}
    for row in range(40):
        spans, taken = set(), set()
        for _ in range(r.randrange(60)):
            start, at, base = r.randrange(150), r.randrange(4), r.random() < 0.4
            if (start, at, base) not in taken:
                taken.add((start, at, base))
                spans.add((start, at, start + r.randrange(1, 20), base))
        want[row] = plain_choice(spans)
        rows += [(row, pii.KINDS[a], s, e, b, True) for s, a, e, b in spans] + [(row, "email", 0, 999, False, False)]
    df = spark.createDataFrame(rows, "row long, kind string, start long, end long, base boolean, taken boolean")
    got = {k: set() for k in want}
    for c in pii.chosen(df).collect():
        got[c["row"]].add((c["start"], c["at"], c["end"], c["base"]))
    assert got == want


def test_many_spans_in_one_text(spark):
    import time

    def contacts(n):
        return " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000} or mail u{i}@h{i % 7}.org" if i % 2 else f"fax +1 (212) 555-{i % 9000 + 1000} or u{i} (at) h (dot) org" for i in range(n))

    big = contacts(10_000)
    df = documents(spark, [big, contacts(40), "x " * 200_000])
    began = time.time()
    found = {r.doc_id: r for r in pii.find(df).collect()}
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.time() - began < 60
    plain, counts = brute(big)
    assert [found[0].n_email, found[0].n_ip, found[0].n_card, found[0].n_phone] == counts
    spans = [s.split(":") for s in found[0].spans.split(",")]
    assert len(spans) >= 19_000 and found[2].spans == ""
    cut, at = [], 0
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in spans), key=lambda x: x[1:]):
        if start >= at:
            cut += [big[at:start], pii.MARKS[kind]]
        at = max(at, end)
    assert text[0] == "".join(cut) + big[at:] and text[2] == "x " * 200_000


def test_repeated_rows_and_clashing_columns(spark):
    df = clashing(documents(spark, ["a@b.co x", "a@b.co x", None], ids=[1, 1, 1]))
    assert sorted(r.spans for r in pii.find(df).collect()) == ["", "email:0:6", "email:0:6"]
    assert sorted(r.text or "" for r in pii.redact(df).collect()) == ["", "[EMAIL] x", "[EMAIL] x"]
