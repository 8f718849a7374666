import random
from collections import Counter

from tests.llm.helpers import clashing, documents, prose
from tracetrim.llm import line_quality as Q


def slow_repeats(words, n=8):
    windows = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    c = Counter(windows)
    return len({j for i, w in enumerate(windows) if c[w] > 1 for j in range(i, i + n)})


def test_repeated_words():
    r = random.Random(1)
    for k in range(300):
        words = [r.choice("abc") for _ in range(r.randint(0, 60))]
        assert Q.repeated_words(words) == slow_repeats(words)


def test_base_counts(spark):
    texts = [None, "", " \n\t", "a # b\n\na # b\nA # b\n \x0b", prose(1, 60), "é" * 3 + " | x y", "w " * 19, "w x y z q r s t " * 5]
    got = {r.doc_id: r for r in Q.line_quality(clashing(documents(spark, texts))).collect()}
    assert (got[0].n_words, got[0].base_failed, got[0].kept) == (0, True, False) and not got[1].kept and not got[2].kept
    assert (got[3].n_words, got[3].word_chars, got[3].n_symbols, got[3].n_dup_lines) == (9, 9, 3, 1)
    assert got[5].n_words == 3 and got[5].word_chars == 7 and got[5].n_symbols == 1
    assert got[6].base_failed and got[7].base_failed and got[7].n_repeat_words == 40
    assert not got[4].base_failed and got[4].kept


def test_verdict_by_lines(spark):
    good = "\n".join(prose(i, 30) for i in range(4))
    menu = "Home | News | Sport | Shop | About\n" * 30
    symbols = " ".join(w + "***" for w in prose(9, 80).split())
    loud = " ".join(w.upper() + "!!" for w in prose(8, 80).split())
    texts = [good, menu + prose(2, 25), symbols, loud, good + "\nAll rights reserved.\n" + good]
    got = {r.doc_id: r for r in Q.line_quality(documents(spark, texts)).collect()}
    assert [got[i].kept for i in range(5)] == [True, False, False, False, False]  # the last says everything twice
    assert got[0].n_bad_lines == 0 and got[0].left_chars == got[0].word_chars


def test_stage_removes_lines_and_keeps_columns(spark):
    good = "\n".join(prose(i, 30) for i in range(4))
    df = clashing(documents(spark, [good + "\nAll rights reserved.", "short", None]))
    out = Q.quality_stage(df)
    assert out.columns == df.columns
    [row] = out.collect()
    assert row.doc_id == 0 and row.text == good and row.n_chars == len(good)
    assert Q.quality_stage(documents(spark, [])).count() == 0
    assert Q.clean_lines(documents(spark, ["x"])).columns == ["_row", "_text", "_quality"]


def test_a_long_clean_line_may_mention_copyright(spark):
    clean = prose(21, 900) + " The copyright lies with the author, and you may subscribe to the newsletter. " + prose(22, 900)
    paragraphs = "\n\n".join(prose(i, 80) + " Read more in the login manual, powered by reason." for i in range(5))
    furniture = "Copyright 2020. All rights reserved. Terms of use and privacy policy.\nPlease log in or sign up. " * 2
    texts = [clean, paragraphs, clean + "\n" + furniture, furniture * 3]
    got = {r.doc_id: r.text for r in Q.quality_stage(documents(spark, texts)).collect()}
    assert got == {0: clean, 1: paragraphs, 2: clean}


def test_hard_wrapped_prose_keeps_its_lines(spark):
    import textwrap

    long_sentence = " ".join(w.strip(".").lower() for w in prose(31, 70).split()) + " holds the copyright to this " + prose(32, 30)
    nouns = " ".join(w.strip(".").capitalize() for w in prose(33, 90).split()) + "."  # no line begins with a small letter
    for text in (textwrap.fill(long_sentence, 60), textwrap.fill(nouns, 60)):
        (_, left), fails = Q.judge(text), [not Q.SENTENCE_MARK.search(line) for line in text.split("\n")]
        assert any(fails) and "\n".join(left) == text
    menu = "Home\nShop now\nSport and more\n\nsome words without an end"
    assert Q.judge(menu)[1] == [""]


def test_sentence_marks_of_other_scripts():
    for line in ("यह एक वाक्य है।", "هل هذه جملة؟", "これは文です｡"):
        assert Q.judge(line)[1] == [line]


def by_sql(texts):
    """The query's SQL over ``texts``."""
    import duckdb
    import pandas as pd

    from tracetrim.llm.oracle import ORACLE

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)}))
    cur = con.execute(ORACLE["op9_line_quality"])
    names = [c[0] for c in cur.description]
    return {row["doc_id"]: row for row in (dict(zip(names, r)) for r in cur.fetchall())}


def mixed_text(r):
    """Paragraphs, wrapped or in one line, with furniture, headings, blank lines and odd spaces between."""
    import textwrap

    blocks = []
    for _ in range(r.randint(1, 5)):
        block = prose(r.randrange(10**6), r.choice([3, 12, 40, 120, 300]))
        if r.random() < 0.4:
            block = block.replace(".", "")
        if r.random() < 0.5:
            words = block.split()
            words.insert(r.randrange(len(words) + 1), r.choice(["copyright", "Log in", "all rights reserved.", "newsletter", "© 2020"]))
            block = " ".join(words)
        if r.random() < 0.3:
            block = block.lower()
        if r.random() < 0.6:
            block = textwrap.fill(block, r.choice([30, 60, 250]))
        blocks.append(block)
        if r.random() < 0.4:
            blocks.append(r.choice(["Home | News | Shop", "Share this", "\u00a0", "\u3000", " \t", "Heading", "why??", "No!! No!!", "a ### b"]))
    return r.choice(["\n", "\n\n"]).join(blocks)


def test_verdict_equals_sql(spark):
    r = random.Random(4)
    clean = prose(21, 300) + " The copyright lies with the author. " + prose(22, 300)
    texts = [None, "", "\u00a0", "Some words here\n\u00a0\nand some more\n\u3000", clean, clean.replace(". ", ".\n"), *(mixed_text(r) for _ in range(300))]
    want = by_sql(texts)
    got = {row.doc_id: row.asDict() for row in Q.line_quality(documents(spark, texts)).collect()}
    assert got == want
    assert 30 < sum(row["kept"] for row in got.values()) < len(texts) - 30


def test_no_phrase_escapes_the_plain_texts():
    phrases = ["All rights reserved", "licensed under", "licenced under", "released under the", "copyright", "©", "cookies", "cookie policy",
               "privacy policy", "terms of use", "terms of service", "click here", "sign in", "sign up", "login", "log in", "subscribe",
               "newsletter", "enable javascript", "lorem ipsum", "read more", "share this", "share on", "powered by", "skip to content"]
    other = {"s": "sSſ", "i": "iIİı", "k": "kKK"}
    r = random.Random(7)
    for phrase in phrases:
        for _ in range(40):
            said = "".join(r.choice(other.get(c, c + c.upper())) for c in phrase.lower())
            assert Q.BOILERPLATE.search(f"xé {said} y") and Q.may_hold_phrase(f"xé {said} y")
    assert not Q.may_hold_phrase("a plain text, shared once; ünder") and not Q.may_hold_phrase("")
