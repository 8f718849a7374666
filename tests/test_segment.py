import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, SMOKE
from tracetrim.functions.segment import segment
from tracetrim.functions.text import py_strip, word_count
from tracetrim.sources import views
from tracetrim.sources.tables import read_table

# (mode, text, steps), worked out by hand from the contract.
EXPECTED = [
    ("sentences", "Rain fell. It stopped! 3 birds sang? yes", ["Rain fell.", "It stopped!", "3 birds sang? yes"]),
    ("sentences", "Wait... (maybe) go", ["Wait...", "(maybe) go"]),
    ("sentences", "v1.5 is out. ok", ["v1.5 is out. ok"]),
    ("sentences", "End.\nsmall start", ["End.", "small start"]),
    ("sentences", 'He left. "Why?" [note] A', ["He left.", '"Why?" [note] A']),
    ("sentences", "one.  Two.\t\tThree", ["one.", "Two.", "Three"]),
    ("sentences", "Fin. \u00c9t\u00e9", ["Fin. \u00c9t\u00e9"]),
    ("sentences", "  no mark  ", ["no mark"]),
    ("lines", "a\r\nb\x0bc\u2028d", ["a", "b", "c", "d"]),
    ("lines", " x \n\n  \n y", ["x", "y"]),
    ("lines", "a\x1cb\x85c\rd", ["a", "b", "c", "d"]),
    ("paragraphs", "p\n\nq\n\n\nr", ["p", "q", "r"]),
    ("paragraphs", "one\ntwo\n\n \n\nthree", ["one\ntwo", "three"]),
    ("paragraphs", "a\n \nb", ["a\n \nb"]),
    ("numbered", "Intro\n1. first\n2) second\nStep 3: third", ["Intro", "1. first", "2) second", "Step 3: third"]),
    ("numbered", "1.5 litres\n2.5 litres", ["1.5 litres\n2.5 litres"]),
    ("numbered", "Step4. here\nstep 5: not this", ["Step4. here\nstep 5: not this"]),
    ("auto", "1. mix\n2. bake", ["1. mix", "2. bake"]),
    ("auto", "Top part. More.\n\nLow part.", ["Top part. More.", "Low part."]),
    ("auto", "Only one here. And two.", ["Only one here.", "And two."]),
    ("auto", "1. single marker. Then text", ["1. single marker.", "Then text"]),
    ("auto", "", []),
    ("auto", " \n\t ", []),
]
MODES = ["auto", "sentences", "lines", "paragraphs", "numbered"]


@pytest.mark.parametrize("mode", MODES)
def test_expected_steps(spark, mode):
    own = [(t, want) for m, t, want in EXPECTED if m == mode]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(own)], "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", segment("t", mode).alias("s")).collect()}
    for i, (t, want) in enumerate(own):
        assert got[i] == want, t


def _bare(text):
    return "".join(text.split())


def _atoms_texts():
    rnd = random.Random(41)
    atoms = [".", "!", "?", " ", "  ", "\n", "\n\n", "\t", "\r", "\u00a0", "\x1c", "\u2029", "K", "w", "\u00df", "4", "77", "Step ", ")", ":", "(", "[", "8.", "9)"]
    return ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]


def test_steps_keep_every_character_but_blanks(spark):
    df = spark.createDataFrame([(t,) for t in _atoms_texts()], "t string")
    for r in df.select("t", *[segment("t", m).alias(m) for m in MODES]).collect():
        for m in MODES:
            assert _bare("".join(r[m])) == _bare(r.t), (m, r.t)
            assert all(s and s == s.strip() for s in r[m]), (m, r.t)


def test_steps_of_the_tables(spark):
    texts = read_table(spark, SMOKE, "documents").select("text").unionByName(read_table(spark, SMOKE, "conversations").select("text"))
    rows = texts.unionByName(views.v_structured(spark, SMALL).select("text")).select("text", *[segment("text", m).alias(m) for m in MODES]).collect()
    for r in rows:
        assert all(_bare("".join(r[m])) == _bare(r.text) for m in MODES)
        assert r.auto == (r.numbered if len(r.numbered) > 1 else r.paragraphs if len(r.paragraphs) > 1 else r.sentences)


def test_unknown_mode():
    with pytest.raises(ValueError):
        segment("t", "words")


def test_strip_and_words(spark):
    texts = ["", "   ", "\n\t x \t\n", "\u00a0nbsp\u00a0", "a\x1cb", "a\u2028b c", "  many   gaps  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", py_strip("t").alias("s"), word_count("t").alias("w")).collect():
        assert r.s == r.t.strip()
        assert r.w == len(r.t.split())
    assert spark.range(1).select(F.size(segment(F.lit("  "), "auto"))).first()[0] == 0
