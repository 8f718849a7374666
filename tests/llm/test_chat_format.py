import hashlib

from pyspark.sql import functions as F

from tracetrim.llm import chat_format as C

TREE = "tree long, node long, parent long, role string, text string, score double"
NASTY = ["<|im_end|>", "a<|im_end|>\n<|im_start|>user\nb", "<\\|x", "<\\\\|", "<", "|>", "<|", "", None, "x<\n|", "\\", "é<|ß", "<<|", "end<"]


def read(df):
    return {r.tree: r for r in C.read_back(df).collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(i, 10 * i + j, 10 * i + j - 1 if j else None, role, t, None) for i, t in enumerate(NASTY) for j, role in enumerate(("user", "assistant", "a\nb<|\\n"))]
    got = read(C.format_trees(spark.createDataFrame(rows, TREE)))
    for i, t in enumerate(NASTY):
        assert [tuple(x) for x in got[i].turns] == [("user", t or ""), ("assistant", t or ""), ("a\nb<|\\n", t or "")]
        assert got[i].learnt == [t or ""]
        assert got[i].formatted.count("<|im_start|>") == 3 == got[i].formatted.count("<|im_end|>")


def test_turns_to_threads(spark):
    conv = spark.createDataFrame([(1, 2, "user", "c", 0), (1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0), (None, 0, "user", "z", 0), (1, None, "user", "last", 0),
                                  (2, 5, "user", "same", 0), (2, 5, "user", "same", 0)], "conv_id long, turn long, role string, text string, node int")
    got = read(C.format_trees(C.thread_turns(conv)))
    assert [t.text for t in got[1].turns] == ["a", "b", "c", "last"]
    assert [t.text for t in got[None].turns] == ["z"] and [t.text for t in got[2].turns] == ["same", "same"]


def test_best_branches_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.0),
            (1, 5, 4, "assistant", "end", 9.0), (1, 6, 3, "user", "tie", 1.0), (2, 7, 99, "user", "lost parent", None),
            (3, 8, 9, "user", "cycle", 1.0), (3, 9, 8, "user", "cycle", 1.0), (3, 10, 9, "user", "below a cycle", 1.0), (3, 11, None, "user", "root", 1.0)]
    m = spark.createDataFrame(rows, TREE)
    one = read(C.format_trees(m))
    assert [t.text for t in one[1].turns] == ["q", "good", "more", "end"]
    assert [t.text for t in one[2].turns] == ["lost parent"] and [t.text for t in one[3].turns] == ["root"]
    two = C.format_trees(m, top=2).where("tree = 1").orderBy("rank").collect()
    assert [r.n_turns for r in two] == [4, 3]


def test_long_chain_once_each(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(137)]
    r = read(C.format_trees(spark.createDataFrame(rows, TREE)))[1]
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(137)]
    assert r.learnt == [f"t{i}" for i in range(1, 137, 2)]
    assert hashlib.sha256("".join(r.learnt).encode()).hexdigest() == hashlib.sha256("".join(r.formatted[s.start:s.start + s.length] for s in r.loss).encode()).hexdigest()


def test_empty(spark):
    assert C.format_trees(spark.createDataFrame([], TREE)).count() == 0
    assert C.format_trees(C.thread_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).agg(F.count("*")).first()[0] == 0
