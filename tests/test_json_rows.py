import glob
import json

import pyarrow.parquet as pq

from tracetrim.sources import benchmarks as BM
from tracetrim.sources import json_rows as JR

LINES = [
    ({"id": 1, "question": " Which? ", "choices": {"label": ["A", "B", "C"], "text": ["x", 2]}, "answerKey": "B"}, ("choice", "Which? (A) x (B) 2", "B")),
    ({"id": 2, "question": "", "question_stem": "stem", "choices": {"label": [], "text": []}, "answer": 7}, ("choice", "stem", "7")),
    ({"id": 3, "question": "q", "choices": ["A", "B"], "answer": "a"}, ("plain", "q", "a")),
    ({"id": 4, "question": "q", "choices": {"label": ["A"]}, "answer": "a"}, ("plain", "q", "a")),
    ({"id": 5, "Body": " b ", "Question": None, "Answer": 3.5}, ("body", "b None", "3.5")),
    ({"id": 6, "Body": "b", "Question": "q"}, ("body", "b q", "")),
    ({"id": 7, "context": " c ", "question": "q", "answers": {"text": ["first", "second"]}, "answer": "other"}, ("context", "Context: c\n\nQuestion: q", "first")),
    ({"id": 8, "context": "c", "question": None, "answers": {"text": []}}, ("context", "Context: c\n\nQuestion: None", "")),
    ({"id": 9, "context": "word " * 80, "question": "q", "answers": None, "answer": True}, ("context", "Context: " + ("word " * 60)[:-1] + "...\n\nQuestion: q", "True")),
    ({"id": 10, "context": 5, "question": "q", "answer": None}, ("plain", "q", "")),
    ({"id": 11, "context": "c", "problem": "p"}, ("plain", "p", "")),
    ({"id": 12, "question": 0, "problem": False, "prompt": "third", "answer": [], "correct_answer": {}, "ground_truth": 12}, ("plain", "third", "12")),
    ({"id": 13, "question": ["a", 1], "answer": {"k": None}}, ("plain", '["a",1]', '{"k":null}')),
    ({"id": 14}, ("plain", "", "")),
    ([1, 2], ("plain", "", "")),
    ({"id": 15, "choices": {"label": [True, None, ["x"]], "text": ["a", "b", "c"]}}, ("choice", '(True) a (None) b (["x"]) c', "")),
    ({"id": 16, "question": "  é ", "answer": "\tx\n"}, ("plain", "é", "x")),
]


def write(path, lines):
    path.mkdir()
    (path / "a.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return str(path)


def test_each_row_by_its_own_keys(spark, tmp_path):
    path = write(tmp_path / "rows", [x for x, _ in LINES] + ["", "   ", "no json {", '{"id": 17, "question": "a", "question": "b"}'])
    rows = JR.format_json_rows(JR.read_json_rows(spark, path)).select(JR.Value("row", "id").text.alias("id"), "layout", "question_text", "answer_text").collect()
    assert len(rows) == len(LINES) + 2
    got = {r["id"]: tuple(r)[1:] for r in rows if r["id"]}
    for line, want in LINES:
        if isinstance(line, dict):
            assert got[str(line["id"])] == want
    assert sorted(tuple(r) for r in rows if r["id"] is None) == [(None, "plain", "", "")] * 2


def test_load_leaves_out_rows_without_question(spark, tmp_path):
    path = write(tmp_path / "rows", [x for x, _ in LINES] + ["null", "3"])
    got = JR.load_json_questions(spark, path, "id").collect()
    assert sorted(int(r.question_key) for r in got) == [i for i in range(1, 17) if i != 14]
    assert JR.load_json_questions(spark, write(tmp_path / "none", []), "id").collect() == []


def test_pairs_by_place(spark, tmp_path):
    path = str(tmp_path / "q.parquet")
    spark.range(0, 1000, 1, 4).selectExpr("cast(1000 - id as string) as question").write.parquet(path)
    asked = BM.in_file_order(spark, path)
    golds = spark.createDataFrame([(k, f"g{k}") for k in range(400)] + [(None, None), (5, "g5")], "k int, answer string")
    plain = [v for f in sorted(glob.glob(path + "/*.parquet")) for v in pq.read_table(f)["question"].to_pylist()]
    order = [None, *range(6), 5, *range(6, 400)]
    want = [(i, plain[i], "None" if k is None else f"g{k}") for i, k in enumerate(order)]
    for q, g in ((asked, golds), (asked.repartition(7), golds.repartition(3))):
        got = BM.zip_inputs(q, g, gold_order="k").orderBy("question_key").collect()
        assert [tuple(r) for r in got] == want
    assert [tuple(r) for r in BM.zip_inputs(asked, golds, gold_order="k", max_samples=3).orderBy("question_key").collect()] == want[:3]
    assert BM.zip_inputs(asked, None, max_samples=5).where("ground_truth is null").count() == 5
    assert BM.zip_inputs(asked.limit(0), golds, gold_order="k").collect() == []


def test_keys_are_read_once_per_row(spark, tmp_path):
    """A key's value is one column that all rules read, not an expression that each of them runs again."""
    rows = JR.read_json_rows(spark, write(tmp_path / "rows", [x for x, _ in LINES]))
    out = JR.format_json_rows(rows)
    assert out.columns == ["row", "layout", "question_text", "answer_text"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.context,") == 1 and plan.count("$.question,") == 1
