import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from tracetrim.operators import format as FM
from tracetrim.sources import benchmarks as BM
from tracetrim.sources import pt_io


def test_format_layouts(spark):
    mc = spark.createDataFrame([("Which floats?", (["A", "B", "C"], ["Iron", "Cork", "Lead"]), "B")],
                               "question string, choices struct<label:array<string>,text:array<string>>, answerKey string")
    r = FM.format_rows(mc).first()
    assert (r.question_text, r.answer_text) == ("Which floats? (A) Iron (B) Cork (C) Lead", "B")
    body = spark.createDataFrame([("A shelf holds 8 books.", "Three go. How many stay?", "5")], "Body string, Question string, Answer string")
    r = FM.format_rows(body).first()
    assert (r.question_text, r.answer_text) == ("A shelf holds 8 books. Three go. How many stay?", "5")
    ctx = spark.createDataFrame([("The bridge opened in 1932.", "When did it open?", (["1932"],))], "context string, question string, answers struct<text:array<string>>")
    r = FM.format_rows(ctx).first()
    assert (r.question_text, r.answer_text) == ("Context: The bridge opened in 1932.\n\nQuestion: When did it open?", "1932")


def test_zero_and_false_count_as_absent(spark):
    df = spark.createDataFrame([("q", 0, "next"), ("q", 7, "next"), ("q", None, None)], "question string, answer int, correct_answer string")
    assert [r.answer_text for r in FM.format_rows(df).collect()] == ["next", "7", ""]
    df = spark.createDataFrame([(False, "p", "a"), (True, "p", "a")], "question boolean, problem string, answer string")
    assert [r.question_text for r in FM.format_rows(df).collect()] == ["p", "True"]


def test_context_cut_and_zip(spark):
    long = ("word " * 100).strip()
    df = spark.createDataFrame([(long, "q?", "x")], "context string, question string, answer string")
    r = FM.format_rows(df).first()
    ctx = r.question_text.split("\n\n")[0][len("Context: "):]
    assert ctx == long[:300].rsplit(" ", 1)[0] + "..."
    mc = spark.createDataFrame([("Q", (["A", "B", "C"], ["x", "y"]), None, "D")],
                               "question string, choices struct<label:array<string>,text:array<string>>, answerKey string, answer string")
    r = FM.format_rows(mc).first()
    assert r.question_text == "Q (A) x (B) y" and r.answer_text == "D"


def test_prompts(spark):
    r = spark.range(1).select(
        FM.continuation_prompt(F.lit("Q"), F.lit("  ")).alias("a"),
        FM.continuation_prompt(F.lit("Q"), F.lit("p")).alias("b"),
        FM.audit_prompt(F.lit("Q {x}"), F.lit(""), F.array(F.lit("s0"), F.lit("s1"))).alias("c"),
        FM.sft_text(F.lit("x"), F.lit("y")).alias("d")).first()
    assert r.a == "Q"
    assert r.b == "Q\n\n[Previous Steps]:\np\n\n[Continue reasoning from here]:"
    py = FM.DEFAULT_AUDIT_TEMPLATE.format(question="Q {x}", prefix_section="", formatted_steps="[0] s0\n[1] s1")
    assert r.c == py
    assert r.d == "x\n\n[Next Step]:\ny"


def test_resolve_and_curated(spark):
    assert BM.resolve_alias(" GSM8K ")["category"] == "Arithmetic & Word Math"
    miss = BM.resolve_alias("some/other")
    assert miss["path"] == "some/other" and miss["category"] == "General Reasoning"
    fb = BM.load_or_curated(spark, "/nonexistent/path.parquet", "gsm8k", "item_id", 2).collect()
    assert len(fb) == 2 and fb[0].category == "Arithmetic & Word Math"
    names = spark.createDataFrame([("zzz", "none/none")], "alias_key string, path string")
    assert BM.curated_for(names, 20).count() == 10


def test_spectrum_and_positions(spark):
    from tracetrim.plans import queries as Q
    spec = BM.spectrum(Q.spectrum_sources(spark, SMOKE), "item_id", per_benchmark=1).collect()
    cats = {r.category for r in spec}
    assert len(spec) >= 4 and {"Arithmetic & Word Math", "Scientific Reasoning"} <= cats
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k").repartition(7)
    from tracetrim.operators.ordering import dense_position
    pos = dense_position(df, ["k"]).collect()
    assert sorted(r.idx for r in pos) == list(range(len(pos)))
    assert all(r.idx == r.k // 3 for r in pos)


def test_load_questions_cap_and_lists(spark):
    from tracetrim.sources import views
    q = BM.load_questions(views.v_choice(spark, SMOKE), "arc_challenge", "item_id", num_samples=5).collect()
    assert [r.metadata["index"] for r in q] == [0, 1, 2, 3, 4] and q[0].id == "arc_challenge_train_0"
    lst = BM.questions_from(["Name a prime.", "", {"question": "Is 91 prime?", "dataset": "d"}, {"question": None}, {"dataset": "d"}], spark).collect()
    assert [r.question for r in lst] == ["Name a prime.", "Is 91 prime?"]
    with pytest.raises(ValueError):
        BM.questions_from(spark.createDataFrame([("q",)], "question string"))
    names = spark.createDataFrame([(" GSM8K ", ""), ("gsm8k", "mine"), ("x/y", "")], "name string, cfg string")
    assert [r.config for r in BM.resolve_benchmarks(names, "name", "cfg").collect()] == ["main", "mine", ""]
    assert lst[0].dataset == "custom"
    pairs = BM.pair_lists(spark, ["a", "b", "c"], ["1", "2"]).collect()
    assert len(pairs) == 2


def test_load_questions_keeps_rows_with_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(2, "b", "x"), (None, "n", "x"), (2, "a", "x"), (2, "a", "x"), (1, "", "x"), (None, "m", "x")], "k int, question string, answer string")
    want = [(None, "t_train_0", "m"), (None, "t_train_1", "n"), (2, "t_train_3", "a"), (2, "t_train_4", "a"), (2, "t_train_5", "b")]
    for cap in (None, 6):
        got = BM.load_questions(rows.repartition(3), "t", "k", num_samples=cap).orderBy("id").collect()
        assert [(r.question_key, r.id, r.question) for r in got] == want
    assert BM.load_questions(rows.limit(0), "t", "k").collect() == []


def test_repeated_turns_neither_multiply_nor_vanish(spark, tmp_path):
    from tracetrim.sources import views
    turns = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "r"), (1, 3, "assistant", "c"),
             (None, 0, "user", "n"), (None, 1, "assistant", "o"), (2, 0, "assistant", "z")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    traces = sorted((r.question, r.full_text) for r in views.v_traces(spark, str(tmp_path)).collect())
    assert traces == [("n", "o"), ("q", "a"), ("r", "c")]
    said = sorted((r.question_key or 0, r.depth, r.text) for r in views.v_completions(spark, str(tmp_path)).collect())
    assert said == [(0, 1, "o"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")]


def test_pt_roundtrip_keeps_schema_when_empty(spark):
    from tracetrim.plans import queries as Q
    from tracetrim.operators import rollout as RO
    tr = RO.rollout_transitions(Q.doc_rollout(spark, SMOKE))
    path = pt_io.shared_path(spark, "pt_test")
    pt_io.save_pt(pt_io.to_pt_rows(tr, "train").unionByName(pt_io.to_pt_rows(tr.limit(3), "test")), path)
    back = pt_io.load_pt(spark, path)
    assert back.count() == tr.count()
    assert pt_io.load_pt(spark, path, "test").count() == 3
    empty = path + "_empty"
    pt_io.save_pt(pt_io.to_pt_rows(tr.limit(0)), empty)
    e = pt_io.load_pt(spark, empty)
    assert e.count() == 0 and "input_x" in e.columns


def test_build_and_evaluate_entry_points(spark):
    from tracetrim.operators.build import build_pt_dataset, evaluate_models
    from tracetrim.sources import views
    from tracetrim.plans import queries as Q
    docs = views.v_doc_traces(spark, SMOKE).select(F.col("trace_id").alias("question_key"), "question", "full_text",
                                                    "category", F.col("source_dataset").alias("dataset"))
    pt = build_pt_dataset(docs, trace_col="full_text")
    ref = Q.QUERIES["build_pt_dataset"](spark, SMOKE)
    assert pt.count() == ref.count() > 0
    assert pt.where(F.col("metadata.category").isNull()).count() == 0
    comp = views.v_completions(spark, SMOKE)
    qs = Q._first_questions(spark, SMOKE)
    rec = build_pt_dataset(qs, completions=comp, replies=views.v_rollout_replies(comp))
    assert rec.count() == Q.QUERIES["rollout_recorded"](spark, SMOKE).count()
    base = comp.where("depth = 1")
    pruned = comp.where("depth = 2")
    samples, summary = evaluate_models(qs.withColumn("ground_truth", F.lit(None).cast("string")), base, pruned, "conv")
    s = summary.first()
    assert s.num_samples == samples.count() and s.base_accuracy is None
    cur = BM.questions_from("/nonexistent/gsm8k.parquet", spark, max_samples=2).collect()
    assert len(cur) == 2 and cur[0].category == "Arithmetic & Word Math"
    assert BM.load_questions(views.v_choice(spark, SMOKE), "arc_challenge", "item_id").count() == views.v_choice(spark, SMOKE).count()


def test_live_build(spark):
    from tracetrim.operators.build import build_pt_dataset
    from tracetrim.plans import queries as Q
    qs = spark.createDataFrame([(1, "Why?", "c"), (2, "1234567", "c"), (3, "Who?", "d"), (4, "Q" * 10, "d")], "question_key long, question string, category string")
    pt = build_pt_dataset(qs, generate=Q._numbered_plan, audit=Q._skip_second, max_depth=2).collect()
    assert {(r.question, r.depth) for r in pt} == {("Why?", 1), ("Who?", 1), ("Why?", 2), ("Who?", 2)}
    assert all(r.metadata.category in "cd" and r.skipped_steps == ["Beta.", "Beta."] for r in pt)


def test_spectrum_from_paths_reads_or_falls_back_each(spark, tmp_path):
    from tracetrim.sources import views
    good = str(tmp_path / "arc")
    views.v_choice(spark, SMOKE).write.parquet(good)
    part = BM.spectrum_from_paths(spark, {"arc_challenge": good, "gsm8k": "/nonexistent/x"}, "item_id", 2).collect()
    assert sorted(r.benchmark for r in part) == ["arc_challenge"] * 2 + ["gsm8k"] * 2
    assert {r.id for r in part if r.benchmark == "gsm8k"} == {"gsm8k_001", "gsm8k_002"}
    none = BM.spectrum_from_paths(spark, {"gsm8k": "/nonexistent/x", "svamp": "/nonexistent/y", "zzz": "/nonexistent/z"}, "item_id", 1).collect()
    assert sorted((r.benchmark, r.id) for r in none) == [("gsm8k", "gsm8k_001"), ("svamp", "svamp_001"), ("zzz", "gsm8k_001")]
    assert len(BM.spectrum_from_paths(spark, None, "item_id", 1).collect()) == 6


def test_context_answers_edges(spark):
    df = spark.createDataFrame([
        ("ctx", "q", ([],), "fallback"), ("ctx", "q", (None,), "fallback"), ("ctx", "q", None, "fallback"),
        ("ctx", "q", (["x", "y"],), "fallback")],
        "context string, question string, answers struct<text:array<string>>, answer string")
    got = [r.answer_text for r in FM.format_rows(df).collect()]
    assert got == ["", "", "fallback", "x"]
