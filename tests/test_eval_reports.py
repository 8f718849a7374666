import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from tracetrim.functions.answers import extract_answer
from tracetrim.operators import evaluate as EV
from tracetrim.operators import reports as RP
from tracetrim.operators import rollout as RO
from tracetrim.plans import queries as Q

# (text, answer), worked out by hand: a marked answer first, then a boxed one, a phrase, and at last the last number.
ANSWERS = [
    ("work #### 2,048.", "2048."), ("####  ,", ""), ("so the answer is 31.", "31."), ("this equals -6 now", "-6"), ("5,678", "678"),
    ("none at all", None), ("thus \\boxed{ x+1 }", "x+1"), ("Final Answer: 8,1", "81"), ("from 2.5 to .75", ".75"), ("", None),
    ("\\boxed{9} yet #### 4", "4"), ("the answer is 6 #### -3", "-3"), ("FINAL ANSWER 12 or 13", "12"), ("the answer is unknown, 7", "7"),
]


def test_extracted_answers(spark):
    df = spark.createDataFrame(ANSWERS, "t string, want string")
    for r in df.select("t", "want", extract_answer("t").alias("a")).collect():
        assert r.a == r.want, r.t


def test_correctness_and_summary(spark):
    rows = [("#### 4", "so 2+2 is 4", "4", 15, 5), (None, "x 1", "y 2", 0, 0), ("B", "answer 3", "B", 10, 10)]
    df = spark.createDataFrame(rows, "ground_truth string, base_response string, pruned_response string, base_usage int, pruned_usage int")
    s = EV.eval_samples(df.withColumn("benchmark", F.lit("b"))).collect()
    assert s[0].base_correct is True and s[0].pruned_correct is True
    assert s[0].token_savings_pct == pytest.approx(66.6666, rel=1e-4)
    assert s[1].base_correct is None and s[1].base_tokens == 2
    assert s[2].pruned_correct is False  # letter gold vs last number
    summ = EV.eval_summary(EV.eval_samples(df.withColumn("benchmark", F.lit("b")))).first()
    assert summ.num_samples == 3 and summ.base_accuracy == pytest.approx(1 / 3)
    card = EV.eval_card(summ and EV.eval_summary(EV.eval_samples(df.withColumn("benchmark", F.lit("b"))))).first()
    assert card.base_accuracy_text == "33.3%" and card.accuracy_delta_text == "+0.0%"


def test_comparison_defaults(spark):
    df = spark.createDataFrame([(1, "Which is larger, 7 or 9?", "Seven is 7. Nine is 9. So 9.", "So 9.", 12, 3, None)],
                               "question_key long, question string, base_response string, pruned_response string, "
                               "base_tokens int, pruned_tokens int, token_savings_pct double")
    r = EV.comparison_rows(df).first()
    assert (r.token_savings_pct, r.title, r.base_tokens) == (75.0, "Question: Which is larger, 7 or 9?...", 12)
    r = EV.comparison_rows(df.drop("base_tokens", "pruned_tokens", "token_savings_pct")).first()
    assert (r.base_tokens, r.pruned_tokens) == (8, 2)


def test_every_question_is_a_sample(spark):
    from tracetrim.operators.build import evaluate_models

    qs = spark.createDataFrame([(1, "a", "4"), (2, "b", "5"), (3, "c", "6")], "question_key long, question string, ground_truth string")
    base = spark.createDataFrame([(1, "#### 4", 10, None), (1, "#### 4", 10, None), (2, None, None, "timeout")], "question_key long, text string, usage_tokens int, error string")
    pruned = spark.createDataFrame([(1, "so 4", 2)], "question_key long, text string, usage_tokens int")
    samples, summary = evaluate_models(qs, base, pruned)
    rows = {r.question_key: r for r in samples.collect()}
    assert rows[2].base_response == "Error during generation: timeout" and rows[2].base_tokens == 4 and rows[3].base_response == ""
    assert (rows[1].base_records, rows[3].pruned_records) == (2, 0)
    s = summary.first()
    assert s.num_samples == 3 and s.base_accuracy == pytest.approx(1 / 3) and s.pruned_accuracy == pytest.approx(1 / 3)
    assert EV.pair_responses(base, pruned).count() == 2


def test_reports(spark):
    tr = RO.rollout_transitions(Q.doc_rollout(spark, SMOKE))
    from tracetrim.sources import pt_io
    sc = RP.schema_check(pt_io.to_pt_rows(tr)).collect()
    assert all(r.present and r.type_ok and r.n_rows == tr.count() for r in sc) and len(sc) == 8
    bad = RP.schema_check(spark.createDataFrame([(None, 1.5)], "id string, depth double")).collect()
    assert {r.column: (r.present, r.type_ok, r.n_null) for r in bad if r.column in ("id", "depth", "question")} == {
        "id": (True, True, 1), "depth": (True, False, 0), "question": (False, False, None)}
    cc = RP.content_check(tr).first()
    assert cc.n_rows == tr.count() and cc.valid_rows + cc.empty_target_y >= cc.n_rows - cc.empty_input_x
    depths = RP.depth_counts(tr).collect()
    assert [r.depth for r in depths] == sorted(r.depth for r in depths)
    card = RP.dataset_card(tr, None, "d").first()
    assert card.generator_model == "N/A" and card.depth_table.startswith("| Depth 1 |")
    cats = RP.category_counts(tr.withColumn("category", F.lit(None).cast("string"))).collect()
    assert cats[0].category == "Unknown"
    rep = RP.rollout_report(RO.rollout_summary(Q.doc_rollout(spark, SMOKE))).first()
    assert rep.report.startswith("Original Steps:")
