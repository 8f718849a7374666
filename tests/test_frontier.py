import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from tracetrim.operators import frontier, ledger
from tracetrim.operators import rollout as RO
from tracetrim.operators.build import build_pt_dataset, recorded_rollout, rollout_live
from tracetrim.operators.completions import batch_completion
from tracetrim.plans import queries as Q
from tracetrim.sources import views


def logged(ro):
    names = [c for c in frontier.LOG_FIELDS if c != "depth"]
    return sorted(map(str, RO.rollout_log(ro, "question_key").select("question_key", "question", F.col("depth").cast("int").alias("depth"), *names).collect()))


def summed(ro):
    return sorted(map(str, RO.rollout_summary(ro, "question_key").collect()))


@pytest.mark.parametrize("judged", ["replies", "rubric"])
def test_same_rows_as_the_unrolled_rollout(spark, judged):
    completions = views.v_completions(spark, SMOKE).cache()
    replies = views.v_rollout_replies(completions) if judged == "replies" else None
    qs = Q._first_questions(spark, SMOKE)
    one, other = (recorded_rollout(qs, completions, replies, max_depth=3, by_depth=d) for d in (False, True))
    assert logged(one) == logged(other) and len(logged(one)) > 10
    assert summed(one) == summed(other)
    assert {(r.decision_model, r.stopped_by) for r in one.collect()} == {(r.decision_model, r.stopped_by) for r in other.collect()}


def long_questions(spark, n, depths):
    qs = spark.createDataFrame([(i, f"question {i}") for i in range(n)], "question_key long, question string")
    rows = [(i, d, f"A{d}. B. B. C{d}. D{d}.", None, None) for i in range(n) for d in range(1, depths + 1) if d <= 5 + i]
    replies = [(i, d, '{"can_skip": true, "skip_start_idx": 1, "skip_end_idx": 2}') for i in range(n) for d in range(1, depths + 1)]
    return (qs, spark.createDataFrame(rows, "question_key long, depth int, text string, usage_tokens int, error string"),
            spark.createDataFrame(replies, "question_key long, depth int, raw_response string"))


def test_twenty_depths(spark):
    qs, completions, replies = long_questions(spark, 20, 20)
    recorded_rollout(qs, completions, replies, max_depth=2, by_depth=True)
    began = time.time()
    ro = recorded_rollout(qs, completions, replies, max_depth=20, by_depth=True)
    assert time.time() - began < 2 * 20  # seconds
    got = {r.question_key: r for r in ro.select("question_key", F.size("log").alias("n"), "stopped_by", F.size("final_steps").alias("kept")).collect()}
    assert [got[i].n for i in range(20)] == [min(20, 5 + i) for i in range(20)]
    assert {got[i].stopped_by for i in range(15)} == {"missing_completion"} and got[19].stopped_by == "max_depth" and got[3].kept == 16
    # the plan of the result does not hold the depths
    assert len(ro._jdf.queryExecution().analyzed().toString()) < 60_000


def test_ends_with_its_last_question_and_keeps_odd_keys(spark):
    qs, completions, replies = long_questions(spark, 2, 3)
    seen = []

    recorded = frontier.recorded_answers(completions, 50)

    def ask(active, depth):
        seen.append(depth)
        return recorded(active, depth)

    odd = qs.unionByName(spark.createDataFrame([(0, "question 0"), (None, "none"), (77, "unanswered")], qs.schema))
    ro = frontier.rollout_by_depth(odd, ask, frontier.recorded_verdicts(replies.where("depth < 2"), 50), max_depth=50)
    rows = sorted((str(r.question_key), len(r.log), r.stopped_by) for r in ro.collect())
    assert seen == [1, 2]
    assert rows == [("0", 2, "no_skip"), ("0", 2, "no_skip"), ("1", 2, "no_skip"), ("77", 0, "missing_completion"), ("None", 0, "missing_completion")]
    assert frontier.rollout_by_depth(qs.limit(0), ask, frontier.recorded_verdicts(replies, 2), max_depth=2).collect() == []


def counting(folder, fail=lambda pdf: False, die_after=None):
    """A client that notes every call's keys in a file, and may fail or take its process down."""
    def fn(pdf):
        done = len(os.listdir(folder))
        if die_after is not None and done >= die_after:
            os._exit(3)
        bad = fail(pdf)
        with open(os.path.join(folder, f"{time.time_ns()}-{'bad' if bad else 'good'}-{len(pdf)}"), "w") as f:
            f.write("\n".join(map(str, pdf["question_key"])))
        if bad:
            raise ValueError("cannot")
        return pd.DataFrame({"text": "said " + pdf["question_key"].astype(str), "usage_tokens": None, "error": None})
    return fn


def calls(folder):
    good, bad = [], 0
    for name in os.listdir(folder):
        if "-good-" in name:
            good += open(os.path.join(folder, name)).read().split()
        else:
            bad += 1
    return good, bad


def requests(spark, n, partitions=1):
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("question_key"), F.concat(F.lit("prompt "), "id").alias("prompt"))


def test_one_bad_row_costs_few_calls(spark, tmp_path):
    fn = counting(str(tmp_path), fail=lambda pdf: (pdf["question_key"] == 700).any())
    out = {r.question_key: r for r in batch_completion(requests(spark, 1024), fn).collect()}
    good, bad = calls(str(tmp_path))
    assert len(out) == 1024 and out[700].error == "cannot" and out[5].text == "said 5" and out[5].error is None
    assert len(good) == len(set(good)) == 1023
    assert len(os.listdir(tmp_path)) <= 1 + 2 * 10


def test_a_task_that_runs_again_asks_for_nothing_twice(spark, tmp_path):
    noted, kept = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.makedirs(noted)
    with pytest.raises(Exception):  # the worker process dies after seven calls
        batch_completion(requests(spark, 200, 2), counting(noted, die_after=7), ledger=kept, call_rows=10).collect()
    first, _ = calls(noted)
    assert 0 < len(first) < 200
    rows = batch_completion(requests(spark, 200, 2), counting(noted), ledger=kept, call_rows=10).collect()
    good, bad = calls(noted)
    assert sorted(r.question_key for r in rows) == list(range(200)) and all(r.text == f"said {r.question_key}" for r in rows)
    # calls whose answer was written before the worker died are not made again; the other task's running call may be
    assert bad == 0 and len(good) - len(set(good)) <= 10 and len(set(good)) == 200
    # once more: nothing is asked
    assert batch_completion(requests(spark, 200, 2), counting(noted), ledger=kept, call_rows=10).count() == 200
    assert len(calls(noted)[0]) == len(good)


def test_answers_by_position_or_key(spark, tmp_path):
    pdf = pd.DataFrame({"k": [1, 1, 2], "q": ["a", "b", "c"]})

    def fewer(rows):
        return pd.DataFrame({"k": [2], "raw": ["only two"]})

    out = list(ledger.answers(fewer, [pdf], None, ["k", "raw", "error"], "k"))
    assert [tuple(r[:2]) for o in out for r in o.values] == [(2, "only two")]
    assert ledger.request_hash([1, ["a", "b"], None]) != ledger.request_hash([1, ["ab"], None])
    assert ledger.usable_ledger("nosuch://x/y") is None and ledger.usable_ledger(str(tmp_path)) == str(tmp_path)


def test_live_calls_each_request_once(spark, tmp_path):
    asked, judged = str(tmp_path / "a"), str(tmp_path / "j")
    os.makedirs(asked), os.makedirs(judged)

    note, other, plan, verdict = counting(asked), counting(judged), Q._numbered_plan, Q._skip_second

    def generate(pdf):
        note(pdf)
        return plan(pdf)

    def audit(pdf):
        other(pdf)
        return verdict(pdf)

    qs = spark.createDataFrame([(i, "q" * (1 + 5 * i)) for i in range(9)], "question_key long, question string")
    ro = rollout_live(qs, generate, audit, max_depth=2, call_rows=1)
    n = RO.rollout_log(ro, "question_key").count()
    assert len(calls(asked)[0]) == n
    logs = RO.rollout_log(ro, "question_key").collect()
    assert {r.reason for r in logs if r.is_error} == {"Trace has 1 or fewer steps."} or all(len(r.steps) <= 1 for r in logs if r.is_error)
    pt = build_pt_dataset(qs, generate=Q._numbered_plan, audit=Q._skip_second, max_depth=2)
    assert pt.count() == sum(r.usable for r in logs)
