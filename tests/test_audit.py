import pytest
from pyspark.sql import functions as F

from tracetrim.functions import reply as R
from tracetrim.operators import audit as A
from tracetrim.operators.transitions import extract_transitions, example_id

FENCE = "`" * 3
JSON_START = '{"can_skip": true, "skip_start_idx": '
# (reply, status, can_skip, start, end), worked out by hand from the contract.
EXPECTED = [
    (FENCE + 'json\n{"skip_end_idx": 4,\n "skip_start_idx": 2, "can_skip": true, "reason": "said before"}\n' + FENCE, "json", True, 2, 4),
    ('Sure. {"can_skip": false, "reason": "nothing to drop"} Bye.', "json", False, -1, -1),
    ("{}", "json", False, -1, -1), ("[1, 2]", "error", False, -1, -1), ("17", "error", False, -1, -1), ('"true"', "error", False, -1, -1),
    ("null", "error", False, -1, -1), ("NaN", "error", False, -1, -1), ("3 4", "fallback", False, -1, -1), ("[1][2]", "fallback", False, -1, -1),
    ('{"can_skip": yes}', "fallback", False, -1, -1), ("{can_skip: true}", "fallback", True, -1, -1), ("", "fallback", False, -1, -1),
    ("TRUE, drop it", "fallback", True, -1, -1), ("not false but true in the end", "fallback", False, -1, -1),
    ("x" * 30 + " false and true", "fallback", True, -1, -1),
    (JSON_START + "5}", "json", True, 5, 5), (JSON_START + '"6"}', "json", True, 6, 6), (JSON_START + '" 6 "}', "json", True, 6, 6),
    (JSON_START + '"6.5"}', "error", False, -1, -1), (JSON_START + "6.9}", "json", True, 6, 6), (JSON_START + "-1.5}", "json", True, -1, -1),
    (JSON_START + "true}", "json", True, 1, 1), (JSON_START + "null}", "error", False, -1, -1), (JSON_START + "[1]}", "error", False, -1, -1),
    (JSON_START + '1, "skip_end_idx": null}', "error", False, -1, -1), (JSON_START + '1, "skip_end_idx": "x"}', "error", False, -1, -1),
    ('{"can_skip": "no", "skip_start_idx": 1}', "json", True, 1, 1), ('{"can_skip": "", "skip_start_idx": 1}', "json", False, -1, -1),
    ('{"can_skip": 0.0, "skip_start_idx": 1}', "json", False, -1, -1), ('{"can_skip": [0], "skip_start_idx": 1}', "json", True, 1, 1),
    ('{"can_skip": true}', "json", True, -1, -1), ('{"can_skip": 1, "note": {"deep": 1}, "skip_start_idx": 1}', "fallback", False, -1, -1),
    # repeated keys, numbers beyond 32 and 64 bits, numbers that JSON has not
    ('{"can_skip": false, "skip_start_idx": 9, "can_skip": true, "skip_start_idx": 3}', "json", True, 3, 3),
    (JSON_START + "3000000000}", "json", True, 3000000000, 3000000000), (JSON_START + "99999999999999999999}", "json", True, 99999999999999999999, 99999999999999999999),
    ('{"can_skip": NaN, "skip_start_idx": 2}', "json", True, 2, 2), (JSON_START + "Infinity}", "error", False, -1, -1),
]


def test_parsed_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(EXPECTED)], "i int, raw string")
    got = {r.i: r for r in R.with_parsed_reply(df, "raw", "p").select("i", "p.*").collect()}
    for i, (raw, *want) in enumerate(EXPECTED):
        r = got[i]
        assert [r.parse_status, r.can_skip, r.skip_start_idx, r.skip_end_idx] == want, raw


def test_reason_text(spark):
    df = spark.createDataFrame([('{"can_skip": true, "skip_start_idx": 0, "reason": true}',),
                                ('{"can_skip": true, "skip_start_idx": 0, "reason": 5}',),
                                ('{"can_skip": true, "skip_start_idx": 0, "reason": null}',),
                                ('{"can_skip": true, "skip_start_idx": 0}',),
                                ('{"can_skip": false, "reason": null}',)], "raw string")
    got = [r.reason for r in R.with_parsed_reply(df, "raw", "p").select("p.reason").collect()]
    assert got == ["True", "5", "None", "", None]


def test_parse_and_span(spark):
    steps = ["The bus has 9 seats.", "Buses are often red.", "So 9 people sit."]
    raw = FENCE + '\n' + JSON_START + '1, "reason": "colour is beside the point"}\n' + FENCE
    df = spark.createDataFrame([(0, raw, steps), (1, '{"can_skip": false, "reason": "all needed"}', steps[:2]),
                                (2, JSON_START + "4000000000}", steps)], "i int, raw string, steps array<string>")
    d = A.with_reply_decision(df, "raw", "steps").select(
        "i", "decision.*", A.skipped_steps(F.col("decision"), F.col("steps")).alias("sk"),
        A.next_step(F.col("decision"), F.col("steps")).alias("nx")).orderBy("i").collect()
    assert (d[0].can_skip, d[0].skip_start_idx, d[0].skip_end_idx, d[0].reason) == (True, 1, 1, "colour is beside the point")
    assert d[0].sk == [steps[1]] and d[0].nx == steps[2]
    assert (d[1].can_skip, d[1].reason, d[1].sk) == (False, "all needed", [])
    assert (d[2].outcome, d[2].reason) == ("invalid_index", "Invalid skip index: 4000000000 outside [0, 2].")


@pytest.mark.parametrize("n,start,end,outcome,exp_end,next_empty", [
    (3, 2, 2, "skip", 2, True),          # last step skipped (start > 0): empty target kept
    (3, 1, 5, "skip", 1, False),         # end beyond range collapses to start
    (3, 2, 1, "skip", 2, True),          # end before start collapses to start
    (3, 0, 2, "whole_trace", -1, True),  # everything from 0: refused
    (3, 3, 3, "invalid_index", -1, True),
    (2, 0, 0, "skip", 0, False),
    (1, 0, 0, "short_trace", -1, True),
    (0, 0, 0, "short_trace", -1, True),
])
def test_validate_edges(spark, n, start, end, outcome, exp_end, next_empty):
    steps = [f"s{i}" for i in range(n)]
    raw = f'{{"can_skip": true, "skip_start_idx": {start}, "skip_end_idx": {end}}}'
    df = spark.createDataFrame([(raw, steps)], "raw string, steps array<string>")
    r = A.with_reply_decision(df, "raw", "steps").select(
        "decision.*", A.next_step(F.col("decision"), F.col("steps")).alias("nx")).first()
    assert r.outcome == outcome
    assert r.skip_end_idx == exp_end
    assert (r.nx == "") == next_empty


def test_extract_transition(spark):
    steps = ["A week has 7 days.", "Monday is a day.", "Two weeks have 14."]
    df = spark.createDataFrame([("How many days?", "", steps)], "question string, prefix string, steps array<string>")
    df = df.withColumn("decision", A.decision(True, 1, 1, "no use", "skip"))
    t = extract_transitions(df).first()
    assert (t.depth, t.input_x, t.target_y, t.skipped_steps, t.id) == (
        1, "How many days?\nA week has 7 days.", "Two weeks have 14.", ["Monday is a day."], "trans_How_many_day_d1")


def test_transition_prefix_rules(spark):
    df = spark.createDataFrame([
        ("Q", "  old  ", ["a", "b", "c"], 1), ("Q", "", ["a", "b", "c"], 0), ("Q", "old", ["a", "b", "c"], 0),
    ], "question string, prefix string, steps array<string>, st int")
    df = df.withColumn("decision", A.decision(True, F.col("st"), F.col("st"), "", "skip"))
    got = [r.input_x for r in extract_transitions(df).orderBy("input_x").collect()]
    assert sorted(got) == sorted(["Q\nold a", "Q", "Q\nold"])


def test_example_id(spark):
    r = spark.range(1).select(example_id(F.lit("  Hello there world"), F.lit(2)).alias("id")).first()
    assert r.id == "trans_Hello_ther_d2"


def test_user_audit_callable(spark):
    import pandas as pd

    def judge(pdf):
        # skip step 1 when the prompt lists at least three steps
        raw = ['{"can_skip": true, "skip_start_idx": 1}' if "[2]" in p else '{"can_skip": false}' for p in pdf["prompt"]]
        return pd.DataFrame({"trace_id": pdf["trace_id"], "raw_response": raw})

    traces = spark.createDataFrame([
        (1, "Q1", "", ["a", "b", "c"]), (2, "Q2", "", ["a", "b"]), (3, "Q3", "", ["only"])],
        "trace_id long, question string, prefix string, steps array<string>")
    out = {r.trace_id: r for r in A.user_audit(traces, judge, parallelism=2).select("trace_id", "decision.*").collect()}
    assert out[1].outcome == "skip" and out[1].skip_start_idx == 1
    assert out[2].outcome == "no_skip"
    assert out[3].outcome == "short_trace"


def test_failing_callables_are_rows(spark):
    import pandas as pd
    from tracetrim.operators.completions import batch_completion, completion_requests

    def judge(pdf):
        if (pdf["trace_id"] == 2).any():
            raise RuntimeError("down")
        return pd.DataFrame({"trace_id": pdf["trace_id"], "raw_response": JSON_START + "0}"})

    traces = spark.createDataFrame([(i, f"Q{i}", "", ["a", "b", "c"]) for i in range(4)], "trace_id long, question string, prefix string, steps array<string>").coalesce(1)
    out = {r.trace_id: r for r in A.user_audit(traces, judge).select("trace_id", "decision.*").collect()}
    assert [out[i].outcome for i in range(4)] == ["skip", "skip", "error", "skip"] and out[2].reason == "Decision call error: down"

    def answer(pdf):
        if pdf["prompt"].str.contains("Q1").any():
            raise RuntimeError("down")
        return pd.DataFrame({"text": "ok", "usage_tokens": 3}, index=pdf.index)

    q = spark.createDataFrame([(i, f"Q{i}") for i in range(4)], "question_key long, question string").coalesce(1)
    got = {r.question_key: (r.text, r.usage_tokens, r.error) for r in batch_completion(completion_requests(q), answer, depth=2).collect()}
    assert got == {0: ("ok", 3, None), 1: (None, None, "down"), 2: ("ok", 3, None), 3: ("ok", 3, None)}


def test_unreadable_replies_never_skip(spark):
    """Random JSON-like text: every reply gets a status, and a span only from an object that allows it."""
    import random
    rnd = random.Random(12)
    atoms = ["{", "}", '"can_skip"', ": ", "true", "false", '"8"', "8.5", "null", ", ", '"skip_start_idx"', '"skip_end_idx"', "[8]", FENCE, "words ", "\n", "0", "-8", " "]
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    for r in R.with_parsed_reply(df, "raw", "p").select("raw", "p.*").collect():
        assert r.parse_status in ("json", "fallback", "error")
        if r.parse_status != "json" or not r.can_skip:
            assert (r.skip_start_idx, r.skip_end_idx) == (-1, -1), r.raw
        else:
            assert "{" in r.raw and '"can_skip"' in r.raw, r.raw


def test_user_callable_gets_pieces_of_bounded_size(spark):
    import pandas as pd

    def judge(pdf):
        if len(pdf) > 1 and pdf["prompt"].str.len().sum() > 8_000_000:
            raise MemoryError("too large")
        return pd.DataFrame({"trace_id": pdf["trace_id"], "raw_response": f'{{"can_skip": false, "reason": "{len(pdf)}"}}'}, index=pdf.index)

    traces = spark.range(0, 500, 1, 1).selectExpr("id AS trace_id", "'Q' AS question", "'' AS prefix", "array(repeat('x', 60000), 'b') AS steps")
    seen = [int(r.reason) for r in A.user_audit(traces, judge).select("decision.*").collect()]
    # 133 prompts of 60,000 characters and the template make 8 MB; a halved batch of 500 gives 125 or 62
    assert len(seen) == 500 and sorted(set(seen)) == [500 - 3 * max(seen), max(seen)] and 126 <= max(seen) <= 133
