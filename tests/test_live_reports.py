"""Reports from the stream's counts against the batch reports."""

import pytest

from tracetrim.operators import reports as RP
from tracetrim.sources import pt_io
from tracetrim.streaming import live_reports as LR


def _reply(start, end):
    return f'{{"can_skip": true, "skip_start_idx": {start}, "skip_end_idx": {end}, "reason": "again"}}'


ROWS = [
    # key, depth, question, prefix, text, usage, error, reply, category
    (1, 1, "Why?", None, "One is here. Two is there. Three is last.", 9, None, _reply(1, 1), "maths"),
    (2, 1, "Why?", "", "One is here. Two is there. Three is last.", None, None, _reply(1, 2), "maths"),  # empty target
    (3, 1, "", "", "One is here. Two is there. Three is last.", None, None, _reply(0, 0), None),  # empty input
    (4, 2, "How?", "Before.", "One is here. Two is there.", 3, None, _reply(0, 0), None),
    (5, 2, "How?", "Before.", None, None, "timeout", None, "facts"),
    (6, 1, "How?", "", "", None, None, '{"can_skip": false}', "facts"),
    (6, 1, "How?", "", "", None, None, '{"can_skip": false}', "facts"),
]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def drained(spark):
    src, out = pt_io.shared_path(spark, "t_reports"), pt_io.shared_path(spark, "t_reports_out")
    records = spark.createDataFrame(ROWS, LR.SCHEMA)
    records.repartition(3, "question_key").write.parquet(src)
    LR.run_report_stream(spark, src, out, max_files_per_trigger=1)
    return records, src, out


def test_reports_equal_batch(spark, drained):
    records, _, out = drained
    decided = LR.decided_transitions(records)
    made = decided.where("made is not null").select("question_key", "category", "made.*")
    counts = LR.read_counts(spark, out)
    assert _rows(LR.content_report(counts)) == _rows(RP.content_check(made)) == [(4, 1, 1, 2)]
    assert [tuple(r) for r in LR.category_report(counts).collect()] == [tuple(r) for r in RP.category_counts(made).collect()]
    assert [tuple(r) for r in LR.depth_report(counts).collect()] == [tuple(r) for r in RP.depth_counts(made).collect()] == [(1, 3), (2, 1)]
    assert _rows(LR.card_report(counts, "g")) == _rows(RP.dataset_card(made, "g"))
    rates = {r[0]: tuple(r)[1:] for r in LR.rates_report(counts).collect()}
    assert rates["maths"] == (2, 1.0, 3.0) and rates["Unknown"] == (2, 1.0, 2.5) and rates["facts"][:2] == (3, 0.0)
    for sink, keys in (("valid", [1, 4]), ("quarantine", [2, 3])):
        assert sorted(r[0] for r in LR.read_rows(spark, out, sink).select("question_key").collect()) == keys


def test_batch_again_changes_nothing(spark, drained):
    records, src, out = drained
    before = _rows(LR.read_counts(spark, out)), _rows(LR.read_rows(spark, out)), _rows(LR.read_rows(spark, out, "quarantine"))
    LR.write_batch(records, 0, out)
    LR.run_report_stream(spark, src, out)
    assert before == (_rows(LR.read_counts(spark, out)), _rows(LR.read_rows(spark, out)), _rows(LR.read_rows(spark, out, "quarantine")))


def test_broken_batch_is_left_out_then_written_over(spark, drained):
    records, _, _ = drained
    out = pt_io.shared_path(spark, "t_reports_broken")
    LR.write_batch(records.limit(0), -1, out)
    made = LR.decided_transitions(records).where("made is not null").select("question_key", "category", "made.*")
    for sink in ("valid", "quarantine"):
        made.write.parquet(f"{out}/{sink}/batch=0")  # a run that ended before its counts
    assert LR.read_rows(spark, out).count() == 0
    LR.write_batch(records, 0, out)
    assert LR.read_rows(spark, out).count() == 2 and LR.read_rows(spark, out, "quarantine").count() == 2


def test_new_files_add_up(spark, drained):
    records, _, _ = drained
    src, out = pt_io.shared_path(spark, "t_reports_more"), pt_io.shared_path(spark, "t_reports_more_out")
    records.limit(0).write.parquet(src)
    LR.run_report_stream(spark, src, out)
    assert _rows(LR.content_report(LR.read_counts(spark, out))) == [(0, 0, 0, 0)]
    assert _rows(LR.card_report(LR.read_counts(spark, out))) == [(0, "N/A", "N/A", "| All | 0 |")]
    for _ in range(2):
        records.coalesce(1).write.mode("append").parquet(src)
        LR.run_report_stream(spark, src, out)
    assert _rows(LR.content_report(LR.read_counts(spark, out))) == [(8, 2, 2, 4)]
