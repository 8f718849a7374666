import collections

from tests.conftest import SMOKE
from tracetrim.plans import queries as Q
from tracetrim.sources import pt_io
from tracetrim.streaming import incremental as INC

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PYTHON_QUERIES = {"batch_completion", "rollout_live", "user_audit"}
SIDE_EFFECT = {"pt_roundtrip", "stream_transitions", "schema_check", "arrow_roundtrip", "stream_rollout", "fmt_mixed_json", "stream_reports"}


def test_stream_equals_batch(spark):
    rec = Q.completion_records(spark, SMOKE)
    src = pt_io.shared_path(spark, "t_src")
    out = pt_io.shared_path(spark, "t_out")
    rec.repartition(3).write.parquet(src)
    INC.run_stream(spark, src, out, out + "_ckpt", max_files_per_trigger=1)
    streamed = collections.Counter(tuple(r) for r in spark.read.parquet(out).select("id", "input_x", "target_y").collect())
    batch = collections.Counter(tuple(r) for r in INC.transitions_from_records(rec).select("id", "input_x", "target_y").collect())
    assert streamed == batch and sum(batch.values()) > 0
    # restarting on the same checkpoint adds nothing
    INC.run_stream(spark, src, out, out + "_ckpt")
    assert spark.read.parquet(out).count() == sum(batch.values())


def test_sql_checked_queries_have_no_python(spark):
    for name, fn in Q.QUERIES.items():
        if name in PYTHON_QUERIES or name in SIDE_EFFECT:
            continue
        plan = fn(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        assert not any(node in plan for node in PYTHON_NODES), name


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "input_x" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_queries_do_not_shuffle(spark):
    for name in ("rollout_replay", "rubric_audit", "segment_auto", "validate_span", "provenance", "build_pt_dataset"):
        assert "Exchange" not in _plan(Q.QUERIES[name](spark, SMOKE)), name


def test_reports_join_nothing(spark):
    for name in ("depth_counts", "category_counts", "content_check", "dataset_card", "build_pt_dataset", "provenance", "eval_summary"):
        assert "Join" not in _plan(Q.QUERIES[name](spark, SMOKE)), name


def test_tables_are_spread_only_when_asked(spark):
    from tracetrim.sources.tables import SPREAD_SETTING, read_table, spread
    df = read_table(spark, SMOKE, "part")
    assert "Exchange" not in _plan(df)
    assert spread(df, 5).rdd.getNumPartitions() == 5
    spark.conf.set(SPREAD_SETTING, "3")
    try:
        assert read_table(spark, SMOKE, "part").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(SPREAD_SETTING)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    import pytest
    from types import SimpleNamespace
    from tracetrim.session import checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
