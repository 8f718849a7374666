import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from tracetrim.plans import queries as Q
from tracetrim.operators import rollout as RO
from tracetrim.sources import arrow_folder as AF
from tracetrim.sources import pt_io


def foreign(path, tables, schema=None):
    """A dataset folder as another program writes it."""
    os.makedirs(path)
    names = []
    for i, t in enumerate(tables):
        names.append(f"data-{i:05d}-of-{len(tables):05d}.arrow")
        with pa.OSFile(f"{path}/{names[-1]}", "wb") as f, pa.ipc.new_stream(f, t.schema) as out:
            out.write_table(t, max_chunksize=7)
    with open(f"{path}/state.json", "w") as f:
        json.dump({"_data_files": [{"filename": n} for n in names], "_fingerprint": "x", "_split": None}, f)
    return names


def rows_of(n, start=0):
    return pa.table({"id": pa.array([f"r{i}" for i in range(start, start + n)], pa.large_string()), "depth": pa.array(range(n), pa.int64()),
                     "kind": pa.array(["a", "b"] * (n // 2)).dictionary_encode(), "skipped_steps": pa.array([["x", None]] * n),
                     "metadata": pa.array([{"category": "c", "skip_start_idx": i, "more": 1.5} for i in range(n)])})


def test_reads_each_shard_in_a_task_of_its_own(spark, tmp_path):
    path = str(tmp_path / "ds")
    foreign(path, [rows_of(20, 20 * k) for k in range(12)])
    df = AF.read_arrow(spark, path)
    assert df.rdd.getNumPartitions() == 12
    assert df.count() == 240 and df.select("id").distinct().count() == 240
    r = df.where("id = 'r25'").first()
    assert r["kind"] == "b" and r["skipped_steps"] == ["x", None] and r["metadata"]["more"] == 1.5 and r["depth"] == 5
    assert dict(df.dtypes)["metadata"].startswith("struct<")
    assert AF.read_arrow(spark, "file://" + path).count() == 240


def test_take_opens_few_shards(spark, tmp_path):
    path = str(tmp_path / "ds")
    names = foreign(path, [rows_of(20, 20 * k) for k in range(12)])
    for name in names[1:]:
        with open(f"{path}/{name}", "wb") as f:
            f.write(b"broken")
    assert [r["id"] for r in AF.read_arrow(spark, path).take(5)] == [f"r{i}" for i in range(5)]
    with pytest.raises(Exception):
        AF.read_arrow(spark, path).count()


def test_foreign_rows_take_the_pt_schema(spark, tmp_path):
    path = str(tmp_path / "ds")
    foreign(path, [rows_of(4)])
    df = pt_io.load_pt(spark, path)
    assert df.schema == pt_io.PT_SCHEMA or [f.dataType for f in df.schema] == [f.dataType for f in pt_io.PT_SCHEMA]
    r = df.orderBy("id").first()
    assert (r["depth"], r["input_x"], r["split"], r["metadata"]["category"], r["metadata"]["ground_truth"]) == (0, None, "train", "c", None)


def test_split_choice(spark, tmp_path):
    path = str(tmp_path / "dd")
    df = spark.range(10).select(F.col("id").cast("string").alias("id"))
    AF.write_arrow_splits({"validation": df.limit(2), "train": df, "test": df.limit(3)}, path)
    count = lambda split=None: pt_io.load_pt(spark, path, split).count()
    assert (count(), count("test"), count("validation")) == (10, 3, 2)
    with pytest.raises(Exception, match="there is no split 'dev'"):
        pt_io.load_pt(spark, path, "dev")
    first = str(tmp_path / "first")
    AF.write_arrow_splits({"b": df.limit(1), "a": df}, first)
    assert pt_io.load_pt(spark, first).first()["split"] == "b"
    with pytest.raises(Exception):
        AF.read_arrow(spark, str(tmp_path)).count()


def test_round_trip_keeps_types_and_rows(spark, tmp_path):
    tr = pt_io.to_pt_rows(RO.rollout_transitions(Q.doc_rollout(spark, SMOKE)))
    path = str(tmp_path / "pt")
    pt_io.save_pt_arrow(tr.repartition(4), path)
    back = pt_io.load_pt(spark, path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in pt_io.PT_SCHEMA]
    assert sorted(map(str, back.collect())) == sorted(map(str, tr.select(*back.columns).collect()))
    assert len(AF.shards_of(path + "/train")) > 1
    info = json.load(open(f"{path}/train/dataset_info.json"))["features"]
    assert info["depth"] == {"dtype": "int32", "_type": "Value"} and info["skipped_steps"] == {"feature": {"dtype": "string", "_type": "Value"}, "_type": "Sequence"}
    assert set(info["metadata"]) >= {"category", "skip_start_idx"}
    # plain Arrow reads a shard, and its metadata names the features
    with pa.OSFile(f"{path}/train/{AF.shards_of(path + '/train')[0]}") as f:
        assert json.loads(pa.ipc.open_stream(f).schema.metadata[b"huggingface"])["info"]["features"] == info
    empty = str(tmp_path / "empty")
    pt_io.save_pt_arrow(tr.limit(0), empty)
    e = pt_io.load_pt(spark, empty)
    assert e.count() == 0 and e.columns == back.columns


def test_shards_roll_and_modes(spark, tmp_path):
    path = str(tmp_path / "ds")
    df = spark.range(0, 60_000, 1, 2).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    AF.write_arrow(df, path, shard_mb=1)
    assert len(AF.shards_of(path)) > 2 and AF.read_arrow(spark, path).agg(F.sum("id")).first()[0] == sum(range(60_000))
    AF.write_arrow(df.limit(5), path, mode="append")
    assert AF.read_arrow(spark, path).count() == 60_005
    AF.write_arrow(df.limit(7), path)
    assert AF.read_arrow(spark, path).count() == 7
    assert {n for n in os.listdir(path) if n.endswith(".arrow")} == set(AF.shards_of(path))


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "ds")
    AF.write_arrow(spark.range(3), path)
    before = set(os.listdir(path))
    bad = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") == 19_999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        AF.write_arrow(bad, path, mode="append")
    assert AF.read_arrow(spark, path).count() == 3 and set(AF.shards_of(path)) <= before
