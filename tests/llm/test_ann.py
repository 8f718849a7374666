import numpy as np
import pytest

from tracetrim.llm import ann

SCHEMA = "vec_id long, embedding array<float>, vec int, Vec_Id int"


def rows_of(x, ids=None):
    return [(int(ids[i]) if ids is not None else i, [float(v) for v in r], 0, 0) for i, r in enumerate(x)]


def truth(x, ids, queries, k=20):
    out = {}
    s = x.astype(np.float32).astype(float)
    for q in queries:
        i = list(ids).index(q)
        score = (s * s[i]).sum(axis=1)
        own = [j for j in range(len(ids)) if ids[j] != q]
        out[q] = sorted(own, key=lambda j: (-score[j], ids[j]))[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    got = ann.nearest_of(spark.createDataFrame(rows_of(x), SCHEMA)).toPandas()
    want = truth(x, range(1500), range(0, 1500, 20))
    hits = [len(set(got[got.query_id == q].vec_id) & set(w)) / 20 for q, w in want.items()]
    assert np.mean(hits) >= 0.9
    s = x.astype(np.float32).astype(float)
    for r in got.head(200).itertuples():
        assert r.score == pytest.approx((s[r.query_id] * s[r.vec_id]).sum(), rel=1e-12, abs=1e-12)
    for _, g in got.groupby("query_id"):
        assert sorted(g["rank"]) == list(range(1, 21)) and list(g.sort_values("rank").score) == sorted(g.score, reverse=True)


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[::3] = x[0]
    got = ann.nearest_of(spark.createDataFrame(rows_of(x), SCHEMA)).toPandas()
    want = truth(x, range(300), (0, 60, 120))
    for q in want:
        own = list(got[got.query_id == q].sort_values("rank").vec_id)
        assert own == want[q] and sum(i % 3 == 0 for i in own) > 5


def test_several_shards_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8))
    v = spark.createDataFrame([(r[0], r[1]) for r in rows_of(x)], "vec_id long, vec array<float>")
    got = ann.nearest(v, "vec_id % 10 = 0", k=5, shard_rows=90, query_block=16).toPandas()
    want = truth(x, range(700), range(0, 700, 10), 5)
    assert np.mean([len(set(got[got.query_id == q].vec_id) & set(w)) / 5 for q, w in want.items()]) >= 0.97


def test_rows_that_take_no_part(spark):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, []),
           (0, [1.0, 0.0]), (1, [0.5, 0.5]), (140, [1.0, 2.0, 3.0])]
    got = ann.nearest_of(spark.createDataFrame([(a, b) for a, b in bad], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert ann.nearest_of(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_two_vectors_far_longer_than_the_rest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1e4
    x[8] *= 1e20
    got = ann.nearest_of(spark.createDataFrame(rows_of(x), SCHEMA)).toPandas()
    want = truth(x, range(3000), range(0, 3000, 20))
    assert np.mean([len(set(got[got.query_id == q].vec_id) & set(w)) / 20 for q, w in want.items()]) >= 0.95


def test_all_points_found_are_compared_in_double(spark):
    """Forty scores that float32 cannot tell apart."""
    x = np.array([[1.0, 0.0]] + [[1.0, 1e-9 * i] for i in range(1, 41)])
    q = np.array([[1.0, 1.0]])
    r, at, _, full = ann.best_found(x, np.arange(41), q, np.arange(41)[None, :], 5)
    assert sorted(at) == list(range(35, 41)) and full.all() and not r.any()


@pytest.mark.parametrize("repeats", [2, 25, 700])
def test_rows_that_repeat_the_query_s_id(spark, repeats):
    """The query's id stands at many near vectors, and at equal ones; it still gets its 20 others."""
    rng = np.random.default_rng(5)
    other = rng.normal(size=(300, 8)) * 0.1
    own = np.array([5.0] + [0.0] * 7) + rng.normal(size=(repeats, 8)) * 0.01
    x, ids = np.concatenate([own, own[:1].repeat(30, 0), other]), [0] * (repeats + 30) + [20 * i + 1 for i in range(300)]
    rows = [(i, [float(v) for v in a]) for i, a in zip(ids, x.astype(np.float32))]
    got = ann.nearest_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert not (got.vec_id == 0).any()
    counts = got.groupby("rank").size()
    assert list(counts.index) == list(range(1, 21)) and (counts == repeats + 30).all()


def test_a_neighbour_s_repeated_rows_each_count(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [3.0, 0.0])] * 4, (2, [2.0, 0.0]), (3, [-1.0, 0.0])]
    got = ann.nearest_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [1, 1, 1, 1, 2]
