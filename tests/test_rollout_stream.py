import collections
import datetime as dt
import itertools
import random

from tests.test_frontier import long_questions
from tracetrim.operators import rollout as RO
from tracetrim.operators.build import recorded_rollout
from tracetrim.streaming import rollout_stream as RS

COLUMNS = ("question_key", "depth", "input_x", "target_y", "skip_reason")
REPLY = '{"can_skip": true, "skip_start_idx": 1, "skip_end_idx": 2, "reason": "r"}'


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def record(key, depth, second=0, text=None, question="q", reply=REPLY):
    return (key, depth, question, text or f"A{depth}. B. B. C{depth}. D.", None, None, reply, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second))


class Stream:
    def __init__(self, spark, folder, max_depth=3, **patience):
        self.spark, self.src, self.out = spark, str(folder / "src"), str(folder / "out")
        self.options = {"max_depth": max_depth, **patience}

    def feed(self, rows):
        df = self.spark.createDataFrame(rows, RS.RAW_SCHEMA).coalesce(1)
        df.write.mode("append").parquet(self.src)
        return self

    def drain(self):
        RS.run_rollout_stream(self.spark, self.src, self.out, self.out + "_ckpt", max_files_per_trigger=1, **self.options)
        return rows_of(self.spark.read.parquet(self.out)) if self.spark.read.format("binaryFile").load(self.out).count() else collections.Counter()


def test_any_order_and_a_restart_equal_the_batch_rollout(spark, tmp_path):
    qs, completions, replies = long_questions(spark, 12, 4)
    replies = replies.where("(question_key + depth) % 5 != 0")
    ro = recorded_rollout(qs, completions, replies, max_depth=4)
    want = rows_of(RO.rollout_transitions(ro, "question_key"))
    rows = [(r.question_key, r.depth, r.question, r.text, r.usage_tokens, r.error, r.raw_response, dt.datetime(2024, 1, 1))
            for r in completions.join(replies, ["question_key", "depth"], "left").join(qs, "question_key").collect()]
    random.Random(4).shuffle(rows)
    stream = Stream(spark, tmp_path, 4)
    third = len(rows) // 3
    stream.feed(rows[:third]).feed(rows[third: 2 * third])
    assert sum(stream.drain().values()) < sum(want.values())
    # the process ends here; another one goes on, and gets the first records again as well
    assert stream.feed(rows[2 * third:]).feed(rows[:third]).drain() == want
    assert stream.drain() == want


def test_late_records_and_expired_questions(spark, tmp_path):
    stream = Stream(spark, tmp_path, patience="10 seconds", patience_ms=10_000)
    stream.feed([record(1, 1), record(1, 3), record(2, 2), (None, 1, *record(9, 1)[2:]), (9, None, *record(9, 1)[2:])])
    assert {k[:2] for k in stream.drain()} == {(1, 1)}
    # far ahead: the gaps of 1 and 2 are given up once the watermark has passed
    stream.feed([record(3, 1, 1000)]).drain()
    stream.feed([record(4, 1, 1001)]).drain()
    got = stream.feed([record(1, 2, 1), record(2, 1, 2), record(1, 1, 3), record(3, 2, 1002)]).drain()
    assert {k[:2] for k in got} == {(1, 1), (3, 1), (3, 2), (4, 1)} and set(got.values()) == {1}


def plain(text, goes_on=True, said="x", question="q"):
    return {"question": question, "text": text, "usage_tokens": None, "error": None, "raw_response": "r", "said": said, "goes_on": goes_on}


def test_every_order_of_arrival_gives_the_same():
    records = [(1, plain("a", said="one")), (2, plain("b", said="")), (2, plain("c", said="two")), (3, plain("d", goes_on=False)), (4, plain("e"))]
    results = set()
    for order in itertools.permutations(records):
        q, out = RS.Question(), []
        for depth, r in order:  # all that came before a release is known here, as within a batch
            q.put(depth, r)
        out = [(d, p, r["text"]) for d, p, r in q.release(5)]
        results.add(tuple(out))
        assert q.next_depth == 0
        q = RS.Question(*q.state())
        q.put(1, plain("again"))
        assert list(q.release(5)) == []
    assert results == {((1, "", "a"), (2, "one", "c"), (3, "one two", "d"))}


def test_state_between_batches():
    q = RS.Question()
    q.put(2, plain("b", question=None))
    assert list(q.release(3)) == []
    q = RS.Question(*q.state())
    q.put(1, plain("a", said="one", question="asked"))
    assert [(d, p) for d, p, _ in q.release(3)] == [(1, ""), (2, "one")] and q.question == "asked"
    assert [d for d, _, _ in q.release(3)] == []
    q.put(2, plain("late"))
    assert list(q.release(3)) == [] and RS.Question(*q.state()).next_depth == 3
