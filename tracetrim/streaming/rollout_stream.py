"""The multi-depth rollout over a stream of raw completions.

A record is one completion with its auditor reply; it knows its question and depth but not the prefix that a rollout has
reached there.  Records arrive in any order.  State keyed by question carries the prefix, the next depth
and the records that came too early; a record is released, with its prefix, when all depths before it are through and the
rollout still goes on.  Released records become transitions by ``transitions_from_records``.

Segmentation, reply parsing and span validation are row-local and run in the JVM before the state, which sees two
facts about a record: the text that it keeps and whether the rollout goes on.

Defined results:
* a question starts with depth 1; nothing is released before it, nor beyond ``max_depth`` or after the rollout has ended;
* of several records of one question and depth the greatest by (text, usage_tokens, error, raw_response) counts,
  among those that are there when the depth's turn comes; later ones are left out;
* the question's text is that of the released record, else the latest that any record of the question gave;
* state goes when the watermark has passed the question's last record by ``patience`` (a gap then stays one, as
  ``missing_completion``); records behind the watermark are left out, so no question starts a second time;
* a null key or depth is left out; a restart from the checkpoint goes on where the state was.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetrim.functions.text import py_strip
from tracetrim.operators.audit import next_step, usable
from tracetrim.session import ship_package
from tracetrim.streaming.incremental import decided, drain, transitions_from_records

RAW_SCHEMA = ("question_key long, depth int, question string, text string, usage_tokens int, error string, raw_response string, "
              "event_time timestamp")
RECORD = ("question", "text", "usage_tokens", "error", "raw_response", "said", "goes_on")
RELEASED = "question_key long, depth int, question string, prefix string, text string, usage_tokens int, error string, raw_response string"
STATE = "next_depth int, prefix string, question string, waiting string"


def with_outlook(records: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds ``said`` (what the record leaves in the prefix) and ``goes_on`` (whether its depth lets the rollout continue)."""
    t = decided(records, mode, ("text", "usage_tokens", "error", "event_time"))
    dec, steps = F.col("decision"), F.col("steps")
    nxt = next_step(dec, steps)
    before = F.slice(steps, 1, F.greatest(dec["skip_start_idx"], F.lit(0)))
    kept = F.when(nxt != "", F.concat(before, F.array(nxt))).otherwise(before)
    return t.select("question_key", "depth", "question", "text", "usage_tokens", "error", "raw_response", "event_time",
                    py_strip(F.array_join(kept, " ")).alias("said"), (usable(dec) & (dec["skip_end_idx"] + 1 < F.size(steps) - 1)).alias("goes_on"))


def _rank(record: dict) -> tuple:
    return tuple((record[c] is not None, record[c] if record[c] is not None else "") for c in ("text", "usage_tokens", "error", "raw_response"))


class Question:
    """What is known of one question between batches: next depth (0 when it has ended), prefix, question and waiting records."""

    def __init__(self, next_depth: int = 1, prefix: str = "", question: str | None = None, waiting: str = "{}"):
        self.next_depth, self.prefix, self.question = next_depth, prefix, question
        self.waiting = {int(d): r for d, r in json.loads(waiting).items()}

    def state(self) -> tuple:
        return self.next_depth, self.prefix, self.question, json.dumps(self.waiting)

    def put(self, depth: int, record: dict) -> None:
        self.question = record["question"] if record["question"] is not None else self.question
        if self.next_depth and depth >= self.next_depth and (depth not in self.waiting or _rank(record) > _rank(self.waiting[depth])):
            self.waiting[depth] = record

    def release(self, max_depth: int):
        """(depth, prefix, record) of all records whose turn has come."""
        while self.next_depth and self.next_depth in self.waiting:
            depth, record = self.next_depth, self.waiting.pop(self.next_depth)
            yield depth, self.prefix, record
            if record["goes_on"] and depth < max_depth:
                self.prefix = (self.prefix + " " + record["said"]).strip() if self.prefix else record["said"]
                self.next_depth += 1
            else:
                self.next_depth, self.prefix, self.waiting = 0, "", {}


def released(records: DataFrame, max_depth: int, patience_ms: int) -> DataFrame:
    """The records with their prefix, each when its turn comes (see the module's text)."""
    ship_package(records.sparkSession)

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        own = Question(*state.get) if state.exists else Question()
        last = state.getCurrentWatermarkMs()
        for pdf in frames:
            last = max(last, int(pdf["event_time"].max().timestamp() * 1000))
            for row in pdf.to_dict("records"):
                plain = {c: None if row[c] is None or row[c] is pd.NA or row[c] != row[c] else row[c] for c in RECORD}
                plain["usage_tokens"] = None if plain["usage_tokens"] is None else int(plain["usage_tokens"])
                plain["goes_on"] = bool(plain["goes_on"])
                own.put(int(row["depth"]), plain)
        out = [(key[0], depth, r["question"] if r["question"] is not None else own.question, prefix, r["text"], r["usage_tokens"], r["error"], r["raw_response"])
               for depth, prefix, r in own.release(max_depth)]
        state.update(own.state())
        state.setTimeoutTimestamp(last + patience_ms)
        if out:
            cols = [c.split()[0] for c in RELEASED.split(", ")]
            yield pd.DataFrame(out, columns=cols).astype({"depth": "int32", "usage_tokens": "Int32"})

    good = records.where(F.col("question_key").isNotNull() & F.col("depth").between(1, max_depth) & F.col("event_time").isNotNull())
    return good.groupBy("question_key").applyInPandasWithState(run, RELEASED, STATE, "append", "EventTimeTimeout")


def rollout_stream(records: DataFrame, max_depth: int = 3, mode: str = "auto", patience: str = "1 day", patience_ms: int = 86_400_000) -> DataFrame:
    """Streaming transitions of a stream of ``RAW_SCHEMA`` records; ``patience`` is the watermark's delay and the state's life."""
    seen = with_outlook(records.withWatermark("event_time", patience), mode)
    return transitions_from_records(released(seen, max_depth, patience_ms), mode)


def run_rollout_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, max_depth: int = 3, mode: str = "auto",
                       max_files_per_trigger: int | None = None, **patience) -> None:
    """Drain ``source_dir`` (parquet files of raw records) into ``out_dir`` (parquet transitions) and stop."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    drain(rollout_stream(reader.parquet(source_dir), max_depth, mode, **patience), out_dir, checkpoint)
