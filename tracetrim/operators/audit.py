"""Audit decisions: validation (E4), materialisation (E5), short-trace guard (E6) and
recorded / user auditors (E8).

A decision is a struct column
``STRUCT<can_skip BOOLEAN, skip_start_idx INT, skip_end_idx INT, reason STRING, outcome STRING>``;
``outcome`` says why (skip, no_skip, fallback, error, invalid_index, whole_trace,
short_trace, missing).  ``usable`` = can_skip and a real start index: a keyword
fallback that says "true" carries no span and is never turned into a transition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.reply import (
    ALL_STEPS_REASON, MISSING_REPLY_REASON, SHORT_TRACE_REASON, with_parsed_reply,
)
from tracetrim.functions.text import col_
from tracetrim.operators.ledger import answers
from tracetrim.session import ship_package

# Fixed value: the reason of a decision whose call failed begins so.
CALL_ERROR = "Decision call error: "

DECISION_FIELDS = ("can_skip", "skip_start_idx", "skip_end_idx", "reason", "outcome")


def decision(can_skip, start, end, reason, outcome) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(can_skip).cast("boolean").alias("can_skip"),
        lit(start).cast("int").alias("skip_start_idx"),
        lit(end).cast("int").alias("skip_end_idx"),
        lit(reason).cast("string").alias("reason"),
        lit(outcome).cast("string").alias("outcome"),
    )


def no_skip(reason, outcome) -> Column:
    return decision(False, -1, -1, reason, outcome)


def validate(parsed: Column, steps) -> Column:
    """Check a parsed reply against the trace's step count."""
    n = F.size(col_(steps))
    start, end = parsed["skip_start_idx"], parsed["skip_end_idx"]
    end_fixed = F.when((end < start) | (end >= n), start).otherwise(end)
    invalid_reason = F.concat(F.lit("Invalid skip index: "), start.cast("string"), F.lit(" outside [0, "), (n - 1).cast("string"), F.lit("]."))
    status = parsed["parse_status"]
    return (
        F.when(status == "fallback", decision(parsed["can_skip"], -1, -1, parsed["reason"], "fallback"))
        .when(status == "error", no_skip(parsed["reason"], "error"))
        .when(~parsed["can_skip"], no_skip(parsed["reason"], "no_skip"))
        .when((start < 0) | (start >= n), no_skip(invalid_reason, "invalid_index"))
        .when((end_fixed >= n - 1) & (start == 0) & (n > 1), no_skip(ALL_STEPS_REASON, "whole_trace"))
        .otherwise(decision(True, start, end_fixed, parsed["reason"], "skip"))
    )


def guard(dec: Column, steps) -> Column:
    """Traces with at most one step are never audited."""
    return F.when(F.size(col_(steps)) <= 1, no_skip(SHORT_TRACE_REASON, "short_trace")).otherwise(dec)


def usable(dec: Column) -> Column:
    return dec["can_skip"] & (dec["skip_start_idx"] >= 0)


def skipped_steps(dec: Column, steps) -> Column:
    """E5: steps[start..end] for a usable decision, else an empty array."""
    s = col_(steps)
    start, end = dec["skip_start_idx"], dec["skip_end_idx"]
    return F.when(usable(dec), F.slice(s, start + 1, end - start + 1)).otherwise(F.array().cast("array<string>"))


def next_step(dec: Column, steps) -> Column:
    """E5: steps[end + 1], or "" past the end / when there is no usable skip."""
    s = col_(steps)
    return F.when(usable(dec), F.coalesce(F.try_element_at(s, dec["skip_end_idx"] + 2), F.lit(""))).otherwise(F.lit(""))


def with_reply_decision(df: DataFrame, raw_col: str, steps_col: str = "steps", out: str = "decision") -> DataFrame:
    """E1-E6 for one recorded reply per row: guard, parse, validate.  A null reply is 'missing'."""
    tmp = f"_{out}_parsed"
    df = with_parsed_reply(df, raw_col, tmp)
    steps = F.col(steps_col)
    d = F.when(F.col(raw_col).isNull(), no_skip(MISSING_REPLY_REASON, "missing")).otherwise(validate(F.col(tmp), steps))
    return df.withColumn(out, guard(d, steps)).drop(tmp)


def recorded_audit(traces: DataFrame, replies: DataFrame, keys=("trace_id",), steps_col: str = "steps",
                   raw_col: str = "raw_response", out: str = "decision") -> DataFrame:
    """Left-join recorded auditor replies on the trace key, then decide.

    Replies are first reduced to one per key (deterministic max); both sides are then
    hash-partitioned on the key by the join.  A reply with an ``error`` is an error decision.
    """
    # one reply per key: duplicates reduce map-side (max is partial), so a key with many
    # replies neither multiplies trace rows nor lands in one task
    failed = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    one = replies.groupBy(*keys).agg(F.max(raw_col).alias(raw_col), F.max(failed).alias("_failed"))
    j = with_reply_decision(traces.join(one, list(keys), "left"), raw_col, steps_col, out)
    dec = F.when(F.col("_failed").isNotNull() & F.col(raw_col).isNull(), guard(call_error(F.col("_failed")), F.col(steps_col))).otherwise(F.col(out))
    return j.withColumn(out, dec).drop("_failed")


def call_error(message: Column) -> Column:
    return no_skip(F.concat(F.lit(CALL_ERROR), message), "error")


def pieces(batches, column: str, kinds: dict, size: int = 8_000_000):
    """Arrow batches as pandas frames whose ``column`` holds ``size`` bytes at most, or of one row: a batch has thousands of rows of any
    length, and their objects take several times its bytes.  ``kinds`` gets the columns' Arrow types."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        kinds.update((f.name, f.type) for f in batch.schema)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo).to_pandas(date_as_object=True, coerce_temporal_nanoseconds=True)
            lo = hi


def user_replies(traces: DataFrame, fn, template: str | None = None, parallelism: int | None = None, key: str = "trace_id",
                 ledger: str | None = None, call_rows: int | None = None) -> DataFrame:
    """The replies of a user callable: ``fn(pandas.DataFrame) -> pandas.DataFrame`` per piece of an Arrow batch (``pieces``).

    The callable sees (key, question, prefix, steps, prompt) batches inside the
    executors (one client per task, no driver loop); ``prompt`` is the audit prompt built
    with ``template`` (default template when None).  It returns the key and
    ``raw_response``.  If it raises, the rows are halved until those that fail stand alone; they
    get their ``error``.  ``ledger`` and ``call_rows`` are those of ``batch_completion``.  Short traces are filtered out before the Python step (the
    guard never calls it), and ``parallelism`` bounds the number of concurrent clients.
    """
    from tracetrim.operators.format import audit_prompt

    ship_package(traces.sparkSession)

    def run(batches):
        import pyarrow as pa

        kinds = {}
        for out in answers(fn, pieces(batches, "prompt", kinds), lambda rows, message: rows[[key]].assign(raw_response=None, error=message),
                           [key, "raw_response", "error"], key, ledger, call_rows):
            yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(out[c], type=kinds[key] if c == key else pa.string()) for c in out.columns], list(out.columns))

    needs = traces.where(F.size("steps") > 1).select(
        key, "question", "prefix", "steps",
        audit_prompt(F.col("question"), F.col("prefix"), F.col("steps"), template).alias("prompt"))
    if parallelism:
        needs = needs.repartition(parallelism)
    return needs.mapInArrow(run, f"{key} {traces.schema[key].dataType.simpleString()}, raw_response string, error string")


def user_audit(traces: DataFrame, fn, template: str | None = None, parallelism: int | None = None) -> DataFrame:
    """E8 with a user callable: its replies go through the same parse and validate path."""
    return recorded_audit(traces, user_replies(traces, fn, template, parallelism))
