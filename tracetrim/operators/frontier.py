"""The multi-depth rollout depth by depth (F4): a written state and a set of active questions.

``rollout`` unrolls its depths into one plan, which suits few depths over recorded tables.  Here every depth is a
plan of its own that reads the written state of the depth before, so neither plan nor construction grows with
``max_depth``, and a depth's work is that of the questions still running.  It ends as soon as none is.

A depth: ``ask`` gives the traces of the active questions, ``judge`` adds a decision to them; the depth's log
(one row a question) is written under ``depth=d`` of one folder.  Its unstopped rows are the next active
set.  A lost executor costs the depth's running tasks only.  Recorded tables are segmented and parsed once, beforehand, and written by
depth, so that a depth reads its own records.

Defined results: a question without a completion stops as ``missing_completion``; repeated keys are one
question (the least text is asked) whose rollout each of their rows gets; a null key is never asked; several completions
of one key and depth reduce to the greatest record, as in ``rollout``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.reply import MISSING_REPLY_REASON, with_parsed_reply
from tracetrim.functions.text import py_strip
from tracetrim.operators.audit import call_error, guard, next_step, no_skip, recorded_audit, skipped_steps, usable, user_replies, validate
from tracetrim.operators.completions import batch_completion, build_traces, completion_requests
from tracetrim.operators.ledger import usable_ledger
from tracetrim.operators.rollout import rubric_auditor
from tracetrim.operators.transitions import input_x
from tracetrim.session import shared_path, write_shared

KEY = "question_key"
LOG_FIELDS = ("depth", "n_steps", "steps", "prefix", "full_text", "token_count", "is_error", "can_skip", "skip_start_idx", "skip_end_idx",
              "reason", "outcome", "usable", "skipped_steps", "next_step", "input_x")


def depth_log(judged: DataFrame, last: bool) -> DataFrame:
    """One depth's log rows with the state after it, from (question_key, question, prefix, kept, steps, full_text, token_count, is_error, decision)."""
    q, prefix, steps, dec = F.col("question"), F.col("prefix"), F.col("steps"), F.col("decision")
    df = judged.withColumns({"usable": usable(dec), "next_step": next_step(dec, steps), "n_steps": F.size(steps)})
    ok, nxt = F.col("usable"), F.col("next_step")
    before = F.slice(steps, 1, F.greatest(dec["skip_start_idx"], F.lit(0)))
    df = df.withColumn("kept_now", F.when(~ok, steps).when(nxt != "", F.concat(before, F.array(nxt))).otherwise(before))
    said = py_strip(F.array_join("kept_now", " "))
    going = F.when(prefix != "", py_strip(F.concat(prefix, F.lit(" "), said))).otherwise(said)
    stop = F.when(~ok, F.lit("no_skip")).when(dec["skip_end_idx"] + 1 >= F.col("n_steps") - 1, F.lit("end_of_trace"))
    return df.select(
        KEY, "question", "n_steps", "steps", "prefix", "full_text", "token_count", "is_error",
        *[dec[c].alias(c) for c in ("can_skip", "skip_start_idx", "skip_end_idx", "reason", "outcome")],
        "usable", skipped_steps(dec, steps).alias("skipped_steps"), "next_step", F.when(ok, input_x(q, prefix, steps, dec)).alias("input_x"),
        F.concat("kept", "kept_now").alias("kept"), F.when(ok, going).otherwise(prefix).alias("next_prefix"),
        (stop.when(F.lit(True), F.lit("max_depth")) if last else stop).alias("stopped_by"))


def frontier_log(questions: DataFrame, ask, judge, *, max_depth: int = 3) -> DataFrame:
    """The long-form log: (question_key, question, depth, log fields, kept, next_prefix, stopped_by).

    ``ask(active, depth)`` -> (question_key, steps, full_text, token_count, is_error), one row a key at most; ``judge(traces, depth)``
    adds the struct ``decision``.
    ``active`` holds question_key, question, prefix (the text kept so far) and kept (its steps).
    """
    if max_depth < 1:
        raise ValueError("max_depth must be >= 1")
    spark = questions.sparkSession
    path = shared_path(spark, "rollout-log")
    active = (questions.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min("question").alias("question"))
              .withColumns({"prefix": F.lit(""), "kept": F.array().cast("array<string>")}))
    active = write_shared(active, "rollout-active")
    schema = None
    for depth in range(1, max_depth + 1):
        log = depth_log(judge(ask(active, depth).join(active, KEY), depth), depth == max_depth)
        schema = log.schema
        log.write.option("compression", "zstd").parquet(f"{path}/depth={depth}")
        done = spark.read.schema(schema).parquet(f"{path}/depth={depth}")
        active = done.where(F.col("stopped_by").isNull()).select(KEY, "question", F.col("next_prefix").alias("prefix"), "kept")
        if not active.head(1):
            break
    return spark.read.schema(schema.add("depth", "integer")).parquet(path)


def rollout_by_depth(questions: DataFrame, ask, judge, *, max_depth: int = 3, generator_model: str = "recorded",
                     decision_model: str = "recorded") -> DataFrame:
    """``frontier_log`` gathered to one row per question, in the columns of ``rollout``: each has at most ``max_depth`` log rows."""
    log = frontier_log(questions, ask, judge, max_depth=max_depth)
    entry = F.struct(*LOG_FIELDS)
    state = log.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("depth").alias("at"), entry.alias("entry")))).alias("e"),
                                 F.max_by(F.struct("kept", "next_prefix", "stopped_by"), "depth").alias("s"))
    rows = questions.join(state, KEY, "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *[F.col(c) for c in questions.columns], F.coalesce("s.kept", none).alias("final_steps"), F.coalesce("s.next_prefix", F.lit("")).alias("next_prefix"),
        F.coalesce("s.stopped_by", F.lit("missing_completion")).alias("stopped_by"),
        F.coalesce(F.transform("e", lambda x: x["entry"]), F.array().cast(state.schema["e"].dataType.simpleString()).getField("entry")).alias("log"),
        F.lit(decision_model).alias("decision_model"), F.lit(generator_model).alias("generator_model"))


TRACE = ("full_text", "token_count", "is_error", "steps")


def traces_of(completions: DataFrame, mode: str) -> DataFrame:
    """(question_key, depth, steps, full_text, token_count, is_error): one record a key and depth."""
    one = completions.groupBy(KEY, "depth").agg(F.max(F.struct("text", "usage_tokens", "error")).alias("r")).select(KEY, "depth", "r.*")
    return build_traces(one, mode).select(KEY, "depth", *TRACE)


def by_depth(df: DataFrame, name: str) -> DataFrame:
    """Written once in a folder a depth: a filter on ``depth`` reads that folder alone."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy("depth").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recorded_answers(completions: DataFrame, max_depth: int, mode: str = "auto"):
    """``ask`` over a table of recorded completions (question_key, depth, text, usage_tokens, error)."""
    traces = by_depth(traces_of(completions.where(F.col("depth").between(1, max_depth)), mode), "recorded-traces")

    def ask(active: DataFrame, depth: int) -> DataFrame:
        return traces.where(F.col("depth") == depth).drop("depth")
    return ask


def recorded_verdicts(replies: DataFrame, max_depth: int):
    """``judge`` by a table of recorded replies (question_key, depth, raw_response and, for failed calls, error)."""
    failed = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    one = (replies.where(F.col("depth").between(1, max_depth)).groupBy(KEY, "depth")
           .agg(F.max("raw_response").alias("raw_response"), F.max(failed).alias("failed")))
    parsed = by_depth(with_parsed_reply(one, "raw_response", "parsed").withColumn("silent", F.col("raw_response").isNull()).drop("raw_response"), "recorded-replies")

    def judge(traces: DataFrame, depth: int) -> DataFrame:
        steps, silent = F.col("steps"), F.coalesce("silent", F.lit(True))
        dec = (F.when(silent & F.col("failed").isNotNull(), call_error(F.col("failed")))
               .when(silent, no_skip(MISSING_REPLY_REASON, "missing")).otherwise(validate(F.col("parsed"), steps)))
        own = parsed.where(F.col("depth") == depth).drop("depth")
        return traces.join(own, KEY, "left").withColumn("decision", guard(dec, steps)).drop("parsed", "silent", "failed")
    return judge


def rubric_verdicts(rules=("repeat",), **settings):
    """``judge`` by the rubric."""
    audit = rubric_auditor(rules, **settings)

    def judge(traces: DataFrame, depth: int) -> DataFrame:
        return audit(traces, {"steps": "steps", "question": "question", "kept": "kept", "prefix": "prefix", "depth": depth}, "decision")
    return judge


def live_calls(spark, generate, audit, *, template: str | None = None, system_prompt: str | None = None, parallelism: int | None = None,
               call_rows: int | None = 256, mode: str = "auto"):
    """``ask`` and ``judge`` that call a user's model; answers are kept in a ledger as they come and written before anything reads them."""
    ledger = usable_ledger(shared_path(spark, "ledger"))

    def kept(name: str) -> str | None:
        return None if ledger is None else f"{ledger}/{name}"

    def ask(active: DataFrame, depth: int) -> DataFrame:
        requests = completion_requests(active, "prefix", system_prompt)
        said = write_shared(batch_completion(requests, generate, depth, parallelism, kept(f"completions-{depth}"), call_rows), f"completions-{depth}")
        return write_shared(traces_of(said, mode).drop("depth"), f"traces-{depth}")

    def judge(traces: DataFrame, depth: int) -> DataFrame:
        replies = write_shared(user_replies(traces, audit, template, parallelism, key=KEY, ledger=kept(f"replies-{depth}"), call_rows=call_rows), f"replies-{depth}")
        return recorded_audit(traces, replies, keys=(KEY,), out="decision")

    return ask, judge
