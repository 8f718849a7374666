"""Multi-depth pruning rollout (F4), per-depth log (F6), summary (F5) and failure rows (F8).

Per question: trace at the current prefix -> audit -> emit a transition -> keep the
steps before the span plus the target -> extend the prefix -> next depth, until no
usable skip, the target was the last step, or ``max_depth``.

The depth loop is unrolled into columns (``max_depth`` is a small parameter), so the
whole rollout is row-local: one scan of the traces and no shuffle in replay mode.  In
recorded mode the completions (and replies) are first gathered per question into a
depth -> record map by one aggregation that combines map-side (at most ``max_depth``
records per question leave each task), then joined once to the questions.  The PT
dataset build (F7) on top of this is ``tracetrim.operators.build``.

Trace sources per depth:
* replay    the continuation is the rest of the recorded trace after the kept target;
* recorded  a ``completions(question_key, depth, text, usage_tokens, error)`` table.
Auditors: the rubric (``rubric_auditor``) or recorded replies (``recorded_auditor``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetrim.functions.segment import segment
from tracetrim.functions.text import py_strip, word_count
from tracetrim.functions.reply import MISSING_REPLY_REASON, with_parsed_reply
from tracetrim.operators.audit import CALL_ERROR, guard, next_step, no_skip, skipped_steps, usable, validate, with_reply_decision
from tracetrim.operators.completions import ERROR_PREFIX
from tracetrim.operators.rubric import with_rubric_decision
from tracetrim.operators.transitions import example_id, input_x

def rubric_auditor(rules=("repeat",), overlap_pct: int = 80, restate_pct: int = 60):
    """Auditor = f(df, ctx, out) -> df with decision column ``out``."""
    def audit(df: DataFrame, ctx: dict, out: str) -> DataFrame:
        return with_rubric_decision(df, ctx["steps"], ctx["question"], ctx["kept"], rules, overlap_pct, restate_pct, out)
    audit.model = "rubric:" + "+".join(rules)
    return audit


def recorded_auditor(replies_col: str = "_replies", model: str = "recorded"):
    """Replies gathered per question by depth: either already parsed (``gather_replies``:
    MAP<INT, STRUCT<raw_null, parsed>>, only validation runs per depth) or raw text
    (MAP<INT, STRING>, parsed per depth)."""
    def audit(df: DataFrame, ctx: dict, out: str) -> DataFrame:
        rec = f"_{out}_rec"
        df = df.withColumn(rec, F.try_element_at(F.col(replies_col), F.lit(ctx["depth"])))
        vt = df.schema[replies_col].dataType.valueType
        if isinstance(vt, T.StructType) and "parsed" in vt.fieldNames():
            steps = F.col(ctx["steps"])
            r = F.col(rec)
            d = F.when(r.isNull() | r["raw_null"], no_skip(MISSING_REPLY_REASON, "missing")).otherwise(validate(r["parsed"], steps))
            return df.withColumn(out, guard(d, steps)).drop(rec)
        return with_reply_decision(df, rec, ctx["steps"], out).drop(rec)
    audit.model = model
    return audit


def completion_trace(rec: Column, mode: str = "auto") -> dict:
    """A recorded completion -> full text, token count, error flag, steps."""
    is_err = rec["error"].isNotNull()
    text = F.when(is_err, F.concat(F.lit(ERROR_PREFIX), rec["error"])).otherwise(F.coalesce(rec["text"], F.lit("")))
    tokens = F.when(is_err, F.lit(0)).otherwise(F.coalesce(rec["usage_tokens"], word_count(rec["text"])))
    return {"full_text": text, "token_count": tokens.cast("int"), "is_error": is_err, "steps": segment(text, mode)}


def gather_by_depth(df: DataFrame, key: str, max_depth: int, value_cols, out: str) -> DataFrame:
    """One row per key with MAP<depth, STRUCT<value_cols>> in a single aggregation.

    Rows past ``max_depth`` are dropped before the shuffle.  Each depth is its own
    ``max(when(depth = d, record))`` column, which combines map-side: a key holding a
    third of all rows still ships at most ``max_depth`` records per task, and
    duplicates of one (key, depth) reduce to one deterministic record.
    """
    vals = F.struct(*value_cols) if len(value_cols) > 1 else F.col(value_cols[0])
    rows = df.where(F.col("depth").between(1, max_depth))
    per_depth = [F.max(F.when(F.col("depth") == d, vals)).alias(f"_g{d}") for d in range(1, max_depth + 1)]
    agg = rows.groupBy(key).agg(*per_depth)
    entries = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"_g{d}").alias("v")) for d in range(1, max_depth + 1)])
    return agg.select(key, F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias(out))


def gather_traces(completions: DataFrame, key: str, max_depth: int, out: str, mode: str = "auto") -> DataFrame:
    """D1/D2 once per completion record (long form, one row per key x depth), then one
    row per key with MAP<depth, STRUCT<full_text, token_count, is_error, steps>>."""
    rows = completions.where(F.col("depth").between(1, max_depth))
    t = completion_trace(F.struct("text", "usage_tokens", "error"), mode)
    rows = rows.select(key, "depth", t["full_text"].alias("full_text"), t["token_count"].alias("token_count"),
                       t["is_error"].alias("is_error"), t["steps"].alias("steps"))
    return gather_by_depth(rows, key, max_depth, ["full_text", "token_count", "is_error", "steps"], out)


def gather_replies(replies: DataFrame, key: str, max_depth: int, out: str, raw_col: str = "raw_response") -> DataFrame:
    """E1-E3 once per reply record (long form), then one row per key with
    MAP<depth, STRUCT<raw_null, parsed>>; only span validation is left per depth."""
    rows = with_parsed_reply(replies.where(F.col("depth").between(1, max_depth)), raw_col, "parsed")
    failed = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    p = F.col("parsed")
    call = F.struct(F.lit("error").alias("parse_status"), F.lit(False).alias("can_skip"), p["skip_start_idx"].alias("skip_start_idx"),
                    p["skip_end_idx"].alias("skip_end_idx"), F.concat(F.lit(CALL_ERROR), failed).alias("reason"))
    rows = rows.withColumn("parsed", F.when(failed.isNotNull(), call).otherwise(p))
    rows = rows.select(key, "depth", (F.col(raw_col).isNull() & failed.isNull()).alias("raw_null"), "parsed")
    return gather_by_depth(rows, key, max_depth, ["raw_null", "parsed"], out)


def rollout(traces: DataFrame, *, key: str = "trace_id", question: str = "question", max_depth: int = 3,
            auditor=None, mode: str = "auto", steps_col: str | None = None, text_col: str = "full_text",
            completions_col: str | None = None, generator_model: str = "recorded", log_fields=None) -> DataFrame:
    """Run the rollout; returns one row per question with per-depth log structs and the final state.

    Replay mode: ``traces`` holds the depth-1 trace (``steps_col`` or ``text_col``).
    Recorded mode: ``completions_col`` names a MAP<INT, STRUCT<text, usage_tokens, error>>.
    ``log_fields``: the per-depth fields to build (default all); a count needs no prefixes or texts.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be >= 1")
    auditor = auditor or rubric_auditor()
    q = F.col(question)
    df = traces
    prebuilt = False
    if completions_col is not None:
        vt = df.schema[completions_col].dataType.valueType
        prebuilt = isinstance(vt, T.StructType) and "steps" in vt.fieldNames()
    if completions_col is None:
        first = F.col(steps_col) if steps_col else segment(text_col, mode)
        df = df.withColumn("_rem", first)
    df = df.withColumns({"_kept": F.array().cast("array<string>"), "_prefix": F.lit(""), "_active": F.lit(True),
                         "_stop": F.lit(None).cast("string")})

    for d in range(1, max_depth + 1):
        if completions_col is None:
            df = df.withColumn(f"_t{d}", F.struct(F.col("_rem").alias("steps"), F.lit(None).cast("string").alias("full_text"),
                                                  F.lit(None).cast("int").alias("token_count"), F.lit(False).alias("is_error")))
        else:
            rec = F.try_element_at(F.col(completions_col), F.lit(d))
            if prebuilt:
                t = {"steps": rec["steps"], "full_text": rec["full_text"], "token_count": rec["token_count"],
                     "is_error": rec["is_error"]}
            else:
                t = completion_trace(rec, mode)
            # rows that already stopped never look at later completions
            df = df.withColumn(f"_t{d}", F.when(rec.isNull() | ~F.col("_active"), F.lit(None)).otherwise(F.struct(
                t["steps"].alias("steps"), t["full_text"].alias("full_text"),
                t["token_count"].alias("token_count"), t["is_error"].alias("is_error"))))
        empty = F.array().cast("array<string>")
        # stopped rows audit nothing: empty steps and no prior (their kept list is final)
        df = df.withColumns({"_steps": F.when(F.col("_active"), F.col(f"_t{d}.steps")).otherwise(empty),
                             "_prior": F.when(F.col("_active"), F.col("_kept")).otherwise(empty)})
        steps = F.col("_steps")
        missing = F.col(f"_t{d}").isNull()
        ctx = {"steps": "_steps", "question": question, "kept": "_prior", "prefix": "_prefix", "depth": d}
        df = auditor(df, ctx, "_dec")
        dec = F.col("_dec")
        n = F.size(steps)
        df = df.withColumns({"_ok": usable(dec), "_nxt": next_step(dec, steps), "_live": F.col("_active") & ~missing})
        ok, nxt, live = F.col("_ok"), F.col("_nxt"), F.col("_live")
        kept_pre = F.slice(steps, 1, F.greatest(dec["skip_start_idx"], F.lit(0)))
        ends_here = (dec["skip_end_idx"] + 1) >= (n - 1)
        stop_now = (F.when(~ok, F.lit("no_skip")).when(ends_here, F.lit("end_of_trace"))
                    .when(F.lit(d) == max_depth, F.lit("max_depth")))
        fields = {
            "depth": F.lit(d), "n_steps": n, "steps": steps, "prefix": F.col("_prefix"),
            "full_text": F.col(f"_t{d}.full_text"), "token_count": F.col(f"_t{d}.token_count"), "is_error": F.col(f"_t{d}.is_error"),
            **{c: dec[c] for c in ("can_skip", "skip_start_idx", "skip_end_idx", "reason", "outcome")},
            "usable": ok, "skipped_steps": skipped_steps(dec, steps), "next_step": nxt,
            "input_x": F.when(ok, input_x(q, F.col("_prefix"), steps, dec)),
        }
        log = F.when(live, F.struct(*[c.alias(name) for name, c in fields.items() if log_fields is None or name in log_fields]))
        # one projection for everything that only needs this depth's decision
        df = df.withColumns({
            "_keptnow": F.when(nxt != "", F.concat(kept_pre, F.array(nxt))).otherwise(kept_pre),
            f"_log{d}": log,
            "_stopnow": stop_now,
        })
        kept_now = F.col("_keptnow")
        ctx_text = py_strip(F.array_join(kept_now, " "))
        new_prefix = F.when(F.col("_prefix") != "", py_strip(F.concat(F.col("_prefix"), F.lit(" "), ctx_text))).otherwise(ctx_text)
        scratch = {"_steps", "_prior", "_dec", "_ok", "_nxt", "_live", "_keptnow", "_stopnow", f"_t{d}",
                   "_kept", "_prefix", "_rem", "_stop", "_active"}
        df = df.select(
            *[c for c in df.columns if c not in scratch],
            F.when(live & ok, F.concat(F.col("_kept"), kept_now))
             .when(live, F.concat(F.col("_kept"), steps)).otherwise(F.col("_kept")).alias("_kept"),
            F.when(live & ok, new_prefix).otherwise(F.col("_prefix")).alias("_prefix"),
            F.when(live & ok, F.slice(steps, dec["skip_end_idx"] + 3, F.greatest(n, F.lit(1))))
             .otherwise(F.array().cast("array<string>")).alias("_rem"),
            F.when(F.col("_active") & missing, F.lit("missing_completion"))
             .when(live, F.col("_stopnow")).otherwise(F.col("_stop")).alias("_stop"),
            (live & F.col("_stopnow").isNull()).alias("_active"),
        )

    logs = F.filter(F.array(*[F.col(f"_log{d}") for d in range(1, max_depth + 1)]), lambda x: x.isNotNull())
    drop = [c for c in df.columns if c.startswith("_") and c not in ("_kept", "_stop", "_prefix")]
    return (df.withColumn("_logs", logs).drop(*drop)
              .withColumnRenamed("_kept", "final_steps").withColumnRenamed("_stop", "stopped_by").withColumnRenamed("_prefix", "next_prefix")
              .withColumnRenamed("_logs", "log")
              .withColumn("decision_model", F.lit(getattr(auditor, "model", "custom")))
              .withColumn("generator_model", F.lit(generator_model)))


def _inline_log(df: DataFrame) -> DataFrame:
    """``inline_outer`` + null filter instead of ``inline``: the optimizer infers a
    ``size(log) > 0`` filter for ``inline`` and pushes it below the projections, which
    would inline (and so recompute) the whole unrolled rollout inside that filter."""
    keep = [c for c in df.columns if c != "log"]
    return df.select(*keep, F.inline_outer("log")).where(F.col("depth").isNotNull())


def rollout_log(ro: DataFrame, key: str = "trace_id") -> DataFrame:
    """one row per question x depth that ran."""
    return _inline_log(ro.select(key, "question", "log"))


def usable_depths(ro: DataFrame, keep=()) -> DataFrame:
    """One row for each usable decision with whatever fields the log holds and the ``keep`` columns."""
    return _inline_log(ro.select(*keep, "log")).where(F.col("usable"))


def rollout_transitions(ro: DataFrame, key: str = "trace_id", keep=()) -> DataFrame:
    """F1 over the rollout: one row per usable decision, the PT dataset shape."""
    lg = _inline_log(ro.select(key, "question", "generator_model", "decision_model", *keep, "log")).where(F.col("usable"))
    return lg.select(
        key, *keep,
        example_id(F.col("question"), F.col("depth")).alias("id"),
        "question", "input_x", F.col("next_step").alias("target_y"), F.col("depth").cast("int").alias("depth"),
        "skipped_steps", F.col("reason").alias("skip_reason"), "generator_model", "decision_model",
        "skip_start_idx", "skip_end_idx", F.col("n_steps").alias("original_step_count"),
    )


def rollout_summary(ro: DataFrame, key: str = "trace_id") -> DataFrame:
    """original and final step counts, compression ratio, final text; no shuffle."""
    orig = F.coalesce(F.try_element_at(F.col("log"), F.lit(1))["n_steps"], F.lit(0))
    final = F.size("final_steps")
    ratio = F.greatest(F.lit(0.0), F.lit(1.0) - final / F.greatest(orig, F.lit(1)))
    return ro.select(
        key, "question",
        orig.cast("int").alias("original_step_count"),
        final.cast("int").alias("final_step_count"),
        ratio.alias("compression_ratio"),
        F.array_join("final_steps", " ").alias("final_pruned_trace"),
        F.size("log").alias("depths_run"),
        F.size(F.filter("log", lambda x: x["usable"])).alias("n_transitions"),
        "stopped_by",
        F.exists("log", lambda x: F.coalesce(x["is_error"], F.lit(False))).alias("had_error"),
    )
