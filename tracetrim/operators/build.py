"""End-to-end entry points: build a PT dataset (F7) and evaluate two models (H3/H4).

Both are compositions of the operators; nothing here loops over rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.operators import frontier
from tracetrim.operators import rollout as RO
from tracetrim.operators.evaluate import eval_samples, eval_summary, pair_responses
from tracetrim.operators.frames import keep_where
from tracetrim.sources import pt_io


def build_pt_dataset(questions: DataFrame, *, completions: DataFrame | None = None, replies: DataFrame | None = None,
                     trace_col: str | None = None, max_depth: int = 3, rules=("repeat",), mode: str = "auto",
                     max_samples: int | None = None, split: str = "train", save_path: str | None = None,
                     generator_model: str = "recorded", generate=None, audit=None) -> DataFrame:
    """Questions -> rollout -> transitions with provenance -> PT rows (optionally saved).

    ``questions``: ``question_key, question`` plus optional ``category, dataset, ground_truth``.
    Trace source: ``completions(question_key, depth, text, usage_tokens, error)`` (recorded
    mode), or the callables ``generate`` and ``audit`` (see ``rollout_live``), else ``trace_col`` of
    ``questions`` holding the depth-1 trace text (replay mode).
    Auditor: recorded ``replies(question_key, depth, raw_response)`` when given, else the
    rubric with ``rules``.  Questions that are empty give no rows; a failing record gives
    error rows, never an exception.
    """
    q = questions
    if max_samples is not None:
        q = q.orderBy("question_key").limit(max_samples)
    q = keep_where(q, F.coalesce(F.col("question"), F.lit("")) != "")
    given = {"category": "category", "dataset": "source_dataset", "ground_truth": "ground_truth"}
    keep = [to for c, to in given.items() if c in q.columns]
    base = q.select("question_key", "question", *[F.col(c).alias(to) for c, to in given.items() if c in q.columns],
                    *([trace_col] if completions is None and trace_col else []))
    if completions is not None:
        ro = recorded_rollout(base, completions, replies, max_depth=max_depth, rules=rules, mode=mode, generator_model=generator_model)
    elif generate is not None:
        ro = rollout_live(base, generate, audit, max_depth=max_depth, mode=mode)
    elif trace_col is not None:
        auditor = RO.rubric_auditor(rules)
        if replies is not None:
            base = base.join(RO.gather_replies(replies, "question_key", max_depth, "_replies"), "question_key", "left")
            auditor = RO.recorded_auditor("_replies")
        ro = RO.rollout(base, key="question_key", max_depth=max_depth, auditor=auditor, mode=mode, text_col=trace_col, generator_model=generator_model)
    else:
        raise ValueError("give completions (recorded), generate and audit (live) or trace_col (replay)")
    tr = RO.rollout_transitions(ro, key="question_key", keep=keep)
    pt = pt_io.to_pt_rows(tr, split)
    if save_path:
        pt_io.save_pt(pt, save_path)
    return pt


def recorded_rollout(questions: DataFrame, completions: DataFrame, replies: DataFrame | None = None, *, max_depth: int = 3, rules=("repeat",),
                     mode: str = "auto", generator_model: str = "recorded", by_depth: bool = False) -> DataFrame:
    """F4 over recorded tables: every question is a row, one without a completion stops as ``missing_completion``.

    ``by_depth`` runs a job a depth over a written state (``frontier.py``) in place of one unrolled plan: the form for many
    depths.
    """
    if by_depth:
        judge = frontier.rubric_verdicts(rules) if replies is None else frontier.recorded_verdicts(replies, max_depth)
        return frontier.rollout_by_depth(questions, frontier.recorded_answers(completions, max_depth, mode), judge, max_depth=max_depth,
                                         generator_model=generator_model, decision_model="recorded" if replies is not None else "rubric:" + "+".join(rules))
    base = questions.join(RO.gather_traces(completions, "question_key", max_depth, "_completions", mode), "question_key", "left")
    auditor = RO.rubric_auditor(rules)
    if replies is not None:
        base = base.join(RO.gather_replies(replies, "question_key", max_depth, "_replies"), "question_key", "left")
        auditor = RO.recorded_auditor("_replies")
    return RO.rollout(base, key="question_key", max_depth=max_depth, auditor=auditor, mode=mode, completions_col="_completions",
                      generator_model=generator_model)


def rollout_live(questions: DataFrame, generate, audit, *, max_depth: int = 3, mode: str = "auto", template: str | None = None,
                 system_prompt: str | None = None, parallelism: int | None = None, generator_model: str = "live",
                 call_rows: int | None = 256) -> DataFrame:
    """F4 with user callables, called once a depth for the questions still running: ``generate`` as in
    ``batch_completion``, ``audit`` as in ``user_replies``, each with at most ``call_rows`` rows.

    Answers are kept in a ledger as they come (``ledger.py``) and each depth's are written to the shared folder before
    anything reads them, so no retry or later depth calls again; a call that fails is a row with its error.
    """
    ask, judge = frontier.live_calls(questions.sparkSession, generate, audit, template=template, system_prompt=system_prompt,
                                     parallelism=parallelism, call_rows=call_rows, mode=mode)
    return frontier.rollout_by_depth(questions, ask, judge, max_depth=max_depth, generator_model=generator_model)


def evaluate_models(questions: DataFrame, base: DataFrame, pruned: DataFrame, benchmark_name: str = "custom",
                    max_samples: int | None = None):
    """Pair each question's base and pruned completion, score, and summarise.

    ``questions``: ``question_key, question, ground_truth`` (gold may be null);
    ``base`` / ``pruned``: ``question_key, text, usage_tokens`` and optionally ``error``.  Every
    question is a sample: a missing reply is empty text, a failed one its error's text.
    Returns (samples, summary).
    """
    q = questions
    if max_samples is not None:
        q = q.orderBy("question_key").limit(max_samples)
    pairs = pair_responses(base, pruned, questions=q.select("question_key", "question", "ground_truth"))
    samples = eval_samples(pairs.withColumn("benchmark", F.lit(benchmark_name)))
    return samples, eval_summary(samples)


def inspect_question(rollout_df: DataFrame, key_value, key: str = "question_key"):
    """The single-question view: per-depth log, step roles per depth and the summary line.

    A filter on the key of an existing rollout (pushed to the scan when the key is a
    source column); returns three DataFrames, nothing is collected.
    """
    from tracetrim.operators.reports import rollout_report

    one = rollout_df.where(F.col(key) == F.lit(key_value))
    log = RO.rollout_log(one, key=key)
    roles = log.select(
        key, "depth", F.posexplode_outer("steps").alias("step_idx", "step"),
        F.when(F.col("usable"), F.col("skip_start_idx")).alias("_s"),
        F.when(F.col("usable"), F.col("skip_end_idx")).alias("_e"),
    ).where(F.col("step_idx").isNotNull())
    i, s_, e = F.col("step_idx"), F.col("_s"), F.col("_e")
    roles = roles.select(key, "depth", "step_idx", "step", F.when(s_.isNull(), F.lit("untouched"))
                         .when((s_ <= i) & (i <= e), F.lit("skipped")).when(i == e + 1, F.lit("target"))
                         .when(i < s_, F.lit("useful_prefix")).otherwise(F.lit("untouched")).alias("role"))
    report = rollout_report(RO.rollout_summary(one, key=key))
    return log, roles, report
