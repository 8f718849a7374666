"""Transition pairs (F1), example ids (F2) and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.text import col_, py_strip
from tracetrim.operators.audit import next_step, skipped_steps, usable
from tracetrim.operators.frames import keep_where


def full_prefix(prefix, steps, dec: Column) -> Column:
    """Prior prefix plus the steps before the skipped span, blank parts left out."""
    useful = py_strip(F.array_join(F.slice(col_(steps), 1, F.greatest(dec["skip_start_idx"], F.lit(0))), " "))
    p = py_strip(F.coalesce(col_(prefix), F.lit("")))
    return F.when((p != "") & (useful != ""), F.concat(p, F.lit(" "), useful)).when(p != "", p).otherwise(useful)


def input_x(question, prefix, steps, dec: Column) -> Column:
    fp = full_prefix(prefix, steps, dec)
    q = F.coalesce(col_(question), F.lit(""))
    return F.when(fp != "", py_strip(F.concat(q, F.lit("\n"), fp))).otherwise(q)


def example_id(question, depth) -> Column:
    """``trans_`` + first 12 characters of the question (stripped, spaces -> _) + ``_d{depth}``."""
    head = F.replace(py_strip(F.substring(F.coalesce(col_(question), F.lit("")), 1, 12)), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("trans_"), head, F.lit("_d"), col_(depth).cast("string"))


def example_key(question, depth) -> Column:
    """A collision-free key (the reference id collides for questions sharing 12 leading chars)."""
    return F.sha2(F.concat_ws("\u001f", F.coalesce(col_(question), F.lit("")), col_(depth).cast("string")), 256)


def transition_columns(question, prefix, steps, dec: Column, depth, generator_model=None, decision_model=None) -> list:
    """F1 as a list of columns (only meaningful where ``usable(dec)``)."""
    return [
        example_id(question, depth).alias("id"),
        col_(question).alias("question"),
        input_x(question, prefix, steps, dec).alias("input_x"),
        next_step(dec, steps).alias("target_y"),
        col_(depth).cast("int").alias("depth"),
        skipped_steps(dec, steps).alias("skipped_steps"),
        dec["reason"].alias("skip_reason"),
        (col_(generator_model) if generator_model is not None else F.lit("")).alias("generator_model"),
        (col_(decision_model) if decision_model is not None else F.lit("")).alias("decision_model"),
        dec["skip_start_idx"].alias("skip_start_idx"),
        dec["skip_end_idx"].alias("skip_end_idx"),
        F.size(col_(steps)).alias("original_step_count"),
    ]


def extract_transitions(df: DataFrame, dec_col: str = "decision", question="question", prefix="prefix", steps="steps",
                        depth=None, keep=()) -> DataFrame:
    """F1 over a table of (trace, decision): one row per usable decision."""
    dec = F.col(dec_col)
    d = depth if depth is not None else F.lit(1)
    return keep_where(df, usable(dec)).select(*keep, *transition_columns(question, prefix, steps, dec, d))


def add_provenance(transitions: DataFrame, questions: DataFrame, key: str = "question_key") -> DataFrame:
    """copy category, dataset (as source_dataset) and ground_truth from the question row.

    For transitions whose questions live in another table; a rollout carries its questions'
    columns itself (``rollout_transitions(keep=...)``).  The question side is reduced to one row
    for each key first, so a repeated key multiplies no transition.
    """
    cols = set(questions.columns)
    q = questions.select(
        key,
        (F.col("category") if "category" in cols else F.lit(None).cast("string")).alias("category"),
        (F.col("dataset") if "dataset" in cols else F.lit(None).cast("string")).alias("source_dataset"),
        (F.col("ground_truth") if "ground_truth" in cols else F.lit(None).cast("string")).alias("ground_truth"),
    )
    fields = ("category", "source_dataset", "ground_truth")
    one = q.groupBy(key).agg(F.max(F.struct(*fields)).alias("_q")).select(key, *[F.col(f"_q.{c}").alias(c) for c in fields])
    return transitions.join(one, key, "left")
