"""Views derived from the driver tables, shaped like the toolkit's inputs.

The prose tables carry no numbered steps, paragraphs, recorded replies or answers, so
these views derive them deterministically (the same statements exist as DuckDB SQL in
``tracetrim.plans.oracle``).  They are plain projections / one window, so their work
grows with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetrim.operators.ordering import next_within, rank_within
from tracetrim.sources.tables import read_table

FENCE = "`" * 3


def turn_key(conv="conv_id", turn="turn") -> F.Column:
    """A key of a conversation's turn that never collides and sorts like (conversation, turn) for ids from 0 on."""
    return F.concat(id_key(conv), F.lit("-"), id_key(turn))


def id_key(c) -> F.Column:
    """An id as text of fixed width, so that keys of different sources can stand in one column."""
    return F.lpad(F.col(c).cast("string"), 19, "0")


def v_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user turn, following assistant turn) pairs as question -> trace text.

    The "next turn" is a join on global position + 1 (``next_within``), not a
    per-conversation window, so one huge conversation is not sorted in one task.  Rows are numbered
    themselves, not by (conversation, turn), so a repeated turn neither multiplies nor vanishes.
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    z = next_within(conv, "conv_id", ["turn", "role", "text"], ["text"], this=F.col("role") == "user", following=F.col("role") == "assistant")
    return z.select(turn_key().alias("trace_id"), F.col("text").alias("question"), F.col("next_text").alias("full_text"))


def v_doc_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("trace_id"),
        F.concat(F.lit("Summarise document "), F.col("doc_id").cast("string"), F.lit(" from "), F.col("source")).alias("question"),
        F.col("text").alias("full_text"),
        F.col("lang").alias("category"),
        F.col("source").alias("source_dataset"),
        gold_case(F.col("doc_id")).alias("ground_truth"),
        F.col("n_chars"),
    )


def gold_case(d) -> F.Column:
    """A gold answer for a document: a number, for some a letter or nothing."""
    return (F.when(d % 10 == 9, F.lit(None).cast("string")).when(d % 10 == 8, F.lit("B"))
            .otherwise(F.concat(F.lit("#### "), (d * 7).cast("string"))))


# The twelve forms of a recorded auditor reply, chosen by id % 12.  Each holds the audited text:
# "inside" as an escaped JSON string between the two parts, "before" or "after" them as it is.
REPLY_CASES = [
    ("inside", FENCE + "json\n" + '{"can_skip": true, "skip_start_idx": 1, "skip_end_idx": 2, "reason": ', "}\n" + FENCE),
    ("after", 'Verdict: {"can_skip": true, "skip_start_idx": 0, "skip_end_idx": 0, "reason": "preamble"} ', ""),
    ("inside", '{"can_skip": false, "reason": ', "}"),
    ("before", "", '\n{"can_skip": false}'),
    ("inside", '{"can_skip": true, "skip_start_idx": 9999, "reason": ', "}"),
    ("before", "", '\n{"can_skip": true, "skip_start_idx": 3, "skip_end_idx": 1, "reason": "end before start"}'),
    ("inside", '{"can_skip": true, "skip_start_idx": "2", "reason": ', "}"),
    ("inside", '{"can_skip": "false", "skip_start_idx": 2.7, "reason": ', "}"),
    ("before", "", '\n{"can_skip": true, "skip_start_idx": 1, "skip_end_idx": null}'),
    ("after", "I believe it is true that step 1 can go\n", ""),
    ("after", "false, although one might say true: ", ""),
    ("after", '{"can_skip": true, "meta": {"a": 1}, "skip_start_idx": 1}\n', ""),
]
# Replies at the edges of JSON, chosen by id % 4: repeated keys, an index beyond 64 bits, not-a-number twice.
EDGE_CASES = [
    ("inside", '{"can_skip": false, "can_skip": true, "skip_start_idx": 7, "skip_start_idx": 1, "reason": ', "}"),
    ("inside", '{"can_skip": true, "skip_start_idx": 123456789012345678901, "reason": ', "}"),
    ("inside", '{"can_skip": NaN, "skip_start_idx": 1, "reason": ', "}"),
    ("inside", '{"can_skip": true, "skip_start_idx": -Infinity, "reason": ', "}"),
]


def reply_case(number, text, cases=REPLY_CASES) -> F.Column:
    """The reply form ``number % len(cases)`` around ``text``."""
    body = F.coalesce(text, F.lit(""))
    quoted = F.to_json(F.array(body))
    k = (F.pmod(number, F.lit(len(cases))) + 1).cast("int")
    inside = k.isin(*[i + 1 for i, (how, _, _) in enumerate(cases) if how == "inside"])
    part = lambda at: F.element_at(F.array(*[F.lit(case[at]) for case in cases]), k)
    return F.concat(part(1), F.when(inside, F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(body), part(2))


def v_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("trace_id"), reply_case(F.col("doc_id"), F.col("text")).alias("raw_response"))


def v_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns numbered per conversation (depth), with derived usage and errors.
    The numbering is ``rank_within`` (global positions), not a per-conversation window; a repeated turn has a depth of its own."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where(F.col("role") == "assistant")
    a = rank_within(conv, "conv_id", ["turn", "text"], "_rank")
    return a.select(
        F.col("conv_id").alias("question_key"),
        F.col("_rank").cast("int").alias("depth"),
        "text",
        F.when(F.col("conv_id") % 3 == 0, F.lit(None).cast("int"))
        .otherwise(F.floor(F.length("text") / 4.0).cast("int")).alias("usage_tokens"),
        F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, F.lit("timeout")).alias("error"),
    )


def v_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    nl = F.lit("\n")
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Step 1: Take "), F.col("p_name"), F.lit("."), nl, F.lit("Step 2: Check size "), size,
                                F.lit(". Then stop."), nl, F.lit("3) Done.")))
        .when(k == 1, F.concat(F.lit("Plan for "), F.col("p_name"), F.lit("."), nl, nl, F.lit("The brand is "), F.col("p_brand"),
                               F.lit(". Fine."), nl, nl, F.lit("Finished.")))
        .when(k == 2, F.concat(F.lit("1. only one marker "), F.col("p_name"), F.lit(". Size is "), size,
                               F.lit('.5 units. next is lower. "Quoted" end!')))
        .otherwise(F.concat(F.lit("  "), F.col("p_name"), nl, F.col("p_brand"), nl, nl, F.lit("  ")))
    )
    return part.select(F.col("p_partkey").alias("text_id"), text.alias("text"))


def v_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        id_key("p_partkey").alias("item_id"),
        F.col("p_name").alias("question"),
        F.struct(
            F.array(F.lit("A"), F.lit("B"), F.lit("C")).alias("label"),
            F.array(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("text"),
        ).alias("choices"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("answerKey"),
    )


def v_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        id_key("doc_id").alias("item_id"),
        F.col("text").alias("context"),
        F.lit("Which language is this?").alias("question"),
        F.col("lang").alias("answer"),
    )


def v_responses(rolled: DataFrame) -> DataFrame:
    """Gold and two models' replies per document of a rollout over ``v_doc_traces``: the base reply is the
    whole text, the pruned one what the rollout left of it; each ends in one of several answer forms."""
    d, text = F.col("trace_id"), F.col("full_text")
    left = F.array_join("final_steps", " ")
    ans = (d * 7).cast("string")
    base = (
        F.when(d % 5 == 0, F.concat(text, F.lit(" #### "), ans))
        .when(d % 5 == 1, F.concat(text, F.lit(" so \\boxed{"), ans, F.lit("}")))
        .when(d % 5 == 2, F.concat(text, F.lit(" The answer is "), ans, F.lit(".")))
        .when(d % 5 == 3, F.concat(text, F.lit(" giving 12 then "), ans))
        .otherwise(text)
    )
    pruned = (
        F.when(d % 3 == 0, F.concat(left, F.lit(" Final answer: "), ans))
        .when(d % 3 == 1, F.concat(left, F.lit(" #### 1,"), (F.lit(100) + d % 900).cast("string")))
        .otherwise(left)
    )
    return rolled.select(
        d.alias("question_key"),
        F.col("source_dataset").alias("benchmark"),
        "question",
        "ground_truth",
        base.alias("base_response"),
        pruned.alias("pruned_response"),
        F.when(d % 6 == 0, F.lit(0)).otherwise(F.floor(F.col("n_chars") / 4.0).cast("int")).alias("base_usage"),
        F.when(d % 4 == 0, F.lit(0)).otherwise(F.floor(F.col("n_chars") / 9.0).cast("int")).alias("pruned_usage"),
    )


def v_rollout_replies(completions: DataFrame) -> DataFrame:
    """Recorded auditor replies for every recorded completion, keyed (question_key, depth)."""
    return completions.select("question_key", "depth",
                              reply_case(F.col("question_key") + F.col("depth"), F.col("text")).alias("raw_response"))
