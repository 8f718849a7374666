"""Base-vs-pruned evaluation (H2-H4) and the comparison projection.

Input: one row per question with ``ground_truth``, ``base_response``, ``pruned_response``
and optional provider token counts.  Per-sample work is a projection; the summary is
one ``groupBy(benchmark)`` whose partial aggregates are combined map-side, so a huge
benchmark is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.answers import extract_answer
from tracetrim.functions.text import clip_with_ellipsis, col_, py_strip, word_count
from tracetrim.operators.completions import ERROR_PREFIX


def gold_answer(gt) -> Column:
    """H2: extracted answer of the gold text, else the stripped gold; null gold stays null."""
    g = col_(gt)
    return F.when(g.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.nullif(extract_answer(g), F.lit("")), py_strip(g)))


def is_correct(response, gt) -> Column:
    """H2: equal when both the response answer and the gold are non-empty, else false;
    null when there is no gold."""
    ans = extract_answer(response)
    gold = gold_answer(gt)
    both = F.coalesce(ans != "", F.lit(False)) & F.coalesce(gold != "", F.lit(False))
    return F.when(col_(gt).isNull(), F.lit(None).cast("boolean")).when(both, ans == gold).otherwise(F.lit(False))


def tokens_or_words(tokens, text) -> Column:
    """A provider count, or the word count when it is missing or 0."""
    t = col_(tokens)
    return F.when(t.isNull() | (t == 0), word_count(text)).otherwise(t).cast("int")


def eval_samples(df: DataFrame, base_tokens: str | None = "base_usage", pruned_tokens: str | None = "pruned_usage") -> DataFrame:
    """H2/H3: per-question correctness, token counts and savings percent."""
    bt = tokens_or_words(F.col(base_tokens) if base_tokens else F.lit(None), F.col("base_response"))
    pt = tokens_or_words(F.col(pruned_tokens) if pruned_tokens else F.lit(None), F.col("pruned_response"))
    out = df.withColumn("base_tokens", bt).withColumn("pruned_tokens", pt)
    return out.select(
        "*",
        is_correct(F.col("base_response"), F.col("ground_truth")).alias("base_correct"),
        is_correct(F.col("pruned_response"), F.col("ground_truth")).alias("pruned_correct"),
        ((F.col("base_tokens") - F.col("pruned_tokens")) / F.greatest(F.col("base_tokens"), F.lit(1)) * 100.0).alias("token_savings_pct"),
    )


def pair_responses(base: DataFrame, pruned: DataFrame, key: str = "question_key", questions: DataFrame | None = None) -> DataFrame:
    """H3: one response per model per question, joined to the questions (or, without them, to
    each other): a side that has no response gives empty text and no tokens.

    Each side is first reduced to one response per key (deterministic max, combined
    map-side), so duplicated responses for one question neither multiply rows in the
    join nor gather in one task; ``base_records`` / ``pruned_records`` say how many there were.
    A response with an ``error`` counts as that error's text with no tokens."""
    def one(df, side):
        failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
        error = F.concat(F.lit(ERROR_PREFIX), F.col("error")) if "error" in df.columns else F.lit(None).cast("string")
        text = F.when(failed, error).otherwise(F.coalesce(F.col("text"), F.lit("")))
        r = df.groupBy(key).agg(F.max(F.struct(text.alias("t"), F.when(~failed, F.col("usage_tokens")).alias("u"))).alias("_r"), F.count(F.lit(1)).alias("_n"))
        return r.select(key, F.col("_r.t").alias(f"{side}_response"), F.col("_r.u").alias(f"{side}_usage"), F.col("_n").alias(f"{side}_records"))
    b, p = one(base, "base"), one(pruned, "pruned")
    pairs = b.join(p, key, "full") if questions is None else questions.join(b, key, "left").join(p, key, "left")
    fill = {f"{s}_response": F.coalesce(F.col(f"{s}_response"), F.lit("")) for s in ("base", "pruned")}
    fill |= {f"{s}_records": F.coalesce(F.col(f"{s}_records"), F.lit(0)) for s in ("base", "pruned")}
    return pairs.withColumns(fill)


def eval_summary(samples: DataFrame, benchmark: str = "benchmark") -> DataFrame:
    """H4: n, mean tokens, reduction from the means, accuracies (null without any gold), delta."""
    n = F.count(F.lit(1))
    has_gt = F.max(F.col("ground_truth").isNotNull().cast("int")) == 1
    base_avg = F.sum("base_tokens") / F.greatest(n, F.lit(1))
    pruned_avg = F.sum("pruned_tokens") / F.greatest(n, F.lit(1))
    base_acc = F.when(has_gt & (n > 0), F.count_if(F.col("base_correct")) / n)
    pruned_acc = F.when(has_gt & (n > 0), F.count_if(F.col("pruned_correct")) / n)
    agg = samples.groupBy(benchmark).agg(
        n.alias("num_samples"), base_avg.alias("base_avg_tokens"), pruned_avg.alias("pruned_avg_tokens"),
        base_acc.alias("base_accuracy"), pruned_acc.alias("pruned_accuracy"))
    return agg.select(
        "*",
        ((F.col("base_avg_tokens") - F.col("pruned_avg_tokens")) / F.greatest(F.col("base_avg_tokens"), F.lit(1)) * 100.0)
        .alias("avg_token_reduction_pct"),
        (F.col("pruned_accuracy") - F.col("base_accuracy")).alias("accuracy_delta"),
    )


def comparison_rows(samples: DataFrame) -> DataFrame:
    """Tokens default to word counts, savings to (1 - p / max(b, 1)) * 100, 300-char
    previews and a 60-char title."""
    cols = set(samples.columns)
    bt = F.coalesce(F.col("base_tokens"), word_count(F.col("base_response"))) if "base_tokens" in cols else word_count(F.col("base_response"))
    pt = F.coalesce(F.col("pruned_tokens"), word_count(F.col("pruned_response"))) if "pruned_tokens" in cols else word_count(F.col("pruned_response"))
    df = samples.withColumn("_bt", bt).withColumn("_pt", pt)
    default_sav = (F.lit(1.0) - F.col("_pt") / F.greatest(F.col("_bt"), F.lit(1))) * 100.0
    sav = F.coalesce(F.col("token_savings_pct"), default_sav) if "token_savings_pct" in cols else default_sav
    return df.select(
        "question_key",
        F.concat(F.lit("Question: "), F.substring(F.coalesce(F.col("question"), F.lit("")), 1, 60), F.lit("...")).alias("title"),
        clip_with_ellipsis(F.col("base_response"), 300).alias("base_preview"),
        clip_with_ellipsis(F.col("pruned_response"), 300).alias("pruned_preview"),
        F.col("_bt").cast("int").alias("base_tokens"), F.col("_pt").cast("int").alias("pruned_tokens"),
        sav.alias("token_savings_pct"),
    )


def tenths(c: Column) -> Column:
    """A number rounded half-even to one place, ready for ``%.1f``: the text never depends on how an engine prints a tie."""
    return F.bround(c, 1)


def eval_card(summary: DataFrame) -> DataFrame:
    """The printed numbers (%.1f, "N/A" for null accuracies, signed delta)."""
    def pct(c):
        return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f%%", tenths(c * 100.0)))
    return summary.select(
        "benchmark", "num_samples",
        pct(F.col("base_accuracy")).alias("base_accuracy_text"),
        pct(F.col("pruned_accuracy")).alias("pruned_accuracy_text"),
        F.when(F.col("accuracy_delta").isNull(), F.lit("N/A"))
         .otherwise(F.format_string("%+.1f%%", tenths(F.col("accuracy_delta") * 100.0))).alias("accuracy_delta_text"),
        F.format_string("%.1f", tenths(F.col("base_avg_tokens"))).alias("base_avg_tokens_text"),
        F.format_string("%.1f", tenths(F.col("pruned_avg_tokens"))).alias("pruned_avg_tokens_text"),
        F.format_string("%.1f%%", tenths(F.col("avg_token_reduction_pct"))).alias("token_reduction_text"),
    )
