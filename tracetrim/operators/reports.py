"""Step roles (G1) and dataset validation / reports.

All reports are aggregations whose outputs are bounded by the number of groups
(categories, depths); nothing is collected per row to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetrim.functions.text import clip_with_ellipsis

# The columns a PT dataset must have and their types.
REQUIRED_COLUMNS = [
    ("id", "string"), ("question", "string"), ("input_x", "string"), ("target_y", "string"), ("depth", "int"),
    ("skipped_steps", "array<string>"), ("skip_reason", "string"), ("metadata", "struct"),
]


def step_roles(df: DataFrame, key: str = "trace_id", steps: str = "steps", dec: str = "decision") -> DataFrame:
    """G1: one row per step with role skipped / target / useful_prefix / untouched."""
    d = F.col(dec)
    ex = df.select(key, d.alias("_d"), F.posexplode_outer(steps).alias("step_idx", "step")).where(F.col("step_idx").isNotNull())
    ok = F.col("_d.can_skip")
    s, e, i = F.col("_d.skip_start_idx"), F.col("_d.skip_end_idx"), F.col("step_idx")
    role = (F.when(ok & (s <= i) & (i <= e), F.lit("skipped"))
            .when(ok & (i == e + 1), F.lit("target"))
            .when(ok & (i < s), F.lit("useful_prefix"))
            .otherwise(F.lit("untouched")))
    return ex.select(key, "step_idx", "step", role.alias("role"))


def role_counts(roles: DataFrame) -> DataFrame:
    """G1 counts: steps per role (partial aggregation; four groups at most)."""
    return roles.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def schema_check(df: DataFrame) -> DataFrame:
    """Per required column of a dataset: present, type as required, rows and nulls (one aggregate over the data)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    ok = {name: name in types and (isinstance(types[name], T.StructType) if kind == "struct" else types[name].simpleString() == kind)
          for name, kind in REQUIRED_COLUMNS}
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        (F.count_if(F.col(name).isNull()) if name in types else F.lit(None).cast("long")).alias(f"_{name}") for name, _ in REQUIRED_COLUMNS])
    rows = F.array(*[F.struct(
        F.lit(name).alias("column"), F.lit(name in types).alias("present"), F.lit(ok[name]).alias("type_ok"),
        F.lit(types[name].typeName() if name in types else None).cast("string").alias("type"),
        F.col("n_rows"), F.col(f"_{name}").alias("n_null")) for name, _ in REQUIRED_COLUMNS])
    return counts.select(F.inline(rows))


def content_check(df: DataFrame) -> DataFrame:
    """Counts of empty inputs / targets (one pass, partial aggregation)."""
    empty_x = F.coalesce(F.col("input_x"), F.lit("")) == ""
    empty_y = F.coalesce(F.col("target_y"), F.lit("")) == ""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(empty_x).alias("empty_input_x"),
        F.count_if(empty_y).alias("empty_target_y"),
        F.count_if(~empty_x & ~empty_y).alias("valid_rows"),
    )


def quarantine(df: DataFrame):
    """Split into (valid, quarantined) by the content rule."""
    ok = (F.coalesce(F.col("input_x"), F.lit("")) != "") & (F.coalesce(F.col("target_y"), F.lit("")) != "")
    return df.where(ok), df.where(~ok)


def category_counts(df: DataFrame, category_col: str = "category") -> DataFrame:
    """Transitions per category ("Unknown" when missing), most frequent first."""
    cat = F.coalesce(F.col(category_col), F.lit("Unknown"))
    return df.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def depth_counts(df: DataFrame) -> DataFrame:
    """I4: transitions per depth, by depth."""
    return df.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).orderBy("depth")


def dataset_card(df: DataFrame, generator_model: str | None = None, decision_model: str | None = None) -> DataFrame:
    """Total, model names ("N/A" when blank) and the markdown depth table; the table
    is built from the per-depth counts (one row per depth)."""
    if "depth" in df.columns:
        return card_of(df.groupBy("depth").agg(F.count(F.lit(1)).alias("n")), generator_model, decision_model)
    card = df.agg(F.count(F.lit(1)).alias("total")).select("total", F.format_string("| All | %d |", F.col("total")).alias("depth_table"))
    return _with_models(card, generator_model, decision_model)


def card_of(per: DataFrame, generator_model: str | None = None, decision_model: str | None = None) -> DataFrame:
    """I5 from the counts per depth (``depth``, ``n``)."""
    card = per.agg(
        F.sum("n").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "n"))),
                                 lambda r: F.format_string("| Depth %d | %d |", r["depth"], r["n"])), "\n").alias("depth_table"))
    card = card.select(F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("total"),
                       F.when(F.col("depth_table") == "", F.lit("| All | 0 |")).otherwise(F.col("depth_table")).alias("depth_table"))
    return _with_models(card, generator_model, decision_model)


def _with_models(card: DataFrame, generator_model: str | None, decision_model: str | None) -> DataFrame:
    return card.select("total", F.lit(generator_model or "N/A").alias("generator_model"),
                       F.lit(decision_model or "N/A").alias("decision_model"), "depth_table")


def audit_summary(df: DataFrame, dataset: str = "source_dataset", category: str = "category",
                  steps: str = "steps", dec: str = "decision") -> DataFrame:
    """Dataset, category, step count, can_skip, "[a..b]" or "None", reason cut to 85."""
    d = F.col(dec)
    span = F.when(d["can_skip"], F.format_string("[%d..%d]", d["skip_start_idx"], d["skip_end_idx"])).otherwise(F.lit("None"))
    return df.select(
        "trace_id", F.col(dataset).alias("dataset"), F.col(category).alias("category"),
        F.size(steps).alias("steps"), d["can_skip"].alias("can_skip"), span.alias("skipped_span"),
        clip_with_ellipsis(d["reason"], 85).alias("reason"))


def audit_rates(df: DataFrame, category: str = "category", steps: str = "steps", dec: str = "decision") -> DataFrame:
    """I7 addition: skip rate and mean step count per category."""
    return df.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n_traces"),
        F.avg(F.col(dec)["can_skip"].cast("double")).alias("skip_rate"),
        F.avg(F.size(steps).cast("double")).alias("mean_steps"))


def spectrum_preview(df: DataFrame) -> DataFrame:
    """I8: 85-character question and 35-character answer previews."""
    return df.select("id", "dataset", "category",
                     clip_with_ellipsis(F.col("question"), 85).alias("question_stem"),
                     clip_with_ellipsis(F.col("ground_truth"), 35).alias("ground_truth"))


def rollout_report(summary: DataFrame) -> DataFrame:
    """The per-question rollout line."""
    return summary.select(
        "*",
        F.format_string("Original Steps: %d | Final Steps: %d | Compression: %.1f%% | Extracted PT Pairs: %d",
                        "original_step_count", "final_step_count", F.bround(F.col("compression_ratio") * 100.0, 1),
                        "n_transitions").alias("report"))
