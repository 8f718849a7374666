"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Outputs are flat (arrays are exploded or joined) so they compare cell by cell with the
SQL in ``tracetrim.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetrim.session import write_shared
from tracetrim.operators.steps import explode_steps, with_steps
from tracetrim.sources import json_rows as JR
from tracetrim.sources import views
from tracetrim.sources.tables import read_table

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- segmentation

def _segmented(df: DataFrame, key: str, text: str, mode: str) -> DataFrame:
    return explode_steps(with_steps(df, text, mode), key)


@register("segment_sentences")
def q_segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return _segmented(docs, "text_id", "text", "sentences")


@register("segment_lines")
def q_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return _segmented(docs, "text_id", "text", "lines")


@register("segment_paragraphs")
def q_segment_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(views.v_structured(spark, sf_dir), "text_id", "text", "paragraphs")


@register("segment_numbered")
def q_segment_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(views.v_structured(spark, sf_dir), "text_id", "text", "numbered")


@register("segment_auto")
def q_segment_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(views.v_structured(spark, sf_dir), "text_id", "text", "auto")


@register("explode_steps")
def q_explode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auto-segmented conversation traces, one row per step with its index and step count."""
    tr = with_steps(views.v_traces(spark, sf_dir), "full_text", "auto")
    out = tr.select("trace_id", F.size("steps").alias("n_steps"), F.posexplode_outer("steps").alias("step_idx", "step"))
    return out.where(F.col("step_idx").isNotNull())


# ---------------------------------------------------------------- auditing

from tracetrim.functions import reply as R  # noqa: E402
from tracetrim.functions.segment import segment  # noqa: E402
from tracetrim.operators import audit as A  # noqa: E402
from tracetrim.operators.rubric import with_rubric_decision  # noqa: E402
from tracetrim.operators import rollout as RO  # noqa: E402
from tracetrim.operators.transitions import example_id, example_key, extract_transitions  # noqa: E402

NL = "\n"


def _docs_with_reply(spark, sf_dir):
    """Documents as auto-segmented traces with their recorded reply, in one projection."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("trace_id"),
        segment("text", "auto").alias("steps"),
        views.reply_case(F.col("doc_id"), F.col("text")).alias("raw_response"),
    )


def _decision_cols(dec="decision", steps="steps"):
    d = F.col(dec)
    return [
        F.size(steps).alias("n_steps"),
        d["outcome"].alias("outcome"),
        d["can_skip"].alias("can_skip"),
        d["skip_start_idx"].alias("skip_start_idx"),
        d["skip_end_idx"].alias("skip_end_idx"),
        d["reason"].alias("reason"),
    ]


def _span_cols(dec="decision", steps="steps"):
    d = F.col(dec)
    sk = A.skipped_steps(d, F.col(steps))
    return [F.size(sk).alias("n_skipped"), F.array_join(sk, NL).alias("skipped_text"), A.next_step(d, F.col(steps)).alias("next_step")]


@register("extract_json_payload")
def q_extract_json_payload(spark, sf_dir):
    r = views.v_replies(spark, sf_dir)
    return r.select("trace_id", R.payload_kind("raw_response").alias("payload_kind"), R.payload("raw_response").alias("payload"))


@register("parse_decision")
def q_parse_decision(spark, sf_dir):
    r = R.with_parsed_reply(views.v_replies(spark, sf_dir), "raw_response", "p")
    return r.select("trace_id", "p.parse_status", "p.can_skip", F.col("p.skip_start_idx").cast("int").alias("skip_start_idx"),
                    F.col("p.skip_end_idx").cast("int").alias("skip_end_idx"), "p.reason")


@register("reply_edges")
def q_reply_edges(spark, sf_dir):
    """E2 at the edges of JSON, around each document's text: repeated keys, a huge index, NaN and -Infinity."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("trace_id"), segment("text", "auto").alias("steps"),
        views.reply_case(F.col("doc_id"), F.col("text"), views.EDGE_CASES).alias("raw_response"))
    t = R.with_parsed_reply(docs, "raw_response", "p").withColumn("decision", A.validate(F.col("p"), F.col("steps")))
    return t.select("trace_id", "p.parse_status", F.col("p.skip_start_idx").cast("string").alias("start_text"), *_decision_cols())


@register("parse_fallback")
def q_parse_fallback(spark, sf_dir):
    r = R.with_parsed_reply(views.v_replies(spark, sf_dir), "raw_response", "p")
    return r.select("trace_id", R.fallback_can_skip("raw_response").alias("fallback_can_skip"),
                    (F.col("p.parse_status") == "fallback").alias("uses_fallback"))


@register("validate_span")
def q_validate_span(spark, sf_dir):
    t = R.with_parsed_reply(_docs_with_reply(spark, sf_dir), "raw_response", "p")
    t = t.withColumn("decision", A.validate(F.col("p"), F.col("steps")))
    return t.select("trace_id", *_decision_cols())


@register("materialize_span")
def q_materialize_span(spark, sf_dir):
    t = R.with_parsed_reply(_docs_with_reply(spark, sf_dir), "raw_response", "p")
    t = t.withColumn("decision", A.validate(F.col("p"), F.col("steps")))
    return t.select("trace_id", *_decision_cols(), *_span_cols())


@register("short_trace_guard")
def q_short_trace_guard(spark, sf_dir):
    t = A.with_reply_decision(_docs_with_reply(spark, sf_dir), "raw_response", "steps", "decision")
    return t.select("trace_id", *_decision_cols())


@register("recorded_audit")
def q_recorded_audit(spark, sf_dir):
    traces = views.v_doc_traces(spark, sf_dir).withColumn("steps", segment("full_text", "auto"))
    t = A.recorded_audit(traces, views.v_replies(spark, sf_dir))
    return t.select("trace_id", *_decision_cols(), *_span_cols())


def _rubric_traces(spark, sf_dir, rules):
    traces = views.v_doc_traces(spark, sf_dir).withColumn("steps", segment("full_text", "auto"))
    return with_rubric_decision(traces, "steps", "question", None, rules)


@register("rubric_audit")
def q_rubric_audit(spark, sf_dir):
    t = _rubric_traces(spark, sf_dir, ("repeat",))
    return t.select("trace_id", *_decision_cols(), *_span_cols())


@register("rubric_overlap")
def q_rubric_overlap(spark, sf_dir):
    t = _rubric_traces(spark, sf_dir, ("repeat", "overlap", "restate", "filler"))
    return t.select("trace_id", *_decision_cols(), *_span_cols())


# ---------------------------------------------------------------- transitions and rollouts (F1-F8)

def _transition_out(df, key="trace_id"):
    return df.select(
        key, "id", "input_x", "target_y", "depth", F.array_join("skipped_steps", NL).alias("skipped_text"),
        "skip_reason", "skip_start_idx", "skip_end_idx", "original_step_count")


@register("extract_transition")
def q_extract_transition(spark, sf_dir):
    t = _rubric_traces(spark, sf_dir, ("repeat",)).withColumn("prefix", F.lit(""))
    return _transition_out(extract_transitions(t, keep=("trace_id",)))


@register("example_id")
def q_example_id(spark, sf_dir):
    t = views.v_traces(spark, sf_dir)
    return t.select("trace_id", example_id(F.col("question"), F.lit(1)).alias("id"),
                    example_key(F.col("question"), F.lit(1)).alias("example_key"))


def doc_rollout(spark, sf_dir, max_depth=3, rules=("repeat",), log_fields=None):
    traces = views.v_doc_traces(spark, sf_dir)
    return RO.rollout(traces, key="trace_id", max_depth=max_depth, auditor=RO.rubric_auditor(rules), log_fields=log_fields)


#: What a question brings to its transitions, carried through the rollout.
PROVENANCE = ("category", "source_dataset", "ground_truth")


@register("rollout_replay")
def q_rollout_replay(spark, sf_dir):
    return _transition_out(RO.rollout_transitions(doc_rollout(spark, sf_dir)))


@register("rollout_log")
def q_rollout_log(spark, sf_dir):
    lg = RO.rollout_log(doc_rollout(spark, sf_dir))
    return lg.select("trace_id", "depth", "n_steps", "outcome", "can_skip", "skip_start_idx", "skip_end_idx",
                     "usable", "next_step", F.length("prefix").alias("prefix_chars"))


@register("rollout_summary")
def q_rollout_summary(spark, sf_dir):
    s = RO.rollout_summary(doc_rollout(spark, sf_dir))
    return s.select("trace_id", "original_step_count", "final_step_count",
                    F.round("compression_ratio", 6).alias("compression_ratio"),
                    F.length("final_pruned_trace").alias("final_chars"), "depths_run", "n_transitions", "stopped_by")


@register("provenance")
def q_provenance(spark, sf_dir):
    tr = RO.rollout_transitions(doc_rollout(spark, sf_dir), keep=PROVENANCE)
    return tr.select("trace_id", "id", "depth", *PROVENANCE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rollout_replay"](spark, sf_dir)


# ---------------------------------------------------------------- sources

from tracetrim.sources import benchmarks as BM  # noqa: E402
from tracetrim.sources import pt_io  # noqa: E402
from tracetrim.operators import format as FM  # noqa: E402
from tracetrim.operators import completions as CP  # noqa: E402
from tracetrim.operators import evaluate as EV  # noqa: E402
from tracetrim.operators import reports as RP  # noqa: E402
from tracetrim.functions.answers import extract_answer  # noqa: E402

# Benchmark names derived per document (hits with odd spacing/case, a path-like miss, the raw source).
NAME_VARIANTS = ["gsm8k", " ARC_Challenge ", "SQuAD_v2", "openbookqa", "commonsense_qa", "Hotpot_QA", "svamp",
                 "sciq", "arc_easy", "my/custom-set"]


def _doc_names(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    variants = F.array(*[F.lit(v) for v in NAME_VARIANTS], F.col("source"))
    return docs.select("doc_id", F.element_at(variants, (F.col("doc_id") % 11 + 1).cast("int")).alias("name"))


@register("resolve_benchmark")
def q_resolve_benchmark(spark, sf_dir):
    r = BM.resolve_benchmarks(_doc_names(spark, sf_dir), "name")
    return r.select("doc_id", "name", "alias_key", "registry_hit", "path", "config", "category")


@register("load_questions")
def q_load_questions(spark, sf_dir):
    q = BM.load_questions(views.v_choice(spark, sf_dir), "arc_challenge", "item_id", "train")
    return q.select("question_key", "id", "dataset", "category", "question", "ground_truth",
                    F.col("metadata.config").alias("config"), F.col("metadata.split").alias("split"),
                    F.col("metadata.index").alias("index"))


@register("load_repeated_keys")
def q_load_repeated_keys(spark, sf_dir):
    """A2 over rows whose order column repeats and is null for some: every row keeps a place of its own."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    rows = conv.select(F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("item_id"), F.col("text").alias("question"), F.col("role").alias("answer"))
    q = BM.load_questions(rows, "gsm8k", "item_id", "train")
    return q.select("question_key", "id", "question", "ground_truth", F.col("metadata.index").alias("index"))


@register("curated_fallback")
def q_curated_fallback(spark, sf_dir):
    names = BM.resolve_benchmarks(_doc_names(spark, sf_dir), "name").select("alias_key", "path").distinct()
    c = BM.curated_for(names, 2)
    return c.select("alias_key", "path", F.col("pos").cast("int").alias("pos"), "id", "category")


def _svamp_like(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.select(
        views.id_key("p_partkey").alias("item_id"),
        F.concat(F.lit("There are "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" boxes.")).alias("Body"),
        F.concat(F.lit("How many "), F.col("p_type"), F.lit(" items are there?")).alias("Question"),
        F.col("p_size").cast("string").alias("Answer"))


def _plain_qa(spark, sf_dir):
    return views.v_traces(spark, sf_dir).select(F.col("trace_id").alias("item_id"), "question",
                                                 F.col("full_text").alias("answer"))


def spectrum_sources(spark, sf_dir):
    return {
        "gsm8k": _plain_qa(spark, sf_dir),
        "arc_challenge": views.v_choice(spark, sf_dir),
        "svamp": _svamp_like(spark, sf_dir),
        "squad_v2": views.v_context(spark, sf_dir),
    }


@register("spectrum_topn")
def q_spectrum_topn(spark, sf_dir):
    return BM.spectrum(spectrum_sources(spark, sf_dir), "item_id", per_benchmark=2)


def _user_turns(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "user").select(views.turn_key().alias("item_id"),
                                                       F.col("text").alias("problem"))


@register("normalize_questions")
def q_normalize_questions(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    src = conv.where(F.col("role") == "user").select(views.turn_key().alias("item_id"),
                                                      F.col("text").alias("question"))
    q = BM.questions_from(src, key_col="item_id")
    return q.select("question_key", "question", "ground_truth", "dataset")


@register("pt_roundtrip")
def q_pt_roundtrip(spark, sf_dir):
    tr = RO.rollout_transitions(doc_rollout(spark, sf_dir))
    path = pt_io.shared_path(spark, "pt_roundtrip")
    pt_io.save_pt(pt_io.to_pt_rows(tr, "train"), path)
    back = pt_io.load_pt(spark, path)
    return back.select("id", "depth", "input_x", "target_y", F.array_join("skipped_steps", NL).alias("skipped_text"),
                       F.col("metadata.skip_start_idx").alias("skip_start_idx"), "split")


@register("arrow_roundtrip")
def q_arrow_roundtrip(spark, sf_dir):
    """A6 through a folder of Arrow datasets: every transition written to its split and read back, splits apart."""
    tr = RO.rollout_transitions(doc_rollout(spark, sf_dir))
    pt = pt_io.to_pt_rows(tr).withColumn("split", F.when(F.col("depth") > 1, "deep").otherwise("train"))
    path = pt_io.shared_path(spark, "arrow_roundtrip")
    pt_io.save_pt_arrow(pt, path)
    back = pt_io.load_pt(spark, path).unionByName(pt_io.load_pt(spark, path, "deep"))
    return back.select("id", "depth", "input_x", "target_y", F.array_join("skipped_steps", NL).alias("skipped_text"),
                       F.col("metadata.skip_start_idx").alias("skip_start_idx"), "split")


@register("eval_inputs")
def q_eval_inputs(spark, sf_dir):
    return BM.eval_inputs(_user_turns(spark, sf_dir), "item_id")


@register("eval_zip")
def q_eval_zip(spark, sf_dir):
    """User turns and documents paired by place, questions in the order of their turns and golds in that of their texts."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    return BM.zip_inputs(_user_turns(spark, sf_dir), docs, "problem", "text", "item_id", "k")


@register("fmt_mixed_json")
def q_fmt_mixed_json(spark, sf_dir):
    """B5 row by row: one file of JSON lines with four layouts, keys missing, null or of other types, written and read back."""
    fmt = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    svamp = _svamp_like(spark, sf_dir)
    context = views.v_context(spark, sf_dir)
    lines = [views.v_choice(spark, sf_dir), svamp.drop("Answer"), context.where("hash(item_id) % 2 = 0"),
             context.where("hash(item_id) % 2 <> 0").select("item_id", "context", "question", F.struct(F.array("answer").alias("text")).alias("answers")),
             _plain_qa(spark, sf_dir)]
    rows = fmt(lines[0])
    for df in lines[1:]:
        rows = rows.unionByName(fmt(df))
    path = pt_io.shared_path(spark, "mixed_json")
    rows.write.text(path)
    f = JR.format_json_rows(JR.read_json_rows(spark, path))
    return f.select("layout", JR.Value(JR.ROW, "item_id").text.alias("item_id"), F.col("question_text").alias("question"), F.col("answer_text").alias("ground_truth"))


# ---------------------------------------------------------------- formatting

def _fmt_out(df, key="item_id"):
    f = FM.format_rows(df)
    return f.select(F.col(key).alias("item_id"), F.col("question_text").alias("question"),
                    F.col("answer_text").alias("ground_truth"))


@register("fmt_multiple_choice")
def q_fmt_multiple_choice(spark, sf_dir):
    return _fmt_out(views.v_choice(spark, sf_dir))


@register("fmt_body_question")
def q_fmt_body_question(spark, sf_dir):
    return _fmt_out(_svamp_like(spark, sf_dir))


@register("fmt_context")
def q_fmt_context(spark, sf_dir):
    return _fmt_out(views.v_context(spark, sf_dir))


@register("fmt_plain")
def q_fmt_plain(spark, sf_dir):
    return _fmt_out(_plain_qa(spark, sf_dir))


@register("fmt_dispatch")
def q_fmt_dispatch(spark, sf_dir):
    """Rows of three layouts in one table: per-row dispatch MC -> context -> plain."""
    none = F.lit(None).cast("string")
    no_choices = F.lit(None).cast("struct<label:array<string>,text:array<string>>").alias("choices")
    mc = views.v_choice(spark, sf_dir).select(
        F.lit("choice").alias("layout"), "item_id", "question", "choices", "answerKey", none.alias("context"), none.alias("answer"))
    ctx = views.v_context(spark, sf_dir).select(
        F.lit("context").alias("layout"), "item_id", "question", no_choices, none.alias("answerKey"), "context", "answer")
    plain = _plain_qa(spark, sf_dir).select(
        F.lit("plain").alias("layout"), "item_id", "question", no_choices, none.alias("answerKey"), none.alias("context"), "answer")
    f = FM.format_rows(mc.unionByName(ctx).unionByName(plain))
    return f.select("layout", "item_id", F.col("question_text").alias("question"), F.col("answer_text").alias("ground_truth"))


@register("continuation_prompt")
def q_continuation_prompt(spark, sf_dir):
    lg = RO.rollout_log(doc_rollout(spark, sf_dir))
    return lg.select("trace_id", "depth", FM.continuation_prompt(F.col("question"), F.col("prefix")).alias("prompt"))


@register("audit_prompt")
def q_audit_prompt(spark, sf_dir):
    lg = RO.rollout_log(doc_rollout(spark, sf_dir))
    return lg.select("trace_id", "depth", FM.audit_prompt(F.col("question"), F.col("prefix"), F.col("steps")).alias("prompt"))


@register("sft_text")
def q_sft_text(spark, sf_dir):
    tr = RO.rollout_transitions(doc_rollout(spark, sf_dir))
    return tr.select("trace_id", "depth", FM.sft_text(F.col("input_x"), F.col("target_y")).alias("text"))


# ---------------------------------------------------------------- traces from completions

@register("build_trace")
def q_build_trace(spark, sf_dir):
    t = CP.build_traces(views.v_completions(spark, sf_dir))
    return t.select("question_key", "depth", "token_count", "is_error", F.size("steps").alias("n_steps"),
                    F.array_join("steps", NL).alias("steps_text"))


@register("completion_errors")
def q_completion_errors(spark, sf_dir):
    t = CP.build_traces(views.v_completions(spark, sf_dir)).where(F.col("is_error"))
    return t.select("question_key", "depth", "full_text", "token_count", F.size("steps").alias("n_steps"))


def _first_questions(spark, sf_dir):
    """One question per conversation: its first user turn."""
    conv = read_table(spark, sf_dir, "conversations")
    return (conv.where(F.col("role") == "user").groupBy(F.col("conv_id").alias("question_key"))
            .agg(F.min_by("text", "turn").alias("question")))


@register("batch_completion")
def q_batch_completion(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    req = CP.completion_requests(turns.select(views.turn_key().alias("question_key"), F.col("text").alias("question")))
    return CP.batch_completion(req, _first_line, depth=1)


def _first_line(pdf):
    """A stand-in client: answers with the prompt's first line, and fails on prompts of a length divisible by 11."""
    import pandas as pd

    if (pdf["prompt"].str.len() % 11 == 0).any():
        raise ValueError("no answer")
    return pd.DataFrame({"text": pdf["prompt"].str.split("\n").str[0], "usage_tokens": None, "error": None})


def _numbered_plan(pdf):
    """A stand-in generator: five steps that name the prompt's length; fails when that is divisible by 7."""
    import pandas as pd

    n = pdf["prompt"].str.len()
    if (n % 7 == 0).any():
        raise ValueError("no answer")
    text = "Alpha " + n.astype(str) + ". Beta. Beta. Gamma " + n.astype(str) + ". Omega."
    return pd.DataFrame({"text": text, "usage_tokens": None, "error": None})


def _skip_second(pdf):
    """A stand-in auditor: leaves out the second and third step; fails on questions of a length divisible by 5."""
    import pandas as pd

    if (pdf["question"].str.len() % 5 == 0).any():
        raise ValueError("no verdict")
    return pd.DataFrame({"question_key": pdf["question_key"], "raw_response": '{"can_skip": true, "skip_start_idx": 1, "skip_end_idx": 2, "reason": "twice"}'})


@register("rollout_live")
def q_rollout_live(spark, sf_dir):
    from tracetrim.operators.build import rollout_live

    ro = rollout_live(_first_questions(spark, sf_dir), _numbered_plan, _skip_second, max_depth=2)
    return RO.rollout_log(ro, "question_key").select("question_key", "depth", "n_steps", "is_error", "prefix", "can_skip", "reason", "outcome", "input_x", "next_step")


@register("user_audit")
def q_user_audit(spark, sf_dir):
    """Every document's steps judged by a callable that fails on some: those get an error decision."""
    t = views.v_doc_traces(spark, sf_dir).select("trace_id", "question", F.lit("").alias("prefix"), segment("full_text", "auto").alias("steps"))
    return A.user_audit(t, _long_prompts).select("trace_id", *_decision_cols())


def _long_prompts(pdf):
    """A stand-in auditor: leaves out the first step of traces with four steps or more; fails when there are 3, 6, 9 ... steps."""
    import pandas as pd

    n = pdf["steps"].str.len()
    if (n % 3 == 0).any():
        raise ValueError("no verdict")
    raw = n.map(lambda k: '{"can_skip": true, "skip_start_idx": 0}' if k >= 4 else '{"can_skip": false}')
    return pd.DataFrame({"trace_id": pdf["trace_id"], "raw_response": raw})


# ---------------------------------------------------------------- recorded rollout, PT build, failures

def recorded_rollout(spark, sf_dir, max_depth=3, completions=None):
    """Recorded completions per (question, depth) and recorded auditor replies per
    (question, depth); each is gathered once per question, then joined on the key."""
    from tracetrim.operators import build

    # read for the traces and for the replies: numbered and written once
    completions = write_shared(views.v_completions(spark, sf_dir), "completions") if completions is None else completions
    return build.recorded_rollout(_first_questions(spark, sf_dir), completions, views.v_rollout_replies(completions), max_depth=max_depth)


@register("rollout_recorded")
def q_rollout_recorded(spark, sf_dir):
    tr = RO.rollout_transitions(recorded_rollout(spark, sf_dir), key="question_key")
    return tr.select("question_key", "id", "input_x", "target_y", "depth",
                     F.array_join("skipped_steps", NL).alias("skipped_text"), "skip_reason",
                     "skip_start_idx", "skip_end_idx", "original_step_count")


@register("failure_isolation")
def q_failure_isolation(spark, sf_dir):
    s = RO.rollout_summary(recorded_rollout(spark, sf_dir), key="question_key")
    return s.select("question_key", "had_error", "depths_run", "n_transitions", "stopped_by")


@register("build_pt_dataset")
def q_build_pt_dataset(spark, sf_dir):
    from tracetrim.operators.build import build_pt_dataset
    docs = views.v_doc_traces(spark, sf_dir).select(F.col("trace_id").alias("question_key"), "question", "full_text",
                                                     "category", F.col("source_dataset").alias("dataset"), "ground_truth")
    pt = build_pt_dataset(docs, trace_col="full_text", max_depth=3, rules=("repeat",))
    return pt.select("id", "input_x", "target_y", "depth", F.array_join("skipped_steps", NL).alias("skipped_text"),
                     "skip_reason", "generator_model", "decision_model",
                     F.col("metadata.skip_start_idx").alias("skip_start_idx"),
                     F.col("metadata.original_step_count").alias("original_step_count"),
                     F.col("metadata.category").alias("category"), F.col("metadata.source_dataset").alias("source_dataset"),
                     F.col("metadata.ground_truth").alias("ground_truth"), "split")


# ---------------------------------------------------------------- roles, evaluation, reports (G, H, I)

@register("step_roles")
def q_step_roles(spark, sf_dir):
    t = _rubric_traces(spark, sf_dir, ("repeat",))
    return RP.step_roles(t).select("trace_id", "step_idx", "role")


@register("step_role_counts")
def q_step_role_counts(spark, sf_dir):
    return RP.role_counts(RP.step_roles(_rubric_traces(spark, sf_dir, ("repeat",))))


def _doc_responses(spark, sf_dir):
    """Base and pruned replies of every document, with its source as the benchmark, from one scan."""
    return views.v_responses(doc_rollout(spark, sf_dir, log_fields=("depth", "usable")))


@register("extract_answer")
def q_extract_answer(spark, sf_dir):
    r = _doc_responses(spark, sf_dir)
    return r.select("question_key", extract_answer(F.col("ground_truth")).alias("gold_extracted"),
                    extract_answer(F.col("base_response")).alias("base_answer"),
                    extract_answer(F.col("pruned_response")).alias("pruned_answer"))


@register("answer_correct")
def q_answer_correct(spark, sf_dir):
    r = _doc_responses(spark, sf_dir)
    return r.select("question_key", EV.gold_answer(F.col("ground_truth")).alias("gold"),
                    EV.is_correct(F.col("base_response"), F.col("ground_truth")).alias("base_correct"),
                    EV.is_correct(F.col("pruned_response"), F.col("ground_truth")).alias("pruned_correct"))


@register("pair_savings")
def q_pair_savings(spark, sf_dir):
    s = EV.eval_samples(_doc_responses(spark, sf_dir))
    return s.select("question_key", "base_tokens", "pruned_tokens", F.round("token_savings_pct", 6).alias("token_savings_pct"))


def _summary(spark, sf_dir):
    return EV.eval_summary(EV.eval_samples(_doc_responses(spark, sf_dir)))


@register("eval_summary")
def q_eval_summary(spark, sf_dir):
    s = _summary(spark, sf_dir)
    return s.select("benchmark", "num_samples", *[F.round(c, 6).alias(c) for c in (
        "base_avg_tokens", "pruned_avg_tokens", "base_accuracy", "pruned_accuracy", "avg_token_reduction_pct",
        "accuracy_delta")])


@register("pair_responses")
def q_pair_responses(spark, sf_dir):
    """Conversations as questions, their first recorded completion as the base reply and the second as the
    pruned one: several have only one of them, or none, or a failed one."""
    c = views.v_completions(spark, sf_dir)
    qs = _first_questions(spark, sf_dir)
    p = EV.eval_samples(EV.pair_responses(c.where("depth = 1"), c.where("depth = 2"), questions=qs.withColumn("ground_truth", F.lit(None).cast("string"))))
    return p.select("question_key", "base_response", "pruned_response", "base_tokens", "pruned_tokens", "base_records", "pruned_records",
                    F.round("token_savings_pct", 6).alias("token_savings_pct"))


@register("eval_card")
def q_eval_card(spark, sf_dir):
    return EV.eval_card(_summary(spark, sf_dir))


@register("comparison_rows")
def q_comparison_rows(spark, sf_dir):
    c = EV.comparison_rows(_doc_responses(spark, sf_dir))
    return c.select("question_key", "title", "base_preview", "pruned_preview", "base_tokens", "pruned_tokens",
                    F.round("token_savings_pct", 6).alias("token_savings_pct"))


def _pt(spark, sf_dir, *fields):
    """The log's ``fields`` of every transition, with its provenance: the rollout carries both."""
    ro = doc_rollout(spark, sf_dir, log_fields=("depth", "usable", *fields))
    return RO.usable_depths(ro, PROVENANCE)


@register("schema_check")
def q_schema_check(spark, sf_dir):
    path = pt_io.shared_path(spark, "pt_schema")
    pt_io.save_pt(pt_io.to_pt_rows(RO.rollout_transitions(doc_rollout(spark, sf_dir), keep=PROVENANCE)), path)
    return RP.schema_check(spark.read.parquet(path))


@register("content_check")
def q_content_check(spark, sf_dir):
    return RP.content_check(_pt(spark, sf_dir, "input_x", "next_step").withColumnRenamed("next_step", "target_y"))


@register("category_counts")
def q_category_counts(spark, sf_dir):
    return RP.category_counts(_pt(spark, sf_dir))


@register("depth_counts")
def q_depth_counts(spark, sf_dir):
    return RP.depth_counts(_pt(spark, sf_dir))


@register("dataset_card")
def q_dataset_card(spark, sf_dir):
    return RP.dataset_card(_pt(spark, sf_dir), "recorded", "rubric:repeat")


@register("audit_summary")
def q_audit_summary(spark, sf_dir):
    return RP.audit_summary(_rubric_traces(spark, sf_dir, ("repeat",)))


@register("audit_rates")
def q_audit_rates(spark, sf_dir):
    r = RP.audit_rates(_rubric_traces(spark, sf_dir, ("repeat",)))
    return r.select("category", "n_traces", F.round("skip_rate", 6).alias("skip_rate"), F.round("mean_steps", 6).alias("mean_steps"))


@register("spectrum_preview")
def q_spectrum_preview(spark, sf_dir):
    return RP.spectrum_preview(BM.spectrum(spectrum_sources(spark, sf_dir), "item_id", per_benchmark=2))


@register("spectrum_categories")
def q_spectrum_categories(spark, sf_dir):
    s = BM.spectrum(spectrum_sources(spark, sf_dir), "item_id", per_benchmark=2)
    return s.agg(F.count(F.lit(1)).alias("n_questions"), F.count_distinct("category").alias("n_categories"))


@register("rollout_report")
def q_rollout_report(spark, sf_dir):
    s = RO.rollout_summary(doc_rollout(spark, sf_dir, log_fields=("depth", "n_steps", "usable", "is_error")))
    return RP.rollout_report(s).select("trace_id", "original_step_count", "final_step_count", "n_transitions", "report")


# ---------------------------------------------------------------- incremental build

from tracetrim.streaming import incremental as INC  # noqa: E402


def completion_records(spark, sf_dir):
    """Every recorded completion that a rollout reaches, as the self-contained record a
    generator service would emit: question, the prefix it was prompted with (from the
    rollout's per-depth log), the completion and the auditor's reply."""
    completions = write_shared(views.v_completions(spark, sf_dir), "completions")
    log = RO.rollout_log(recorded_rollout(spark, sf_dir, completions=completions), key="question_key").select(
        "question_key", "depth", "question", "prefix")
    rec = log.join(completions, ["question_key", "depth"])
    return rec.select(
        "question_key", "depth", "question", "prefix", "text", "usage_tokens", "error",
        views.reply_case(F.col("question_key") + F.col("depth"), F.col("text")).alias("raw_response"))


@register("stream_transitions")
def q_stream_transitions(spark, sf_dir):
    src = pt_io.shared_path(spark, "stream_src")
    out = pt_io.shared_path(spark, "stream_out")
    completion_records(spark, sf_dir).write.parquet(src)
    INC.run_stream(spark, src, out, out + "_checkpoint")
    res = spark.read.parquet(out)
    return res.select("question_key", "id", "input_x", "target_y", "depth",
                      F.array_join("skipped_steps", NL).alias("skipped_text"), "skip_reason")


from tracetrim.streaming import rollout_stream as RS  # noqa: E402


def raw_records(spark, sf_dir):
    """Every recorded completion with its reply and question, as a generator service emits it: without a prefix."""
    completions = write_shared(views.v_completions(spark, sf_dir), "completions")
    rec = completions.join(_first_questions(spark, sf_dir), "question_key")
    return rec.select("question_key", "depth", "question", "text", "usage_tokens", "error",
                      views.reply_case(F.col("question_key") + F.col("depth"), F.col("text")).alias("raw_response"),
                      F.timestamp_seconds(F.lit(1_700_000_000) + F.col("depth")).alias("event_time"))


@register("stream_rollout")
def q_stream_rollout(spark, sf_dir):
    """F9 with state: raw completions dealt over files without regard to depth, drained two files at a time."""
    src = pt_io.shared_path(spark, "rollout_src")
    out = pt_io.shared_path(spark, "rollout_out")
    raw_records(spark, sf_dir).repartition(4, F.xxhash64("question_key", "depth")).write.parquet(src)
    RS.run_rollout_stream(spark, src, out, out + "_checkpoint", max_files_per_trigger=2)
    return spark.read.parquet(out).select("question_key", "id", "input_x", "target_y", "depth",
                                          F.array_join("skipped_steps", NL).alias("skipped_text"), "skip_reason")


from tracetrim.streaming import live_reports as LR  # noqa: E402


def categorised_records(spark, sf_dir):
    """``completion_records`` with a category by the length of the question; some have none."""
    return completion_records(spark, sf_dir).withColumn("category", F.when(
        F.col("question_key") % 5 != 0, F.when(F.length("question") < 80, F.lit("short")).otherwise(F.lit("long"))))


@register("stream_reports")
def q_stream_reports(spark, sf_dir):
    """The counts that the stream's batches add up to."""
    src = pt_io.shared_path(spark, "report_src")
    out = pt_io.shared_path(spark, "report_out")
    categorised_records(spark, sf_dir).repartition(2, "question_key").write.parquet(src)
    LR.run_report_stream(spark, src, out, max_files_per_trigger=1)
    return LR.read_counts(spark, out)
