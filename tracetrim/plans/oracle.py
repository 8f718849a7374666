"""DuckDB SQL equivalents of the registered queries (same column names)."""

from __future__ import annotations

from tracetrim.plans import oracle_views as V
from tracetrim.plans import sqlfrag as S

ORACLE: dict = {}


def _explode(key: str, steps_sql: str, source: str, extra: str = "") -> str:
    return f"""SELECT {key}, {extra} CAST(unnest(range(len(st))) AS INTEGER) AS step_idx, unnest(st) AS step
FROM (SELECT *, {steps_sql} AS st FROM {source}) s"""


ORACLE["segment_sentences"] = _explode("doc_id AS text_id", S.sentences("text"), "documents")
ORACLE["segment_lines"] = _explode("doc_id AS text_id", S.lines("text"), "documents")
ORACLE["segment_paragraphs"] = V.with_views(V.V_STRUCTURED) + _explode("text_id", S.paragraphs("text"), "v_structured")
ORACLE["segment_numbered"] = V.with_views(V.V_STRUCTURED) + _explode("text_id", S.numbered("text"), "v_structured")
ORACLE["segment_auto"] = V.with_views(V.V_STRUCTURED) + _explode("text_id", S.auto("text"), "v_structured")
ORACLE["explode_steps"] = V.with_views(V.V_TRACES) + _explode(
    "trace_id", S.auto("full_text"), "v_traces", extra="CAST(len(st) AS INTEGER) AS n_steps,")


# ---------------------------------------------------------------- auditing

from tracetrim.plans import oracle_audit as OA  # noqa: E402

_DOCS_REPLY = """docs_reply AS (
  SELECT d.doc_id AS trace_id, {steps} AS steps, r.raw_response
  FROM documents d JOIN v_replies r ON r.trace_id = d.doc_id)""".format(steps=S.auto("d.text"))

ORACLE["extract_json_payload"] = V.with_views(V.V_REPLIES) + f"""SELECT trace_id,
  {OA.payload_kind("coalesce(raw_response, '')")} AS payload_kind, {OA.payload("coalesce(raw_response, '')")} AS payload
FROM v_replies"""

ORACLE["parse_decision"] = V.with_views(V.V_REPLIES, OA.parsed_layers("v_replies")) + """SELECT trace_id,
  ps AS parse_status, pcan AS can_skip, CAST(pstart AS INTEGER) AS skip_start_idx, CAST(pend AS INTEGER) AS skip_end_idx,
  preason AS reason FROM p3"""

ORACLE["parse_fallback"] = V.with_views(V.V_REPLIES, OA.parsed_layers("v_replies")) + f"""SELECT trace_id,
  {OA.fallback_can_skip("_r")} AS fallback_can_skip, ps = 'fallback' AS uses_fallback FROM p3"""

ORACLE["validate_span"] = V.with_views(V.V_REPLIES, _DOCS_REPLY, OA.parsed_layers("docs_reply"), OA.validated_layer()) + \
    f"SELECT trace_id, {OA.DECISION_COLS} FROM v1"

ORACLE["materialize_span"] = V.with_views(V.V_REPLIES, _DOCS_REPLY, OA.parsed_layers("docs_reply"), OA.validated_layer()) + \
    f"SELECT trace_id, {OA.DECISION_COLS}, {OA.span_cols()} FROM v1"

ORACLE["short_trace_guard"] = V.with_views(V.V_REPLIES, _DOCS_REPLY, OA.parsed_layers("docs_reply"),
                                           OA.validated_layer(guard=True)) + f"SELECT trace_id, {OA.DECISION_COLS} FROM v1"

_DOC_STEPS = f"""doc_steps AS (
  SELECT trace_id, question, category, source_dataset, ground_truth, {S.auto("full_text")} AS steps FROM v_doc_traces)"""

ORACLE["recorded_audit"] = V.with_views(
    V.V_DOC_TRACES, V.V_REPLIES, _DOC_STEPS,
    "joined AS (SELECT t.trace_id, t.steps, r.raw_response FROM doc_steps t LEFT JOIN v_replies r ON r.trace_id = t.trace_id)",
    OA.parsed_layers("joined"), OA.validated_layer(guard=True)) + f"SELECT trace_id, {OA.DECISION_COLS}, {OA.span_cols()} FROM v1"

ORACLE["rubric_audit"] = V.with_views(V.V_DOC_TRACES, _DOC_STEPS, OA.rubric_layers("doc_steps", ("repeat",))) + \
    f"SELECT trace_id, {OA.DECISION_COLS}, {OA.span_cols()} FROM r3"

ORACLE["rubric_overlap"] = V.with_views(V.V_DOC_TRACES, _DOC_STEPS, OA.rubric_layers(
    "doc_steps", ("repeat", "overlap", "restate", "filler"))) + f"SELECT trace_id, {OA.DECISION_COLS}, {OA.span_cols()} FROM r3"


# ---------------------------------------------------------------- transitions and rollouts (F1-F8)

def _transition_select(src, steps="steps", prefix="''", depth="1"):
    sk = f"{steps}[skip_start_idx + 1 : skip_end_idx + 1]"
    return f"""SELECT trace_id, {OA.example_id("question", depth)} AS id,
  {OA.input_x("question", prefix, steps, "skip_start_idx")} AS input_x,
  coalesce({steps}[skip_end_idx + 2], '') AS target_y, CAST({depth} AS INTEGER) AS depth,
  array_to_string({sk}, chr(10)) AS skipped_text, reason AS skip_reason, skip_start_idx, skip_end_idx,
  CAST(len({steps}) AS INTEGER) AS original_step_count
FROM {src} WHERE can_skip AND skip_start_idx >= 0"""


ORACLE["extract_transition"] = V.with_views(V.V_DOC_TRACES, _DOC_STEPS, OA.rubric_layers("doc_steps", ("repeat",))) + \
    _transition_select("r3")

ORACLE["example_id"] = V.with_views(V.V_TRACES) + f"""SELECT trace_id, {OA.example_id("question", "1")} AS id,
  sha256(coalesce(question, '') || chr(31) || '1') AS example_key FROM v_traces"""

_RO = "WITH RECURSIVE " + ",\n".join([
    V.V_DOC_TRACES, _DOC_STEPS, OA.replay_rollout("doc_steps", 3),
    OA.rubric_layers("ro", ("repeat",), steps="rem", prior="kept")]) + "\n"

ORACLE["rollout_replay"] = _RO + _transition_select("r3", steps="rem", prefix="prefix", depth="depth")

ORACLE["rollout_log"] = _RO + """SELECT trace_id, CAST(depth AS INTEGER) AS depth, CAST(len(rem) AS INTEGER) AS n_steps, outcome,
  can_skip, skip_start_idx, skip_end_idx, (can_skip AND skip_start_idx >= 0) AS usable,
  CASE WHEN can_skip THEN coalesce(rem[skip_end_idx + 2], '') ELSE '' END AS next_step,
  CAST(length(prefix) AS INTEGER) AS prefix_chars FROM r3"""

ORACLE["rollout_summary"] = _RO + """, last AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY depth DESC) AS rk,
         count(*) OVER (PARTITION BY trace_id) AS depths_run,
         sum(CASE WHEN can_skip THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id) AS n_tr,
         first_value(len(rem)) OVER (PARTITION BY trace_id ORDER BY depth) AS orig
  FROM r3),
fin AS (
  SELECT *, kept || CASE WHEN can_skip THEN rem[1 : skip_start_idx] ||
                 CASE WHEN coalesce(rem[skip_end_idx + 2], '') <> '' THEN [rem[skip_end_idx + 2]] ELSE [] END
               ELSE rem END AS final_steps
  FROM last WHERE rk = 1)
SELECT trace_id, CAST(orig AS INTEGER) AS original_step_count, CAST(len(final_steps) AS INTEGER) AS final_step_count,
  round(greatest(0.0, 1.0 - len(final_steps) / greatest(orig, 1)), 6) AS compression_ratio,
  CAST(length(array_to_string(final_steps, ' ')) AS INTEGER) AS final_chars, CAST(depths_run AS INTEGER) AS depths_run,
  CAST(n_tr AS INTEGER) AS n_transitions,
  CASE WHEN NOT can_skip THEN 'no_skip' WHEN skip_end_idx + 1 >= len(rem) - 1 THEN 'end_of_trace' ELSE 'max_depth' END AS stopped_by
FROM fin"""

ORACLE["provenance"] = _RO + """SELECT r.trace_id, """ + OA.example_id("r.question", "r.depth") + """ AS id,
  CAST(r.depth AS INTEGER) AS depth, d.category, d.source_dataset, d.ground_truth
FROM r3 r JOIN doc_steps d ON d.trace_id = r.trace_id WHERE r.can_skip"""


# ---------------------------------------------------------------- sources, formatting, evaluation, reports

from tracetrim.plans import oracle_more as OM  # noqa: E402
from tracetrim.operators import format as FMT  # noqa: E402

ORACLE.update(OM.ORACLE)

_TR = _RO + ", tr AS (" + _transition_select("r3", steps="rem", prefix="prefix", depth="depth") + ")\n"
_PT = _TR + ", pt AS (SELECT t.*, d.question, d.category, d.source_dataset, d.ground_truth FROM tr t JOIN doc_steps d ON d.trace_id = t.trace_id)\n"

ORACLE["pt_roundtrip"] = _TR + """SELECT id, depth, input_x, target_y, skipped_text, skip_start_idx, 'train' AS split FROM tr"""

ORACLE["arrow_roundtrip"] = _TR + """SELECT id, depth, input_x, target_y, skipped_text, skip_start_idx,
  CASE WHEN depth > 1 THEN 'deep' ELSE 'train' END AS split FROM tr"""

ORACLE["build_pt_dataset"] = _PT + """SELECT id, input_x, target_y, depth, skipped_text, skip_reason,
  'recorded' AS generator_model, 'rubric:repeat' AS decision_model, skip_start_idx, original_step_count,
  category, source_dataset, ground_truth, 'train' AS split FROM pt"""

ORACLE["sft_text"] = _TR + "SELECT trace_id, depth, input_x || chr(10) || chr(10) || '[Next Step]:' || chr(10) || target_y AS text FROM tr"

ORACLE["continuation_prompt"] = _RO + f"""SELECT trace_id, CAST(depth AS INTEGER) AS depth,
  CASE WHEN {S.strip('prefix')} <> '' THEN question || chr(10) || chr(10) || '[Previous Steps]:' || chr(10) || prefix
       || chr(10) || chr(10) || '[Continue reasoning from here]:' ELSE question END AS prompt FROM r3"""


def _audit_prompt_sql():
    vals = {
        "question": "question",
        "prefix_section": "(CASE WHEN prefix <> '' THEN 'USEFUL PREFIX (already established):' || chr(10) || prefix || chr(10) ELSE '' END)",
        "formatted_steps": "array_to_string(list_transform(range(len(rem)), lambda i: '[' || CAST(i AS VARCHAR) || '] ' || rem[i + 1]), chr(10))",
    }
    parts = [OA._q(v) if k == "lit" else vals[v] for k, v in FMT._template_parts(FMT.DEFAULT_AUDIT_TEMPLATE)]
    return " || ".join(parts)


ORACLE["audit_prompt"] = _RO + f"SELECT trace_id, CAST(depth AS INTEGER) AS depth, {_audit_prompt_sql()} AS prompt FROM r3"

_RUB = V.with_views(V.V_DOC_TRACES, _DOC_STEPS, OA.rubric_layers("doc_steps", ("repeat",)))

ORACLE["step_roles"] = _RUB + """SELECT trace_id, step_idx, CASE
    WHEN can_skip AND skip_start_idx <= step_idx AND step_idx <= skip_end_idx THEN 'skipped'
    WHEN can_skip AND step_idx = skip_end_idx + 1 THEN 'target'
    WHEN can_skip AND step_idx < skip_start_idx THEN 'useful_prefix' ELSE 'untouched' END AS role
FROM (SELECT trace_id, can_skip, skip_start_idx, skip_end_idx, CAST(unnest(range(len(steps))) AS INTEGER) AS step_idx FROM r3) x"""

ORACLE["audit_summary"] = _RUB + f"""SELECT trace_id, source_dataset AS dataset, category, CAST(len(steps) AS INTEGER) AS steps, can_skip,
  CASE WHEN can_skip THEN printf('[%d..%d]', skip_start_idx, skip_end_idx) ELSE 'None' END AS skipped_span,
  {OM.clip('reason', 85)} AS reason FROM r3"""

ORACLE["audit_rates"] = _RUB + """SELECT category, count(*) AS n_traces, round(avg(CAST(can_skip AS DOUBLE)), 6) AS skip_rate,
  round(avg(CAST(len(steps) AS DOUBLE)), 6) AS mean_steps FROM r3 GROUP BY category"""

ORACLE["schema_check"] = _PT + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", true AS present, true AS type_ok, '{kind}' AS type, count(*) AS n_rows, "
    f"CAST(count_if({sql} IS NULL) AS BIGINT) AS n_null FROM pt"
    for c, kind, sql in (("id", "string", "id"), ("question", "string", "question"), ("input_x", "string", "input_x"),
                         ("target_y", "string", "target_y"), ("depth", "integer", "depth"), ("skipped_steps", "array", "skipped_text"),
                         ("skip_reason", "string", "skip_reason"), ("metadata", "struct", "1")))

ORACLE["content_check"] = _PT + """SELECT count(*) AS n_rows, CAST(count_if(coalesce(input_x, '') = '') AS BIGINT) AS empty_input_x,
  CAST(count_if(coalesce(target_y, '') = '') AS BIGINT) AS empty_target_y,
  CAST(count_if(coalesce(input_x, '') <> '' AND coalesce(target_y, '') <> '') AS BIGINT) AS valid_rows FROM pt"""

ORACLE["category_counts"] = _PT + "SELECT coalesce(category, 'Unknown') AS category, count(*) AS n FROM pt GROUP BY 1"

ORACLE["depth_counts"] = _PT + "SELECT depth, count(*) AS n FROM pt GROUP BY depth"

ORACLE["dataset_card"] = _PT + """SELECT CAST(sum(n) AS BIGINT) AS total, 'recorded' AS generator_model, 'rubric:repeat' AS decision_model,
  string_agg('| Depth ' || CAST(depth AS VARCHAR) || ' | ' || CAST(n AS VARCHAR) || ' |', chr(10) ORDER BY depth) AS depth_table
FROM (SELECT depth, count(*) AS n FROM pt GROUP BY depth) x"""

ORACLE["rollout_report"] = """SELECT trace_id, original_step_count, final_step_count, n_transitions,
  printf('Original Steps: %d | Final Steps: %d | Compression: %.1f%% | Extracted PT Pairs: %d', original_step_count, final_step_count,
         round_even(greatest(0.0, 1.0 - final_step_count / greatest(original_step_count, 1)) * 100.0, 1), n_transitions) AS report
FROM (""" + ORACLE["rollout_summary"] + ") z"

ORACLE["step_role_counts"] = "SELECT role, count(*) AS n FROM (" + ORACLE["step_roles"] + ") z GROUP BY role"
