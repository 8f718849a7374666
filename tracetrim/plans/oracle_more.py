"""DuckDB SQL for the source, formatting, completion, evaluation and report queries."""

from __future__ import annotations

from tracetrim.plans import oracle_audit as OA
from tracetrim.plans import oracle_views as V
from tracetrim.plans import sqlfrag as S
from tracetrim.sources import benchmarks as BM

q = OA._q


def _lit(v):
    return "NULL" if v is None else q(v)


REG = "reg(alias, path, config, category) AS (VALUES " + ", ".join(
    f"({q(a)}, {q(p)}, {_lit(c)}, {q(cat)})" for a, p, c, cat, _qf, _af in BM.REGISTRY_ROWS) + ")"
CURATED = "curated(pos, id, dataset, category) AS (VALUES " + ", ".join(
    f"({i}, {q(r[0])}, {q(r[1])}, {q(r[2])})" for i, r in enumerate(BM.CURATED_ROWS)) + ")"


def clip(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END)"


def first_truthy(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(CAST({c} AS VARCHAR), '')" for c in cols) + ", '')"


def sstr(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


# ---------------------------------------------------------------- formatting fragments
def mc_question(question="question", labels="choices.label", texts="choices.text") -> str:
    m = f"least(len({labels}), len({texts}))"
    pairs = (f"array_to_string(list_transform(range({m}), lambda i: '(' || coalesce({labels}[i + 1], 'None') || ') ' "
             f"|| coalesce({texts}[i + 1], 'None')), ' ')")
    return S.strip(f"{S.strip(first_truthy(question))} || ' ' || {pairs}")


def body_question(body="Body", question="Question") -> str:
    return S.strip(f"{S.strip(sstr(body))} || ' ' || {S.strip(sstr(question))}")


def context_question(context="context", question="question") -> str:
    c = S.strip(context)
    cut = f"(CASE WHEN length({c}) > 300 THEN regexp_replace(left({c}, 300), '(?s) [^ ]*\\z', '') || '...' ELSE {c} END)"
    return f"('Context: ' || {cut} || chr(10) || chr(10) || 'Question: ' || {S.strip(sstr(question))})"


def plain_question(*cols) -> str:
    return S.strip(first_truthy(*cols))


CHOICE_FMT = f"""fmt AS (SELECT item_id, {mc_question()} AS question, {first_truthy('answerKey')} AS ground_truth FROM v_choice)"""
SVAMP = """svamp AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 19, '0') AS item_id, 'There are ' || CAST(p_size AS VARCHAR) || ' ' || p_name || ' boxes.' AS Body,
  'How many ' || p_type || ' items are there?' AS Question, CAST(p_size AS VARCHAR) AS Answer FROM part)"""
PLAIN = "plain_qa AS (SELECT trace_id AS item_id, question, full_text AS answer FROM v_traces)"

ORACLE = {}

ORACLE["fmt_multiple_choice"] = V.with_views(V.V_CHOICE, CHOICE_FMT) + "SELECT item_id, question, ground_truth FROM fmt"
ORACLE["fmt_body_question"] = V.with_views(SVAMP) + \
    f"SELECT item_id, {body_question()} AS question, {sstr('Answer')} AS ground_truth FROM svamp"
ORACLE["fmt_context"] = V.with_views(V.V_CONTEXT) + \
    f"SELECT item_id, {context_question()} AS question, {sstr('answer')} AS ground_truth FROM v_context"
ORACLE["fmt_plain"] = V.with_views(V.V_TRACES, PLAIN) + \
    f"SELECT item_id, {plain_question('question')} AS question, {plain_question('answer')} AS ground_truth FROM plain_qa"
ORACLE["fmt_dispatch"] = V.with_views(V.V_CHOICE, V.V_CONTEXT, V.V_TRACES, PLAIN, """u AS (
  SELECT 'choice' AS layout, item_id, question, choices, answerKey, CAST(NULL AS VARCHAR) AS context, CAST(NULL AS VARCHAR) AS answer FROM v_choice
  UNION ALL SELECT 'context', item_id, question, NULL, NULL, context, answer FROM v_context
  UNION ALL SELECT 'plain', item_id, question, NULL, NULL, NULL, answer FROM plain_qa)""") + f"""SELECT layout, item_id,
  CASE WHEN choices IS NOT NULL THEN {mc_question()} WHEN context IS NOT NULL THEN {context_question()}
       ELSE {plain_question('question')} END AS question,
  CASE WHEN choices IS NOT NULL THEN {first_truthy('answerKey', 'answer')} WHEN context IS NOT NULL THEN {sstr('answer')}
       ELSE {plain_question('answer')} END AS ground_truth
FROM u"""

# a language is never null here, so both answer forms of a context row read alike
ORACLE["fmt_mixed_json"] = V.with_views(V.V_CHOICE, CHOICE_FMT, SVAMP, V.V_CONTEXT, V.V_TRACES, PLAIN) + f"""
SELECT 'choice' AS layout, item_id, question, ground_truth FROM fmt
UNION ALL SELECT 'body', item_id, {body_question()}, '' FROM svamp
UNION ALL SELECT CASE WHEN context IS NULL THEN 'plain' ELSE 'context' END, item_id,
  CASE WHEN context IS NULL THEN {plain_question('question')} ELSE {context_question()} END, {sstr('answer')} FROM v_context
UNION ALL SELECT 'plain', item_id, {plain_question('question')}, {plain_question('answer')} FROM plain_qa"""

ORACLE["eval_zip"] = f"""WITH q AS (SELECT coalesce(text, 'None') AS question, row_number() OVER (ORDER BY {V.TURN_KEY}) - 1 AS question_key FROM conversations WHERE role = 'user'),
g AS (SELECT coalesce(text, 'None') AS ground_truth, row_number() OVER (ORDER BY doc_id) - 1 AS question_key FROM documents)
SELECT question_key, question, ground_truth FROM q JOIN g USING (question_key)"""

# ---------------------------------------------------------------- sources
NAMES = "names AS (SELECT doc_id, (list_value(" + ", ".join(
    q(v) for v in ["gsm8k", " ARC_Challenge ", "SQuAD_v2", "openbookqa", "commonsense_qa", "Hotpot_QA", "svamp",
                   "sciq", "arc_easy", "my/custom-set"]) + ", source))[doc_id % 11 + 1] AS name FROM documents)"
RESOLVED = f"""resolved AS (
  SELECT doc_id, name, lower({S.strip('name')}) AS alias_key, reg.alias IS NOT NULL AS registry_hit,
         coalesce(reg.path, name) AS path, reg.config AS config, coalesce(reg.category, {q(BM.GENERAL_CATEGORY)}) AS category
  FROM names LEFT JOIN reg ON reg.alias = lower({S.strip('name')}))"""

ORACLE["resolve_benchmark"] = V.with_views(REG, NAMES, RESOLVED) + \
    "SELECT doc_id, name, alias_key, registry_hit, path, config, category FROM resolved"

# rows equal in every column share what their places differ in, so any order among them compares equal
ORACLE["load_repeated_keys"] = """WITH q AS (
  SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id END AS question_key, text AS question, role AS ground_truth FROM conversations WHERE role = 'user'),
n AS (SELECT *, row_number() OVER (ORDER BY question_key NULLS FIRST, question NULLS FIRST, ground_truth) - 1 AS index FROM q)
SELECT question_key, 'gsm8k_train_' || CAST(index AS VARCHAR) AS id, question, ground_truth, index FROM n WHERE coalesce(question, '') <> ''"""

ORACLE["load_questions"] = V.with_views(V.V_CHOICE, CHOICE_FMT) + """SELECT item_id AS question_key,
  'arc_challenge_train_' || CAST(idx AS VARCHAR) AS id, 'allenai/ai2_arc' AS dataset, 'Scientific Reasoning' AS category,
  question, ground_truth, 'ARC-Challenge' AS config, 'train' AS split, CAST(idx AS BIGINT) AS "index"
FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM fmt) WHERE question <> ''"""

ORACLE["curated_fallback"] = V.with_views(REG, CURATED, NAMES, RESOLVED, """nm AS (SELECT DISTINCT alias_key, path FROM resolved),
m AS (SELECT n.alias_key, n.path, c.pos, c.id, c.category FROM nm n JOIN curated c
      ON contains(c.id, n.alias_key) OR c.dataset = n.path),
hit AS (SELECT DISTINCT alias_key, path FROM m),
allc AS (SELECT n.alias_key, n.path, c.pos, c.id, c.category FROM nm n CROSS JOIN curated c
         WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.alias_key = n.alias_key AND h.path = n.path)),
u AS (SELECT * FROM m UNION ALL SELECT * FROM allc)""") + """SELECT alias_key, path, CAST(pos AS INTEGER) AS pos, id, category
FROM (SELECT *, row_number() OVER (PARTITION BY alias_key, path ORDER BY pos) AS rn FROM u) WHERE rn <= 2"""

SPECTRUM = V.with_views(V.V_TRACES, V.V_CHOICE, V.V_CONTEXT, SVAMP, PLAIN, REG, f"""allq AS (
  SELECT 'gsm8k' AS benchmark, item_id AS question_key, {plain_question('question')} AS question_text,
         {plain_question('answer')} AS answer_text FROM plain_qa
  UNION ALL SELECT 'arc_challenge', item_id, {mc_question()}, {first_truthy('answerKey')} FROM v_choice
  UNION ALL SELECT 'svamp', item_id, {body_question()}, {sstr('Answer')} FROM svamp
  UNION ALL SELECT 'squad_v2', item_id, {context_question()}, {sstr('answer')} FROM v_context),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY question_key) - 1 AS idx FROM allq)
        WHERE idx < 2),
spec AS (SELECT t.benchmark, t.question_key, reg.alias || '_train_' || CAST(t.idx AS VARCHAR) AS id, reg.path AS dataset,
                reg.category, t.question_text AS question, t.answer_text AS ground_truth, CAST(t.idx AS BIGINT) AS "index"
         FROM top t JOIN reg ON reg.alias = t.benchmark WHERE t.question_text <> '')""")
ORACLE["spectrum_topn"] = SPECTRUM + "SELECT * FROM spec"
ORACLE["spectrum_preview"] = SPECTRUM + \
    f"SELECT id, dataset, category, {clip('question', 85)} AS question_stem, {clip('ground_truth', 35)} AS ground_truth FROM spec"
ORACLE["spectrum_categories"] = SPECTRUM + \
    "SELECT count(*) AS n_questions, count(DISTINCT category) AS n_categories FROM spec"

ORACLE["normalize_questions"] = f"""SELECT {V.TURN_KEY} AS question_key, {plain_question('text')} AS question,
  '' AS ground_truth, 'hf_dataset' AS dataset FROM conversations WHERE role = 'user' AND {plain_question('text')} <> ''"""

ORACLE["eval_inputs"] = f"""SELECT {V.TURN_KEY} AS question_key, coalesce(text, 'None') AS question,
  CAST(NULL AS VARCHAR) AS ground_truth FROM conversations WHERE role = 'user'"""

# ---------------------------------------------------------------- completions
TRACES = V.with_views(V.V_COMPLETIONS, f"""tr AS (
  SELECT question_key, CAST(depth AS INTEGER) AS depth,
         CASE WHEN error IS NOT NULL THEN 'Error during generation: ' || error ELSE coalesce(text, '') END AS full_text,
         CAST(CASE WHEN error IS NOT NULL THEN 0 ELSE coalesce(usage_tokens, {S.word_count('text')}) END AS INTEGER) AS token_count,
         error IS NOT NULL AS is_error FROM v_completions),
trs AS (SELECT *, {S.auto('full_text')} AS steps FROM tr)""")
ORACLE["build_trace"] = TRACES + """SELECT question_key, depth, token_count, is_error, CAST(len(steps) AS INTEGER) AS n_steps,
  array_to_string(steps, chr(10)) AS steps_text FROM trs"""
ORACLE["completion_errors"] = TRACES + """SELECT question_key, depth, full_text, token_count, CAST(len(steps) AS INTEGER) AS n_steps
FROM trs WHERE is_error"""

# ---------------------------------------------------------------- recorded rollout (F4 recorded, F8)
RECORDED = V.with_views(V.V_COMPLETIONS, f"""firstq AS (
  SELECT conv_id AS question_key, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
tr AS (
  SELECT c.question_key, CAST(c.depth AS INTEGER) AS depth, f.question,
         CASE WHEN c.error IS NOT NULL THEN 'Error during generation: ' || c.error ELSE coalesce(c.text, '') END AS full_text,
         c.error IS NOT NULL AS is_error,
         {V.reply_sql('c.question_key + c.depth', 'c.text')} AS raw_response
  FROM v_completions c JOIN firstq f ON f.question_key = c.question_key WHERE c.depth BETWEEN 1 AND 3),
trs AS (SELECT *, {S.auto('full_text')} AS steps FROM tr)""", OA.parsed_layers("trs"), OA.validated_layer(guard=True), """d1 AS (
  SELECT *, (can_skip AND skip_start_idx >= 0) AS usable,
         CASE WHEN can_skip AND skip_start_idx >= 0 THEN coalesce(steps[skip_end_idx + 2], '') ELSE '' END AS nxt FROM v1),
d2 AS (
  SELECT *, """ + S.strip("array_to_string(steps[1 : greatest(skip_start_idx, 0)] || CASE WHEN nxt <> '' THEN [nxt] ELSE [] END, ' ')") + """ AS ctx,
         usable AND NOT (skip_end_idx + 1 >= len(steps) - 1) AS cont FROM d1),
d3 AS (
  SELECT *,
    coalesce(bool_and(cont) OVER w, true) AS prev_ok,
    count(*) OVER w AS n_prev,
    coalesce(array_to_string(list(ctx) OVER w, ' '), '') AS prefix
  FROM d2 WINDOW w AS (PARTITION BY question_key ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ran AS (SELECT * FROM d3 WHERE prev_ok AND n_prev = depth - 1)""")

ORACLE["rollout_recorded"] = RECORDED + f"""SELECT question_key, {OA.example_id("question", "depth")} AS id,
  {OA.input_x("question", "prefix", "steps", "skip_start_idx")} AS input_x, nxt AS target_y, depth,
  array_to_string(steps[skip_start_idx + 1 : skip_end_idx + 1], chr(10)) AS skipped_text, reason AS skip_reason,
  skip_start_idx, skip_end_idx, CAST(len(steps) AS INTEGER) AS original_step_count
FROM ran WHERE usable"""

ORACLE["failure_isolation"] = RECORDED + """, lastrow AS (
  SELECT *, row_number() OVER (PARTITION BY question_key ORDER BY depth DESC) AS rk,
         bool_or(is_error) OVER (PARTITION BY question_key) AS had_error,
         count(*) OVER (PARTITION BY question_key) AS depths_run,
         sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY question_key) AS n_tr
  FROM ran)
SELECT f.question_key, coalesce(had_error, false) AS had_error, CAST(coalesce(depths_run, 0) AS INTEGER) AS depths_run,
  CAST(coalesce(n_tr, 0) AS INTEGER) AS n_transitions,
  CASE WHEN l.question_key IS NULL THEN 'missing_completion' WHEN NOT usable THEN 'no_skip'
       WHEN skip_end_idx + 1 >= len(steps) - 1 THEN 'end_of_trace'
       WHEN depth = 3 THEN 'max_depth' ELSE 'missing_completion' END AS stopped_by
FROM firstq f LEFT JOIN (SELECT * FROM lastrow WHERE rk = 1) l ON l.question_key = f.question_key"""

# ---------------------------------------------------------------- evaluation
GSM = r"####\s*([-0-9.,]+)"
BOXED = r"\\boxed\{([^}]+)\}"
PHRASE = r"(?i)(?:the answer is|equals|final answer:?)\s*([-0-9.,]+)"
NUMBER = r"[-+]?[0-9]*\.?[0-9]+"


def extract(x: str) -> str:
    t = f"coalesce({x}, '')"
    return (f"(CASE WHEN regexp_matches({t}, {q(GSM)}) THEN replace({S.strip(f'regexp_extract({t}, {q(GSM)}, 1)')}, ',', '') "
            f"WHEN regexp_matches({t}, {q(BOXED)}) THEN {S.strip(f'regexp_extract({t}, {q(BOXED)}, 1)')} "
            f"WHEN regexp_matches({t}, {q(PHRASE)}) THEN replace({S.strip(f'regexp_extract({t}, {q(PHRASE)}, 1)')}, ',', '') "
            f"ELSE regexp_extract_all({t}, {q(NUMBER)})[-1] END)")


def gold(gt: str) -> str:
    return f"(CASE WHEN {gt} IS NULL THEN NULL ELSE coalesce(nullif({extract(gt)}, ''), {S.strip(gt)}) END)"


def correct(resp: str, gt: str) -> str:
    a, g = extract(resp), gold(gt)
    return (f"(CASE WHEN {gt} IS NULL THEN NULL WHEN coalesce({a} <> '', false) AND coalesce({g} <> '', false) "
            f"THEN {a} = {g} ELSE false END)")


def tokens(t: str, text: str) -> str:
    return f"CAST(CASE WHEN {t} IS NULL OR {t} = 0 THEN {S.word_count(text)} ELSE {t} END AS INTEGER)"


# the replay rollout to its final steps; oracle.py builds its rollout queries on the same text
FINAL = """last AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY depth DESC) AS rk,
         count(*) OVER (PARTITION BY trace_id) AS depths_run,
         sum(CASE WHEN can_skip THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id) AS n_tr,
         first_value(len(rem)) OVER (PARTITION BY trace_id ORDER BY depth) AS orig
  FROM r3),
fin AS (
  SELECT *, kept || CASE WHEN can_skip THEN rem[1 : skip_start_idx] ||
                 CASE WHEN coalesce(rem[skip_end_idx + 2], '') <> '' THEN [rem[skip_end_idx + 2]] ELSE [] END
               ELSE rem END AS final_steps
  FROM last WHERE rk = 1)"""
RESPONSES = "WITH RECURSIVE " + ",\n".join([
    V.V_DOC_TRACES, f"doc_steps AS (SELECT trace_id, question, {S.auto('full_text')} AS steps FROM v_doc_traces)",
    OA.replay_rollout("doc_steps", 3), OA.rubric_layers("ro", ("repeat",), steps="rem", prior="kept"), FINAL, V.V_RESPONSES])

ORACLE["extract_answer"] = RESPONSES + f""" SELECT question_key, {extract('ground_truth')} AS gold_extracted,
  {extract('base_response')} AS base_answer, {extract('pruned_response')} AS pruned_answer FROM v_responses"""

ORACLE["answer_correct"] = RESPONSES + f""" SELECT question_key, {gold('ground_truth')} AS gold,
  {correct('base_response', 'ground_truth')} AS base_correct, {correct('pruned_response', 'ground_truth')} AS pruned_correct
FROM v_responses"""

SAMPLES = RESPONSES + f""", smp AS (
  SELECT r.*, {tokens('base_usage', 'base_response')} AS base_tokens,
         {tokens('pruned_usage', 'pruned_response')} AS pruned_tokens,
         {correct('base_response', 'ground_truth')} AS base_correct, {correct('pruned_response', 'ground_truth')} AS pruned_correct
  FROM v_responses r),
summ AS (
  SELECT benchmark, count(*) AS num_samples, sum(base_tokens) / greatest(count(*), 1) AS base_avg_tokens,
         sum(pruned_tokens) / greatest(count(*), 1) AS pruned_avg_tokens,
         CASE WHEN max(CAST(ground_truth IS NOT NULL AS INTEGER)) = 1 THEN count_if(base_correct) / count(*) END AS base_accuracy,
         CASE WHEN max(CAST(ground_truth IS NOT NULL AS INTEGER)) = 1 THEN count_if(pruned_correct) / count(*) END AS pruned_accuracy
  FROM smp GROUP BY benchmark),
summ2 AS (
  SELECT *, (base_avg_tokens - pruned_avg_tokens) / greatest(base_avg_tokens, 1) * 100.0 AS avg_token_reduction_pct,
         pruned_accuracy - base_accuracy AS accuracy_delta FROM summ)
"""

ORACLE["pair_savings"] = SAMPLES + """SELECT question_key, base_tokens, pruned_tokens,
  round((base_tokens - pruned_tokens) / greatest(base_tokens, 1) * 100.0, 6) AS token_savings_pct FROM smp"""

ORACLE["eval_summary"] = SAMPLES + """SELECT benchmark, num_samples, round(base_avg_tokens, 6) AS base_avg_tokens,
  round(pruned_avg_tokens, 6) AS pruned_avg_tokens, round(base_accuracy, 6) AS base_accuracy,
  round(pruned_accuracy, 6) AS pruned_accuracy, round(avg_token_reduction_pct, 6) AS avg_token_reduction_pct,
  round(accuracy_delta, 6) AS accuracy_delta FROM summ2"""

ORACLE["eval_card"] = SAMPLES + """SELECT benchmark, num_samples,
  CASE WHEN base_accuracy IS NULL THEN 'N/A' ELSE printf('%.1f%%', round_even(base_accuracy * 100.0, 1)) END AS base_accuracy_text,
  CASE WHEN pruned_accuracy IS NULL THEN 'N/A' ELSE printf('%.1f%%', round_even(pruned_accuracy * 100.0, 1)) END AS pruned_accuracy_text,
  CASE WHEN accuracy_delta IS NULL THEN 'N/A' ELSE printf('%+.1f%%', round_even(accuracy_delta * 100.0, 1)) END AS accuracy_delta_text,
  printf('%.1f', round_even(base_avg_tokens, 1)) AS base_avg_tokens_text,
  printf('%.1f', round_even(pruned_avg_tokens, 1)) AS pruned_avg_tokens_text,
  printf('%.1f%%', round_even(avg_token_reduction_pct, 1)) AS token_reduction_text FROM summ2"""

ORACLE["pair_responses"] = V.with_views(V.V_COMPLETIONS, """firstq AS (
  SELECT conv_id AS question_key, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
said AS (SELECT question_key, depth, CASE WHEN error IS NOT NULL THEN 'Error during generation: ' || error ELSE coalesce(text, '') END AS t,
                CASE WHEN error IS NULL THEN usage_tokens END AS u FROM v_completions),
pairs AS (SELECT f.question_key, coalesce(b.t, '') AS base_response, coalesce(p.t, '') AS pruned_response, b.u AS bu, p.u AS pu,
                 (b.t IS NOT NULL)::BIGINT AS base_records, (p.t IS NOT NULL)::BIGINT AS pruned_records
          FROM firstq f LEFT JOIN said b ON b.question_key = f.question_key AND b.depth = 1
               LEFT JOIN said p ON p.question_key = f.question_key AND p.depth = 2)""") + f"""SELECT question_key, base_response, pruned_response,
  base_tokens, pruned_tokens, base_records, pruned_records,
  round((base_tokens - pruned_tokens) / greatest(base_tokens, 1) * 100.0, 6) AS token_savings_pct
FROM (SELECT *, {tokens('bu', 'base_response')} AS base_tokens, {tokens('pu', 'pruned_response')} AS pruned_tokens FROM pairs) x"""

ORACLE["comparison_rows"] = RESPONSES + f""" SELECT question_key,
  'Question: ' || left(question, 60) || '...' AS title,
  {clip('base_response', 300)} AS base_preview, {clip('pruned_response', 300)} AS pruned_preview,
  CAST({S.word_count('base_response')} AS INTEGER) AS base_tokens, CAST({S.word_count('pruned_response')} AS INTEGER) AS pruned_tokens,
  round((1.0 - {S.word_count('pruned_response')} / greatest({S.word_count('base_response')}, 1)) * 100.0, 6) AS token_savings_pct
FROM v_responses"""

ORACLE["stream_transitions"] = RECORDED + f"""SELECT question_key, {OA.example_id("question", "depth")} AS id,
  {OA.input_x("question", "prefix", "steps", "skip_start_idx")} AS input_x, nxt AS target_y, depth,
  array_to_string(steps[skip_start_idx + 1 : skip_end_idx + 1], chr(10)) AS skipped_text, reason AS skip_reason
FROM ran WHERE usable"""

ORACLE["stream_reports"] = RECORDED + f""", made AS (
  SELECT *, CASE WHEN question_key % 5 <> 0 THEN CASE WHEN length(question) < 80 THEN 'short' ELSE 'long' END END AS category,
         coalesce({OA.input_x("question", "prefix", "steps", "skip_start_idx")}, '') = '' AS no_x, coalesce(nxt, '') = '' AS no_y FROM ran)
SELECT category, depth, count(*) AS n_records, CAST(count_if(can_skip) AS BIGINT) AS n_skip, CAST(sum(len(steps)) AS BIGINT) AS n_steps,
  CAST(count_if(usable) AS BIGINT) AS n_transitions, CAST(count_if(usable AND no_x) AS BIGINT) AS empty_input_x, CAST(count_if(usable AND no_y) AS BIGINT) AS empty_target_y,
  CAST(count_if(usable AND NOT no_x AND NOT no_y) AS BIGINT) AS valid_rows FROM made GROUP BY category, depth"""

# The stand-in client answers with the first line of each prompt (the question itself, since there is no prefix at
# depth 1) and fails on prompts of a length divisible by 11.
ORACLE["batch_completion"] = """SELECT question_key, CAST(1 AS INTEGER) AS depth, CASE WHEN n % 11 <> 0 THEN split_part(q, chr(10), 1) END AS text,
  CAST(NULL AS INTEGER) AS usage_tokens, CASE WHEN n % 11 = 0 THEN 'no answer' END AS error
FROM (SELECT """ + V.TURN_KEY + """ AS question_key, text AS q, length(text) AS n FROM conversations WHERE role = 'user') z"""

# The live rollout's stand-ins, written out depth by depth: five steps that name the prompt's length n, the second and
# third left out; no answer when n % 7 = 0, no verdict when the question's length is divisible by 5.
_LIVE_STEPS = "CASE WHEN n % 7 = 0 THEN 1 ELSE 5 END"


def _live_depth(depth: int, source: str) -> str:
    error = "'Error during generation: no answer'"
    skips = "(n % 7 <> 0 AND length(question) % 5 <> 0)"
    return f"""d{depth} AS (
  SELECT question_key, question, prefix, n, CAST({depth} AS INTEGER) AS depth, CAST({_LIVE_STEPS} AS INTEGER) AS n_steps, n % 7 = 0 AS is_error,
         {skips} AS can_skip,
         CASE WHEN n % 7 = 0 THEN {q(OA.R.SHORT_TRACE_REASON)} WHEN length(question) % 5 = 0 THEN 'Decision call error: no verdict' ELSE 'twice' END AS reason,
         CASE WHEN n % 7 = 0 THEN 'short_trace' WHEN length(question) % 5 = 0 THEN 'error' ELSE 'skip' END AS outcome,
         CASE WHEN {skips} THEN question || chr(10) || CASE WHEN prefix <> '' THEN prefix || ' ' ELSE '' END || 'Alpha ' || n || '.' END AS input_x,
         CASE WHEN {skips} THEN 'Gamma ' || n || '.' ELSE '' END AS next_step
  FROM {source})"""


_LIVE_NEXT = """s2 AS (
  SELECT question_key, question, prefix, length(question || chr(10) || chr(10) || '[Previous Steps]:' || chr(10) || prefix || chr(10) || chr(10)
                                               || '[Continue reasoning from here]:') AS n
  FROM (SELECT question_key, question, 'Alpha ' || n || '. Gamma ' || n || '.' AS prefix FROM d1 WHERE can_skip) z)"""
ORACLE["stream_rollout"] = ORACLE["stream_transitions"]

ORACLE["rollout_live"] = V.with_views("""s1 AS (
  SELECT question_key, question, '' AS prefix, length(question) AS n
  FROM (SELECT conv_id AS question_key, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id) z)""",
    _live_depth(1, "s1"), _LIVE_NEXT, _live_depth(2, "s2")) + """SELECT question_key, depth, n_steps, is_error, prefix, can_skip, reason, outcome, input_x, next_step
FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) z"""

ORACLE["user_audit"] = V.with_views(f"st AS (SELECT doc_id AS trace_id, {S.auto('text')} AS steps FROM documents)",
    "c AS (SELECT trace_id, CAST(len(steps) AS INTEGER) AS n_steps FROM st)") + f"""SELECT trace_id, n_steps,
  CASE WHEN n_steps <= 1 THEN 'short_trace' WHEN n_steps % 3 = 0 THEN 'error' WHEN n_steps >= 4 THEN 'skip' ELSE 'no_skip' END AS outcome,
  n_steps >= 4 AND n_steps % 3 <> 0 AS can_skip,
  CAST(CASE WHEN n_steps >= 4 AND n_steps % 3 <> 0 THEN 0 ELSE -1 END AS INTEGER) AS skip_start_idx,
  CAST(CASE WHEN n_steps >= 4 AND n_steps % 3 <> 0 THEN 0 ELSE -1 END AS INTEGER) AS skip_end_idx,
  CASE WHEN n_steps <= 1 THEN {q(OA.R.SHORT_TRACE_REASON)} WHEN n_steps % 3 = 0 THEN 'Decision call error: no verdict'
       WHEN n_steps >= 4 THEN '' ELSE {q(OA.R.NO_SKIP_DEFAULT_REASON)} END AS reason
FROM c"""

# By the contract: of repeated keys the last counts, a huge index is out of range, NaN is truthy, an infinity no index.
ORACLE["reply_edges"] = V.with_views(f"st AS (SELECT doc_id AS trace_id, coalesce(text, '') AS reason_text, {S.auto('text')} AS steps FROM documents)",
    "c AS (SELECT *, trace_id % 4 AS k, len(steps) AS n FROM st)") + f"""SELECT trace_id, CASE WHEN k = 3 THEN 'error' ELSE 'json' END AS parse_status,
  CASE k WHEN 1 THEN '123456789012345678901' WHEN 3 THEN '-1' ELSE '1' END AS start_text, CAST(n AS INTEGER) AS n_steps,
  CASE WHEN k = 3 THEN 'error' WHEN k = 1 OR n < 2 THEN 'invalid_index' ELSE 'skip' END AS outcome,
  (k IN (0, 2) AND n >= 2) AS can_skip,
  CAST(CASE WHEN k IN (0, 2) AND n >= 2 THEN 1 ELSE -1 END AS INTEGER) AS skip_start_idx,
  CAST(CASE WHEN k IN (0, 2) AND n >= 2 THEN 1 ELSE -1 END AS INTEGER) AS skip_end_idx,
  CASE WHEN k = 3 THEN {q(OA.R.ERROR_REASON)}
       WHEN k = 1 THEN 'Invalid skip index: 123456789012345678901 outside [0, ' || CAST(n - 1 AS VARCHAR) || '].'
       WHEN n < 2 THEN 'Invalid skip index: 1 outside [0, ' || CAST(n - 1 AS VARCHAR) || '].' ELSE reason_text END AS reason
FROM c"""
