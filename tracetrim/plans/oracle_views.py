"""DuckDB SQL for the derived views (same rows as ``tracetrim.sources.views``)."""

from tracetrim.sources.views import REPLY_CASES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TURN_KEY = "lpad(CAST(conv_id AS VARCHAR), 19, '0') || '-' || lpad(CAST(turn AS VARCHAR), 19, '0')"


def reply_sql(number: str, text: str, cases=REPLY_CASES) -> str:
    """The reply form ``number % len(cases)`` around ``text``."""
    body = f"coalesce({text}, '')"
    forms = {"inside": "{h} || CAST(to_json({b}) AS VARCHAR) || {t}", "before": "{b} || {t}", "after": "{h} || {b} || {t}"}
    return f"CASE ({number}) % {len(cases)} " + " ".join(
        f"WHEN {k} THEN " + forms[how].format(h=_q(head), t=_q(tail), b=body) for k, (how, head, tail) in enumerate(cases)) + " END"

V_TRACES = """v_traces AS (
  SELECT lpad(CAST(conv_id AS VARCHAR), 19, '0') || '-' || lpad(CAST(turn AS VARCHAR), 19, '0') AS trace_id, text AS question, next_text AS full_text
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations) z
  WHERE role = 'user' AND next_role = 'assistant')"""

V_DOC_TRACES = """v_doc_traces AS (
  SELECT doc_id AS trace_id,
         'Summarise document ' || CAST(doc_id AS VARCHAR) || ' from ' || source AS question,
         text AS full_text, lang AS category, source AS source_dataset,
         CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 10 = 8 THEN 'B' ELSE '#### ' || CAST(doc_id * 7 AS VARCHAR) END AS ground_truth
  FROM documents)"""

V_REPLIES = f"""v_replies AS (
  SELECT doc_id AS trace_id, {reply_sql('doc_id', 'text')} AS raw_response
  FROM documents)"""

V_COMPLETIONS = """v_completions AS (
  SELECT conv_id AS question_key,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS depth, text,
         CASE WHEN conv_id % 3 = 0 THEN NULL ELSE CAST(floor(length(text) / 4.0) AS INTEGER) END AS usage_tokens,
         CASE WHEN (conv_id + turn) % 17 = 0 THEN 'timeout' END AS error
  FROM conversations WHERE role = 'assistant')"""

V_STRUCTURED = """v_structured AS (
  SELECT p_partkey AS text_id, CASE p_partkey % 4
    WHEN 0 THEN 'Step 1: Take ' || p_name || '.' || chr(10) || 'Step 2: Check size ' || CAST(p_size AS VARCHAR) || '. Then stop.' || chr(10) || '3) Done.'
    WHEN 1 THEN 'Plan for ' || p_name || '.' || chr(10) || chr(10) || 'The brand is ' || p_brand || '. Fine.' || chr(10) || chr(10) || 'Finished.'
    WHEN 2 THEN '1. only one marker ' || p_name || '. Size is ' || CAST(p_size AS VARCHAR) || '.5 units. next is lower. "Quoted" end!'
    ELSE '  ' || p_name || chr(10) || p_brand || chr(10) || chr(10) || '  ' END AS text
  FROM part)"""

V_CHOICE = """v_choice AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 19, '0') AS item_id, p_name AS question,
         {'label': ['A', 'B', 'C'], 'text': [p_brand, p_type, CAST(p_size AS VARCHAR)]} AS choices,
         CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS answerKey
  FROM part)"""

V_CONTEXT = """v_context AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 19, '0') AS item_id, text AS context, 'Which language is this?' AS question, lang AS answer
  FROM documents)"""

# over ``fin``: the final steps of each document's rollout
V_RESPONSES = """v_responses AS (
  SELECT doc_id AS question_key, source AS benchmark,
    'Summarise document ' || CAST(doc_id AS VARCHAR) || ' from ' || source AS question,
    CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 10 = 8 THEN 'B' ELSE '#### ' || CAST(doc_id * 7 AS VARCHAR) END AS ground_truth,
    CASE doc_id % 5 WHEN 0 THEN text || ' #### ' || CAST(doc_id * 7 AS VARCHAR)
                    WHEN 1 THEN text || ' so \\boxed{' || CAST(doc_id * 7 AS VARCHAR) || '}'
                    WHEN 2 THEN text || ' The answer is ' || CAST(doc_id * 7 AS VARCHAR) || '.'
                    WHEN 3 THEN text || ' giving 12 then ' || CAST(doc_id * 7 AS VARCHAR)
                    ELSE text END AS base_response,
    CASE doc_id % 3 WHEN 0 THEN array_to_string(fin.final_steps, ' ') || ' Final answer: ' || CAST(doc_id * 7 AS VARCHAR)
                    WHEN 1 THEN array_to_string(fin.final_steps, ' ') || ' #### 1,' || CAST(100 + doc_id % 900 AS VARCHAR)
                    ELSE array_to_string(fin.final_steps, ' ') END AS pruned_response,
    CASE WHEN doc_id % 6 = 0 THEN 0 ELSE CAST(floor(n_chars / 4.0) AS INTEGER) END AS base_usage,
    CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(floor(n_chars / 9.0) AS INTEGER) END AS pruned_usage
  FROM documents JOIN fin ON fin.trace_id = doc_id)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
