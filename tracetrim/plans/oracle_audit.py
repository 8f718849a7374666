"""DuckDB SQL builders for the audit / rubric / rollout oracles."""

from __future__ import annotations

from tracetrim.functions import reply as R
from tracetrim.operators import rubric as RB
from tracetrim.plans import sqlfrag as S


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BRACE = r"(?s)\{.*?\}"
SCALAR = (r'[ \t\n\r]*(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|"(?:[^"\\]|\\.)*"'
          r"|true|false|null|NaN|-?Infinity)[ \t\n\r]*")
ARRAY = r"(?s)[ \t\n\r]*\[.*\][ \t\n\r]*"


def payload(r: str) -> str:
    return (f"CASE WHEN regexp_matches({r}, {_q(FENCED)}) THEN regexp_extract({r}, {_q(FENCED)}, 1) "
            f"WHEN regexp_matches({r}, {_q(BRACE)}) THEN regexp_extract({r}, {_q(BRACE)}, 0) ELSE {r} END")


def payload_kind(r: str) -> str:
    return (f"CASE WHEN regexp_matches({r}, {_q(FENCED)}) THEN 'fenced' "
            f"WHEN regexp_matches({r}, {_q(BRACE)}) THEN 'brace' ELSE 'raw' END")


def fallback_can_skip(r: str) -> str:
    return f"(contains(lower({r}), 'true') AND NOT contains(left(lower({r}), 30), 'false'))"


def _int_of(j: str, path: str) -> str:
    t = f"json_type({j}, '{path}')"
    v = f"({j}->>'{path}')"
    return (f"CASE WHEN {t} IN ('BIGINT', 'UBIGINT') THEN TRY_CAST({v} AS INTEGER) "
            f"WHEN {t} = 'DOUBLE' THEN TRY_CAST(trunc(CAST({v} AS DOUBLE)) AS INTEGER) "
            f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {v} = 'true' THEN 1 ELSE 0 END "
            f"WHEN {t} = 'VARCHAR' AND regexp_full_match(trim({v}), '[+-]?[0-9]+') THEN TRY_CAST(trim({v}) AS INTEGER) "
            f"ELSE NULL END")


def parsed_layers(src: str, raw: str = "raw_response") -> str:
    """CTE text: p1..p3 over ``src``; p3 has ps, pcan, pstart, pend, preason."""
    return f"""p1 AS (
  SELECT *, coalesce({raw}, '') AS _r FROM {src}),
p2a AS (
  SELECT *, {payload('_r')} AS _j0,
         (regexp_matches(_r, {_q(FENCED)}) OR regexp_matches(_r, {_q(BRACE)})) AS _shape FROM p1),
p2 AS (
  SELECT *, CASE WHEN json_valid(_j0) THEN _j0 ELSE 'null' END AS _j, json_valid(_j0) AS _valid,
         CASE WHEN json_valid(_r) THEN _r ELSE 'null' END AS _rv FROM p2a),
p2b AS (
  SELECT *, CASE WHEN _shape AND NOT _valid THEN 'fallback'
                 WHEN _shape AND json_type(_j) <> 'OBJECT' THEN 'error'
                 WHEN _shape THEN 'object'
                 WHEN regexp_full_match(_r, {_q(SCALAR)}) OR (regexp_full_match(_r, {_q(ARRAY)}) AND json_type(_rv) = 'ARRAY') THEN 'error'
                 ELSE 'fallback' END AS _kind FROM p2),
p2c AS (
  SELECT *,
    CASE WHEN _kind <> 'object' THEN false
         WHEN json_type(_j, '$.can_skip') IS NULL OR json_type(_j, '$.can_skip') = 'NULL' THEN false
         WHEN json_type(_j, '$.can_skip') = 'BOOLEAN' THEN (_j->>'$.can_skip') = 'true'
         WHEN json_type(_j, '$.can_skip') = 'VARCHAR' THEN length(_j->>'$.can_skip') > 0
         WHEN json_type(_j, '$.can_skip') = 'ARRAY' THEN json_array_length(_j, '$.can_skip') > 0
         WHEN json_type(_j, '$.can_skip') = 'OBJECT' THEN CAST(_j->'$.can_skip' AS VARCHAR) <> '{{}}'
         ELSE coalesce(TRY_CAST(_j->>'$.can_skip' AS DOUBLE) <> 0, false) END AS _can,
    CASE WHEN _kind <> 'object' THEN NULL WHEN json_type(_j, '$.skip_start_idx') IS NULL THEN -1
         ELSE {_int_of('_j', '$.skip_start_idx')} END AS _start,
    json_type(_j, '$.skip_end_idx') AS _endt,
    json_type(_j, '$.reason') AS _rt,
    CASE WHEN json_type(_j, '$.reason') = 'VARCHAR' THEN _j->>'$.reason'
         WHEN json_type(_j, '$.reason') = 'BOOLEAN' THEN CASE WHEN _j->>'$.reason' = 'true' THEN 'True' ELSE 'False' END
         ELSE CAST(_j->'$.reason' AS VARCHAR) END AS _rtext
  FROM p2b),
p2d AS (
  SELECT *, CASE WHEN _endt IS NULL THEN _start ELSE {_int_of('_j', '$.skip_end_idx')} END AS _end FROM p2c),
p3 AS (
  SELECT *,
    CASE WHEN _kind = 'fallback' THEN 'fallback' WHEN _kind = 'error' THEN 'error' WHEN NOT _can THEN 'json'
         WHEN _start IS NULL OR _end IS NULL THEN 'error' ELSE 'json' END AS ps,
    CASE WHEN _kind = 'fallback' THEN {fallback_can_skip('_r')} WHEN _kind = 'error' THEN false WHEN NOT _can THEN false
         WHEN _start IS NULL OR _end IS NULL THEN false ELSE true END AS pcan,
    CASE WHEN _kind = 'object' AND _can AND _start IS NOT NULL AND _end IS NOT NULL THEN _start ELSE -1 END AS pstart,
    CASE WHEN _kind = 'object' AND _can AND _start IS NOT NULL AND _end IS NOT NULL THEN _end ELSE -1 END AS pend,
    CASE WHEN _kind = 'fallback' THEN {_q(R.FALLBACK_REASON)}
         WHEN _kind = 'error' THEN {_q(R.ERROR_REASON)}
         WHEN NOT _can THEN CASE WHEN _rt IS NULL THEN {_q(R.NO_SKIP_DEFAULT_REASON)} WHEN _rt = 'NULL' THEN NULL ELSE _rtext END
         WHEN _start IS NULL OR _end IS NULL THEN {_q(R.ERROR_REASON)}
         ELSE CASE WHEN _rt IS NULL THEN '' WHEN _rt = 'NULL' THEN 'None' ELSE _rtext END END AS preason
  FROM p2d)"""


def validated_layer(src: str = "p3", steps: str = "steps", guard: bool = False, raw: str = "raw_response") -> str:
    """CTE v1 over ``src`` (needs ps, pcan, pstart, pend, preason and ``steps``)."""
    n = f"len({steps})"
    endf = f"(CASE WHEN pend < pstart OR pend >= {n} THEN pstart ELSE pend END)"
    g_out = f"WHEN {n} <= 1 THEN 'short_trace' WHEN {raw} IS NULL THEN 'missing' " if guard else ""
    g_reason = (f"WHEN {n} <= 1 THEN {_q(R.SHORT_TRACE_REASON)} WHEN {raw} IS NULL THEN {_q(R.MISSING_REPLY_REASON)} "
                if guard else "")
    g_false = f"WHEN {n} <= 1 OR {raw} IS NULL THEN " if guard else None

    def pick(fallback, error, noskip, invalid, whole, ok, guarded=None):
        pre = f"{g_false}{guarded} " if guard and guarded is not None else ""
        return (f"CASE {pre}WHEN ps = 'fallback' THEN {fallback} WHEN ps = 'error' THEN {error} WHEN NOT pcan THEN {noskip} "
                f"WHEN pstart < 0 OR pstart >= {n} THEN {invalid} "
                f"WHEN {endf} >= {n} - 1 AND pstart = 0 AND {n} > 1 THEN {whole} ELSE {ok} END")

    outcome = pick("'fallback'", "'error'", "'no_skip'", "'invalid_index'", "'whole_trace'", "'skip'")
    if guard:
        outcome = f"CASE {g_out}ELSE {outcome} END"
    can = pick("pcan", "false", "false", "false", "false", "true", guarded="false")
    start = pick("-1", "-1", "-1", "-1", "-1", "pstart", guarded="-1")
    end = pick("-1", "-1", "-1", "-1", "-1", endf, guarded="-1")
    invalid_reason = f"printf('Invalid skip index: %d outside [0, %d].', pstart, {n} - 1)"
    reason = pick("preason", "preason", "preason", invalid_reason, _q(R.ALL_STEPS_REASON), "preason")
    if guard:
        reason = f"CASE {g_reason}ELSE {reason} END"
    return f"""v1 AS (
  SELECT *, {outcome} AS outcome, {can} AS can_skip, CAST({start} AS INTEGER) AS skip_start_idx,
         CAST({end} AS INTEGER) AS skip_end_idx, {reason} AS reason FROM {src})"""


DECISION_COLS = "CAST(len(steps) AS INTEGER) AS n_steps, outcome, can_skip, skip_start_idx, skip_end_idx, reason"


def span_cols(steps: str = "steps") -> str:
    usable = "(can_skip AND skip_start_idx >= 0)"
    sk = f"(CASE WHEN {usable} THEN {steps}[skip_start_idx + 1 : skip_end_idx + 1] ELSE [] END)"
    return (f"CAST(len({sk}) AS INTEGER) AS n_skipped, array_to_string({sk}, chr(10)) AS skipped_text, "
            f"CASE WHEN {usable} THEN coalesce({steps}[skip_end_idx + 2], '') ELSE '' END AS next_step")


# ------------------------------------------------------------------ rubric

def _tokens(norm: str) -> str:
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda w: w <> ''))"


def _sim(a: str, b: str, pct: int) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"(len({a}) > 0 AND len({b}) > 0 AND {inter} * 100 >= {pct} * (len({a}) + len({b}) - {inter}))"


def rubric_layers(src: str, rules=("repeat",), steps: str = "steps", question: str | None = "question",
                  prior: str | None = None, overlap_pct: int = 80, restate_pct: int = 60, suffix: str = "") -> str:
    """CTEs r1{suffix}..r3{suffix}: adds outcome, can_skip, skip_start_idx, skip_end_idx, reason."""
    n = f"len({steps})"
    prior_norms = f"list_transform({prior}, lambda s: {S.norm_step('s')})" if prior else "[]"
    conds = {}
    conds["repeat"] = ("(_norms[i + 1] <> '' AND (list_position(_norms, _norms[i + 1]) < i + 1 "
                       "OR list_contains(_pnorms, _norms[i + 1])))")
    conds["overlap"] = f"coalesce(list_bool_or(list_transform(range(i), lambda j: {_sim('_toks[j + 1]', '_toks[i + 1]', overlap_pct)})), false)"
    conds["restate"] = _sim("_qtok", "_toks[i + 1]", restate_pct)
    conds["filler"] = f"regexp_matches(lower({steps}[i + 1]), {_q(RB.FILLER_RE)})"
    active = [r for r in RB.RULES if r in rules]
    flag = " OR ".join(conds[r] for r in active)
    qexpr = f"coalesce({question}, '')" if question else "''"
    reason = "CASE " + " ".join(
        f"WHEN {conds[r].replace('i + 1', 'st + 1').replace('range(i)', 'range(st)')} THEN {_q(RB.REASONS[r])}"
        for r in active) + " END"
    return f"""r1{suffix} AS (
  SELECT *, list_transform({steps}, lambda s: {S.norm_step('s')}) AS _norms, {prior_norms} AS _pnorms,
         list_transform({steps}, lambda s: {_tokens(S.norm_step('s'))}) AS _toks,
         {_tokens(S.norm_step(qexpr))} AS _qtok FROM {src}),
r2{suffix} AS (
  SELECT *, list_transform(range({n}), lambda i: i < {n} - 1 AND ({flag})) AS _flags FROM r1{suffix}),
r2b{suffix} AS (
  SELECT *, coalesce(list_position(_flags, true), 0) - 1 AS st FROM r2{suffix}),
r2c{suffix} AS (
  SELECT *, CASE WHEN st >= 0 THEN st + list_position(_flags[st + 1 :], false) - 2 END AS en FROM r2b{suffix}),
r3{suffix} AS (
  SELECT * EXCLUDE (_norms, _pnorms, _toks, _qtok, _flags, st, en),
    CASE WHEN {n} <= 1 THEN 'short_trace' WHEN st < 0 THEN 'no_skip' ELSE 'skip' END AS outcome,
    ({n} > 1 AND st >= 0) AS can_skip,
    CAST(CASE WHEN {n} > 1 AND st >= 0 THEN st ELSE -1 END AS INTEGER) AS skip_start_idx,
    CAST(CASE WHEN {n} > 1 AND st >= 0 THEN en ELSE -1 END AS INTEGER) AS skip_end_idx,
    CASE WHEN {n} <= 1 THEN {_q(R.SHORT_TRACE_REASON)} WHEN st < 0 THEN {_q(RB.NO_MATCH_REASON)} ELSE {reason} END AS reason
  FROM r2c{suffix})"""


# ------------------------------------------------------------------ transitions

def input_x(question: str, prefix: str, steps: str, start: str) -> str:
    useful = S.strip(f"array_to_string({steps}[1 : greatest({start}, 0)], ' ')")
    p = S.strip(f"coalesce({prefix}, '')")
    fp = f"(CASE WHEN {p} <> '' AND {useful} <> '' THEN {p} || ' ' || {useful} WHEN {p} <> '' THEN {p} ELSE {useful} END)"
    q = f"coalesce({question}, '')"
    return f"(CASE WHEN {fp} <> '' THEN {S.strip(f'{q} || chr(10) || {fp}')} ELSE {q} END)"


def example_id(question: str, depth: str) -> str:
    head = f"replace({S.strip(f'left(coalesce({question}, {chr(39) * 2}), 12)')}, ' ', '_')"
    return f"('trans_' || {head} || '_d' || CAST({depth} AS VARCHAR))"


# ------------------------------------------------------------------ replay rollout (recursive CTE)

def replay_rollout(base: str, max_depth: int = 3) -> str:
    """CTE ``ro``: one row per (trace_id, depth) state over ``base(trace_id, question, steps)``
    with the exact-repeat rubric; the recursive term recomputes the decision per state."""
    norm = S.norm_step("s")
    flag = ("i < len(rem) - 1 AND _norms[i + 1] <> '' AND (list_position(_norms, _norms[i + 1]) < i + 1 "
            "OR list_contains(_pnorms, _norms[i + 1]))")
    kn = ("(rem[1 : st] || CASE WHEN coalesce(rem[en + 2], '') <> '' THEN [rem[en + 2]] ELSE [] END)")
    ctx = S.strip(f"array_to_string({kn}, ' ')")
    new_prefix = f"(CASE WHEN prefix <> '' THEN {S.strip(f'prefix || {chr(39)} {chr(39)} || {ctx}')} ELSE {ctx} END)"
    return f"""ro AS (
  SELECT trace_id, question, 1 AS depth, steps AS rem, CAST([] AS VARCHAR[]) AS kept, '' AS prefix FROM {base}
  UNION ALL
  SELECT trace_id, question, depth + 1, rem[en + 3 :], kept || {kn}, {new_prefix}
  FROM (SELECT *, CASE WHEN st >= 0 THEN st + list_position(_flags[st + 1 :], false) - 2 END AS en
        FROM (SELECT *, coalesce(list_position(_flags, true), 0) - 1 AS st
              FROM (SELECT *, list_transform(range(len(rem)), lambda i: {flag}) AS _flags
                    FROM (SELECT *, list_transform(rem, lambda s: {norm}) AS _norms,
                                 list_transform(kept, lambda s: {norm}) AS _pnorms FROM ro) a) b) c) d
  WHERE st >= 0 AND en + 1 < len(rem) - 1 AND depth < {max_depth})"""
