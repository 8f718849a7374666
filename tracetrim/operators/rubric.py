"""Deterministic first-skippable-span auditor (a rubric in place of a judging model).

A step i (0-based) is *flagged* when it is not the last step and one of the enabled
rules holds:

* ``repeat``   its normalised text equals an earlier step of the trace or a step already
               kept in the prefix (empty normal forms never match);
* ``overlap``  the Jaccard overlap of its distinct words with some earlier step is at
               least ``overlap_pct`` percent;
* ``restate``  the Jaccard overlap with the question is at least ``restate_pct`` percent;
* ``filler``   it opens with conversational filler / meta commentary.

The span is the first flagged step extended over the following consecutive flagged
steps; the reason names the rule that flagged the first step.  The last step is never
flagged, so the target step always exists.

Everything is row-local: exact repeats use one ``array_sort`` over (norm, index) pairs
(O(n log n) per trace); overlaps are looked up by each step's rarest words and verified.
Lambdas only touch their own arguments so no array is re-evaluated per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.text import col_, let, normalise_step
from tracetrim.operators.audit import decision, no_skip
from tracetrim.functions.reply import SHORT_TRACE_REASON

RULES = ("repeat", "overlap", "restate", "filler")

# Rubric reasons and the filler openings (lower case, at the start of a step).
REASONS = {
    "repeat": "Repeats a step that is already established.",
    "overlap": "Largely restates an earlier step.",
    "restate": "Restates the question.",
    "filler": "Conversational filler or meta-commentary.",
}
NO_MATCH_REASON = "No step matched the skip rubric."
FILLER_OPENINGS = (
    "let me", "let us", "let's see", "hmm", "wait", "okay", "ok", "alright", "so basically", "as mentioned",
    "as noted", "as stated", "to recap", "in other words", "i think", "double-check", "just to be sure",
)
# An opening followed by a non letter/digit (or the end); no \b, whose meaning differs by regex engine.
FILLER_RE = "^(" + "|".join(FILLER_OPENINGS) + ")(?:[^\\p{L}\\p{N}_]|\\z)"


def _tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " ", -1), lambda w: w != F.lit("")))


def _similar(a: Column, b: Column, pct: int) -> Column:
    """Jaccard(a, b) >= pct% on distinct tokens.  The size test first: Jaccard can only
    reach pct% when the smaller set is at least pct% of the larger one."""
    sa, sb = F.size(a), F.size(b)
    inter = F.size(F.array_intersect(a, b))
    return ((sa > 0) & (sb > 0) & (F.least(sa, sb) * 100 >= F.lit(pct) * F.greatest(sa, sb))
            & (inter * (100 + pct) >= F.lit(pct) * (sa + sb)))


def repeat_indices(steps, prior=None, norms=None) -> Column:
    """Indices of steps whose normal form already occurred (earlier in the trace or in prior); ``norms``: the normal forms, if there."""
    norms = F.transform(F.transform(col_(steps), normalise_step) if norms is None else norms, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    if prior is not None:
        prior_tagged = F.transform(col_(prior), lambda s: F.struct(normalise_step(s).alias("k"), F.lit(-1).alias("i")))
        norms = F.concat(prior_tagged, norms)

    def hits(srt):
        shifted = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("k"), F.lit(-2).alias("i"))), srt)
        return F.filter(F.zip_with(srt, shifted, lambda cur, prev: F.when(
            (cur["i"] >= 0) & (cur["k"] != F.lit("")) & (cur["k"] == prev["k"]), cur["i"])), lambda x: x.isNotNull())
    return let(F.sort_array(norms), hits)


def _runs(rows: Column, key: str) -> Column:
    """A sorted array of structs cut into arrays of equal ``key``.  ``rows`` is a lambda's own argument."""
    at = F.filter(F.transform(rows, lambda e, k: F.when(
        (k == 0) | (e[key] != F.get(rows, k - 1)[key]), k)), lambda k: k.isNotNull())
    return let(at, lambda S: F.transform(S, lambda s, r: F.slice(rows, s + 1, F.coalesce(F.get(S, r + 1), F.size(rows)) - s)))


def step_tokens(norms: Column) -> Column:
    """The distinct words of each step's normal form; none of a null step."""
    return F.transform(norms, lambda k: F.coalesce(_tokens(k), F.array().cast("array<string>")))


def may_overlap(toks: Column, pct: int) -> Column:
    """The steps' words, but none where fewer than ``pct`` percent of them stand in another step: all that two overlapping steps share does."""
    def several(T):
        return let(F.sort_array(F.flatten(T)), lambda A: F.array_distinct(F.filter(A, lambda w, k: w == F.get(A, k - 1))))

    return let(toks, lambda T: let(several(T), lambda D: F.transform(T, lambda t: F.when(
        F.size(F.array_intersect(t, D)) * 100 >= F.size(t) * pct, t).otherwise(F.array().cast("array<string>")))))


def overlap_indices(steps, pct: int = 80, toks=None) -> Column:
    """Indices of steps whose words overlap an earlier step's by ``pct`` percent or more (Jaccard), ascending;
    ``toks``: the steps' words, if there.

    Exact prefix filter inside the row: two such steps share one of their rarest words, namely one of the
    first ``size - ceil(size * pct / 100) + 1`` in the order (count in the trace, word).  Those words lead to the
    steps that have them, and only these are compared; a step stops at its first partner.
    """
    if not 1 <= pct <= 100:
        raise ValueError(f"overlap_pct must lie in 1 to 100: {pct}")
    toks = step_tokens(F.transform(col_(steps), normalise_step)) if toks is None else toks

    def prefix(g):
        return F.slice(g, 1, F.size(g) - F.floor((F.size(g) * pct + 99) / 100).cast("int") + 1)

    def by_step(by_word):
        """(step, count, word number) of every word, rarest first within a step."""
        return F.sort_array(F.flatten(F.transform(by_word, lambda g, w: F.transform(
            g, lambda e: F.struct(e["i"].alias("i"), F.size(g).alias("n"), w.alias("w"))))))

    def rare(groups):
        """(word number, step) of every step's prefix."""
        return F.sort_array(F.flatten(F.transform(groups, lambda g: F.transform(
            prefix(g), lambda e: F.struct(e["w"].alias("w"), e["i"].alias("i"))))))

    def lists_of(postings):
        """(step, place of the word's list) of every prefix word."""
        return F.sort_array(F.flatten(F.transform(postings, lambda g, q: F.transform(
            g, lambda e: F.struct(e["i"].alias("i"), q.alias("q"))))))

    def hits(T, postings, own):
        return F.filter(F.transform(own, lambda g: F.when(F.exists(g, lambda e: F.exists(
            F.get(postings, e["q"]), lambda c: (c["i"] < e["i"]) & _similar(F.get(T, c["i"]), F.get(T, e["i"]), pct))),
            F.get(g, F.lit(0))["i"])), lambda i: i.isNotNull())

    def found(T):
        words = F.sort_array(F.flatten(F.transform(T, lambda t, i: F.transform(t, lambda w: F.struct(w.alias("w"), i.alias("i"))))))
        return let(words, lambda W: let(by_step(_runs(W, "w")), lambda B: let(rare(_runs(B, "i")), lambda R: let(
            _runs(R, "w"), lambda P: let(lists_of(P), lambda L: hits(T, P, _runs(L, "i")))))))

    return let(may_overlap(toks, pct), found)


def _restate_indices(toks, question, pct: int) -> Column:
    """Indices of steps (their words) whose words overlap the question's by ``pct`` percent or more."""
    qtok = _tokens(normalise_step(F.coalesce(col_(question), F.lit("")))) if question is not None else F.array().cast("array<string>")
    return let(qtok, lambda Q: F.filter(F.transform(toks, lambda t, i: F.when(
        _similar(Q, t, pct), i)), lambda i: i.isNotNull()))


def with_rubric_decision(df: DataFrame, steps_col: str = "steps", question_col: str | None = "question",
                         prior_col: str | None = None, rules=("repeat",), overlap_pct: int = 80,
                         restate_pct: int = 60, out: str = "decision") -> DataFrame:
    """Adds the rubric decision ``out``; intermediates are staged as columns so each is
    computed once per row."""
    unknown = set(rules) - set(RULES)
    if unknown or not rules:
        raise ValueError(f"unknown or empty rubric rules: {sorted(unknown)}")
    t = f"_{out}_"
    s = F.col(steps_col)
    n = F.size(s)
    parts, per_rule = [], {}
    # several rules read the normal forms and words
    norms, toks = F.col(t + "norm"), F.col(t + "toks")
    df = df.withColumn(t + "norm", F.transform(s, normalise_step)).withColumn(t + "toks", step_tokens(norms))
    if "repeat" in rules:
        per_rule[t + "rep"] = repeat_indices(s, F.col(prior_col) if prior_col else None, norms)
        parts.append(F.col(t + "rep"))
    if "overlap" in rules:
        per_rule[t + "over"] = overlap_indices(s, overlap_pct, toks)
        parts.append(F.col(t + "over"))
    if "restate" in rules:
        per_rule[t + "rest"] = _restate_indices(toks, F.col(question_col) if question_col else None, restate_pct)
        parts.append(F.col(t + "rest"))
    if "filler" in rules:
        per_rule[t + "fill"] = F.transform(s, lambda x: F.lower(x).rlike(FILLER_RE))
        parts.append(F.filter(F.transform(F.col(t + "fill"), lambda b, i: F.when(b, i)), lambda x: x.isNotNull()))
    df = df.withColumns(per_rule)  # the rules are independent: one projection
    flagged = parts[0] if len(parts) == 1 else F.concat(*parts)
    df = df.withColumn(t + "flag", F.sort_array(F.array_distinct(F.filter(flagged, lambda i: i < n - 1))))
    run = F.aggregate(
        F.col(t + "flag"),
        F.struct(F.lit(-2).alias("s"), F.lit(-2).alias("e")),
        lambda acc, x: F.when(acc["s"] == -2, F.struct(x.alias("s"), x.alias("e")))
        .when(x == acc["e"] + 1, F.struct(acc["s"].alias("s"), x.alias("e")))
        .otherwise(acc),
    )
    df = df.withColumn(t + "run", run)
    start, end = F.col(t + "run.s"), F.col(t + "run.e")

    ordered = []
    if "repeat" in rules:
        ordered.append((F.array_contains(F.col(t + "rep"), start), REASONS["repeat"]))
    if "overlap" in rules:
        ordered.append((F.array_contains(F.col(t + "over"), start), REASONS["overlap"]))
    if "restate" in rules:
        ordered.append((F.array_contains(F.col(t + "rest"), start), REASONS["restate"]))
    if "filler" in rules:
        ordered.append((F.element_at(F.col(t + "fill"), start + 1), REASONS["filler"]))
    reason = None
    for cond, text in ordered:
        reason = F.when(cond, F.lit(text)) if reason is None else reason.when(cond, F.lit(text))

    dec = (
        F.when(n <= 1, no_skip(SHORT_TRACE_REASON, "short_trace"))
        .when(F.size(F.col(t + "flag")) == 0, no_skip(NO_MATCH_REASON, "no_skip"))
        .otherwise(decision(True, start, end, reason, "skip"))
    )
    df = df.withColumn(out, dec)
    return df.drop(*[c for c in df.columns if c.startswith(t)])
