"""Row formatting (B1-B8): benchmark rows -> (question, ground_truth), prompts, SFT text.

The dispatch follows the column layout of the source (which columns exist and their
types) and, row by row, which values are present:
multiple choice -> body + question -> string context -> plain question/answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetrim.functions.text import col_, py_strip


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _str(c: Column) -> Column:
    """``str(x)`` for a value that may be null: None -> 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _first_truthy(df: DataFrame, names) -> Column:
    """``row.get(a) or row.get(b) or ... or ""`` over the columns that exist."""
    present = [_truthy_text(df, n) for n in names if _has(df, n)]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def _truthy_text(df: DataFrame, name: str) -> Column:
    """The value as text; null for what counts as absent: empty text, and a number 0 or false."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True"))
    if isinstance(kind, T.NumericType):
        return F.when(c != 0, c.cast("string"))
    return F.nullif(c.cast("string"), F.lit(""))


def _struct_has(df: DataFrame, col: str, fields) -> bool:
    if not _has(df, col):
        return False
    dt = df.schema[col].dataType
    return isinstance(dt, T.StructType) and all(f in dt.fieldNames() for f in fields)


def multiple_choice(df: DataFrame):
    """B1: "stem (A) x (B) y ..."; labels and texts are paired up to the shorter list."""
    labels, texts = F.col("choices.label"), F.col("choices.text")
    m = F.least(F.size(labels), F.size(texts))
    pairs = F.zip_with(F.slice(labels, 1, m), F.slice(texts, 1, m),
                       lambda l, t: F.concat(F.lit("("), _str(l), F.lit(") "), _str(t)))
    stem = py_strip(_first_truthy(df, ["question", "question_stem"]))
    q = py_strip(F.concat(stem, F.lit(" "), F.array_join(pairs, " ")))
    a = _first_truthy(df, ["answerKey", "answer"])
    cond = F.col("choices").isNotNull() & labels.isNotNull() & texts.isNotNull()
    return cond, q, a


def body_question(df: DataFrame):
    """B2: "{Body} {Question}", answer = Answer."""
    q = py_strip(F.concat(py_strip(_str(F.col("Body"))), F.lit(" "), py_strip(_str(F.col("Question")))))
    a = _str(F.col("Answer")) if _has(df, "Answer") else F.lit("")
    return F.lit(True), q, a


def context_question(df: DataFrame):
    """Context cut to 300 characters at the last space (+ "..."), then the question."""
    ctx = py_strip(F.col("context"))
    cut = F.concat(F.regexp_replace(F.substring(ctx, 1, 300), "(?s) [^ ]*\\z", ""), F.lit("..."))
    ctx = F.when(F.length(ctx) > 300, cut).otherwise(ctx)
    q = F.concat(F.lit("Context: "), ctx, F.lit("\n\nQuestion: "), py_strip(_str(F.col("question"))))
    if _struct_has(df, "answers", ["text"]):
        # answers present: its first text (str() of it), "" when the list is empty or missing
        texts = F.col("answers.text")
        a = F.when(F.col("answers").isNotNull(), F.when(F.coalesce(F.size(texts), F.lit(0)) > 0,
                                                        _str(F.try_element_at(texts, F.lit(1)))).otherwise(F.lit("")))
        if _has(df, "answer"):
            a = a.otherwise(_str(F.col("answer")))
        else:
            a = a.otherwise(F.lit(""))
    elif _has(df, "answer"):
        a = _str(F.col("answer"))
    else:
        a = F.lit("")
    return F.col("context").isNotNull(), q, a


def plain(df: DataFrame):
    """First non-empty of question/problem/prompt and of answer/correct_answer/ground_truth."""
    q = py_strip(_first_truthy(df, ["question", "problem", "prompt"]))
    a = py_strip(_first_truthy(df, ["answer", "correct_answer", "ground_truth"]))
    return F.lit(True), q, a


def format_rows(df: DataFrame) -> DataFrame:
    """Add ``question_text`` and ``answer_text`` by the first matching layout."""
    rules = []
    if _struct_has(df, "choices", ["label", "text"]):
        rules.append(multiple_choice(df))
    if _has(df, "Body") and _has(df, "Question"):
        rules.append(body_question(df))
    if _has(df, "context") and isinstance(df.schema["context"].dataType, T.StringType) and _has(df, "question"):
        rules.append(context_question(df))
    rules.append(plain(df))
    q = a = None
    for cond, qq, aa in rules:
        q = F.when(cond, qq) if q is None else q.when(cond, qq)
        a = F.when(cond, aa) if a is None else a.when(cond, aa)
    return df.withColumn("question_text", q).withColumn("answer_text", a)


def continuation_prompt(question, prefix) -> Column:
    """The generator prompt for continuing from a kept prefix."""
    p = F.coalesce(col_(prefix), F.lit(""))
    return F.when(py_strip(p) != "", F.concat(
        col_(question), F.lit("\n\n[Previous Steps]:\n"), p, F.lit("\n\n[Continue reasoning from here]:"))).otherwise(col_(question))


# The generator system prompt and the auditor prompt template.  The
# placeholders {question}, {prefix_section} and {formatted_steps} are filled by
# concatenation (literal braces in data are never re-substituted).
DEFAULT_SYSTEM_PROMPT = (
    "You are an expert reasoning model. Solve the given problem step-by-step with clear, "
    "concise, and logically rigorous deductions."
)
DEFAULT_AUDIT_TEMPLATE = """You are an expert reasoning auditor. Your task is to analyze a step-by-step reasoning trajectory and identify the FIRST reasoning step (or short span of consecutive steps) that can be SAFELY SKIPPED without damaging the logical correctness or deductive validity of the final solution.

QUESTION:
{question}

{prefix_section}
REASONING STEPS:
{formatted_steps}

CRITERIA FOR SKIPPING:
1. Redundancy / Repetition: The step repeats calculations or facts already established.
2. Unnecessary Detour / Fluff: Conversational filler, meta-commentary, or uninformative trivialities.
3. Locally Skippable: The reasoning can logically jump from the prefix directly to the subsequent step without losing necessary context.
4. DO NOT skip essential mathematical derivations, intermediate results needed downstream, or the final answer.

INSTRUCTIONS:
- Identify the FIRST skippable step (index `skip_start_idx`) and optional ending index (`skip_end_idx`).
- If no step can be safely skipped, set `"can_skip": false`.
- Return ONLY a valid JSON object in the exact schema below.

JSON FORMAT:
```json
{{
  "can_skip": true,
  "skip_start_idx": 2,
  "skip_end_idx": 2,
  "reason": "Step 2 merely restates that the apple is red without computing or contributing to the total price."
}}
```
"""


def _template_parts(template: str):
    """Split a str.format template into literal text and placeholder names."""
    import string
    out = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            out.append(("lit", literal))
        if field is not None:
            out.append(("field", field))
    return out


def formatted_steps(steps) -> Column:
    """"[i] step" lines, 0-based."""
    return F.array_join(F.transform(col_(steps), lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def audit_prompt(question, prefix, steps, template: str | None = None) -> Column:
    """The auditor prompt; a caller template may use the same three placeholders."""
    p = F.coalesce(col_(prefix), F.lit(""))
    values = {
        "question": col_(question),
        "prefix_section": F.when(p != "", F.concat(F.lit("USEFUL PREFIX (already established):\n"), p, F.lit("\n"))).otherwise(F.lit("")),
        "formatted_steps": formatted_steps(steps),
    }
    parts = []
    for kind, v in _template_parts(template or DEFAULT_AUDIT_TEMPLATE):
        if kind == "lit":
            parts.append(F.lit(v))
        elif v in values:
            parts.append(values[v])
        else:
            raise KeyError(v)
    return F.concat(*parts)


def sft_text(input_x, target_y) -> Column:
    """The supervised fine-tuning text for one pair."""
    return F.concat(col_(input_x), F.lit("\n\n[Next Step]:\n"), col_(target_y))
