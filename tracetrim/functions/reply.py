"""Auditor-reply parsing (payload extraction, JSON coercion, fallback) as Column expressions.

Contract reproduced:
* payload = first fenced ```json {...}``` block (non-greedy), else the first non-greedy
  ``{...}``, else the whole reply;
* a payload that is not valid JSON -> *fallback*: can_skip when the reply mentions "true"
  and its first 30 characters do not mention "false"; indices stay -1;
* valid JSON that is not an object -> *error* decision;
* object: can_skip by Python truthiness; indices by ``int()`` (2.7 -> 2, "2" -> 2,
  true -> 1, "2.7"/null/list -> error); a missing start is -1, a missing end is the start.

Python's JSON is a little wider than Spark's: of repeated keys the last counts (the parser's
setting for that is turned on here), and NaN and the infinities are numbers (a reply that does not
parse is tried again with them as objects, which are truthy and no index, as they are).  An index of
any size is read whole, so one beyond 64 bits is out of range like any other.

Spark's JSON parser accepts trailing text ("12 34" parses as 12), so a reply with no
braces counts as JSON only when the whole trimmed text is one scalar or array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.text import col_

# Reasons written for decisions that were not taken from the reply.
NO_SKIP_DEFAULT_REASON = "Decision model found no skippable steps."
FALLBACK_REASON = "Fallback parse from unformatted response"
ERROR_REASON = "Decision call error: reply is not a usable JSON decision"
SHORT_TRACE_REASON = "Trace has fewer than 2 steps; cannot prune intermediate reasoning."
ALL_STEPS_REASON = "Cannot skip all steps in the trajectory."
MISSING_REPLY_REASON = "No recorded auditor response."

FENCED_RE = "(?sU)```(?:json)?\\s*(\\{.*?\\})\\s*```"
BRACE_RE = "(?s)\\{.*?\\}"
# A whole JSON scalar as Python's json module reads it (NaN / Infinity included).
JSON_SCALAR_RE = (
    '^[ \\t\\n\\r]*(?:-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|"(?:[^"\\\\]|\\\\.)*"'
    "|true|false|null|NaN|-?Infinity)[ \\t\\n\\r]*\\z"
)
# NaN or an infinity as a value of an object or list.
NOT_FINITE_RE = "([:\\[,][ \\t\\n\\r]*)(NaN|-?Infinity)(?=[ \\t\\n\\r]*[,}\\]])"
INDEX = "decimal(38,0)"
JSON_ARRAY_RE = "(?s)^[ \\t\\n\\r]*\\[.*\\][ \\t\\n\\r]*\\z"


def payload(raw) -> Column:
    """The JSON candidate inside a reply."""
    r = F.coalesce(col_(raw), F.lit(""))
    return (
        F.when(r.rlike(FENCED_RE), F.regexp_extract(r, FENCED_RE, 1))
        .when(r.rlike(BRACE_RE), F.regexp_extract(r, BRACE_RE, 0))
        .otherwise(r)
    )


def payload_kind(raw) -> Column:
    r = F.coalesce(col_(raw), F.lit(""))
    return F.when(r.rlike(FENCED_RE), F.lit("fenced")).when(r.rlike(BRACE_RE), F.lit("brace")).otherwise(F.lit("raw"))


def _first_array_closes_at_end(r: Column) -> Column:
    """True when the first top-level ``[...]`` of ``r`` (brackets inside strings ignored)
    is followed by JSON whitespace only.  Spark's parser accepts trailing text after a
    complete value (``[1][]`` parses as ``[1]``); Python's does not."""
    init = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("s"), F.lit(False).alias("esc"),
                    F.lit(0).alias("pos"), F.lit(-1).alias("end"))

    def step(acc, c):
        pos = acc["pos"] + 1
        opened = F.when(c == "[", acc["depth"] + 1).when(c == "]", acc["depth"] - 1).otherwise(acc["depth"])
        closes = (c == "]") & (acc["depth"] == 1)
        in_str = acc["s"]
        return (F.when(acc["end"] >= 0, acc)
                .when(in_str & acc["esc"], F.struct(acc["depth"].alias("depth"), F.lit(True).alias("s"), F.lit(False).alias("esc"), pos.alias("pos"), acc["end"].alias("end")))
                .when(in_str, F.struct(acc["depth"].alias("depth"), (c != '"').alias("s"), (c == "\\").alias("esc"), pos.alias("pos"), acc["end"].alias("end")))
                .otherwise(F.struct(opened.alias("depth"), (c == '"').alias("s"), F.lit(False).alias("esc"), pos.alias("pos"),
                                    F.when(closes, pos).otherwise(acc["end"]).alias("end"))))

    end = F.aggregate(F.split(r, "", -1), init, step)["end"]
    rest = F.substring(r, end + 1, 1 << 30)
    return (end > 0) & (F.regexp_replace(rest, "[ \\t\\n\\r]", "") == "")


def fallback_can_skip(raw) -> Column:
    """The keyword rule used when the payload is not JSON."""
    low = F.lower(F.coalesce(col_(raw), F.lit("")))
    return low.contains("true") & ~F.substring(low, 1, 30).contains("false")


def _truthy(field: Column) -> Column:
    t = F.schema_of_variant(field)
    return (
        F.when(field.isNull(), F.lit(False))
        .when(t == "BOOLEAN", F.try_variant_get(field, "$", "boolean"))
        .when(t == "STRING", F.length(F.try_variant_get(field, "$", "string")) > 0)
        .when(t == "VOID", F.lit(False))
        .when(t.startswith("ARRAY"), F.to_json(field) != "[]")
        .when(t.startswith("OBJECT"), F.to_json(field) != "{}")
        .otherwise(F.coalesce(F.try_variant_get(field, "$", "double") != 0, F.lit(False)))
    )


def _text_of(field: Column) -> Column:
    """``str(value)`` of a JSON value: text as is, booleans as True/False, else its JSON form."""
    t = F.schema_of_variant(field)
    return (F.when(t == "STRING", F.try_variant_get(field, "$", "string"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(field, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .otherwise(F.to_json(field)))


def _index(v: Column, path: str) -> Column:
    """An index as a whole number of any size; null where ``int()`` would fail."""
    field = F.try_variant_get(v, path, "variant")
    large = F.schema_of_variant(field).rlike("^(DECIMAL|DOUBLE)")
    return F.coalesce(F.try_variant_get(v, path, "bigint").cast(INDEX), F.when(large, F.try_variant_get(v, path, INDEX)))


def with_parsed_reply(df: DataFrame, raw_col: str, out: str = "parsed") -> DataFrame:
    """Adds ``out`` = STRUCT<parse_status, can_skip, skip_start_idx, skip_end_idx, reason>.

    parse_status is 'json', 'fallback' or 'error'.  Indices are not yet validated
    against the trace (see ``tracetrim.operators.audit.validate``).  Each costly
    intermediate (payload, parsed variant, fields) is its own column so it is computed
    once per row.
    """
    t = f"_{out}_"
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    r = F.coalesce(F.col(raw_col), F.lit(""))
    df = df.withColumn(t + "r", r)
    r = F.col(t + "r")
    df = df.withColumns({t + "shape": r.rlike(FENCED_RE) | r.rlike(BRACE_RE), t + "p": payload(r)})
    whole = F.col(t + "p")
    numbers = F.when(whole.rlike(NOT_FINITE_RE), F.try_parse_json(F.regexp_replace(whole, NOT_FINITE_RE, '$1{"number":"$2"}')))
    df = df.withColumn(t + "v", F.coalesce(F.try_parse_json(whole), numbers))
    v = F.col(t + "v")
    # everything that only needs the parsed variant, in one projection
    df = df.withColumns({
        t + "vt": F.schema_of_variant(v),
        t + "skip_f": F.try_variant_get(v, "$.can_skip", "variant"),
        t + "start_f": F.try_variant_get(v, "$.skip_start_idx", "variant"),
        t + "end_f": F.try_variant_get(v, "$.skip_end_idx", "variant"),
        t + "reason_f": F.try_variant_get(v, "$.reason", "variant"),
        t + "start_i": _index(v, "$.skip_start_idx"),
        t + "end_i": _index(v, "$.skip_end_idx"),
    })
    vt = F.col(t + "vt")
    # With braces: unparsable -> fallback, non-object -> error.  Without braces the
    # reply can only be JSON if the whole text is one scalar or array (-> error).
    whole_value = r.rlike(JSON_SCALAR_RE) | (r.rlike(JSON_ARRAY_RE) & vt.startswith("ARRAY") & _first_array_closes_at_end(r))
    shape = F.col(t + "shape")
    start = F.when(F.col(t + "start_f").isNull(), F.lit(-1)).otherwise(F.col(t + "start_i"))
    df = df.withColumns({
        t + "kind": F.when(shape & v.isNull(), F.lit("fallback"))
                     .when(shape & ~vt.startswith("OBJECT"), F.lit("error"))
                     .when(shape, F.lit("object"))
                     .when(whole_value, F.lit("error")).otherwise(F.lit("fallback")),
        t + "start": start,
        t + "can": _truthy(F.col(t + "skip_f")),
    })
    start = F.col(t + "start")
    end = F.when(F.col(t + "end_f").isNull(), start).otherwise(F.col(t + "end_i"))
    reason_f = F.col(t + "reason_f")
    no_skip_reason = F.when(reason_f.isNull(), F.lit(NO_SKIP_DEFAULT_REASON)).when(
        F.is_variant_null(reason_f), F.lit(None).cast("string")).otherwise(_text_of(reason_f))
    skip_reason = F.when(reason_f.isNull(), F.lit("")).when(F.is_variant_null(reason_f), F.lit("None")).otherwise(_text_of(reason_f))
    df = df.withColumn(t + "end", end)
    can, end, kind = F.col(t + "can"), F.col(t + "end"), F.col(t + "kind")
    minus1 = F.lit(-1)

    def st(status, can_skip, s, e, reason):
        return F.struct(F.lit(status).alias("parse_status"), can_skip.alias("can_skip"), s.cast(INDEX).alias("skip_start_idx"),
                        e.cast(INDEX).alias("skip_end_idx"), reason.cast("string").alias("reason"))

    parsed = (
        F.when(kind == "fallback", st("fallback", fallback_can_skip(r), minus1, minus1, F.lit(FALLBACK_REASON)))
        .when(kind == "error", st("error", F.lit(False), minus1, minus1, F.lit(ERROR_REASON)))
        .when(~can, st("json", F.lit(False), minus1, minus1, no_skip_reason))
        .when(start.isNull() | end.isNull(), st("error", F.lit(False), minus1, minus1, F.lit(ERROR_REASON)))
        .otherwise(st("json", F.lit(True), start, end, skip_reason))
    )
    df = df.withColumn(out, parsed)
    return df.drop(*[c for c in df.columns if c.startswith(t)])
