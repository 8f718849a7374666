"""Rows of mixed shape: JSON lines, each formatted by its own keys.

A table has one schema for all its rows; a file of JSON lines need not.  Each line is read as a VARIANT, and the layout
(multiple choice, body and question, context, plain) is decided per row by the keys that the row has and what they
hold, in that order.  All of it is row-local built-in expressions.

Values become text as in the column layouts: text as it is, numbers as JSON writes them, true and false as "True" and
"False", null as "None"; a list or an object as its JSON.  Where the first value that counts is looked for, null, "", 0, false, [] and {}
do not count.

Defined results: a line that is no JSON object has no key, so it is a plain row without question (and is dropped by
``load_json_questions``, which counts it in the numbering); blank lines are no rows; a key that repeats counts with its
last value; ``choices`` whose label or text is no list has no choices; an empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetrim.functions.text import py_strip

ROW = "row"


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files as (row VARIANT), null where a line is no JSON.  Sets the session to read repeated keys."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias(ROW))


class Value:
    """One key of a VARIANT row."""

    def __init__(self, row: str, key: str):
        whole = F.col(row)
        # on anything but an object no key is there; a null value is there
        self.v = F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.try_variant_get(whole, f"$.{key}", "variant"))

    @property
    def there(self) -> Column:
        return self.v.isNotNull()

    @property
    def kind(self) -> Column:
        """STRING, BIGINT, DECIMAL.., DOUBLE, BOOLEAN, VOID, ARRAY.. or OBJECT..; null where the key is not."""
        return F.schema_of_variant(self.v)

    @property
    def is_object(self) -> Column:
        return F.coalesce(self.kind.startswith("OBJECT"), F.lit(False))

    @property
    def text(self) -> Column:
        """The value as text; null where the key is not."""
        k = self.kind
        return (F.when(k == "VOID", "None").when(k == "BOOLEAN", F.when(self.v.cast("boolean"), "True").otherwise("False"))
                .when(k.startswith("ARRAY") | k.startswith("OBJECT"), F.to_json(self.v)).otherwise(F.try_variant_get(self.v, "$", "string")))

    @property
    def counting(self) -> Column:
        """The text of a value that counts, else null."""
        t = self.text
        nothing = ((self.kind == "VOID") | (self.kind == "BOOLEAN") & (t == "False") | t.isin("", "[]", "{}")
                   | (self.kind != "STRING") & F.coalesce(t.try_cast("double") == 0, F.lit(False)))
        return F.when(self.there & ~nothing, t)

    def list_of(self, key: str) -> Column:
        """The elements of ``key`` in this object as text; null unless it is a list."""
        elements = F.try_variant_get(self.v, f"$.{key}", "array<variant>")
        return F.transform(elements, lambda e: F.when(e.isNull() | F.is_variant_null(e), "None")
                           .when(F.schema_of_variant(e) == "BOOLEAN", F.when(F.try_variant_get(e, "$", "boolean"), "True").otherwise("False"))
                           .when(F.schema_of_variant(e).startswith("ARRAY") | F.schema_of_variant(e).startswith("OBJECT"), F.to_json(e))
                           .otherwise(F.try_variant_get(e, "$", "string")))

    def has(self, key: str) -> Column:
        return self.is_object & F.try_variant_get(self.v, f"$.{key}", "variant").isNotNull()


class _Staged(Value):
    """A key whose value, kind and text are columns already, each computed once per row."""

    def __init__(self, name: str):
        self.v, self._kind, self._text = (F.col(_staged(part, name)) for part in ("v", "kind", "text"))

    @property
    def kind(self) -> Column:
        return self._kind

    @property
    def text(self) -> Column:
        return self._text


KEYS = ("choices", "context", "answers", "question", "question_stem", "Body", "Question", "problem", "prompt",
        "answer", "answerKey", "Answer", "correct_answer", "ground_truth")


def _staged(part: str, name: str) -> str:
    # keys may differ in case alone, column names may not
    return f"_json_{part}_{KEYS.index(name)}"


def _with_keys(df: DataFrame, row: str) -> DataFrame:
    """Adds every key's value, kind and text as columns: an expression that many others use would run for each of them."""
    whole, there = F.col(row), F.col("_json_object")
    df = df.withColumn("_json_object", F.schema_of_variant(whole).startswith("OBJECT"))
    df = df.withColumns({_staged("v", k): F.when(there, F.try_variant_get(whole, f"$.{k}", "variant")) for k in KEYS})
    df = df.withColumns({_staged("kind", k): F.schema_of_variant(F.col(_staged("v", k))) for k in KEYS})
    return df.withColumns({_staged("text", k): Value.text.fget(_Staged(k)) for k in KEYS})


def format_json_rows(df: DataFrame, row: str = ROW) -> DataFrame:
    """Adds ``layout``, ``question_text`` and ``answer_text`` (B5), decided row by row."""
    columns = df.columns
    df = _with_keys(df, row)
    key = _Staged

    def first(*names: str) -> Column:
        return F.coalesce(*[key(n).counting for n in names], F.lit(""))

    def said(name: str) -> Column:
        return py_strip(F.coalesce(key(name).text, F.lit("None")))

    choices, context, answers = key("choices"), key("context"), key("answers")
    none = F.array().cast("array<string>")
    labels, texts = F.coalesce(choices.list_of("label"), none), F.coalesce(choices.list_of("text"), none)
    n = F.least(F.size(labels), F.size(texts))
    pairs = F.zip_with(F.slice(labels, 1, n), F.slice(texts, 1, n), lambda a, b: F.concat(F.lit("("), a, F.lit(") "), b))
    chosen = py_strip(F.concat(py_strip(first("question", "question_stem")), F.lit(" "), F.array_join(pairs, " ")))

    df = df.withColumn("_json_around", py_strip(context.text))
    around = F.col("_json_around")
    cut = F.concat(F.regexp_replace(F.substring(around, 1, 300), "(?s) [^ ]*\\z", ""), F.lit("..."))
    around = F.when(F.length(around) > 300, cut).otherwise(around)
    listed = answers.list_of("text")
    in_context = (F.when(answers.has("text"), F.coalesce(F.try_element_at(listed, F.lit(1)), F.lit("")))
                  .otherwise(F.coalesce(key("answer").text, F.lit(""))))

    layout = (F.when(choices.has("label") & choices.has("text"), "choice")
              .when(key("Body").there & key("Question").there, "body")
              .when((context.kind == "STRING") & key("question").there, "context").otherwise("plain"))
    of = F.col("layout")
    question = (F.when(of == "choice", chosen)
                .when(of == "body", py_strip(F.concat(said("Body"), F.lit(" "), said("Question"))))
                .when(of == "context", F.concat(F.lit("Context: "), around, F.lit("\n\nQuestion: "), said("question")))
                .otherwise(py_strip(first("question", "problem", "prompt"))))
    answer = (F.when(of == "choice", first("answerKey", "answer")).when(of == "body", F.coalesce(key("Answer").text, F.lit("")))
              .when(of == "context", in_context).otherwise(py_strip(first("answer", "correct_answer", "ground_truth"))))
    df = df.withColumn("layout", layout).withColumns({"question_text": question, "answer_text": answer})
    return df.drop(*[c for c in df.columns if c.startswith("_json_") and c not in columns])


def load_json_questions(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A5 over JSON lines: (question_key, question, ground_truth, layout), rows without a question left out.
    ``key`` names the rows' key field; its text is the question's key (null where a row has none)."""
    f = format_json_rows(read_json_rows(spark, path))
    out = f.select(Value(ROW, key).text.alias("question_key"), F.col("question_text").alias("question"), F.col("answer_text").alias("ground_truth"), "layout")
    return out.where(F.col("question") != "")
