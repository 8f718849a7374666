"""Traces from completions (D1, D2) and the batch-completion contract (D3).

A completion record is ``(question_key, depth, text, usage_tokens, error)``.  The
generator itself is external: completions arrive as a table, or a user callable runs
inside ``mapInPandas`` (one client per task, batches of rows, no driver loop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.segment import segment
from tracetrim.functions.text import word_count
from tracetrim.operators.format import DEFAULT_SYSTEM_PROMPT, continuation_prompt
from tracetrim.operators.ledger import answers
from tracetrim.session import ship_package

ERROR_PREFIX = "Error during generation: "
COMPLETION_FIELDS = "depth int, text string, usage_tokens int, error string"


def build_traces(completions: DataFrame, mode: str = "auto", generator_model: str = "recorded",
                 temperature: float = 0.7, max_tokens: int = 1024) -> DataFrame:
    """Full text (error text for failed calls), token count (usage, else word
    count, 0 for failures), error flag, steps, model and generation parameters."""
    is_err = F.col("error").isNotNull()
    text = F.when(is_err, F.concat(F.lit(ERROR_PREFIX), F.col("error"))).otherwise(F.coalesce(F.col("text"), F.lit("")))
    tokens = F.when(is_err, F.lit(0)).otherwise(F.coalesce(F.col("usage_tokens"), word_count(F.col("text"))))
    df = completions.withColumn("full_text", text)
    return df.select(
        "question_key", F.col("depth").cast("int").alias("depth"), "full_text",
        tokens.cast("int").alias("token_count"), is_err.alias("is_error"),
        segment(F.col("full_text"), mode).alias("steps"),
        F.lit(generator_model).alias("generator_model"),
        F.struct(F.lit(float(temperature)).alias("temperature"), F.lit(int(max_tokens)).alias("max_tokens")).alias("metadata"),
    )


def completion_requests(questions: DataFrame, prefix_col: str | None = None, system_prompt: str | None = None,
                        max_tokens: int = 1024, temperature: float = 0.7) -> DataFrame:
    """D3 input: one request row per question (system prompt, user prompt, parameters)."""
    prefix = F.col(prefix_col) if prefix_col else F.lit("")
    return questions.select(
        "question_key",
        F.lit(system_prompt or DEFAULT_SYSTEM_PROMPT).alias("system_prompt"),
        continuation_prompt(F.col("question"), prefix).alias("prompt"),
        F.lit(int(max_tokens)).alias("max_tokens"), F.lit(float(temperature)).alias("temperature"),
    )


def batch_completion(requests: DataFrame, complete_fn, depth: int = 1, parallelism: int | None = None, ledger: str | None = None,
                     call_rows: int | None = None) -> DataFrame:
    """D3: run ``complete_fn(pandas.DataFrame) -> pandas.DataFrame[text, usage_tokens, error]``
    over Arrow batches, at most ``call_rows`` rows a call.  ``parallelism`` bounds concurrent clients (the
    thread-pool knob) by repartitioning before the Python stage.  If the callable raises, the rows are halved until
    those that fail stand alone; these become rows with their ``error``.  With ``ledger``, a folder that all
    executors reach, answers are kept there as they come and a task that is run again does not ask for them (``ledger.py``).
    """
    ship_package(requests.sparkSession)
    req = requests.repartition(parallelism) if parallelism else requests
    columns = ["question_key", "depth", "text", "usage_tokens", "error"]

    def run(batches):
        def one(pdf):
            return complete_fn(pdf).reset_index(drop=True).assign(question_key=pdf["question_key"].values, depth=depth)

        def failed(row, message):
            return row[["question_key"]].assign(depth=depth, text=None, usage_tokens=None, error=message)

        for out in answers(one, batches, failed, columns, "question_key", ledger, call_rows):
            yield out.astype({"depth": "int32", "usage_tokens": "Int32"})

    key_type = requests.schema["question_key"].dataType.simpleString()
    return req.mapInPandas(run, f"question_key {key_type}, {COMPLETION_FIELDS}")
