"""Incremental PT build (F9): recorded completion + auditor reply records arrive as files;
each record becomes a trace (D1/D2), a decision (E1-E6) and maybe a transition (F1).

Every step is row-local and stateless, so the streaming query needs no watermark or
state store; the same ``transitions_from_records`` runs in batch, which is how the
stream is checked (streamed == batch).  ``trigger(availableNow=True)`` drains what is
there and stops; the checkpoint lets a restarted job (or a lost executor) resume
without duplicating output files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetrim.operators.audit import usable, with_reply_decision
from tracetrim.operators.frames import keep_where
from tracetrim.operators.completions import ERROR_PREFIX
from tracetrim.functions.segment import segment
from tracetrim.functions.text import word_count
from tracetrim.operators.transitions import transition_columns

RECORD_SCHEMA = ("question_key long, depth int, question string, prefix string, text string, usage_tokens int, "
                 "error string, raw_response string")


def decided(records: DataFrame, mode: str = "auto", keep=()) -> DataFrame:
    """D1/D2 and E1-E6 row by row: each record's steps and decision."""
    is_err = F.col("error").isNotNull()
    t = records.select(
        "question_key", "depth", "question", "raw_response", *keep,
        F.when(is_err, F.concat(F.lit(ERROR_PREFIX), F.col("error"))).otherwise(F.coalesce(F.col("text"), F.lit(""))).alias("full_text"),
        F.when(is_err, F.lit(0)).otherwise(F.coalesce(F.col("usage_tokens"), word_count(F.col("text")))).cast("int").alias("token_count"),
    )
    t = t.withColumn("steps", segment(F.col("full_text"), mode))
    return with_reply_decision(t, "raw_response", "steps", "decision")


def transitions_from_records(records: DataFrame, mode: str = "auto", generator_model: str = "recorded",
                             decision_model: str = "recorded") -> DataFrame:
    t = decided(records.withColumn("prefix", F.coalesce(F.col("prefix"), F.lit(""))), mode, ("prefix",))
    dec = F.col("decision")
    return keep_where(t, usable(dec)).select(
        "question_key",
        *transition_columns(F.col("question"), F.col("prefix"), F.col("steps"), dec, F.col("depth"),
                            F.lit(generator_model), F.lit(decision_model)))


def run_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, mode: str = "auto",
               max_files_per_trigger: int | None = None) -> None:
    """Drain ``source_dir`` (parquet records) into ``out_dir`` (parquet transitions) and stop."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    drain(transitions_from_records(reader.parquet(source_dir), mode), out_dir, checkpoint)


def drain(stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Write what the stream's sources hold now, and stop."""
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(out_dir))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
