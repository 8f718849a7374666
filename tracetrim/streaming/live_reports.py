"""Dataset reports kept up to date from the record stream.

Each micro-batch of completion and reply records is decided once and gives three tables under ``out_dir``: ``valid`` and
``quarantine`` (its transitions, split by the content rule) and ``counts``, one row for each (category, depth) of the
batch.  All counts are sums, so those of any batches merge by adding: a report reads the small counts alone,
never the rows.

Exactly once: a batch writes into folders of its own number, the counts last.  A batch run again after a crash finds either
its finished counts, and does nothing, or overwrites what the broken run left.  ``read_rows`` takes only batches that have
counts.  The checkpoint lies inside ``out_dir``, so numbers and tables cannot come apart.

Defined results: a null category counts as "Unknown" in the reports, and null and empty texts are empty; a record with an error
counts as a trace with its error text, as in batch; a stream without records gives empty tables and zero counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetrim.operators import reports as RP
from tracetrim.operators.audit import usable
from tracetrim.operators.transitions import transition_columns
from tracetrim.session import is_written
from tracetrim.streaming.incremental import RECORD_SCHEMA, decided

SCHEMA = RECORD_SCHEMA + ", category string"
COUNTS = ("n_records", "n_skip", "n_steps", "n_transitions", "empty_input_x", "empty_target_y", "valid_rows")
COUNT_SCHEMA = "category string, depth int, " + ", ".join(f"{c} long" for c in COUNTS)


def decided_transitions(records: DataFrame, mode: str = "auto") -> DataFrame:
    """Each record with its category and, if its decision is usable, its transition (else that is null)."""
    r = records.withColumn("prefix", F.coalesce(F.col("prefix"), F.lit("")))
    d = decided(r, mode, ("prefix", "category"))
    dec = F.col("decision")
    made = F.struct(*transition_columns(F.col("question"), F.col("prefix"), F.col("steps"), dec, F.col("depth"),
                                        F.lit("recorded"), F.lit("recorded")))
    return d.select("question_key", "category", "depth", dec["can_skip"].alias("can_skip"), F.size("steps").alias("n_steps"),
                    F.explode_outer(F.array(F.when(usable(dec), made))).alias("made"))  # a Generate: see ``keep_where``


def count_batch(rows: DataFrame) -> DataFrame:
    """The sums of ``decided_transitions`` rows for each (category, depth)."""
    x = F.coalesce(F.col("made.input_x"), F.lit("")) == ""
    y = F.coalesce(F.col("made.target_y"), F.lit("")) == ""
    is_made = F.col("made").isNotNull()
    return rows.groupBy("category", "depth").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("can_skip").alias("n_skip"), F.sum(F.col("n_steps").cast("long")).alias("n_steps"),
        F.count_if(is_made).alias("n_transitions"), F.count_if(is_made & x).alias("empty_input_x"),
        F.count_if(is_made & y).alias("empty_target_y"), F.count_if(is_made & ~x & ~y).alias("valid_rows"))


def _folder(out_dir: str, sink: str, batch_id: int) -> str:
    return f"{out_dir.rstrip('/')}/{sink}/batch={batch_id}"


def write_batch(records: DataFrame, batch_id: int, out_dir: str, mode: str = "auto") -> None:
    """One micro-batch into its folders; nothing if it is there already."""
    if is_written(records.sparkSession, _folder(out_dir, "counts", batch_id)):
        return
    rows = decided_transitions(records, mode).persist()
    try:
        made = rows.where(F.col("made").isNotNull()).select("question_key", "category", "made.*")
        for sink, part in zip(("valid", "quarantine"), RP.quarantine(made)):
            part.write.mode("overwrite").parquet(_folder(out_dir, sink, batch_id))
        count_batch(rows).write.mode("overwrite").parquet(_folder(out_dir, "counts", batch_id))
    finally:
        rows.unpersist()


def run_report_stream(spark: SparkSession, source_dir: str, out_dir: str, mode: str = "auto",
                      max_files_per_trigger: int | None = None) -> None:
    """Drain ``source_dir`` (parquet records of ``SCHEMA``) into ``out_dir`` and stop."""
    reader = spark.readStream.schema(SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # batch -1 is empty: the tables can be read before any record has come
    write_batch(spark.createDataFrame([], SCHEMA), -1, out_dir, mode)
    q = (reader.parquet(source_dir).writeStream.option("checkpointLocation", out_dir.rstrip("/") + "/checkpoint")
         .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out_dir, mode))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The merged counts of all batches, one row for each (category, depth)."""
    counts = spark.read.schema(COUNT_SCHEMA + ", batch long").parquet(out_dir.rstrip("/") + "/counts")
    return counts.groupBy("category", "depth").agg(*[F.sum(c).alias(c) for c in COUNTS])


def read_rows(spark: SparkSession, out_dir: str, sink: str = "valid") -> DataFrame:
    """The ``valid`` or ``quarantine`` rows of all finished batches."""
    done = spark.read.schema(COUNT_SCHEMA + ", batch long").parquet(out_dir.rstrip("/") + "/counts").select("batch").distinct()
    return spark.read.parquet(f"{out_dir.rstrip('/')}/{sink}").join(done, "batch", "left_semi").drop("batch")


def content_report(counts: DataFrame) -> DataFrame:
    """I2 from merged counts."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
        ("n_transitions", "n_rows"), ("empty_input_x", "empty_input_x"), ("empty_target_y", "empty_target_y"), ("valid_rows", "valid_rows"))])


def category_report(counts: DataFrame) -> DataFrame:
    """I3 from merged counts."""
    per = counts.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(F.sum("n_transitions").alias("n"))
    return per.where(F.col("n") > 0).orderBy(F.desc("n"), "category")


def depth_report(counts: DataFrame) -> DataFrame:
    """I4 from merged counts."""
    return counts.groupBy("depth").agg(F.sum("n_transitions").alias("n")).where(F.col("n") > 0).orderBy("depth")


def card_report(counts: DataFrame, generator_model: str | None = None, decision_model: str | None = None) -> DataFrame:
    """I5 from merged counts."""
    return RP.card_of(depth_report(counts), generator_model, decision_model)


def rates_report(counts: DataFrame) -> DataFrame:
    """I7 rates from merged counts."""
    return counts.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(
        F.sum("n_records").alias("n_traces"), (F.sum("n_skip") / F.sum("n_records")).alias("skip_rate"),
        (F.sum("n_steps") / F.sum("n_records")).alias("mean_steps"))
