"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a shuffled order that depends on the id alone,
served at a rate in proportion to its target.  A document's virtual finish time is the
words of its source up to and with it, divided by the source's target; a source is gone
through up to ``max_epochs`` times.  All copies are sorted by virtual finish time and the
mix ends when the budget is used up: at time budget / all words, where each source has been
served its share, a document then in service only in part.

Cumulative words need no task that holds a source: shuffled order is cut into buckets of
about ``bucket_rows`` documents, bucket sums are added up in two levels, and windows run
inside one (source, bucket) only.

Defined results: null text has size 0; null source is a source of its own, ranked last;
a null id is an id like any other; repeated rows are documents each; with no words at all
every target and share is 0; an empty table gives no rows; other columns are not looked at
(``mix_rows`` carries them along).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracetrim.llm.common import WORD, Carried, pick, text_or_empty
from tracetrim.operators.ordering import dense_position
from tracetrim.session import write_shared

WEIGHTS = (1, 2, 3)


def sized(df: DataFrame) -> DataFrame:
    """Adds the number of words and the shuffled order's key (of the id, then the text)."""
    return (df.withColumn("size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
            .withColumn("shuffle", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
            .withColumn("tie", F.xxhash64("text"))
            .drop("text"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources by code point, null last, weigh ``weights``, repeated; they share all words by
    weight.  A target stops at ``max_epochs`` times its source's size and the excess is
    shared anew by weight, until no target is above.  Each round is one aggregate over the
    table of sources; the driver sees four numbers.
    """
    ranked = dense_position(sizes, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = write_shared(ranked.withColumn("weight", w.cast("long")), "mix-sources")
    cap = F.col("source_size") * max_epochs
    share, stopped = None, -1
    while True:
        full = F.lit(False) if share is None else cap <= F.col("weight") * F.lit(share)
        total, capped, free, n = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == stopped or not free:
            share = share if free else float("inf")
            break
        share, stopped = ((total or 0) - (capped or 0)) / free, n
    target = F.when(cap <= F.col("weight") * F.lit(share), cap.cast("double")).otherwise(F.col("weight") * F.lit(share))
    return ranked.withColumn("target", target)


def schedule(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, bucket_rows: int = 256) -> DataFrame:
    """``docs`` (doc_id, source, size, shuffle, tie, and any others; written, so that re-reading
    gives the same rows) with row, source_size, target and ``before``: the words of its source in front of it."""
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    n = docs.count()
    bits = min(31, max(0, (n // bucket_rows).bit_length()))
    half = bits // 2
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, max_epochs).select(F.col("source").alias("of"), "rank", "source_size", "target")
    d = docs.join(sources, docs["source"].eqNullSafe(F.col("of"))).drop("of")
    prefix = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    d = d.withColumn("bucket", F.shiftright(prefix, 32 - bits) if bits else F.lit(0).cast("long"))
    d = d.withColumn("wide", F.shiftright("bucket", half) if half else F.col("bucket"))
    earlier = (Window.unboundedPreceding, -1)
    sums = d.groupBy("rank", "wide", "bucket").agg(F.sum("size").alias("n"))
    wide = sums.groupBy("rank", "wide").agg(F.sum("n").alias("n"))
    of_source = Window.partitionBy("rank").orderBy("wide").rowsBetween(*earlier)
    wide = wide.select("rank", "wide", F.coalesce(F.sum("n").over(of_source), F.lit(0)).alias("wide_before"))
    of_wide = Window.partitionBy("rank", "wide").orderBy("bucket").rowsBetween(*earlier)
    starts = (sums.withColumn("in_wide", F.coalesce(F.sum("n").over(of_wide), F.lit(0))).join(wide, ["rank", "wide"])
              .select("rank", "bucket", (F.col("wide_before") + F.col("in_wide")).alias("bucket_before")))
    of_bucket = Window.partitionBy("rank", "bucket").orderBy("shuffle", F.col("doc_id").asc_nulls_first(), "size", "tie", "row").rowsBetween(*earlier)
    return (d.join(starts, ["rank", "bucket"])
            .withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(of_bucket), F.lit(0)))
            .drop("bucket_before", "bucket", "wide"))


def mix(scheduled: DataFrame, max_epochs: int = 3, budget_share: float = 1.0) -> DataFrame:
    """One row for each copy of a document, range-sorted by virtual finish time, with ``taken``: the
    words of it that the mix takes (0 past the end of the budget, ``budget_share`` of all words)."""
    copies = scheduled.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    served = F.floor(F.col("target") * F.lit(float(budget_share))).cast("long") - start
    return (copies.withColumn("finish", F.try_divide((start + F.col("size")).cast("double"), "target"))
            .withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least("size", served)))
            .repartitionByRange(F.col("finish").asc_nulls_last(), "row").sortWithinPartitions(F.col("finish").asc_nulls_last(), "row"))


def mix_sizes(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words over all its copies) and n_copies."""
    narrow = write_shared(sized(pick(docs, "doc_id", "source", "text")), "mix-documents")
    copies = mix(schedule(narrow, weights, max_epochs), max_epochs)
    first = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return (copies.groupBy("row").agg(*first, F.sum("taken").alias("taken"), F.count(F.when(F.col("taken") > 0, 1)).alias("n_copies"))
            .drop("row"))


def mix_rows(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, budget_share: float = 1.0) -> DataFrame:
    """The mix itself: the input's rows, each as often as the mix takes it, in order of virtual finish
    time.  A copy served in part keeps its first ``taken`` words; ``n_chars`` counts anew."""
    carried = Carried(docs, "doc_id", "source", "text")
    whole = write_shared(sized(carried.frame), "mix-rows")
    whole_text = carried.field("text")
    out = mix(schedule(whole, weights, max_epochs), max_epochs, budget_share).where("taken > 0")
    pieces = F.regexp_extract_all(whole_text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("taken") == F.col("size"), whole_text).otherwise(F.array_join(F.slice(pieces, 1, F.col("taken").cast("int")), ""))
    return carried.restore(out, text=text, n_chars=F.length(text).cast("long"))
