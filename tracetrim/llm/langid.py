"""Language identification by compression.

Each language of the training rows gets a zstandard raw-content dictionary: the letters, as in
the texts to be named, of a sample of its documents.  A text is compressed with every dictionary and the
smallest result names its language; a narrow margin rejects the answer.  Whole texts are
compressed, so a long one weighs all it holds.

The sample is bounded by documented parameters, in documents and in bytes of dictionary: for each
language the documents with the least hash of their id, at most ``sample_docs``, each whole, until
they fill ``dict_bytes`` (of text).  Texts over an eighth of ``dict_bytes`` come behind all shorter ones, so that one text
does not make up a dictionary; a language without enough shorter ones takes them, whole too.  A dictionary
therefore holds at most ``dict_bytes`` and the text that fills it; its size does not grow with the input.  The
dictionaries go to the workers as one broadcast of at most ``max_mb``, the keys of their documents as one
of at most 1,024 rows a megabyte of it (more languages than that allows raise an error; nothing is dropped).
Equal rows among the chosen teach once.

Defined results: a null text and one without a letter give ``und`` with score 0, not
rejected; ties go to the language with less code points; a null id counts as empty text
for the split; with no training rows every text is ``und``; repeated rows are predicted
each; other columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracetrim.llm.common import id_remainder, pick
from tracetrim.session import shared_table, ship_package

UNDETERMINED = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """Lower-case letters with one blank for whatever stands between them: marks and digits name no language."""
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def learn(labelled: DataFrame, sample_docs: int = 512, dict_bytes: int = 1 << 18, max_mb: int = 256) -> dict[str, bytes]:
    """language -> dictionary content, from rows (doc_id, text, lang)."""
    # the rows are chosen by narrow keys; only the chosen ones' texts move.  \p{L}: a text without a letter teaches nothing
    keyed = (labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
             .select("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text"))
    order = Window.partitionBy("lang").orderBy("long", "h", "t")
    earlier = Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (keyed.select("lang", "h", "t", F.octet_length("text").cast("long").alias("bytes"))
              .withColumn("long", F.col("bytes") > dict_bytes // 8)
              .withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_docs)
              .withColumn("before", F.coalesce(F.sum(F.col("bytes") + 1).over(earlier), F.lit(0))).where(F.col("before") < dict_bytes)
              .groupBy("lang", "h", "t").agg(F.min("at").alias("at")))
    chosen, _ = shared_table(chosen, "language-samples")
    n = chosen.count()
    if n > max_mb << 10:
        raise ValueError(f"{n} texts to learn from; take fewer than {sample_docs} a language")
    letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    rows = keyed.join(F.broadcast(chosen), ["lang", "h", "t"]).dropDuplicates(["lang", "at"]).select("lang", "at", letters.alias("text"))
    content = rows.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), "\n").alias("c"))
    content, _ = shared_table(content, "language-dictionaries")
    size = content.agg(F.sum(F.octet_length("c"))).first()[0] or 0
    if size > max_mb << 20:
        raise ValueError(f"the dictionaries take {size >> 20} MB; take smaller ones than {dict_bytes} bytes")
    return {lang: c.encode("utf-8") for lang, c in sorted(content.collect())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 5, least_margin: float = 0.01) -> DataFrame:
    """doc_id, held_out-free prediction: lang_pred, score, margin and rejected for each row of (doc_id, text).

    ``margin`` is the second smallest size over the smallest, less one; a text is ``rejected``
    when it is under ``least_margin``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(dictionaries)

    def run(batches):
        import zstandard as zstd

        langs = list(held.value)
        params = zstd.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
        coders = []
        for c in held.value.values():
            d = zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
        for batch in batches:
            out = []
            for v in batch.column(1):
                text = v.as_py()
                out.append(_predict(text, langs, coders, least_margin))
            lang, score, margin, rejected = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                                   "margin": pa.array(margin, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def _predict(text, langs: list[str], coders: list, least_margin: float):
    if not text or not langs or not (text.isalpha() or any(map(str.isalpha, text))):
        return UNDETERMINED, 0.0, 0.0, False
    raw = letters_only(text)
    sizes = [len(c.compress(raw)) for c in coders]
    best = min(range(len(langs)), key=lambda i: (sizes[i], langs[i]))
    rest = sorted(sizes[:best] + sizes[best + 1:])
    score = 1.0 / sum(2.0 ** -min(1000, s - sizes[best]) for s in sizes)
    margin = rest[0] / sizes[best] - 1 if rest else 1.0
    return langs[best], score, margin, margin < least_margin


def train_and_identify(docs: DataFrame) -> DataFrame:
    """The split by crc32 of the id: learn where the remainder by 4 is not 2, predict every row."""
    d = pick(docs, "doc_id", "text", "lang")
    model = learn(d.where(id_remainder(4) != 2))
    return identify(d, model).withColumn("held_out", id_remainder(4) == 2)
