"""Token ids as fixed-width bit-packed files.

File format.  Documents in ascending id order (nulls first, equal ids by a hash of their
text) are tokenised task by task; every ``file_ids`` ids or so a file is closed, always
after a whole document.  A file is one row of a Parquet table in the shared folder:
``part``/``seq`` (its place), ``n_ids``, ``doc_ids``, ``doc_lens`` and ``payload``:

    bytes 0-3 "BPK1" | u32 width | u32 block ids | u32 blocks | u64 ids | u64 offset of each block, and the end | blocks

Each id takes ``width`` bits, the least that hold the vocabulary.  A block of
``block_ids`` ids (a multiple of 64) is a whole number of little-endian 64-bit words, so
any block is found by its offset and unpacked by 64 vectorised shifts, without its neighbours.

Defined results: a null text has only the end id; an empty table gives no rows; repeated
rows are written each; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracetrim.llm.common import pick, text_or_empty
from tracetrim.session import ship_package

MAGIC = b"BPK1"
_HEAD = struct.Struct("<4sIIIQ")
FILE = "part long, seq long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _pack_words(ids: np.ndarray, width: int) -> np.ndarray:
    """ids (a multiple of 64 of them) -> 64-bit words: 64 ids make ``width`` words."""
    lanes = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(lanes), width), dtype=np.uint64)
    for j in range(64):
        w, shift = divmod(j * width, 64)
        words[:, w] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, w + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8")


def _unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.astype(np.uint64).reshape(-1, width)
    lanes = np.empty((len(rows), 64), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        w, shift = divmod(j * width, 64)
        v = rows[:, w] >> np.uint64(shift)
        if shift + width > 64:
            v = v | rows[:, w + 1] << np.uint64(64 - shift)
        lanes[:, j] = v & mask
    return lanes.reshape(-1)


def pack_ids(ids: np.ndarray, width: int, block_ids: int = 4096) -> bytes:
    if block_ids % 64 or not 0 < width <= 32:
        raise ValueError("block_ids must be a multiple of 64 and width lie between 1 and 32")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    padded = np.zeros(-(-len(ids) // 64) * 64, dtype=np.uint32)
    padded[: len(ids)] = ids
    words = _pack_words(padded, width)
    blocks = -(-len(ids) // block_ids)
    begin = _HEAD.size + 8 * (blocks + 1)
    step = block_ids * width // 8
    offsets = np.minimum(begin + step * np.arange(blocks + 1, dtype=np.uint64), np.uint64(begin + words.nbytes))
    return _HEAD.pack(MAGIC, width, block_ids, blocks, len(ids)) + offsets.astype("<u8").tobytes() + words.tobytes()


def unpack_ids(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start:stop`` of a file; only the blocks that hold them are touched."""
    magic, width, block_ids, blocks, n = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a bit-packed file")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, dtype=np.uint32)
    offsets = np.frombuffer(payload, "<u8", blocks + 1, _HEAD.size)
    first, last = start // block_ids, (stop - 1) // block_ids
    lo, hi = int(offsets[first]), int(offsets[last + 1])
    ids = _unpack_words(np.frombuffer(payload, "<u8", (hi - lo) // 8, lo), width)
    return ids[start - first * block_ids: stop - first * block_ids]


def write_packed(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
                 file_ids: int = 1 << 18, block_ids: int = 4096) -> None:
    """Tokenise all documents in ascending id order and write them as packed files at ``path``.

    The global order is one range exchange on (id, text hash), so that a frequent id spreads.
    """
    ship_package(docs.sparkSession)
    d = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    ordered = (d.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
               .sortWithinPartitions("doc_id", "h", F.length("text")).select("doc_id", "text"))

    def run(batches):
        from tracetrim.llm.tokens import encoder

        enc = encoder(tokenizer)
        width = width_of(max(enc.vocab_size, end_id + 1))
        end = np.array([end_id], dtype="<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        held, names, lens, n = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.record_batch({
                "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "n_ids": pa.array([n], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "doc_lens": pa.array([lens], pa.list_(pa.int64())),
                "payload": pa.array([pack_ids(ids, width, block_ids)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                held.append(ids)
                names.append(doc_id)
                lens.append(len(ids) // 4)
                n += len(ids) // 4
                if n >= file_ids:
                    yield row()
                    held, names, lens, n, seq = [], [], [], 0, seq + 1
        if names:
            yield row()

    ordered.mapInArrow(run, FILE).write.option("maxRecordsPerFile", 64).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, unpacked from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.  Files of one part are added up
    within the part, and the parts (as many as the write had tasks) among themselves.
    """
    ship_package(spark)
    files = spark.read.schema(FILE).parquet(path)
    own = files.select("part", "seq", "n_ids")
    parts = own.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (own.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
              .select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("file_start")))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                part, seq, _, names, lens, payload = (batch.column(i)[r].as_py() for i in range(6))
                ids = unpack_ids(payload).astype("<u4")
                ends = np.cumsum(np.array(lens, dtype=np.int64))
                begins = ends - np.array(lens, dtype=np.int64)
                yield pa.record_batch({
                    "part": pa.array([part] * len(names), pa.int64()), "seq": pa.array([seq] * len(names), pa.int64()),
                    "doc_id": pa.array(names, pa.int64()), "at": pa.array(begins, pa.int64()), "n_tokens": pa.array(lens, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[b:e].tobytes()) for b, e in zip(begins, ends)], pa.int64())})

    docs = files.mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
