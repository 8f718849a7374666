"""Sum-of-squares online packing of documents into fixed-size training sequences.

Each task packs the documents it reads, in order, and keeps one array: how many open
sequences stand at each fill level.  A document's whole windows fill sequences of their
own; the rest of it goes to the open level (or a new sequence) for which the sum of
squared level counts afterwards is least.  Cuts are free, so when a task ends, or its
open sequences hold ``open_tokens`` ids, what they hold is laid out anew back to back:
full sequences, then the last remainder in sequences of powers of two, which need no
padding.  Memory is bounded by ``open_tokens`` and the longest document; there is no
shuffle, and a lost task is simply run again with the same result.

Defined results: a null text is empty (the piece holds only the end id); a null id is an
id like any other; repeated rows are packed each; an empty table gives no pieces; other
columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracetrim.llm.common import pick
from tracetrim.session import ship_package

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long")


class LevelPacker:
    """The level array of one task and the pieces in its open sequences."""

    def __init__(self, capacity: int, open_tokens: int):
        self.capacity, self.limit = capacity, open_tokens
        self.done: list[tuple] = []  # (doc key, start, ids, sequence, offset, tokens in the sequence)
        self.next = 0
        self.reset()

    def reset(self) -> None:
        self.counts = np.zeros(self.capacity + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(self.capacity + 1)]
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        whole = n - n % cap
        for s in range(0, whole, cap):
            self.close([(key, s, ids[s:s + cap])])
        if whole < n:
            self.place(key, whole, ids[whole:].copy())
        if self.held > self.limit:
            self.flush()

    def place(self, key, start: int, ids: np.ndarray) -> None:
        n, counts = len(ids), self.counts
        # moving a sequence from level h to h+n changes the sum of squares by
        # 2*(counts[h+n] - counts[h]) + 2; a full sequence leaves the array, a new one enters it
        levels = np.flatnonzero(counts[: self.capacity - n + 1])
        after = counts[levels + n] + 1
        after[levels + n == self.capacity] = 0
        change = 2 * (after - counts[levels])
        new = 2 * counts[n] + 1
        at = 0
        if len(levels):
            best = change.min()
            if best <= new:
                at = int(levels[np.flatnonzero(change == best)[-1]])  # of equal levels the fullest
        pieces = self.open[at].pop() if at else []
        if at:
            counts[at] -= 1
            self.held -= at
        pieces.append((key, start, ids))
        if at + n == self.capacity:
            self.close(pieces)
        else:
            counts[at + n] += 1
            self.open[at + n].append(pieces)
            self.held += at + n

    def close(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) for p in pieces)
        for key, start, ids in pieces:
            self.done.append((key, start, ids, self.next, offset, total))
            offset += len(ids)
        self.next += 1

    def flush(self) -> None:
        """Lay what is open out back to back: full sequences, then powers of two."""
        left = [p for level in reversed(self.open) for pieces in level for p in pieces]
        rest = sum(len(p[2]) for p in left)
        self.reset()
        sizes = [self.capacity] * (rest // self.capacity)
        rest %= self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = iter(left)
        key, start, ids = next(at, (None, 0, np.empty(0, np.uint32)))
        for size in sizes:
            pieces, room = [], size
            while room:
                if not len(ids):
                    key, start, ids = next(at)
                take = min(room, len(ids))
                pieces.append((key, start, ids[:take]))
                start, ids, room = start + take, ids[take:], room - take
            self.close(pieces)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048,
         open_tokens: int = 4_000_000) -> DataFrame:
    """One row for each piece: which ids of which document lie where in which sequence.

    ``capacity`` is the sequence length; ``tokenizer`` a tokenizers file that every worker
    can open (default: the public byte-level one).
    """
    ship_package(docs.sparkSession)

    def run(batches):
        from tracetrim.llm.tokens import encoder

        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = LevelPacker(capacity, open_tokens)
        base = TaskContext.get().partitionId() << 33

        def rows(done):
            return pa.record_batch({
                "doc_id": pa.array([k[0] for k, *_ in done], pa.int64()),
                "start": pa.array([d[1] for d in done], pa.int64()),
                "length": pa.array([len(d[2]) for d in done], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(d[2].tobytes()) for d in done], pa.int64()),
                "doc_tokens": pa.array([k[1] for k, *_ in done], pa.int64()),
                "sequence_id": pa.array([base + d[3] for d in done], pa.int64()),
                "offset": pa.array([d[4] for d in done], pa.int64()),
                "sequence_tokens": pa.array([d[5] for d in done], pa.int64()),
            })

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py() or "") + end, dtype="<u4")
                packer.add((doc_id, len(ids)), ids)
                if len(packer.done) >= 20_000:
                    yield rows(packer.take())
        packer.flush()
        yield rows(packer.take())

    return pick(docs, "doc_id", "text").mapInArrow(run, PIECES)
