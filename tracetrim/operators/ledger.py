"""Calls to a user's model that are paid for once.

A task hands its rows to the callable in chunks.  With a ledger, each chunk's answers are written to the
shared folder as soon as they come, under a hash of their request; when the task is run again (a lost
executor, a failure later in the task), it reads its partition's answers first and asks only for what is not there.
A speculative copy of a task reads what the first has written by then and may ask for the rest: leave
``spark.speculation`` off where a call costs money.

A chunk whose call raises is halved, and the halves again, until the rows that fail stand alone: one bad row among n
costs at most 2 log2(n) calls more, and no answered row is asked again.  A row that fails alone is a row with its
error; errors are not written to the ledger, so a later run asks again.

Answers belong to requests by position when the callable returns as many rows with the same keys, else by key.
"""

from __future__ import annotations

import hashlib
import uuid

from tracetrim.sources.arrow_folder import open_folder

KEY = "_request"


def request_hash(values) -> str:
    """A hash of one request's values; arrays (steps) count by their elements."""
    return hashlib.sha256(repr([list(v) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else v for v in values]).encode("utf-8", "surrogatepass")).hexdigest()


class Ledger:
    """The answers of one partition: a folder of small files, each written whole under a fresh name."""

    def __init__(self, path: str, partition: int):
        from pyarrow import fs, parquet

        self.files, at = open_folder(path)
        self.at = f"{at.rstrip('/')}/part-{partition:06d}"
        self.known: dict[str, list[dict]] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.at, allow_not_found=True)):
            if not info.path.endswith(".parquet"):
                continue
            with self.files.open_input_file(info.path) as f:
                for row in parquet.read_table(f).to_pylist():
                    self.known.setdefault(row.pop(KEY), []).append(row)

    def commit(self, hashes: list[str], answers) -> None:
        import pyarrow as pa
        from pyarrow import parquet

        self.files.create_dir(self.at, recursive=True)
        name = f"{self.at}/{uuid.uuid4().hex}"
        table = pa.Table.from_pylist([{KEY: h, **a} for h, a in zip(hashes, answers)])
        with self.files.open_output_stream(name + ".part") as f:
            parquet.write_table(table, f)
        self.files.move(name + ".part", name + ".parquet")  # seen whole or not at all


def usable_ledger(path: str | None) -> str | None:
    """``path`` if its store can be opened without Spark, else None: calls are then not kept."""
    if path is None:
        return None
    try:
        open_folder(path)
    except Exception:  # noqa: BLE001 - no such file system here
        return None
    return path


def answers(fn, batches, failed, columns: list[str], key: str, ledger: str | None = None, call_rows: int | None = None):
    """The pandas results of ``fn`` over pandas ``batches``, ``columns`` only, each row asked for once.

    ``failed(row, message)`` makes the result of a row whose own call raises.
    """
    import pandas as pd

    held = None
    if ledger is not None:
        from pyspark import TaskContext

        held = Ledger(ledger, TaskContext.get().partitionId())

    def shaped(out):
        out = out.reset_index(drop=True)
        # plain objects: columns backed by chunked arrays do not go back to Spark
        return pd.DataFrame({c: out[c].astype(object).where(out[c].notna(), None) if c in out.columns else None for c in columns}, index=out.index)

    def ask(rows, hashes):
        try:
            out = shaped(fn(rows))
        except Exception as e:  # noqa: BLE001 - whatever a user's client raises
            if len(rows) == 1:
                yield shaped(failed(rows, str(e)))
                return
            half = len(rows) // 2
            yield from ask(rows.iloc[:half], hashes[:half])
            yield from ask(rows.iloc[half:], hashes[half:])
            return
        if held is not None and len(out):
            if list(out[key]) == list(rows[key]):
                own = hashes
            else:
                by_key = dict(zip(reversed(list(rows[key])), reversed(hashes)))
                own = [by_key.get(k) for k in out[key]]
            kept = [(h, {c: None if _missing(v) else v for c, v in r.items()}) for h, r in zip(own, out.to_dict("records")) if h is not None]
            held.commit([h for h, _ in kept], [r for _, r in kept])
        yield out

    for pdf in batches:
        for lo in range(0, len(pdf), call_rows or max(1, len(pdf))):
            rows = pdf.iloc[lo: lo + (call_rows or len(pdf))]
            if held is None:
                yield from ask(rows, [""] * len(rows))
                continue
            hashes = [request_hash(v) for v in rows.itertuples(index=False, name=None)]
            old = [r for h in hashes for r in held.known.get(h, ())]
            if old:
                yield shaped(pd.DataFrame(old))
            new = [i for i, h in enumerate(hashes) if h not in held.known]
            if new:
                yield from ask(rows.iloc[new], [hashes[i] for i in new])


def _missing(v) -> bool:
    import pandas as pd

    return v is None or v is pd.NA or (isinstance(v, float) and v != v)
