"""Dataset folders of Arrow shard files as a Spark source and sink.

Layout (fixed by the format): a dataset is a folder with ``state.json`` that lists its shard files (Arrow IPC
streams, in order), ``dataset_info.json`` with the column features, and the shards.  A folder with
``dataset_dict.json`` holds one such folder per split and lists their names.

Reading: the driver reads the lists and the first shard's schema; each shard is a partition of its own, read batch
by batch, so memory holds one batch and ``take(n)`` opens as few shards as it needs.  Columns that Spark
does not ask for are still decoded (the files are streams), but not sent.

Writing: each task writes its own shards (a new one at ``shard_mb``), named by the attempt; the
lists are written at commit and name the files of the tasks that Spark committed, so a retried or speculative task
adds nothing.  Files of failed attempts are removed.

Paths are opened by ``pyarrow.fs`` on driver and executors, so any store that it opens (shared or local files, S3, GCS,
HDFS) works and all machines must reach it.

Defined results: an empty dataset keeps its columns; a missing split is an error that names the splits there are; a
folder without lists is an error.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tracetrim.session import ship_package

FORMAT = "arrow_folder"
# The names and fields of the folder format.
STATE, INFO, SPLITS = "state.json", "dataset_info.json", "dataset_dict.json"
FEATURE_KEY = b"huggingface"
STATE_FIELDS = {"_format_columns": None, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None}


def open_folder(path: str):
    """(file system, path there) for a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


def _json(files, path: str):
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def _there(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type == fs.FileType.File


def is_arrow_folder(path: str) -> bool:
    """Whether the path holds the lists of this format; a store that ``pyarrow.fs`` cannot open does not."""
    try:
        files, at = open_folder(path)
        return any(_there(files, f"{at}/{name}") for name in (STATE, SPLITS))
    except (OSError, ValueError, pa.ArrowException):
        return False


def splits_of(path: str) -> list[str]:
    """The split names of a folder of splits, none for a single dataset."""
    files, at = open_folder(path)
    return _json(files, f"{at}/{SPLITS}")["splits"] if _there(files, f"{at}/{SPLITS}") else []


def choose_split(path: str, split: str | None) -> str:
    """The folder to read: the asked split, else "train", else the first; a single dataset is itself, whatever is asked."""
    names = splits_of(path)
    if not names:
        return path
    if split is not None and split not in names:
        raise ValueError(f"there is no split {split!r} in {path}; there are {names}")
    return f"{path.rstrip('/')}/{split or ('train' if 'train' in names else names[0])}"


def shards_of(path: str) -> list[str]:
    files, at = open_folder(path)
    if not _there(files, f"{at}/{STATE}"):
        raise ValueError(f"{path} has no {STATE}: it is no Arrow dataset folder")
    return [entry["filename"] for entry in _json(files, f"{at}/{STATE}")["_data_files"]]


def _plain(schema: pa.Schema) -> pa.Schema:
    """Without metadata and dictionaries, which Spark's types do not know."""
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema])


def schema_of(path: str) -> pa.Schema:
    """The first shard's schema."""
    files, at = open_folder(path)
    with files.open_input_stream(f"{at}/{shards_of(path)[0]}") as f, pa.ipc.open_stream(f) as reader:
        return _plain(reader.schema)


def feature(kind: pa.DataType):
    """A column type as the format's feature entry."""
    if pa.types.is_struct(kind):
        return {f.name: feature(f.type) for f in kind}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        inner = feature(kind.value_type)
        # a list of records is a record around the list, in the format's words
        return [inner] if pa.types.is_struct(kind.value_type) else {"feature": inner, "_type": "Sequence"}
    names = {pa.float64(): "float64", pa.float32(): "float32", pa.large_string(): "string"}
    return {"dtype": names.get(kind, str(kind)), "_type": "Value"}


class Shard(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class ArrowFolderReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def partitions(self):
        return [Shard(name) for name in shards_of(self.path)]

    def read(self, partition):
        wanted = to_arrow_schema(self.schema)
        files, at = open_folder(self.path)
        with files.open_input_stream(f"{at}/{partition.name}") as f, pa.ipc.open_stream(f) as reader:
            for batch in reader:
                yield pa.RecordBatch.from_arrays([_as(batch, field) for field in wanted], schema=wanted)


def _as(batch: pa.RecordBatch, field: pa.Field) -> pa.Array:
    at = batch.schema.get_field_index(field.name)
    if at < 0:
        return pa.nulls(batch.num_rows, field.type)
    column = batch.column(at)
    return column.dictionary_decode().cast(field.type) if pa.types.is_dictionary(column.type) else column.cast(field.type)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str], task: int):
        self.names, self.task = names, task


class ArrowFolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema, shard_mb: int, overwrite: bool):
        self.path, self.shard_bytes, self.overwrite = path, shard_mb << 20, overwrite
        plain = to_arrow_schema(schema)
        info = {"info": {"features": {f.name: feature(f.type) for f in plain}}}
        self.schema, self.info = plain.with_metadata({FEATURE_KEY: json.dumps(info).encode()}), info["info"]

    def write(self, iterator):
        from pyspark import TaskContext

        files, at = open_folder(self.path)
        files.create_dir(at, recursive=True)
        task, attempt, names = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], []
        out = sink = None
        try:
            for batch in iterator:
                if out is None:
                    names.append(f"data-{task:05d}-{attempt}-{len(names):05d}.arrow")
                    sink = files.open_output_stream(f"{at}/{names[-1]}")
                    out, size = pa.ipc.new_stream(sink, self.schema), 0
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.schema)], schema=self.schema))
                size += batch.nbytes
                if size >= self.shard_bytes:
                    out.close()
                    sink.close()
                    out = None
            if out is not None:
                out.close()
                sink.close()
        except BaseException:
            if sink is not None:
                sink.close()
            for name in names:
                files.delete_file(f"{at}/{name}")
            raise
        return Written(names, task)

    def commit(self, messages):
        files, at = open_folder(self.path)
        files.create_dir(at, recursive=True)
        names = [n for m in sorted((m for m in messages if m), key=lambda m: m.task) for n in m.names]
        old = [] if self.overwrite or not _there(files, f"{at}/{STATE}") else shards_of(self.path)
        if not names + old:  # an empty dataset: one shard that holds its schema
            names = [f"data-00000-{uuid.uuid4().hex[:12]}-00000.arrow"]
            with files.open_output_stream(f"{at}/{names[0]}") as f, pa.ipc.new_stream(f, self.schema):
                pass
        replaced = shards_of(self.path) if self.overwrite and _there(files, f"{at}/{STATE}") else []
        state = {"_data_files": [{"filename": n} for n in old + names], "_fingerprint": uuid.uuid4().hex[:16], **STATE_FIELDS}
        info = {"citation": "", "description": "", "features": self.info["features"], "homepage": "", "license": ""}
        for name, content in ((INFO, info), (STATE, state)):
            with files.open_output_stream(f"{at}/{name}") as f:
                f.write(json.dumps(content, indent=2).encode())
        for name in replaced:  # no list names them any more
            files.delete_file(f"{at}/{name}")

    def abort(self, messages):
        files, at = open_folder(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{at}/{name}")


class ArrowFolder(DataSource):
    """``format("arrow_folder")``: options ``path``, ``split`` and, to write, ``shard_mb`` (default 500)."""

    @classmethod
    def name(cls):
        return FORMAT

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("name the folder: load(path) or save(path)")
        return self.options["path"]

    def schema(self):
        return from_arrow_schema(schema_of(choose_split(self._path(), self.options.get("split"))))

    def reader(self, schema):
        return ArrowFolderReader(choose_split(self._path(), self.options.get("split")), schema)

    def writer(self, schema, overwrite):
        return ArrowFolderWriter(self._path(), schema, int(self.options.get("shard_mb", "500")), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and its workers."""
    ship_package(spark)
    spark.dataSource.register(ArrowFolder)


def read_arrow(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(FORMAT)
    return (reader if split is None else reader.option("split", split)).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite", shard_mb: int = 500) -> None:
    """One dataset at ``path``."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode(mode).option("shard_mb", str(shard_mb)).save(path)


def write_arrow_splits(splits: dict[str, DataFrame], path: str, shard_mb: int = 500) -> None:
    """A folder of splits; the list of their names is written last."""
    for name, df in splits.items():
        write_arrow(df, f"{path.rstrip('/')}/{name}", shard_mb=shard_mb)
    files, at = open_folder(path)
    with files.open_output_stream(f"{at.rstrip('/')}/{SPLITS}") as f:
        f.write(json.dumps({"splits": list(splits)}).encode())
