"""Spark session helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; we read it
from the session and only set one ourselves when it is unset (local runs, tests).
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "tracetrim", shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call sites noted for every expression double the time that a long plan takes to define
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, bench) a folder of our own is
    set; on a cluster an unset folder is an error, because a machine-local folder would
    be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tracetrim-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_WRITTEN: list[tuple[SparkSession, str]] = []
_AT_EXIT: list = []


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that ``shared_table`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table's write into ``path`` has been committed."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _remove_all() -> None:
    for spark, path in _WRITTEN:
        try:
            remove_shared(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already: nothing can be read or removed
            return


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when this process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _AT_EXIT:
        _AT_EXIT.append(atexit.register(_remove_all))
    _WRITTEN.append((spark, path))
    return path


def shared_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as a parquet table under the shared checkpoint folder; the table
    read back (lineage is cut, every later use sees the same rows) and its path."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def tables_of():
    """The paths of the shared tables written inside the block, for a caller that knows when nothing reads them any more."""
    paths: list[str] = []
    before = len(_WRITTEN)
    yield paths
    paths.extend(path for _, path in _WRITTEN[before:])


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """``shared_table`` for callers that keep the table to the end of the process."""
    return shared_table(df, name)[0]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: their search path need not hold it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tracetrim-src-"), "tracetrim.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
