"""Shared working folders, hot keys, and small file access for operators that write.

Everything an executor writes and another process reads goes below the folder
named by ``spark.checkpoint.dir``.  Only a local session without that setting
(tests, notebooks) gets a temporary folder; a cluster without it gets an error.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_MADE: list[tuple] = []

#: A key is hot if it has one in so many of all rows: there are never more hot keys than this, whatever the input.
HOT_SHARE = 10_000
#: Keys with fewer rows than this are never hot.
LEAST_HOT = 1000


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="carteel-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        root = "file://" + _LOCAL[0]
    return root.rstrip("/")


def _clear() -> None:
    """Results are read from their workspaces as long as the session lives; then nobody needs them."""
    for path, conf in _MADE:
        with contextlib.suppress(Exception):  # the session's gateway may be gone
            path.getFileSystem(conf).delete(path, True)


def workspace(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of an operator, removed when the process ends."""
    folder = f"{shared_root(spark)}/carteel/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_clear)
    _MADE.append((spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jsc.hadoopConfiguration()))
    return folder


def hot_keys(rows: DataFrame, key: str, folder: str, name: str) -> DataFrame:
    """The values of ``key`` with at least max(LEAST_HOT, rows / HOT_SHARE) rows, HOT_SHARE at most, written down."""
    least = max(LEAST_HOT, -(-rows.count() // HOT_SHARE))
    return written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(key), folder, name)


def joined(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has a row for each ``key``: rows of the hot keys stay where they are, the others are shuffled."""
    warm = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return cold.unionByName(warm)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that no column of an operator can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def written(df: DataFrame, folder: str, name: str, compression: str = "zstd", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once below ``folder``, in folders for the columns ``by``, and read it back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write_file(uri: str, chunks) -> int:
    """Write the byte chunks to ``uri`` and return their length.

    The file appears whole under its name or not at all, so a retried or
    speculative task only replaces equal content."""
    size, local = 0, _local(uri)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as out:
            for chunk in chunks:
                size += out.write(chunk)
        os.replace(part, local)
        return size
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    where.move(part, path)
    return size


class RangeReader:
    """Random reads of one file."""

    def __init__(self, uri: str):
        local = _local(uri)
        if local is not None:
            self._file = open(local, "rb")  # noqa: SIM115
            self.size = os.fstat(self._file.fileno()).st_size
        else:
            from pyarrow import fs

            where, path = fs.FileSystem.from_uri(uri)
            self._file = where.open_input_file(path)
            self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        data = self._file.read(length)
        if len(data) != length:
            raise EOFError(f"{length} bytes wanted at {offset}, {len(data)} there")
        return data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()
