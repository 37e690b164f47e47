"""Where jobs leave files that several executors read, and how those files are opened."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.shared import new_folder, shared_dir

__all__ = ["bounded", "by_place", "chunks", "create", "drop", "fresh", "lasting_small_batches", "local", "mapped", "new_folder", "quoted", "remove", "rename", "shared_dir", "small_batches", "sweep", "written"]


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lasting_small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time: batches lie outside the heap on one side and in the worker on the other.

    From now on in this session: a frame that a job hands out is planned with the setting of the moment when it is written.
    A smaller setting stays.
    """
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= 1000:
        spark.conf.set(_BATCH_ROWS, "1000")


@contextmanager
def small_batches(spark: SparkSession):
    """The same for a while."""
    before = spark.conf.get(_BATCH_ROWS)
    lasting_small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def local(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A frame of the driver's few rows. From a list Spark would make it in Python workers, by a daemon of their own on each executor."""
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, types.items(), strict=True)}))


#: Bytes of a row group. A reader takes a column of one at once, through a buffer outside the heap that its thread keeps.
ROW_GROUP = 4_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and lost executors don't matter."""
    place, seen = new_folder(df.sparkSession, name), Observation()
    with small_batches(df.sparkSession):
        df.observe(seen, F.sum(_row_bytes(df)).alias("bytes")).write.option("parquet.block.size", ROW_GROUP).parquet(place)
    held = df.sparkSession.read.schema(df.schema).parquet(place)
    held.written_at_, held.bytes_ = place, seen.get.get("bytes") or 0
    return held


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[str]:
    """The names as Spark's expressions take them, whatever they hold."""
    return [f"`{c.replace('`', '``')}`" for c in columns]


def by_place(columns: list[str], df: DataFrame) -> DataFrame:
    """The columns named by their places: what goes to Python workers can't have any name. ``toDF`` gives the names back."""
    return df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(quoted(columns))])


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_at_)


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder and what it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing holds any more: it waits for the driver's garbage collector."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of a table, as Spark holds its rows, up to which it is broadcast.
MAX_BROADCAST_BYTES = 48_000_000


def _row_bytes(table: DataFrame) -> Column:
    """Bytes of a row in memory: numbers take 8, strings and arrays what they hold; the row itself about 40."""
    total = F.lit(40).cast("long")
    for field in table.schema.fields:
        kind, c = field.dataType.typeName(), F.col(quoted([field.name])[0])
        size = F.lit(8)
        if kind in ("string", "binary"):
            size = F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind == "array":
            inner = field.dataType.elementType.typeName()
            each = F.aggregate(c, F.lit(0), lambda n, x: n + F.octet_length(x) + 16) if inner == "string" else F.size(c) * (64 if inner == "struct" else 8)
            size = F.coalesce(each, F.lit(0)) + 32
        total = total + size
    return total


def bounded(table: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """A table of ``written``, to be broadcast if its measured bytes are few enough: no choice is left to estimates.

    ``held``: the written table that ``table`` takes some columns of.
    """
    return F.broadcast(table) if (held or table).bytes_ <= MAX_BROADCAST_BYTES else table


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


@contextmanager
def create(path: str):
    """A binary file to write; folders on the way are made."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as out:
            yield out
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as out:
        yield out


def mapped(path: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped where the store is a file system, else read as a whole."""
    local = _local(path)
    if local is not None:
        return np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as src:
        return np.frombuffer(src.read(), dtype)


def chunks(path: str, size: int = 1 << 18) -> Iterator[bytes]:
    """A file's bytes, a piece at a time."""
    local = _local(path)
    if local is not None:
        with open(local, "rb") as src:
            while piece := src.read(size):
                yield piece
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as src:
        while piece := src.read(size):
            yield piece


def rename(source: str, target: str, size: int) -> None:
    """Gives a file of ``size`` bytes its name; done again, it finds the file in place and leaves it."""
    local = _local(source)
    if local is not None:
        there = _local(target)
        if os.path.exists(local):
            os.replace(local, there)
        elif not os.path.exists(there) or os.path.getsize(there) != size:
            raise FileNotFoundError(source)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(source)
    there = fs.FileSystem.from_uri(target)[1]
    if store.get_file_info(inner).type == fs.FileType.File:
        store.move(inner, there)
    elif store.get_file_info(there).size != size:
        raise FileNotFoundError(source)
