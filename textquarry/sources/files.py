"""Small files beside the data: manifests, and folders that go. Through the Hadoop file system of their path, so any store works."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, place: str) -> str:
    """The path with the scheme that Spark reads it by: one without any belongs to the default file system."""
    path, store = _path(spark, place)
    return store.makeQualified(path).toString().rstrip("/")


def local_path(place: str) -> str | None:
    """The path on this machine of a ``file:`` one, else None."""
    parsed = urlparse(place)
    return unquote(parsed.path) if parsed.scheme == "file" else None


def names(spark: SparkSession, place: str) -> list[str]:
    """What a folder holds, sorted; nothing if there is no such folder."""
    path, store = _path(spark, place)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def exists(spark: SparkSession, place: str) -> bool:
    path, store = _path(spark, place)
    return store.exists(path)


def remove(spark: SparkSession, place: str) -> None:
    path, store = _path(spark, place)
    store.delete(path, True)


def read(spark: SparkSession, place: str) -> str:
    path, store = _path(spark, place)
    stream = store.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, place: str, text: str) -> bool:
    """Puts a whole file at a path that has none; False if another writer was there first.

    It is written beside the path and then named: readers see all of it or nothing.
    """
    place = qualified(spark, place)
    folder, name = place.rsplit("/", 1)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    local = local_path(place)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = local_path(beside)
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, local)  # fails where there is a file; a rename would replace it
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    path, store = _path(spark, beside)
    out = store.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()
    if store.rename(path, spark._jvm.org.apache.hadoop.fs.Path(place)):
        return True
    store.delete(path, False)
    return False
