"""The folder that all executors of a session share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from textquarry.sources.files import qualified


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, with its scheme: without one it belongs to the default file system, not to the machine.

    Only a session on one machine that has none gets a temporary one.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if place:
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(place)
        return qualified(spark, place)
    if not held.isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textquarry-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return qualified(spark, held.get())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
