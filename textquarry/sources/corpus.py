"""Corpora as DataFrames with one string column ``text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strict_utf8(raw: DataFrame) -> DataFrame:
    """The column ``text``; fails on bytes that are not UTF-8."""
    fail = F.raise_error(F.lit("corpus is not valid UTF-8"))
    return raw.select(F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(fail).alias("text"))


def read_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A text file, one row a line.

    Only a line feed ends a line; a carriage return before it goes. Lines are cut by the reader, so a
    file of any size is split over tasks. ``strict`` fails on bytes that are not UTF-8.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"))
    return (strict_utf8(raw) if strict else raw).select(F.regexp_replace("text", "\r$", "").alias("text"))


def from_column(df: DataFrame, column: str) -> DataFrame:
    """Any string column as a corpus; null rows hold no items and go."""
    return df.select(F.col(column).alias("text")).where(F.col("text").isNotNull())


def read_table(spark: SparkSession, sf_dir: str, table: str, column: str) -> DataFrame:
    return from_column(spark.read.parquet(f"{sf_dir}/{table}.parquet"), column)
