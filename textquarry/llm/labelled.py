"""Bounded samples of labelled rows, and the split that keeps a fifth of the labels unseen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.storage import local

#: Rows whose crc32 leaves remainder 0 are held out.
FOLDS = 5
#: Bytes of text that a sample holds of each class at most. Rows are taken in the order of their hash; one that
#: would not fit is passed over. They are scored whole.
TRAIN_BYTES = 32_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, text, lang, source, y, n_y: at most ``per_class`` rows of each class, those of least hash, and
    the number of labels that class has.

    Rows held out, without label or without doc_id are never taken, nor are those with both labels. Of repeated ids the
    row of the least text is taken.
    """
    seen = labels.select(F.col("doc_id").cast("long").alias("id_"), F.col(label).cast("int").alias("y"))
    seen = seen.where(F.col("id_").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id_")))
    seen = seen.groupBy("id_").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    totals = {r.y: r.n for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = None
    for y in (0, 1):
        some = seen.where(F.col("y") == y).orderBy(F.xxhash64("id_"), "id_").limit(per_class)
        picks = some if picks is None else picks.unionByName(some)
    rows = _columns(docs).join(F.broadcast(picks), F.col("doc_id") == F.col("id_"))  # 2 * per_class rows at most
    sizes = rows.groupBy("id_", "y").agg(F.max(F.octet_length("text")).alias("size"), F.xxhash64("id_").alias("turn"))
    left, taken = {0: train_bytes, 1: train_bytes}, []
    for r in sorted(sizes.collect(), key=lambda r: (r.turn, r.id_)):
        if (r.size or 0) <= left[r.y]:
            left[r.y] -= r.size or 0
            taken.append((r.id_, r.y, totals[r.y]))
    chosen = F.broadcast(local(docs.sparkSession, taken, id_=pa.int64(), y=pa.int32(), n_y=pa.int64()))
    rows = _columns(docs).join(chosen, F.col("doc_id") == F.col("id_"))
    least = rows.groupBy("doc_id", "y", "n_y").agg(F.min(F.struct("text", "lang", "source")).alias("r"))
    return least.select("doc_id", "r.text", "r.lang", "r.source", "y", "n_y")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )


def learnable(docs: DataFrame) -> DataFrame:
    """The same columns (y null) of all rows with a doc_id that isn't held out, labelled or not, of any length."""
    rows = _columns(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.withColumn("y", F.lit(None).cast("int"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients and, last, the intercept, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * c)
    return c
