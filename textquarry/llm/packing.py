"""Operator 5: packing by concatenating and cutting.

Pass one encodes every document, with its end id, into token files and yields each part's total. Prefix
sums of those totals give every part the global offset of its first id. Pass two maps the files and cuts
the one long run of ids into windows of ``length``: window w holds the ids from w * length on. A window
that two or more parts share is written in pieces by each of them (boundary records), and those
alone are put together by a shuffle when whole sequences are asked for. Only the last window is not full.

A null text is empty and gives its end id. Rows with the same doc_id are packed one by one. An empty
table gives no piece. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.token_files import Part, TokenFiles, nullable_ids, per_part, write

LENGTH = 2048
#: Documents cut at once.
RUN = 4096


def encode(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> TokenFiles:
    return write(docs, folder, tokenizer, end_id, in_order=False)


def _cuts(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents at global [start, end): document number, piece start and end."""
    first, last = starts // length, (ends - 1) // length
    n = last - first + 1
    doc = np.repeat(np.arange(len(starts)), n)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    return doc, np.maximum(starts[doc], window * length), np.minimum(ends[doc], (window + 1) * length)


def pieces(spark: SparkSession, files: TokenFiles, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""

    def job(held: Part, opened: tuple) -> Iterator[pa.RecordBatch]:
        ids, offsets, docs, nulls = opened
        base = held.id_base
        for at in range(0, len(docs), RUN):
            bounds = offsets[at : at + RUN + 1].astype(np.int64) + base
            starts, ends = bounds[:-1], bounds[1:]
            doc, a, b = _cuts(starts[ends > starts], ends[ends > starts], length)
            doc = np.flatnonzero(ends > starts)[doc]
            sums = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(a - base, b - base, strict=True)]
            columns = {
                "doc_id": nullable_ids(docs[at : at + RUN][doc], nulls[at : at + RUN][doc]),
                "start": pa.array(a - starts[doc], pa.int64()),
                "length": pa.array(b - a, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": pa.array((ends - starts)[doc], pa.int64()),
                "sequence_id": pa.array(a // length, pa.int64()),
                "offset": pa.array(a % length, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return per_part(
        spark,
        files,
        job,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def sequences(spark: SparkSession, files: TokenFiles, length: int = LENGTH) -> DataFrame:
    """sequence_id and its ids; windows inside one part come straight from its file."""

    def job(held: Part, opened: tuple) -> Iterator[pa.RecordBatch]:
        ids = opened[0]
        base, n = held.id_base, len(ids)
        at = 0
        while at < n:
            window = (base + at) // length
            end = min(n, (window + 1) * length - base)
            yield pa.RecordBatch.from_arrays(
                [pa.array([window]), pa.array([(base + at) % length]), pa.array([ids[at:end].astype(np.int32).tolist()], pa.list_(pa.int32()))],
                ["sequence_id", "offset", "ids"],
            )
            at = end

    rows = per_part(spark, files, job, "sequence_id long, offset long, ids array<int>")
    full = F.size("ids") == length
    whole = rows.where(full).select("sequence_id", "ids")
    shared = rows.where(~full).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.unionByName(shared.select("sequence_id", F.flatten("parts.ids").alias("ids")))
