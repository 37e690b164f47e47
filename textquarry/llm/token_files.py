"""Operator 2: token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds, for each part, ``<part>.bin`` (ids of 16 bits if the vocabulary fits, else 32, little
endian), ``<part>.off`` (one unsigned 64-bit count per document and one more: ids of the part before it),
``<part>.doc`` (64-bit document ids, 0 for null) and ``<part>.nul`` (a byte per document, 1 for null). ``manifest`` keeps the parts in order with
their bases, the prefix sums of the parts' totals: a document's global offset is base plus local offset.
The files are memory-mapped when read.

Nulls: a null text is empty and has the end id only; a null doc_id sorts first. Repeated doc_ids stay as they
are, next to each other. An empty table gives no part. Further columns are not read. Parts are named
by task attempt and only attempts that ended are listed, so a repeated task leaves no double rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import storage
from textquarry.llm.encoding import encoder
from textquarry.llm.token_counts import runs
from textquarry.llm.workers import lean

#: Bytes of text encoded at once by a task.
BATCH_BYTES = 2_000_000


class Part(NamedTuple):
    name: str
    documents: int
    ids: int
    #: Numbers of the first document and of the first id.
    document_base: int
    id_base: int

    def open(self, folder: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets in the part, document ids and which of these are null."""
        stem = f"{folder}/{self.name}"
        return storage.mapped(f"{stem}.bin", dtype), storage.mapped(f"{stem}.off", "<u8"), storage.mapped(f"{stem}.doc", "<i8"), storage.mapped(f"{stem}.nul", "|u1")


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    dtype: str
    #: In order.
    parts: tuple[Part, ...]

    @property
    def n_tokens(self) -> int:
        return sum(p.ids for p in self.parts)

    def manifest(self) -> str:
        return json.dumps({"dtype": self.dtype, "parts": [p._asdict() for p in self.parts]})

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.parts[k].open(self.folder, self.dtype)


def load(folder: str) -> TokenFiles:
    spec = json.loads(bytes(storage.mapped(f"{folder}/manifest", np.uint8)))
    return TokenFiles(folder, spec["dtype"], tuple(Part(**p) for p in spec["parts"]))


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Documents in runs of bounded size."""
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in runs(sizes, BATCH_BYTES):
            yield batch.column(0).slice(a, b - a), [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, in_order: bool = True) -> TokenFiles:
    """Encodes ``doc_id, text`` and writes the files; ``in_order``: by ascending doc_id over all parts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if in_order:
        rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # rows of one id are split

    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    dtype = "<u2" if largest < 2**16 else "<u4"

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        enc, docs_done, ids_done = encoder(tokenizer), 0, 0
        first = next(batches := _batches(stream), None)
        if first is None:
            return
        stem = f"{folder}/{name}"
        with storage.create(f"{stem}.bin") as ids_out, storage.create(f"{stem}.off") as off_out, storage.create(f"{stem}.doc") as doc_out, storage.create(f"{stem}.nul") as nul_out:
            off_out.write(np.zeros(1, "<u8").tobytes())
            run = first
            while run is not None:
                doc_ids, texts = run
                flat, counts = enc.encode(texts)
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(counts), end_id)
                    counts = counts + 1
                ids_out.write(flat.astype(dtype).tobytes())
                off_out.write((ids_done + np.cumsum(counts)).astype("<u8").tobytes())
                doc_out.write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nul_out.write(doc_ids.is_null().to_numpy(zero_copy_only=False).astype("|u1").tobytes())
                docs_done, ids_done = docs_done + len(doc_ids), ids_done + len(flat)
                run = next(batches, None)
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "documents": [docs_done], "ids": [ids_done]})

    # One row for each task, whatever the input holds.
    with storage.small_batches(docs.sparkSession):
        done = sorted(rows.mapInArrow(lean("tokens", task), "part long, name string, documents long, ids long").collect())
    parts, n_docs, n_ids = [], 0, 0
    for row in done:
        parts.append(Part(row["name"], row["documents"], row["ids"], n_docs, n_ids))
        n_docs, n_ids = n_docs + row["documents"], n_ids + row["ids"]
    files = TokenFiles(folder, dtype, tuple(parts))
    with storage.create(f"{folder}/manifest") as out:
        out.write(files.manifest().encode())
    return files


def per_part(spark: SparkSession, files: TokenFiles, job, schema: str) -> DataFrame:
    """``job(part, files of the part)`` yields record batches; one task a part, which is told of its own part alone."""
    if not files.parts:
        return spark.createDataFrame([], schema)
    folder, dtype = files.folder, files.dtype

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.drop_columns(["k"]).to_pylist():
                part = Part(**row)
                yield from job(part, part.open(folder, dtype))

    numbers = dict.fromkeys(("documents", "ids", "document_base", "id_base"), pa.int64())
    listed = storage.local(spark, [(k, *p) for k, p in enumerate(files.parts)], k=pa.int32(), name=pa.string(), **numbers)
    return listed.repartitionById(len(files.parts), F.col("k")).mapInArrow(lean("tokens", task), schema)


def nullable_ids(ids: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.array(np.array(ids), pa.int64(), mask=np.array(nulls, bool))


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Every document as the files hold it: doc_id, start (ids before it), ids."""

    def job(held: Part, opened: tuple) -> Iterator[pa.RecordBatch]:
        ids, offsets, docs, nulls = opened
        for at in range(0, len(docs), 256):
            part = offsets[at : at + 257].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(ids[part[0] : part[-1]].astype(np.int32)))
            starts = pa.array(part[:-1] + held.id_base, pa.int64())
            yield pa.RecordBatch.from_arrays([nullable_ids(docs[at : at + 256], nulls[at : at + 256]), starts, lists], ["doc_id", "start", "ids"])

    return per_part(spark, files, job, "doc_id long, start long, ids array<int>")


def digest(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the mapped files."""

    def job(held: Part, opened: tuple) -> Iterator[pa.RecordBatch]:
        ids, offsets, docs, nulls = opened
        for at in range(0, len(docs), 8192):
            part = offsets[at : at + 8193].astype(np.int64)
            sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(part[:-1], part[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [nullable_ids(docs[at : at + 8192], nulls[at : at + 8192]), pa.array(part[:-1] + held.id_base, pa.int64()), pa.array(np.diff(part), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return per_part(spark, files, job, "doc_id long, start long, n_tokens long, ids_crc32 long")
