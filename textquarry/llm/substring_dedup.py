"""Operator 6: repeated passages found by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are hashed by a 32-bit gear hash, whose value depends on the last ``WINDOW`` bytes only. A
chunk ends where the hash is the least within ``RADIUS`` bytes on either side, so cuts depend on the bytes
around them alone: an insertion moves only the cuts next to it, and the same passage is cut alike in
any document. Text with a period of ``RADIUS`` or less ties at every period; it is cut every so many whole periods,
so a long stretch of it repeats itself and all but its first chunk goes. Chunks are told apart by a 64-bit digest. The owner of a digest is its least (doc_id, start);
every other chunk with it is a repeat. Repeats side by side form a run, and runs of ``MIN_RUN`` bytes or more
are removed; shorter ones, such as a shared short line, stay. A false match of digests would need a run of
several such chunks to have an effect.

Digests are pre-aggregated before the shuffle and joined back one owner row each, so a passage makes no pairs. Those
that ``HOT_REPEATS`` chunks or more have are joined in as many parts as that asks for, so a passage that a third of all
documents hold doesn't meet in one task.

Null and empty texts have no chunks and pass unchanged. Equal doc_ids count as one document: a repeated row
is no repeat of itself. Rows without doc_id come first, and are one document if their texts are equal. An empty table gives
none. All columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from textquarry.llm.storage import bounded, by_place, fresh, quoted, written
from textquarry.llm.token_counts import runs
from textquarry.llm.workers import lean

#: Bytes that a hash value depends on: the gear hash is shifted by two bits a byte.
WINDOW = 16
RADIUS = 16
#: Bytes of a run of repeats from which it is removed.
MIN_RUN = 128
#: Chunks of one digest that are joined by one task, about.
HOT_REPEATS = 20_000
BATCH_BYTES = 2_000_000
#: The gear table, from a rule: the first four bytes of a digest of each byte value.
GEAR = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
_FAR = np.uint32(0xFFFFFFFF)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the last 16 bytes' gear values, each shifted by twice its age."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        h = h + (older << np.uint32(2 * span))
        span *= 2
    return h


def _least_around(h: np.ndarray) -> np.ndarray:
    """The least value within RADIUS places on either side."""
    width, out, span = 2 * RADIUS + 1, np.concatenate([np.full(RADIUS, _FAR), h, np.full(RADIUS, _FAR)]), 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def _apart(least: np.ndarray) -> np.ndarray:
    """Places of which each is more than RADIUS behind the one kept before it.

    Places nearer than that are ties, so the text between them has a period. Counted from the last one kept, whole
    periods are chunks, alike wherever the stretch stands; counted from the last tie, the stretch would be one chunk.
    """
    near = np.flatnonzero(np.diff(least) <= RADIUS) + 1
    if not len(near):
        return least
    keep = np.ones(len(least), bool)
    places, last, before = least[near].tolist(), 0, -1
    for k, place in zip(near.tolist(), places, strict=True):
        if k - 1 != before:  # a new chain: the place before it is kept
            last = int(least[k - 1])
        keep[k] = place - last > RADIUS
        last, before = place if keep[k] else last, k
    return least[keep]


def cut(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text."""
    if not len(data):
        return np.empty(0, np.int64)
    h = rolling(data)
    least = np.flatnonzero(h == _least_around(h))
    ends = _apart(least) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def digests(data: bytes, ends: np.ndarray) -> list[int]:
    out, at = [], 0
    for end in ends.tolist():
        out.append(int.from_bytes(blake2b(data[at:end], digest_size=8).digest(), "little", signed=True))
        at = end
    return out


def _text_hash(text: Column) -> Column:
    """Tells rows without doc_id apart; 0 for the others."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.lit(0))


def chunks(docs: DataFrame) -> DataFrame:
    """digest, doc_id, h (hash of the text of rows without doc_id), start, of every chunk of every text."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(2)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs(sizes, BATCH_BYTES):
                keys, starts, found, counts = [], [], [], []
                for k in range(a, b):
                    if not sizes[k]:
                        continue
                    data = texts[k].as_buffer().to_pybytes()
                    ends = cut(np.frombuffer(data, np.uint8))
                    found += digests(data, ends)
                    starts.append(np.concatenate([[0], ends[:-1]]))
                    keys.append(k)
                    counts.append(len(ends))
                if keys:
                    of = pa.array(np.repeat(keys, counts))
                    columns = [pa.array(found, pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(starts).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "h", "start"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", _text_hash(F.col("text")).alias("h"), "text").mapInArrow(lean("chunks", task), "digest long, doc_id long, h long, start int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, h, and the document's repeated chunks as sorted structs (start, digest, owner)."""
    laid = chunks(docs)
    owners = laid.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    owners = owners.where("n > 1").select("digest", "n", F.col("first.doc_id").alias("owner"), F.col("first.h").alias("owner_h"), F.col("first.start").alias("owner_start"))
    owners = written(owners, "owners")
    hot = written(owners.where(F.col("n") > HOT_REPEATS).select("digest", F.ceil(F.col("n") / HOT_REPEATS).cast("int").alias("parts")), "hot-digests")
    salted = laid.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        part = F.coalesce(F.pmod(F.xxhash64("doc_id", "h", "start"), "parts"), F.lit(0)).cast("int")
        salted = laid.join(bounded(hot), "digest", "left").withColumn("part", part).drop("parts")
    spread = owners.withColumn("part", F.explode_outer(F.sequence(F.lit(0), F.when(F.col("n") > HOT_REPEATS, F.ceil(F.col("n") / HOT_REPEATS).cast("int") - 1).otherwise(F.lit(0)))))
    found = salted.join(spread.drop("n"), ["digest", "part"])
    itself = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("h") == F.col("owner_h")) & (F.col("start") == F.col("owner_start"))
    # A document's chunks at most.
    return found.where(~itself).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "digest", "owner"))).alias("repeats"))


def removable(data: bytes, marked: dict[tuple[int, int], int | None], min_run: int = MIN_RUN) -> list[tuple[int, int, list]]:
    """Runs of marked chunks: start, end in bytes, and their owners."""
    ends = cut(np.frombuffer(data, np.uint8))
    out: list[tuple[int, int, list]] = []
    start, at, owners = -1, 0, []
    for end, digest in zip(ends.tolist(), digests(data, ends), strict=True):
        hit = (at, digest) in marked
        if hit:
            start = at if start < 0 else start
            owners.append(marked[at, digest])
        if start >= 0 and (not hit or end == len(data)):
            stop = end if hit else at
            if stop - start >= min_run:
                out.append((start, stop, owners))
            start, owners = -1, []
        at = end
    # A cut may fall inside a character: a removed span ends and starts at whole ones.
    whole = []
    for a, b, o in out:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b, o))
    return whole


def dedup(docs: DataFrame, min_run: int = MIN_RUN, spans_name: str = "repeat_spans") -> DataFrame:
    """All columns of ``docs``, text without repeated passages, and ``spans_name``: start, length (bytes of the old text), owners.

    A column of the input that has that name is replaced.
    """
    docs = docs.drop(spans_name)
    d, h, r, own = (fresh([*docs.columns, spans_name], x) for x in ("d", "h", "r", "own_h"))
    found = repeats(docs).select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("repeats").alias(r))
    text = docs.withColumn(own, _text_hash(F.col("text").cast("string")))
    same = text["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h))
    joined = text.join(found, same, "left").select(*[text[c] for c in quoted(docs.columns)], r)
    names = docs.columns
    text_at, r_at = names.index("text"), len(names)
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("owners", pa.list_(pa.int64()))]))

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts, spans = batch.column(text_at), [[]] * batch.num_rows
            new: dict[int, str] = {}
            for k in np.flatnonzero(batch.column(r_at).is_valid().to_numpy(zero_copy_only=False)).tolist():
                if not texts[k].is_valid:
                    continue
                data = texts[k].as_buffer().to_pybytes()
                marked = {(m["start"], m["digest"]): m["owner"] for m in batch.column(r_at)[k].as_py()}
                gone = removable(data, marked, min_run)
                if gone:
                    kept, at = [], 0
                    for a, b, _ in gone:
                        kept.append(data[at:a])
                        at = b
                    new[k] = b"".join([*kept, data[at:]]).decode()
                    spans[k] = [{"start": a, "length": b - a, "owners": sorted({x for x in o if x is not None})} for a, b, o in gone]
            columns = [batch.column(i) for i in range(len(names))]
            if new:
                held = texts.to_pylist()
                for k, t in new.items():
                    held[k] = t
                columns[text_at] = pa.array(held, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, arrow_span)], [f"c{i}" for i in range(len(names) + 1)])

    span = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("owners", ArrayType(LongType()))]))
    placed = by_place(joined.columns, joined)
    out = StructType([*placed.schema.fields[:-1], StructField(f"c{len(names)}", span)])
    return placed.mapInArrow(lean("chunks", task), out).toDF(*names, spans_name)


def report(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, text without repeated passages, n_spans, removed_bytes, owner_ids (documents that keep them)."""
    done = dedup(docs.select("doc_id", "text"), min_run)
    removed = F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    owners = F.sort_array(F.array_distinct(F.flatten(F.transform("repeat_spans", lambda x: x["owners"]))))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size("repeat_spans").cast("long").alias("n_spans"), removed.alias("removed_bytes"), owners.alias("owner_ids"))
