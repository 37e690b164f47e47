"""Operator 11: web pages as WARC archives, written by sorted shards, and read back.

``write`` sorts records by page_id and url into shards of near equal bytes. The places of the cuts come from the rows with the smallest
hashes of their page_id, so they and all files are the same whenever the same pages are written. A shard is one
task's stream: it rolls over to a new file when the compressed size of the present one reaches ``file_bytes``. Each record is a
gzip member of its own, with headers and digests made anew. Of records with equal payloads of ``min_revisit`` bytes
and more, that with the largest page_id (then url) is a response, the others are revisits of it and carry no payload.

Files are written under temporary names that hold the task's attempt. When all tasks have ended, those of the attempts that
counted get their names, and ``manifest.jsonl`` (name, records, bytes, SHA-1 of each file) comes last: archives without it are not
finished. A repeated task leaves a temporary file at most, which goes when the manifest is there.

Nulls: a null html is an empty payload, a null page_id sorts before all others and is left out of the headers, a null url
gives no target. Rows that are alike in all three are records of their own, the first of them the response. An empty
table gives a manifest without files. A page is held as a whole while its record is made. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import storage
from textquarry.llm.workers import lean

#: Bytes of records, before compression, of a shard, and the most shards there are: beyond, shards grow.
SHARD_BYTES, MAX_SHARDS = 16_000_000, 20_000
#: Compressed bytes at which a file ends.
FILE_BYTES = 64_000_000
#: Sampled rows for each cut between shards.
SAMPLES = 32
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
# Fixed values of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(2**63)
_MANIFEST = "name string, records long, bytes long, sha1 string"


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, copy]))}>"


def _uri(url: str) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member."""
    fields = [*fields, ("WARC-Block-Digest", _label(hashlib.sha1(block).digest())), ("Content-Length", len(block))]
    head = b"\r\n".join([_VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None)])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _record(row: dict, copy: int, date: str) -> bytes:
    """A response, or a revisit if another row keeps its payload; ``copy``: how many rows before it are alike."""
    revisit = row["again"] or (row["shared"] and copy > 0)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"], row["url"], row["digest"], copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if row["url"] is None else _uri(row["url"])),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", _label(bytes.fromhex(row["digest"]))),
        ("X-Page-ID", row["page_id"]),
    ]
    if revisit:
        keeper, target = (row["keeper"], row["keeper_url"]) if row["again"] else (row["page_id"], row["url"])
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id(keeper, target, row["digest"], 0)),
            ("WARC-Refers-To-Target-URI", None if target is None else _uri(target)),
            ("X-Refers-To-Page-ID", keeper),
        ]
    return _member(fields, http if revisit else http + row["payload"])


class _File:
    """An archive under a temporary name."""

    def __init__(self, folder: str, shard: int, part: int, attempt: int, date: str):
        self.name = f"shard-{shard:05d}-{part:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{attempt}"
        self.records = self.bytes = 0
        self._sum, self._opened = hashlib.sha1(), storage.create(f"{folder}/{self.temporary}")
        self._out = self._opened.__enter__()
        about = f"format: WARC File Format 1.1\r\nisPartOf: shard {shard}, file {part}\r\n".encode()
        first = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name, "", 0)), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(_member(first, about))

    def _put(self, member: bytes) -> None:
        self._out.write(member)
        self._sum.update(member)
        self.bytes += len(member)

    def add(self, member: bytes) -> None:
        self._put(member)
        self.records += 1

    def close(self) -> dict:
        self._opened.__exit__(None, None, None)
        return {"temporary": self.temporary, "name": self.name, "records": self.records, "bytes": self.bytes, "sha1": self._sum.hexdigest()}


def _rank(bounds: list[int], value: Column, also_equal: bool) -> Column:
    """How many of the sorted bounds are below the value, or equal to it: a binary search."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds)

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        at = F.get(held, middle)
        below = (at <= value) if also_equal else (at < value)
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step)["low"]


def _cuts(rows: DataFrame, shard_bytes: int) -> list[int]:
    """page_ids between shards: of ``SAMPLES`` rows a shard, those at equal parts of the sampled bytes. A page_id of many rows may stand there more than once."""
    total = rows.agg(F.sum(F.col("n") + 500).alias("n")).first().n or 0
    shards = max(1, min(MAX_SHARDS, -(-total // shard_bytes)))
    if shards == 1:
        return []
    # SAMPLES * MAX_SHARDS rows at most. Rows with the least hashes, so neither partitions nor their order matter.
    sample = rows.select("key", "n").orderBy(F.xxhash64("key"), "key", "n").limit(SAMPLES * shards).collect()
    sample = sorted((r.key, r.n + 500) for r in sample)
    every, seen, out = sum(n for _, n in sample), 0, []
    for key, n in sample:
        seen += n
        while len(out) < shards - 1 and seen * shards >= every * (len(out) + 1):
            out.append(key)
    return out


def write(
    pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Archives of ``page_id, url, html`` in ``folder``, a new one; ``date``: the time that records state."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    every = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    slim = every.select("page_id", "url", F.coalesce("page_id", F.lit(_NO_ID)).alias("key"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    cuts = _cuts(slim, shard_bytes)
    best = F.max(F.struct("key", F.coalesce("url", F.lit("")), "page_id", "url")).alias("best")
    alike = slim.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(best, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    keepers = storage.written(alike.select("digest", "n", F.col("best.page_id").alias("keeper"), F.col("best.url").alias("keeper_url"), F.lit(True).alias("shared")), "keepers")
    rows = every.withColumns({"key": F.coalesce("page_id", F.lit(_NO_ID)), "digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    other = ~(F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("url").eqNullSafe(F.col("keeper_url")))
    rows = rows.join(storage.bounded(keepers), ["digest", "n"], "left").withColumns({"again": F.coalesce("shared", F.lit(False)) & other, "shared": F.coalesce("shared", F.lit(False))})
    low, high = _rank(cuts, F.col("key"), False), _rank(cuts, F.col("key"), True)
    # Rows of a page_id that fills more than one shard are dealt among these by their url.
    shard = (low + F.pmod(F.xxhash64("url"), (high - low + 1).cast("long")).cast("int")).alias("shard")
    # The payload of a revisit stays behind.
    laid = rows.select(shard, "key", "page_id", "url", "digest", "n", F.when(~F.col("again"), F.col("payload")).alias("payload"), "keeper", "keeper_url", "shared", "again")
    dealt = laid.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "url", "digest")

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, held, at, last, copy = TaskContext.get().taskAttemptId(), None, None, None, 0
        done: list[dict] = []
        for batch in stream:
            for row in batch.to_pylist():
                alike = (row["key"], row["url"], row["digest"])
                copy = copy + 1 if alike == last else 0
                last = alike
                if held is None or at[0] != row["shard"] or held.bytes >= file_bytes:
                    if held is not None:
                        done.append(held.close())
                    at = (row["shard"], at[1] + 1 if at and at[0] == row["shard"] else 0)
                    held = _File(folder, *at, attempt, date)
                held.add(_record(row, copy, date))
        if held is not None:
            done.append(held.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    with storage.small_batches(spark):
        files = storage.written(dealt.mapInArrow(lean("warc", task), f"temporary string, {_MANIFEST}"), "archives")

    def name(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                storage.rename(f"{folder}/{row['temporary']}", f"{folder}/{row['name']}", row["bytes"])
            yield batch.select(["name"])

    files.mapInArrow(name, "name string").write.format("noop").mode("overwrite").save()
    listed = sorted((r.name, r.records, r.bytes, r.sha1) for r in files.collect())  # a row a file
    text = "".join(json.dumps(dict(zip(("name", "records", "bytes", "sha1"), r, strict=True))) + "\n" for r in listed)
    with storage.create(f"{folder}/_temporary/manifest") as out:
        out.write(text.encode())
    storage.rename(f"{folder}/_temporary/manifest", f"{folder}/manifest.jsonl", len(text))
    storage.remove(spark, f"{folder}/_temporary")
    storage.drop(keepers, files)


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked."""
    unpack, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, held against its length and digest."""
    end = member.index(b"\r\n\r\n")
    version, *lines = member[:end].split(b"\r\n")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    block = member[end + 4 : end + 4 + int(fields["content-length"])]
    if version != _VERSION or len(block) != int(fields["content-length"]) or _label(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    return fields, block


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    end = block.index(b"\r\n\r\n")
    payload, stated = block[end + 4 :], fields["warc-payload-digest"]
    size = next(int(x.split(b":")[1]) for x in block[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != size or _label(hashlib.sha1(payload).digest()) != stated):
        raise ValueError(f"a payload that is not the stated one: {fields['warc-record-id']}")
    number = lambda k: int(fields[k]) if k in fields else None
    row = {
        "page_id": number("x-page-id"),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(stated.removeprefix("sha1:")).hex(),
        "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
        "record_id": fields["warc-record-id"],
        "refers_to_id": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
    }
    return row | {"payload": payload if fields["warc-type"] == "response" else None} if with_payload else row


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, target_uri and, if asked for, payload
    of every record of the archives that the manifest lists. A damaged file or record fails."""
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest.jsonl")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, target_uri string"
    schema += ", payload binary" * with_payload

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")]
        for batch in stream:
            for file in batch.to_pylist():
                seen, size, rows, held, n = hashlib.sha1(), 0, [], 0, 0

                def chunks(file=file):
                    nonlocal size
                    for chunk in storage.chunks(f"{folder}/{file['name']}"):
                        seen.update(chunk)
                        size += len(chunk)
                        yield chunk

                for member in _members(chunks()):
                    head, block = parse(member)
                    if head["warc-type"] in ("response", "revisit"):
                        rows.append(_row(head, block, with_payload))
                        n, held = n + 1, held + (len(block) if with_payload else 0)
                    if len(rows) >= 1000 or held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
                        rows, held = [], 0
                if (n, size, seen.hexdigest()) != (file["records"], file["bytes"], file["sha1"]):
                    raise ValueError(f"{file['name']} is not what the manifest lists")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return manifest.repartition(max(1, manifest.count())).mapInArrow(lean("warc", task), schema)
