import gzip
import hashlib
import json
import os
import random

import pytest
from oracle import connection, rows_of, sql_rows
from textquarry.llm import storage, warc
from textquarry.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, key long, shard int, n long"
BIG, BIG2 = "é" * 700, "y" * 1000
ROWS = [(i, f"http://a/{i}", f"<p>{i}</p>" * (1 + i % 40)) for i in range(120)] + [
    (500, "http://b/1", BIG), (501, "http://b/2", BIG), (502, None, BIG), (9, "http://b/9", BIG),
    (600, "u", BIG2), (600, "u", BIG2), (600, "v", BIG2), (None, "w", BIG2),
    (700, "short", "y" * 999), (701, "short", "y" * 999), (702, "none", None), (703, "", ""),
    (900, "z", "small"), (900, "z", "small"), (None, None, "no id"), (None, None, None), (-5, "http://x/\r\nX-Page-ID: 7 ü", "line\r\n\r\nend" * 200), (800, "long", "long text " * 300_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGES)


def archived(spark, folder, rows, **kw):
    warc.write(frame(spark, rows), f"file://{folder}", **kw)
    return warc.read(spark, f"file://{folder}", with_payload=True).collect()


def brute(rows):
    """(page_id, bytes, digest, type, refers_to), revisits by text."""
    out, order = [], lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or "", -k)
    best = {}
    for k, (_, _, html) in enumerate(rows):
        p = (html or "").encode()
        if len(p) >= 1000 and (p not in best or order(k) > order(best[p])):
            best[p] = k
    for k, (page, _, html) in enumerate(rows):
        p = (html or "").encode()
        again = best.get(p, k) != k
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", rows[best[p]][0] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    got = archived(spark, tmp_path, ROWS, file_bytes=3000, shard_bytes=60_000)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS)
    texts = sorted((r[2] or "").encode() for r in ROWS)
    whole = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert sorted(whole[r.payload_digest] for r in got) == texts
    assert len({r.record_id for r in got}) == len(ROWS)
    assert {r.refers_to_id for r in got if r.record_type == "revisit"} <= {r.record_id for r in got if r.record_type == "response"}


def test_files_roll_and_are_the_same_again(spark, tmp_path):
    rows = ROWS[:-1]
    archived(spark, tmp_path / "a", rows, file_bytes=2000, shard_bytes=20_000)
    random.Random(4).shuffle(rows)
    warc.write(frame(spark, rows).repartition(7), f"file://{tmp_path}/b", file_bytes=2000, shard_bytes=20_000)
    names = sorted(os.listdir(tmp_path / "a"))
    assert names == sorted(os.listdir(tmp_path / "b")) and "_temporary" not in names
    listed = [json.loads(x) for x in (tmp_path / "a/manifest.jsonl").read_text().splitlines()]
    assert len({x["name"].split("-")[1] for x in listed}) > 5 and len(listed) > 12 and sum(x["records"] for x in listed) == len(rows)
    for name in names:
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes(), name
    for x in listed:
        held = (tmp_path / "a" / x["name"]).read_bytes()
        assert len(held) == x["bytes"] and gzip.decompress(held).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert x["records"] == 1 or len(held) < 2000 + 3000


def test_damage_is_found(spark, tmp_path):
    archived(spark, tmp_path, ROWS[:30])
    name = next(x for x in os.listdir(tmp_path) if x.endswith(".gz"))
    data = bytearray((tmp_path / name).read_bytes())
    (tmp_path / name).write_bytes(data[:-200])
    with pytest.raises(Exception, match="ends inside|manifest"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_empty_and_unfinished(spark, tmp_path):
    assert archived(spark, tmp_path / "none", []) == []
    (tmp_path / "half").mkdir()
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, f"file://{tmp_path}/half").collect()


def test_rename_twice(tmp_path):
    with storage.create(f"{tmp_path}/a/x") as out:
        out.write(b"abc")
    storage.rename(f"{tmp_path}/a/x", f"{tmp_path}/a/y", 3)
    storage.rename(f"{tmp_path}/a/x", f"{tmp_path}/a/y", 3)
    with pytest.raises(FileNotFoundError):
        storage.rename(f"{tmp_path}/a/x", f"{tmp_path}/a/y", 4)


def test_hot_page_id_is_dealt_out(spark, tmp_path):
    rows = [(7, f"http://a/{i}", f"{i} " * 300) for i in range(300)] + [(i, "x", "y") for i in range(100)]
    got = archived(spark, tmp_path, rows, shard_bytes=30_000)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    listed = [json.loads(x) for x in (tmp_path / "manifest.jsonl").read_text().splitlines()]
    assert max(x["records"] for x in listed) < 150


def test_query(spark):
    sql = sql_rows(connection(SF), oracle_sql()["op11_warc"])
    assert rows_of(queries()["op11_warc"](spark, SF)) == sql and sql
