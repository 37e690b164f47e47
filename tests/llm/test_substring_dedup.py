import random

import numpy as np

from textquarry.llm import substring_dedup as s
from textquarry.llm.queries import queries

SCHEMA = "doc_id long, text string, repeat int, digest int, start string, owner string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuéß") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_rolling_depends_on_the_window_only():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    want = [sum(int(s.GEAR[b]) << 2 * age for age, b in enumerate(reversed(data[max(0, i - 15) : i + 1].tolist()))) % 2**32 for i in range(500)]
    assert s.rolling(data).tolist() == want


def test_cuts_survive_insertions():
    rng = random.Random(2)
    passage = prose(rng, 200).encode()
    a = prose(rng, 40).encode() + passage
    b = prose(rng, 33).encode() + passage + prose(rng, 9).encode()
    pieces = lambda data: set(s.digests(data, s.cut(np.frombuffer(data, np.uint8))))
    shared = pieces(a) & pieces(b)
    assert len(shared) > 0.85 * len(s.cut(np.frombuffer(passage, np.uint8)))
    # Minima within 16 bytes on either side lie 17 bytes apart at least, 33 on random bytes on average.
    assert 20 < len(passage) / len(s.cut(np.frombuffer(passage, np.uint8))) < 50
    flat = np.zeros(10_000, np.uint8)
    assert 1 <= len(s.cut(flat)) <= 10_000 / s.RADIUS


def removed(passage, a, b):
    """Bytes removed of the second of two texts, each a passage between its own surroundings."""
    first, second = (f"{x[0]} {passage} {x[1]}".encode() for x in (a, b))
    owned = set(s.digests(first, s.cut(np.frombuffer(first, np.uint8))))
    ends = s.cut(np.frombuffer(second, np.uint8))
    starts = [0, *ends[:-1].tolist()]
    marked = {(at, d): 1 for at, d in zip(starts, s.digests(second, ends), strict=True) if d in owned}
    return sum(y - x for x, y, _ in s.removable(second, marked))


def test_little_of_short_passages_is_left():
    rng = random.Random(0)
    size = left = 0
    for _ in range(200):
        passage = prose(rng, 51)
        gone = removed(passage, (prose(rng, 30), prose(rng, 30)), (prose(rng, 30), prose(rng, 30)))
        assert gone
        size, left = size + len(passage.encode()), left + len(passage.encode()) - gone
    assert left < 0.185 * size
    passage = prose(rng, 200).encode()
    assert 20 < len(passage) / len(s.cut(np.frombuffer(passage, np.uint8))) < 50


def test_periodic_passages_are_found():
    rng = random.Random(7)
    for unit in ("thanin ", "and ", "onnd, ", "buy now ", "=", "ab cd ef gh ij kl "):
        for times in (500, 5_000):
            passage = (unit * times).strip()
            gone = removed(passage, (prose(rng, 30), prose(rng, 30)), (prose(rng, 33), prose(rng, 30)))
            assert len(passage) - 6 * s.RADIUS - 2 * s.WINDOW < gone
    for data in (b"and " * 5_000, b"x" * 5_000):
        assert np.diff(s.cut(np.frombuffer(data, np.uint8))).max() <= 2 * s.RADIUS + s.WINDOW


def brute(texts):
    """Repeats by plain dictionaries, in order of (doc_id, start)."""
    seen, marked = {}, {}
    for doc, text in sorted(texts.items()):
        data = text.encode()
        at = 0
        ends = s.cut(np.frombuffer(data, np.uint8))
        for end, digest in zip(ends.tolist(), s.digests(data, ends), strict=True):
            if digest in seen:
                marked.setdefault(doc, {})[at, digest] = seen[digest]
            seen.setdefault(digest, doc)
            at = end
    return marked


def test_planted_passages(spark):
    rng = random.Random(3)
    passage, line = prose(rng, 55), prose(rng, 8)
    texts = {i: f"{prose(rng, 60)}\n{line}\n{prose(rng, 60)}" for i in range(40)}
    for i in (3, 11, 12, 30):
        texts[i] = f"{prose(rng, 30 + i)} {passage} {prose(rng, 20)}"
    texts[40] = texts[7]  # a whole copy
    rows = [(i, t, 1, 2, "x", "y") for i, t in texts.items()] + [(90, None, 1, 2, "x", "y"), (91, "", 1, 2, "x", "y"), (5, texts[5], 1, 2, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r.doc_id: r for r in s.dedup(docs).collect()}
    assert s.dedup(docs).columns == [*docs.columns, "repeat_spans"] and s.dedup(docs).count() == len(rows)
    assert {k for k, r in out.items() if r.repeat_spans} == {11, 12, 30, 40}
    assert out[40].text == "" and out[90].text is None and out[91].text == ""
    for i in (11, 12, 30):
        middle = " ".join(passage.split()[20:35])
        assert middle not in out[i].text and middle in out[3].text and out[i].repeat_spans[0].owners == [3]
    marked = brute(texts)
    for i, r in out.items():
        if i in texts:
            want = s.removable(texts[i].encode(), marked.get(i, {}))
            assert [(x.start, x.start + x.length) for x in r.repeat_spans] == [w[:2] for w in want]
    got = {r.doc_id: r for r in s.report(docs).collect()}
    assert got[11].n_spans == 1 and got[11].owner_ids == [3] and got[0].removed_bytes == 0


def test_long_text_and_empty_table(spark):
    rng = random.Random(4)
    long = prose(rng, 60_000)
    got = s.report(spark.createDataFrame([(1, long, 0, 0, "", ""), (None, "z" * 50_000, 0, 0, "", ""), (2, long, 0, 0, "", "")], SCHEMA)).collect()
    assert {(r.doc_id, r.text == "") for r in got if r.doc_id} == {(1, False), (2, True)}
    assert s.report(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_dedup(rows):
    """The whole operator by loops over plain values: hash, cuts, owners, runs. rows: (doc_id, text)."""
    gear = [int(x) for x in s.GEAR]

    def cut(data):
        h = [sum(gear[data[i - j]] << 2 * j for j in range(min(16, i + 1))) % 2**32 for i in range(len(data))]
        ends, last = [], None
        for i in range(len(h)):
            if h[i] == min(h[max(0, i - 16) : i + 17]) and (last is None or i - last > 16):
                ends.append(i + 1)
                last = i
        if data and (not ends or ends[-1] != len(data)):
            ends.append(len(data))
        return list(zip([0, *ends[:-1]], ends, strict=True))

    laid = {(doc, text): [(a, text.encode()[a:b]) for a, b in cut(text.encode())] for doc, text in rows if text}
    owner = {}
    for (doc, text), pieces in laid.items():
        for a, piece in pieces:
            owner[piece] = min(owner.get(piece, (doc, a)), (doc, a))
    out = []
    for doc, text in rows:
        data, spans, kept, at = (text or "").encode(), [], b"", 0
        for a, piece in [*laid.get((doc, text), []), (len(data), None)]:
            if piece is not None and owner[piece] != (doc, a):
                spans[-1:] = [[spans[-1][0], a + len(piece)]] if spans and spans[-1][1] == a else [*spans[-1:], [a, a + len(piece)]]
        n = 0
        for a, b in spans:
            if b - a >= 128:
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while a < b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                kept, at, n = kept + data[at:a], b, n + 1
        out.append((doc, text if not n else (kept + data[at:]).decode(), n))
    return sorted(out, key=str)


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op6_substring_dedup"](spark, sf).select("doc_id", "text", "n_spans").collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows)


def test_hot_passages_are_split(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_REPEATS", 3)
    rng = random.Random(12)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 25)} {passage} {prose(rng, 25)}") for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(4)
    assert sorted(((r.doc_id, r.text, r.n_spans) for r in s.report(docs).collect()), key=str) == plain_dedup(rows)


def test_names_and_rows_without_id(spark):
    rng = random.Random(13)
    passage, other = prose(rng, 60), prose(rng, 80)
    rows = [(None, f"{prose(rng, 20)} {passage}"), (None, f"{passage} {prose(rng, 9)}"), (None, other), (None, other), (4, f"{passage} {prose(rng, 30)}"), (5, None)]
    names = "doc_id long, text string, repeat_spans string, d string, h string, digest int"
    docs = spark.createDataFrame([(*r, "mine", "d", "h", 3) for r in rows], names)
    out = s.dedup(docs).collect()
    assert s.dedup(docs).columns == ["doc_id", "text", "d", "h", "digest", "repeat_spans"]
    assert sum(len(r.repeat_spans) for r in out if r.doc_id is None) == 1
    assert [len(r.repeat_spans) for r in out if r.doc_id == 4] == [1]
    assert [r.text for r in out if r.text == other] == [other] * 2 and all(r.d == "d" and r.digest == 3 for r in out)
