import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textquarry.llm import packing, storage, token_files
from textquarry.llm.encoding import UnitEncoder
from textquarry.llm.queries import op2_token_files, op5_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
BITS = [" ", "  ", "\n", "\t", " \n", "a", "b's", "1", "23", ".", "é", " ", "日", "ing", "The", "<|endoftext|>", "'ll", "\x1c", "\x00", "\x85", "x" * 300, "½", "ª", "\u0300", "가", "😀", "\u3000", "'s", "'re", "'"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_units_equal_the_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    enc = UnitEncoder(PATH, max_units=200)  # the table starts anew several times
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        flat, counts = enc.encode(some)
        ends = np.cumsum(counts)
        for text, a, b in zip(some, ends - counts, ends, strict=True):
            assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, ids string")


ROWS = [(-(2**63), "least id", "", ""), (5, "Hello there", "x", "y"), (1, None, None, None), (None, "null id", "", ""), (3, "", "", ""), (3, "twice", "", ""), (2, "word " * 3000, "", "")]


def test_token_files_round_trip(spark, library):
    files = token_files.write(table(spark, ROWS), storage.new_folder(spark, "t"), PATH, end_id=2)
    assert files.dtype == "<u2" and token_files.load(files.folder) == files
    none = -(2**70)
    want = sorted(((r[0] if r[0] is not None else none), [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ROWS)
    read = [((r.doc_id if r.doc_id is not None else none), list(r.ids), r.start) for r in token_files.read(spark, files).collect()]
    read.sort(key=lambda r: r[2])
    assert [r[0] for r in read] == [w[0] for w in want]
    assert sorted(r[:2] for r in read) == want
    assert [r[2] for r in read] == np.cumsum([0, *(len(r[1]) for r in read)])[:-1].tolist()
    digest = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, files).collect()}
    assert digest == {(r[2], len(r[1]), crc(r[1])) for r in read}


def test_empty_table(spark):
    empty = table(spark, [])
    files = token_files.write(empty, storage.new_folder(spark, "t"), PATH, end_id=2)
    assert token_files.digest(spark, files).count() == 0
    assert packing.pieces(spark, packing.encode(empty, storage.new_folder(spark, "t"), PATH, 1)).count() == 0


def test_op2_against_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted(tuple(r) for r in op2_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want


def check_packed(rows, ids_of, length):
    """Pieces cover every document, and every sequence but the last is full."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids) and crc(ids[r.start : r.start + r.length]) == r.ids_crc32
    assert by_doc.keys() == ids_of.keys()
    for doc, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids_of[doc])
    for seq, found in by_seq.items():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at == length or seq == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_op5_pieces(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    check_packed(op5_packing(spark, SF).collect(), ids, 2048)


@pytest.mark.parametrize("length", [1, 7, 64])
def test_sequences(spark, library, length):
    rows = [(i, " ".join(["tok"] * (i % 11)), "", "") for i in range(60)] + [(60, "long " * 500, "", ""), (61, None, "", "")]
    files = packing.encode(table(spark, rows).repartition(5), storage.new_folder(spark, "t"), PATH, 1)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    check_packed(packing.pieces(spark, files, length).collect(), ids, length)
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(spark, files, length).collect()}
    flat = [i for k in range(len(files.parts)) for i in files.open(k)[0].tolist()]
    assert [i for k in sorted(whole) for i in whole[k]] == flat
    assert all(len(v) == length for k, v in whole.items() if k < max(whole))
