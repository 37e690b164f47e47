import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from textquarry.llm.queries import queries
from textquarry.llm.token_counts import PieceCounter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
BITS = [" ", "  ", "   ", "\n", "\t", "a", "b's", "12", ".", "..", "é", " ", "日本", "ing", "The", "<s>", "</s>", "▁", "\x00", "😀", "tion", "ﬁ", "https://", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def held():
    return PieceCounter(PATH, max_units=500)


def test_random_texts(library, held):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        assert held.count(some).tolist() == [len(x) for x in library.encode(some, num_threads=1)]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "=" * 777, " " * 500, "tion" * 900, "aaab" * 70])
def test_long_sequences(library, held, text):
    assert held.count([text]).tolist() == [len(library.encode(text))]


def test_both_array_forms_agree(held):
    rng = random.Random(8)
    for letters in ("abceinost", "ab", "=-", "etionrs") * 8:
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 64))) for _ in range(40)]
        flat = held.symbol[[ord(c) for c in "".join(words)]]
        n = np.array([len(w) for w in words])
        assert held.survivors(flat, n).tolist() == held.survivors_by_rank(flat, n).tolist()


def test_long_random_sequences(library, held):
    rng = random.Random(9)
    letters = ("abceinost", "ab", "=-", "etionrsh", "ABCDEFGHabcdefgh0123456789+/")
    texts = ["".join(rng.choice(letters[k % 5]) for _ in range(rng.randrange(65, 4000))) for k in range(100)]
    assert held.count(texts).tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text.encode()), n := len(library.encode(r.text)), n > 4096) for r in docs)
    assert sorted(tuple(r) for r in queries()["op7_token_counts"](spark, SF).collect()) == want


def test_edges(spark, library):
    rows = [(1, None, 3), (None, "two words", 3), (2, "", 3), (2, "", 3), (4, "x " * 50_000, 3)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = [(r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
