"""Byte-level BPE ids of whole texts, at the speed of a dictionary.

A byte-level BPE file first cuts a text into pre-tokens (a word, number or run of marks, each with the space before
it; white space), and no token crosses their ends. Here arrays find those ends for a run of texts at once, Arrow finds
the distinct pre-tokens, and only these are looked up in a table. Those that it lacks go through the model of the
tokenizers library. Texts with characters whose class versions of Unicode don't agree on, or with strings that
the library takes as one id, go through the library as a whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from textquarry.llm.workers import keeps

#: Pre-tokens held per worker (about 45 MB): when half of it is full, the half before it goes. A bound on memory only.
MAX_UNITS = 300_000
#: Longer pre-tokens are encoded when met and not kept.
MAX_UNIT_CHARS = 256

#: Classes of characters; a zero character stands between texts.
_END, _LETTER, _DIGIT, _MARK, _SPACE, _BLANK, _ODD = range(7)
_CLASSIFIED = 0x20000

#: Byte-level BPE writes bytes that are no printable Latin-1 character as the characters from U+0100 on.
_ODD_BYTES = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(_ODD_BYTES)}


def byte_level(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.replace(" ", "Ġ")
    return text.encode().decode("latin-1").translate(_BYTE_CHARS)


@cache
def _classes() -> np.ndarray:
    """The class of every character below ``_CLASSIFIED``; _ODD where it depends on the version of Unicode."""
    out = np.full(_CLASSIFIED + 1, _ODD, np.uint8)
    now, then = unicodedata.category, unicodedata.ucd_3_2_0.category
    for point in range(1, _CLASSIFIED):
        char = chr(point)
        kind = now(char)
        if char.isspace():
            if point not in (0x1C, 0x1D, 0x1E, 0x1F, 0x85):
                out[point] = _BLANK
        elif kind[0] in "LN":
            if then(char)[0] == kind[0]:
                out[point] = _LETTER if kind[0] == "L" else _DIGIT
        elif kind not in ("Cn", "Cs") and then(char)[0] not in "LN":
            out[point] = _MARK
    out[0], out[0x20] = _END, _SPACE
    return out


def _starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character. Texts end with a zero character each, a pre-token of its own."""
    before, blank = np.concatenate([[_END], kind[:-1]]), (kind == _SPACE) | (kind == _BLANK)
    after_blank = np.concatenate([[False], blank[:-1]])
    opens = (kind != before) & ~(blank & after_blank) | (kind == _END)
    # A space goes with the letters, digits or marks behind it; of more white space only its last character stands apart.
    opens &= ~((before == _SPACE) & ~blank & (kind != _END))
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & (kind[1:] != _END))
    opens[last] = True
    # An apostrophe that opens a pre-token takes the letters of a contraction, and what follows them opens another.
    at = np.flatnonzero((points == 0x27) & opens)
    one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    # Fixed values of the byte-level pattern: s t m d, re ve ll.
    short = np.isin(one, list(b"stmd"))
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))
    opens[at[short | long] + 1] = False
    opens[at[short] + 2] = True
    opens[at[long] + 3] = True
    return opens


class UnitEncoder:
    def __init__(self, path: str, max_units: int = MAX_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        pre = self.library.pre_tokenizer
        self.by_unit = (
            self.library.normalizer is None
            and isinstance(self.library.model, BPE)
            and isinstance(pre, ByteLevel)
            and pre.use_regex
            and not pre.add_prefix_space
        )
        #: Strings that the library takes as one id wherever they stand.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.max_units = max_units
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        #: Pre-token -> its ids as bytes.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _table(self, units: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, as bytes."""
        if len(self.young) > self.max_units // 2:
            self.old, self.young = self.young, {}
        model, young, old = self.library.model, self.young, self.old
        found: list = list(map(young.get, units))
        for k, ids in enumerate(found):
            if ids is None:
                unit = units[k]
                ids = old.get(unit)
                if ids is None:
                    ids = np.array([t.id for t in model.tokenize(byte_level(unit))], "<u4").tobytes()
                found[k] = ids
                if len(unit) <= MAX_UNIT_CHARS:
                    young[unit] = ids
        return found

    def _encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their counts, and which texts hold odd characters (their ids mean nothing)."""
        whole = "\0".join([*texts, ""])
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kind = _classes()[np.minimum(points, _CLASSIFIED)]
        ends = np.flatnonzero(kind == _END)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero(kind == _ODD))] = True
        starts = np.flatnonzero(_starts(points, kind))
        raw = np.frombuffer(whole.encode(), np.uint8)
        places = starts if len(raw) == len(points) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        offsets = pa.py_buffer(np.append(places, len(raw)).astype(np.int64))
        distinct = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(raw)).dictionary_encode()
        units = distinct.dictionary.to_pylist()
        zero = units.index("\0")
        units[zero] = "."  # any other: its ids are taken out below
        table = self._table(units)
        table[zero] = b""
        laid = pa.array(table, pa.large_binary()).take(distinct.indices)
        bounds = np.frombuffer(laid.buffers()[1], np.int64)[: len(laid) + 1] // 4
        counts = np.diff(bounds[np.searchsorted(starts, ends)], prepend=0)
        ids = np.frombuffer(laid.buffers()[2] or b"", "<u4")[: bounds[-1]]
        return ids, counts, odd

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and the number of each text's ids."""
        if not texts:
            return np.empty(0, "<u4"), np.zeros(0, np.int64)
        direct = np.array([not self.by_unit or "\0" in t or any(a in t for a in self.added) for t in texts])
        ids, counts, odd = self._encode_run(["" if d else t for d, t in zip(direct.tolist(), texts, strict=True)])
        if not (direct | odd).any():
            return ids, counts
        ends = np.cumsum(counts)
        parts, at = [], 0
        for k in np.flatnonzero(direct | odd).tolist():
            parts += [ids[at : ends[k] - counts[k]], np.array(self.library.encode(texts[k], add_special_tokens=False).ids, "<u4")]
            at, counts[k] = ends[k], len(parts[-1])
        return np.concatenate([*parts, ids[at:]]), counts


_ENCODERS: dict[str, UnitEncoder] = {}


keeps("tokens", _ENCODERS.clear)


def encoder(path: str) -> UnitEncoder:
    """One per worker process and file, so that its table serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
