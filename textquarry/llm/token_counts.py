"""Operator 7: token counts of whole texts under a byte-fallback BPE piece model.

Rank-synchronous array merging. Texts fall into pre-tokens at places no piece can span. Pre-tokens that are
new to the worker are laid out as one ragged array of symbol ids; in each step every sequence finds its
own lowest-rank pair (leftmost among equals) by one segmented minimum, all those pairs merge at once, and
sequences without a pair leave. The symbols that survive are the tokens; a symbol outside the vocabulary
counts its UTF-8 bytes. In sequences of more than ``MAX_WIDTH`` symbols, where one merge a step would be
slow, all pairs of the lowest rank merge in one step, as far as that gives the same order.

A null or empty text has no bytes and no tokens. Rows are independent, so repeated rows repeat. An empty
table gives none. Further columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.workers import keeps, lean

SPACE = "▁"
MAX_UNITS = 1_000_000
MAX_UNIT_CHARS = 256
MAX_WIDTH = 64
BATCH_CHARS = 4_000_000
_NONE = np.int64(1) << 31
_SHIFT = 8  # MAX_WIDTH < 2 ** _SHIFT
_UNITS = re.compile(r" +[^ ]*")


class PieceCounter:
    def __init__(self, path: str, max_units: int = MAX_UNITS):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as src:
            model.ParseFromString(src.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        held = SentencePieceProcessor(model_file=path)
        kinds = [p.type for p in model.pieces]
        if (
            train.model_type != 2  # BPE
            or not train.byte_fallback
            or norm.name != "identity"
            or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces
            or any(k in (4, 5) for k in kinds)  # user-defined, unused
        ):
            raise ValueError("only plain BPE piece models with byte fallback and no normalisation are supported")
        self.size = held.get_piece_size()
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self._symbols(pieces)
        self._pairs(pieces)
        self.max_units = max_units
        self.known: dict[str, int] = {}

    def _symbols(self, pieces: list[tuple[int, str, float]]) -> None:
        """Character -> symbol. Beyond the vocabulary: one symbol for each UTF-8 length, and one for each
        character that is part of a piece but none itself."""
        self.ids = {text: i for i, text, _ in pieces}
        points = np.arange(0x110000)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.symbol = (self.size + width).astype(np.int64)
        extra = sorted({c for _, text, _ in pieces for c in text} - self.ids.keys())
        for n, c in enumerate(extra):
            self.ids[c] = self.size + 5 + n
        for text, i in self.ids.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        self.n_symbols = self.size + 5 + len(extra)
        self.weight = np.ones(self.n_symbols, np.int64)
        self.weight[self.size : self.size + 5] = range(5)
        for n, c in enumerate(extra):
            self.weight[self.size + 5 + n] = len(c.encode())

    def _pairs(self, pieces: list[tuple[int, str, float]]) -> None:
        """Every way a piece joins two symbols, by key left * n_symbols + right; and characters that stand side by side in a piece."""
        _, dense = np.unique([-s for _, _, s in pieces], return_inverse=True)
        keys, merged, ranks, side = [], [], [], set()
        for (i, text, _), rank in zip(pieces, dense.tolist(), strict=True):
            for cut in range(1, len(text)):
                left, right = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.n_symbols + right)
                    merged.append(i)
                    ranks.append(rank)
                side.add(ord(text[cut - 1]) << 21 | ord(text[cut]))
        order = np.argsort(keys)
        self.keys, self.merged, self.ranks = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order], np.array(ranks, np.int64)[order]
        self.side = np.array(sorted(side), np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs in the table, and whether they are there."""
        key = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._find(left, right)
        return np.where(there, self.ranks[at], _NONE)

    def survivors(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tokens of each of the sequences of n symbols that stand in flat one after another."""
        out = np.zeros(len(n), np.int64)
        rows, flat, n = np.arange(len(n)), flat.copy(), n.copy()
        starts = np.cumsum(n) - n
        rank = np.append(self._pair_ranks(flat[:-1], flat[1:]), _NONE)
        rank[starts + n - 1] = _NONE
        while len(rows):
            local = np.arange(len(flat)) - np.repeat(starts, n)
            best = np.minimum.reduceat((rank << _SHIFT) | local, starts)
            live = best < (_NONE << _SHIFT)
            if not live.all():
                out[rows[~live]] = np.add.reduceat(self.weight[flat], starts)[~live]
                keep = np.repeat(live, n)
                flat, rank, n, rows, best = flat[keep], rank[keep], n[live], rows[live], best[live]
                if not len(rows):
                    break
                starts = np.cumsum(n) - n
            at = starts + (best & ((1 << _SHIFT) - 1))
            flat[at] = self.merged[self._find(flat[at], flat[at + 1])[0]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat, rank, n = flat[keep], rank[keep], n - 1
            starts = np.cumsum(n) - n
            at -= np.arange(len(at))  # every sequence before lost one symbol
            rank[at] = _NONE
            inner = at[at < starts + n - 1]
            rank[inner] = self._pair_ranks(flat[inner], flat[inner + 1])
            before = at[at > starts] - 1
            rank[before] = self._pair_ranks(flat[before], flat[before + 1])
        return out

    def survivors_by_rank(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for long sequences: a step merges all pairs of the lowest rank and visits no other symbol.

        The sequences stand in one array with a symbol of no pair behind each. Places of pairs wait by rank. Of
        pairs that overlap every other one merges, from the left. A step ends behind a merge that makes a pair
        of its own or a lower rank, since that pair comes before those further right.
        """
        ends = np.cumsum(n)
        sym = np.insert(flat, ends, self.size)
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        rank = np.append(self._pair_ranks(sym[:-1], sym[1:]), _NONE)
        gone = np.zeros(len(sym), bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < _NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            values, first = np.unique(rank[places], return_index=True)
            for value, some in zip(values.tolist(), np.split(places, first[1:]), strict=False):
                if value not in waiting:
                    waiting[value] = []
                    heapq.heappush(queue, value)
                waiting[value].append(some)

        wait(np.arange(len(sym)))
        while queue:
            lowest = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(lowest)))
            places = places[rank[places] == lowest]
            if not len(places):
                continue
            nth = np.arange(len(places))
            heads = np.where(np.append(True, after[places[:-1]] != places[1:]), nth, 0)
            at = places[(nth - np.maximum.accumulate(heads)) % 2 == 0]
            right = after[at]
            beyond = after[right]
            new = self.merged[self._find(sym[at], sym[right])[0]]
            left = sym[before[at]]  # in front of the first symbol: the last one, which has no pair
            side_by_side = np.flatnonzero(beyond[:-1] == at[1:])
            left[side_by_side + 1] = new[side_by_side]
            made = np.minimum(self._pair_ranks(left, new), self._pair_ranks(new, sym[beyond]))
            stop = np.flatnonzero(made <= lowest)
            if len(stop):
                end = stop[0] + 1
                at, right, beyond, new = at[:end], right[:end], beyond[:end], new[:end]
            sym[at], after[at], before[beyond] = new, beyond, at
            rank[right], gone[right] = _NONE, True
            front = before[at]
            changed = np.unique(np.concatenate((at, front[front >= 0])))
            rank[changed] = self._pair_ranks(sym[changed], sym[after[changed]])
            wait(changed)
            if len(stop):
                wait(places[places > at[-1]])
        return np.add.reduceat(np.where(gone, 0, self.weight[sym]), ends - n + np.arange(len(n)))

    def _count_units(self, units: list[str]) -> np.ndarray:
        texts = [SPACE + u.replace(" ", SPACE) for u in units]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        opens = np.zeros(len(points), bool)
        pair = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.side, pair), len(self.side) - 1)
        opens[1:] = self.side[at] != pair
        opens[first] = True
        starts = np.flatnonzero(opens)
        n = np.diff(np.append(starts, len(points)))
        flat = self.symbol[points]
        counts = np.zeros(len(n), np.int64)
        short = n <= MAX_WIDTH
        if short.any():
            counts[short] = self.survivors(flat[np.repeat(short, n)], n[short])
        if not short.all():
            counts[~short] = self.survivors_by_rank(flat[np.repeat(~short, n)], n[~short])
        return np.add.reduceat(counts, np.searchsorted(starts, first))

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > self.max_units:
            self.known = {}
        known, held, missing = self.known, [], {}
        for text in texts:
            if not text:
                held.append(None)
                continue
            if SPACE in text:
                text = text.replace(SPACE, " ")
            # A run of spaces stays with what follows it; the first space of each is the separator.
            units = text.split(" ") if "  " not in text and text[0] != " " else [u[1:] for u in _UNITS.findall(" " + text)]
            found = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
            new = np.flatnonzero(found < 0)
            missing.update((units[k], None) for k in new)
            held.append((units, found, new))
        if missing:
            learned = dict(zip(missing, self._count_units(list(missing)).tolist(), strict=True))
            known.update((u, c) for u, c in learned.items() if len(u) <= MAX_UNIT_CHARS)
        out = np.zeros(len(texts), np.int64)
        for i, item in enumerate(held):
            if item is not None:
                units, found, new = item
                for k in new:
                    found[k] = learned[units[k]]
                out[i] = found.sum()
        return out


_COUNTERS: dict[str, PieceCounter] = {}


keeps("pieces", _COUNTERS.clear)


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``limit`` in sum, one row at least."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(model)
        for batch in stream:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs(sizes, BATCH_CHARS):
                counts = held.count(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(counts), pa.array(counts > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean("pieces", task), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
