"""Operator 9: a quality classifier by co-training.

Two views of a document: its content (rates of characters and words) and its page metadata (language,
source, length and layout). Each view has a logistic classifier over binned features. In every round each
classifier labels the unlabelled documents it is surest of among those that the other one has no label of yet, and
those labels go to the other one. After
the last round each view's logit is calibrated (Platt) and a joint logistic on both calibrated logits scores every
document. Both learn from logits of rows outside the fit: all labelled rows fit the views, and for each fold of them the
views without that fold are one Newton step away, from sums that are at hand.

The fit sees at most ``PER_CLASS`` labelled rows of each class and all unlabelled ones: their features are written once,
and every Newton step and every choice of rows is a pass over them whose sums alone come to the driver. Null and empty
texts are documents without words. Null languages and sources are values of their own; of languages and of sources
the ``MAX_NAMES`` commonest have a weight each, all others one. Repeated rows score alike.
If the labels have one class or none, every document scores 1. Further columns pass through ``keep_good``.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.labelled import held_out, learnable, logistic, training_rows
from textquarry.llm.storage import by_place, drop, written
from textquarry.llm.token_counts import runs
from textquarry.llm.workers import lean

#: The documented bound of the labelled sample that the models are fitted on.
PER_CLASS = 2000
ROUNDS = 3
#: Pseudo-labels a view gives away in a round: this part of the unlabelled rows at most, dealt to the classes as
#: the labelled rows have them.
GIVEN = 0.1
SURE = 0.9
_SURE_LOGIT = math.log(SURE / (1 - SURE))
#: Edges of a feature's bins: its quantiles, closer at both ends, where the odd documents are.
QUANTILES = [0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.25, 0.33, 0.42, 0.5, 0.58, 0.67, 0.75, 0.84, 0.92, 0.96, 0.98, 0.99, 0.995]
STEPS = 12
#: Tasks that add up what the others have summed.
ADDERS = 8
FOLDS = 5
MAX_NAMES = 1000
BATCH_CHARS = 1_000_000
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@+]")

CONTENT = ("words", "mean_word", "distinct", "top_word", "upper", "symbols", "bangs", "digits", "stops", "line_repeats", "window_repeats", "non_ascii")
METADATA = ("lang", "source", "chars", "lines", "line_chars", "longest_line")


def content(text: str) -> list[float]:
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = Counter(words)
    top = max(distinct.values(), default=0)
    pairs = set(zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, words))
    return [
        math.log1p(len(words)),
        (len(text) - text.count(" ") - text.count("\n")) / n,
        len(distinct) / n,
        top / n,
        upper / n,
        len(_SYMBOLS.findall(text)) / n,
        (text.count("!") + text.count("?")) / n,
        sum(text.count(d) for d in "0123456789") / chars,
        (text.count(".") + text.count(",")) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(pairs) / max(len(words) - 1, 1),
        1 - len(text.encode("ascii", "ignore")) / chars,
    ]


def metadata(lang: str | None, source: str | None, text: str, names: list[dict]) -> list[float]:
    lines = text.split("\n")
    return [
        float(names[0].get(lang, 0)),
        float(names[1].get(source, 0)),
        math.log1p(len(text)),
        math.log1p(len(lines)),
        math.log1p(len(text) / len(lines)),
        math.log1p(max(map(len, lines))),
    ]


class View:
    """A logistic classifier over features cut into bins at training quantiles; names are bins as they are."""

    def __init__(self, edges: list[list[float]], names: dict[int, int]):
        """names: features that are names already, with the number of their values."""
        self.edges, self.names = edges, names
        self.sizes = [names.get(k, len(e) + 1) for k, e in enumerate(edges)]
        self.first = np.cumsum([0, *self.sizes[:-1]])
        self.w, self.b, self.slope, self.shift = np.zeros(sum(self.sizes)), 0.0, 1.0, 0.0
        #: Log odds of the labelled rows' classes; fits take them as equal.
        self.prior = 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for k, edges in enumerate(self.edges):
            out[:, k] = self.first[k] + (x[:, k].astype(np.int64) if k in self.names else np.searchsorted(edges, x[:, k], "right"))
        return out

    def sums(self, x: np.ndarray, y: np.ndarray) -> list[list]:
        """Of each class: rows, loss, gradient and Hessian by weights and, last, the intercept."""
        out = []
        for label in (0.0, 1.0):
            cells = self.cells(x[y == label])
            size = len(self.w) + 1
            grad, bend = np.zeros(size), np.zeros((size, size))
            z = np.clip(self.b + self.w[cells].sum(1), -30, 30)
            p = 1 / (1 + np.exp(-z))
            if len(cells):
                used, place = np.unique(cells, return_inverse=True)
                hot = np.zeros((len(cells), len(used) + 1))
                hot[np.arange(len(cells))[:, None], place.reshape(cells.shape)] = 1
                hot[:, -1] = 1
                at = np.append(used, size - 1)
                grad[at] = hot.T @ (p - label)
                bend[np.ix_(at, at)] = hot.T @ (hot * (p * (1 - p))[:, None])
            out.append([len(cells), float(np.logaddexp(0, -z if label else z).sum()), grad, bend])
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.b + self.w[self.cells(x)].sum(1)


def known_names(docs: DataFrame) -> list[dict]:
    """Number from 1 of the commonest languages and of the commonest sources among rows to learn from."""
    out = []
    for c in ("lang", "source"):
        some = learnable(docs).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).limit(MAX_NAMES).collect()
        out.append({r[c]: k for k, r in enumerate(some, 1)})
    return out


def features(rows: DataFrame, names: list[dict]) -> DataFrame:
    """doc_id, y and x, the content and then the metadata features, of rows with text, lang and source."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sizes = pc.fill_null(pc.binary_length(batch.column(4)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs(sizes, BATCH_CHARS):
                part = batch.slice(a, b - a)
                lang, source, texts = (part.column(k).to_pylist() for k in (2, 3, 4))
                x = [content(t or "") + metadata(m, n, t or "", names) for m, n, t in zip(lang, source, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return rows.select("doc_id", "y", "lang", "source", "text").mapInArrow(lean("quality", task), "doc_id long, y int, x array<double>")


def table(docs: DataFrame, labels: DataFrame, names: list[dict], per_class: int = PER_CLASS) -> DataFrame:
    """Features of the labelled sample and (y null) of all documents that no label names, one row each."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    pool = features(learnable(docs), names).groupBy("doc_id").agg(F.min("x").alias("x")).join(named, "doc_id", "left_anti")
    known = features(training_rows(docs, labels, "quality", per_class), names)
    return written(known.unionByName(pool.select("doc_id", F.lit(None).cast("int").alias("y"), "x")), "quality-features")


def _split(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, : len(CONTENT)], x[:, len(CONTENT) :]]


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in stream:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield batch.column(0).to_numpy(), _split(x)


def _keys(ids: np.ndarray, view: View, z: np.ndarray, label: float) -> np.ndarray:
    """How sure a view is of a label, with classes at their own parts; equal logits are put in an order by a hash of the doc_id."""
    z = z + view.prior
    turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    return (z if label else -z) + turn.astype(float) / 2.0**53 * 1e-6


def given(ids: np.ndarray, x: list[np.ndarray], past: list) -> list[np.ndarray]:
    """The labels that each view has been given, NaN where none, by the rounds so far: both views, and their least keys."""
    out = [np.full(len(ids), np.nan) for _ in x]
    for views, least in past:
        for v, view in enumerate(views):
            z = view.logit(x[v])
            for label in (1.0, 0.0):
                key = _keys(ids, view, z, label)
                out[1 - v][np.isnan(out[1 - v]) & (key >= _SURE_LOGIT) & (key > least[v, label])] = label
    return out


def _newton(sums: list[list], c: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss at c, with both classes at equal parts and a ridge, and the step to its least as far as a parabola tells."""
    ridge = np.append(np.full(len(c) - 1, 1e-3), 1e-9)
    loss, grad, bend = (sum(s[k] * (0.5 / max(s[0], 1)) for s in sums) for k in (1, 2, 3))
    return loss + 0.5 * float(ridge @ (c * c)), -np.linalg.solve(bend + np.diag(ridge), grad + ridge * c)


def _pool_sums(pool: DataFrame, views: list[View], past: list) -> list | None:
    """Sums of both views over what they have been given: a row a task, added up in ``ADDERS`` tasks, whose rows come back.

    One job over all partitions. Sums are added in the order of partitions, so they are the same each time.
    """
    if not past:
        return None

    def packed(part: int, total: list | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([zlib.compress(pickle.dumps(total), 1)], pa.binary())})

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for ids, part in _batches(stream):
            labels = given(ids, part, past)
            total = _plus(total, [view.sums(part[v], labels[v]) for v, view in enumerate(views)])
        yield from packed(TaskContext.get().partitionId(), total)

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = 0, None
        for batch in stream:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = part if total is None else first
                total = _plus(total, pickle.loads(zlib.decompress(sums)))
        yield from packed(first, total)

    schema = "part int, sums binary"
    rows = pool.mapInArrow(lean("quality", task), schema).repartition(ADDERS).sortWithinPartitions("part")
    total = None
    for row in sorted(rows.mapInArrow(lean("quality", add), schema).collect()):
        total = _plus(total, pickle.loads(zlib.decompress(bytes(row.sums))))
    return total


def _fit(pool: DataFrame, views: list[View], past: list, x: list[np.ndarray], y: np.ndarray) -> None:
    """Newton steps on the labelled rows and what the views have been given, classes at equal parts; halved where they overshoot."""
    best: list = [(math.inf, None, None)] * len(views)
    for _ in range(STEPS):
        total = _plus(_pool_sums(pool, views, past), [view.sums(x[v], y) for v, view in enumerate(views)])
        moved = 0.0
        for v, view in enumerate(views):
            c = np.append(view.w, view.b)
            loss, step = _newton(total[v], c)
            if loss <= best[v][0] + 1e-12:
                best[v] = (loss, c, step)
            else:
                step = best[v][2] / 2
                best[v] = (best[v][0], best[v][1], step)
            c = best[v][1] + step
            view.w, view.b = c[:-1], float(c[-1])
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-2:
            break


def _plus(a: list | None, b: list) -> list:
    return b if a is None else [[[p + q for p, q in zip(m, n, strict=True)] for m, n in zip(v, w, strict=True)] for v, w in zip(a, b, strict=True)]


def _least(pool: DataFrame, views: list[View], past: list, most: list[int]) -> dict:
    """By view and label, the key above which stand the ``most[label]`` surest rows that the other view has no label of."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in _batches(stream):
            labels = given(ids, part, past)
            for v, view in enumerate(views):
                z = view.logit(part[v])
                for label in (1.0, 0.0):
                    key = _keys(ids, view, z, label)
                    key = key[np.isnan(labels[1 - v]) & (key >= _SURE_LOGIT)]
                    slots = pa.array(np.full(len(key), 2 * v + int(label), np.int32))
                    yield pa.RecordBatch.from_arrays([slots, pa.array(key)], ["slot", "key"])

    keys = pool.mapInArrow(lean("quality", task), "slot int, key double")
    counts = {r.slot: r.n for r in keys.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = {slot: 1 - (most[slot % 2] + 0.5) / n for slot, n in counts.items() if n > most[slot % 2]}
    found = {}
    if over:
        wanted = [F.percentile_approx(F.when(F.col("slot") == slot, F.col("key")), part, 100_000).alias(str(slot)) for slot, part in over.items()]
        found = keys.agg(*wanted).first().asDict()
    return {(v, label): found.get(str(2 * v + int(label)), -math.inf) for v in range(len(views)) for label in (1.0, 0.0)}


def _outside(views: list[View], pooled: list | None, x: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Logits of the labelled rows, each by the views without its fold."""
    total = _plus(pooled, [view.sums(x[v], y) for v, view in enumerate(views)])
    out = [np.zeros(len(y)) for _ in views]
    for fold in range(FOLDS):
        inside = np.arange(len(y)) % FOLDS == fold
        for v, view in enumerate(views):
            own = view.sums(x[v][inside], y[inside])
            rest = [[p - q for p, q in zip(m, n, strict=True)] for m, n in zip(total[v], own, strict=True)]
            c = np.append(view.w, view.b)
            c = c + _newton(rest, c)[1]
            out[v][inside] = c[-1] + c[:-1][view.cells(x[v][inside])].sum(1)
    return out


def co_train(rows: DataFrame, names: list[dict]) -> tuple[list[View], list, list[np.ndarray], np.ndarray] | None:
    """Both views, the rounds, and the logits outside their folds and labels of the labelled rows; None without labels of both classes."""
    columns = ["doc_id", "x"]
    known = sorted((r.doc_id, float(r.y), r.x) for r in rows.where("y is not null").collect())  # 2 * per_class rows at most
    y = np.array([k[1] for k in known])
    if {0.0, 1.0} - set(y.tolist()):
        return None
    x = _split(np.array([k[2] for k in known]))
    named, width = {len(CONTENT), len(CONTENT) + 1}, len(CONTENT) + len(METADATA)
    cuts = rows.agg(*[F.percentile_approx(F.col("x")[k], QUANTILES, 10_000).alias(str(k)) for k in range(width) if k not in named]).first().asDict()
    edges = [sorted(set(cuts.get(str(k), []))) for k in range(width)]
    views = [View(edges[: len(CONTENT)], {}), View(edges[len(CONTENT) :], {k: len(n) + 1 for k, n in enumerate(names)})]
    pool = rows.where("y is null").select(*columns)
    parts = [float(np.mean(y == label)) for label in (0.0, 1.0)]
    many, past = pool.count(), []
    most = [int(GIVEN * part * many) for part in parts]
    for view in views:
        view.prior = math.log(parts[1] / parts[0])
    for turn in range(ROUNDS + 1):
        _fit(pool, views, past, x, y)
        if turn == ROUNDS or not any(most):
            break
        held = [View(view.edges, view.names) for view in views]
        for old, view in zip(held, views, strict=True):
            old.w, old.b, old.prior = view.w, view.b, view.prior
        past.append((held, _least(pool, held, past, most)))
    return views, past, _outside(views, _pool_sums(pool, views, past), x, y), y


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The model as plain values."""
    names = known_names(docs)
    held = table(docs, labels, names, per_class)
    found = co_train(held, names)
    drop(held)
    if found is None:
        return {}
    views, _, logits, target = found
    # Classes at their own parts here, so that scores are probabilities.
    weight, calibrated = np.ones(len(target)), []
    for view, z in zip(views, logits, strict=True):
        view.slope, view.shift = logistic(z[:, None], target, weight).tolist()
        calibrated.append(view.slope * z + view.shift)
    joint = logistic(np.column_stack(calibrated), target, weight)
    kept = [{"edges": v.edges, "names": v.names, "w": v.w.tolist(), "b": v.b, "slope": v.slope, "shift": v.shift} for v in views]
    return {"views": kept, "joint": joint.tolist(), "names": names}


def _load(model: dict) -> list[View]:
    out = []
    for v in model["views"]:
        view = View(v["edges"], v["names"])
        view.w, view.b, view.slope, view.shift = np.array(v["w"]), v["b"], v["slope"], v["shift"]
        out.append(view)
    return out


def _scores(model: dict, lang: list, source: list, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    if not model:
        return np.ones(n), np.ones(n), np.ones(n)
    texts = [t or "" for t in texts]
    x = [np.array([content(t) for t in texts]), np.array([metadata(a, b, t, model["names"]) for a, b, t in zip(lang, source, texts, strict=True)])]
    z = [v.slope * v.logit(x[k]) + v.shift for k, v in enumerate(_load(model))]
    a, b, c = model["joint"]
    p = lambda q: 1 / (1 + np.exp(-np.clip(q, -30, 30)))
    return p(z[0]), p(z[1]), p(a * z[0] + b * z[1] + c)


def _map(docs: DataFrame, model: dict, columns: list[str], schema: str, keep) -> DataFrame:
    """One pass over the columns; ``keep(batch, scores)`` makes the rows that go out."""
    at = {c: columns.index(c) for c in ("lang", "source", "text")}

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sizes = pc.fill_null(pc.binary_length(batch.column(at["text"])), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs(sizes, BATCH_CHARS):
                part = batch.slice(a, b - a)
                lists = [part.column(at[c]).to_pylist() for c in ("lang", "source", "text")]
                yield keep(part, _scores(model, *lists))

    return by_place(columns, docs).mapInArrow(lean("quality", task), schema)


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, p_content, p_metadata, score (probability of good quality) of every row."""

    def out(part: pa.RecordBatch, found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(f, pa.float64()) for f in found)], ["doc_id", "p_content", "p_metadata", "score"])

    return _map(_typed(docs), model, ["doc_id", "lang", "source", "text"], "doc_id long, p_content double, p_metadata double, score double", out)


def keep_good(docs: DataFrame, model: dict, at_least: float = 0.5) -> DataFrame:
    """The rows that score ``at_least`` so much, with all their columns."""

    def out(part: pa.RecordBatch, found: tuple) -> pa.RecordBatch:
        return part.filter(pa.array(found[2] >= at_least))

    placed = by_place(docs.columns, docs).schema
    return _map(docs, model, docs.columns, placed, out).toDF(*docs.columns)


def report(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """doc_id, held_out, both views' scores, score, kept."""
    out: Column = held_out(F.col("doc_id")).alias("held_out")
    return score(docs, train(docs, labels)).select("doc_id", out, "p_content", "p_metadata", "score", (F.col("score") >= at_least).alias("kept"))
