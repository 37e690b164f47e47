"""An index as a chain of versions, each a list of segments that never change.

Layout: ``<root>/versions/<number>.json`` and ``<root>/segments/<name>/``. What a segment holds is up to a layout:
``Items`` here, ``documents.Documents`` for postings. A segment of items has, for each scope, its counted items sorted by token
(``trie``, for prefix and interior searches) and by reversed token (``suffix``, which holds no other form), and the texts of
documents with ids, which deletes cut again. The words of lines are not stored: a search cuts the lines that hold its term. A writer
puts its segment under a new name and then creates the next version's file, which exactly one writer can do: readers see all
datasets of a change or none, whatever fails on the way, and go on reading an older version while it is made.

A delete adds two things: a delete vector (doc_ids), which is anti-joined wherever single documents are read, and a segment with the
negative counts of those documents, so that searches, which read counts alone, need no documents. ``compact``
applies the vectors, sums the counts and leaves one segment. A version knows the last batch of each source, so a repeated append adds nothing.

A null doc_id is a document that can't be deleted. Rows with equal doc_ids are deleted together; added again later, an id is alive again.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.enums import Scope, SearchType
from textquarry.operators.tokens import counted, tokens
from textquarry.sources import files

log = logging.getLogger(__name__)
ALL = [(s, k) for s in Scope for k in SearchType]
#: Deleted ids, as counted when they are written, up to which they are broadcast.
MAX_BROADCAST_IDS = 2_000_000
#: Times that a writer starts again because another one was first.
RETRIES = 10


class ConcurrentCommit(RuntimeError):
    """Other writers were first each time."""


@dataclass(frozen=True)
class Segment:
    name: str
    #: The version that added it.
    since: int
    #: Counts of deleted documents, below zero; such a segment has no documents of its own.
    retracts: bool = False
    #: Some of its texts were cut by the full word rules.
    any_script: bool = False


@dataclass(frozen=True)
class Deletes:
    name: str
    #: Segments of versions up to this one are meant.
    upto: int
    rows: int


@dataclass(frozen=True)
class Version:
    number: int = -1
    kind: str = "none"
    at: str = ""
    segments: tuple[Segment, ...] = ()
    deletes: tuple[Deletes, ...] = ()
    #: Source -> its last batch that is in.
    sources: dict[str, int] = field(default_factory=dict)

    def vectors(self, segment: Segment) -> tuple[Deletes, ...]:
        return tuple(d for d in self.deletes if d.upto >= segment.since)


def dataset(root: str, segment: str, scope: Scope, what: str) -> str:
    return f"{root}/segments/{segment}/scope={scope.value}/type={what}"


def _held(kind: SearchType) -> str:
    """The dataset that answers a kind of search: interior ones read every item, in whatever order."""
    return (SearchType.PREFIX if kind is SearchType.CONTAINS else kind).index_name


def _texts(root: str, segment: str) -> str:
    return f"{root}/segments/{segment}/type=texts"


def _file(root: str, number: int) -> str:
    return f"{root}/versions/{number:010d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in files.names(spark, f"{root}/versions") if n.endswith(".json") and n[0] != "."]


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, the last one by default; an empty one before anything was written."""
    known = versions(spark, root)
    if number is not None and number not in known:
        raise ValueError(f"no version {number} in {root}: {known}")
    if not known:
        return Version()
    held = json.loads(files.read(spark, _file(root, known[-1] if number is None else number)))
    if any("any_script" not in s for s in held["segments"]):
        raise ValueError(f"{root} has the layout of an earlier release; build it anew")
    return Version(held["number"], held["kind"], held["at"], tuple(Segment(**s) for s in held["segments"]), tuple(Deletes(**d) for d in held["deletes"]), held["sources"])


def _commit(spark: SparkSession, root: str, base: Version, kind: str, segments, deletes, sources: dict[str, int]) -> Version | None:
    """The version after ``base``, or None if there is one already."""
    new = Version(base.number + 1, kind, datetime.now(UTC).isoformat(timespec="milliseconds"), tuple(segments), tuple(deletes), dict(sources))
    done = files.create_once(spark, _file(root, new.number), json.dumps(asdict(new), indent=1))
    log.info("%s version %d of %s", "made" if done else "lost", new.number, root)
    return new if done else None


def _clustered(items: DataFrame, kind: SearchType) -> DataFrame:
    key = "token"
    if kind is SearchType.SUFFIX:
        items, key = items.withColumn("token_rev", F.reverse("token")), "token_rev"
    return items.repartitionByRange(key).sortWithinPartitions(key)


class Items:
    """What a segment of a search index holds: counted items of documents (``doc_id`` is optional, ``text``)."""

    def __init__(self, any_script: bool = False):
        self.any_script = any_script

    def write(self, corpus: DataFrame, root: str, name: str) -> None:
        spark, place = corpus.sparkSession, _texts(root, name)
        if "doc_id" in corpus.columns:
            rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(self.any_script).alias("any_script"))
            _put(rows.where(F.col("text").isNotNull()).sortWithinPartitions("doc_id"), place)
            corpus = spark.read.parquet(place)  # and so does a task that is run again
        else:
            _put(spark.createDataFrame([], "doc_id long, text string, any_script boolean"), place)
        for scope in Scope:
            write_kinds(counted(tokens(corpus, scope, self.any_script)), scope, lambda kind, scope=scope: dataset(root, name, scope, kind.index_name))

    def rewrite(self, spark: SparkSession, root: str, held: Version, to: str, name: str) -> None:
        """Everything alive in a version, as one segment: texts are copied, and counts summed, none is cut."""
        texts = alive(spark, root, held, lambda segment: _texts(root, segment))
        _put(texts.sortWithinPartitions("doc_id"), _texts(to, name))
        for scope in Scope:
            rows = spark.read.parquet(*[dataset(root, s.name, scope, SearchType.PREFIX.index_name) for s in held.segments])
            items = rows.groupBy("token").agg(F.sum("freq").alias("freq")).where("freq > 0")
            write_kinds(items, scope, lambda kind, scope=scope: dataset(to, name, scope, kind.index_name))

    def retract(self, root: str, held: Version, gone: DataFrame, low: int, high: int, name: str) -> bool:
        """A segment with the negative counts of the documents ``gone``."""
        # Files are sorted by id: the range reaches the scan.
        texts = alive(gone.sparkSession, root, held, lambda segment: _texts(root, segment)).where(F.col("doc_id").between(low, high))
        texts = texts.join(gone, "doc_id", "left_semi")
        for scope in Scope:
            items = tokens(texts.where(~F.col("any_script")), scope)
            if any(s.any_script for s in held.segments):
                items = items.unionByName(tokens(texts.where("any_script"), scope, True))
            lost = counted(items).select("token", (-F.col("freq")).alias("freq"))
            write_kinds(lost, scope, lambda kind, scope=scope: dataset(root, name, scope, kind.index_name))
        return True


def _put(rows: DataFrame, place: str) -> None:
    """Zstandard: an index is written once and read often."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(place)


def write_kinds(items: DataFrame, scope: Scope, path_of) -> None:
    """The datasets of a scope from its counted items; ``path_of(kind)`` says where.

    Items stay in the partitions that counting dealt them to, and are sorted there: every file tells by its page index where a
    beginning stands. The second order is made of what the first one wrote.
    """
    place = path_of(SearchType.PREFIX)
    _put(items.select("token", "freq").sortWithinPartitions("token"), place)
    turned = items.sparkSession.read.parquet(place).select(F.reverse("token").alias("token_rev"), "freq")
    _put(turned.sortWithinPartitions("token_rev"), path_of(SearchType.SUFFIX))


def _any_script(layout) -> bool:
    return getattr(layout, "any_script", False)


def build(corpus: DataFrame, root: str, layout=None) -> Version:
    """A version that holds the corpus and nothing else; earlier versions stay readable."""
    spark, name = corpus.sparkSession, uuid.uuid4().hex
    (layout or Items()).write(corpus, root, name)
    for _ in range(RETRIES):
        base = version(spark, root)
        if done := _commit(spark, root, base, "build", [Segment(name, base.number + 1, any_script=_any_script(layout))], [], {}):
            return done
    raise ConcurrentCommit(root)


def append(corpus: DataFrame, root: str, layout=None, source: str | None = None, batch: int | None = None) -> Version:
    """Adds new texts. With ``source`` and a rising ``batch`` number, a batch that is in already adds nothing."""
    spark, name = corpus.sparkSession, uuid.uuid4().hex

    def is_in(base: Version) -> bool:
        return source is not None and base.sources.get(source, -1) >= batch

    if is_in(base := version(spark, root)):
        return base
    (layout or Items()).write(corpus, root, name)
    for _ in range(RETRIES):
        base = version(spark, root)
        if is_in(base):
            files.remove(spark, f"{root}/segments/{name}")
            return base
        sources = base.sources | ({} if source is None else {source: batch})
        if done := _commit(spark, root, base, "append", [*base.segments, Segment(name, base.number + 1, any_script=_any_script(layout))], base.deletes, sources):
            return done
    raise ConcurrentCommit(root)


def _named(spark: SparkSession, root: str, vectors: tuple[Deletes, ...]) -> DataFrame:
    gone = spark.read.parquet(*[f"{root}/deletes/{d.name}" for d in vectors])
    return F.broadcast(gone) if sum(d.rows for d in vectors) <= MAX_BROADCAST_IDS else gone


def without(spark: SparkSession, root: str, rows: DataFrame, vectors: tuple[Deletes, ...]) -> DataFrame:
    """Rows of documents that no delete vector names."""
    return rows.join(_named(spark, root, vectors), "doc_id", "left_anti").select(*rows.columns) if vectors else rows


def within(spark: SparkSession, root: str, rows: DataFrame, vectors: tuple[Deletes, ...]) -> DataFrame:
    """Rows of documents that one of the delete vectors names."""
    return rows.join(_named(spark, root, vectors), "doc_id", "left_semi").select(*rows.columns)


def by_vectors(held: Version) -> dict[tuple[Deletes, ...], list[str]]:
    """The names of a version's segments with documents, by the delete vectors that hold for them."""
    groups: dict[tuple[Deletes, ...], list[str]] = {}
    for segment in held.segments:
        if not segment.retracts:
            groups.setdefault(held.vectors(segment), []).append(segment.name)
    return groups


def alive(spark: SparkSession, root: str, held: Version, path_of) -> DataFrame:
    """Rows, with a column doc_id, of the documents alive in a version that has segments; ``path_of(segment name)`` holds them.

    Segments with the same delete vectors are read together.
    """
    rows = None
    for vectors, names in by_vectors(held).items():
        some = without(spark, root, spark.read.parquet(*map(path_of, names)), vectors)
        rows = some if rows is None else rows.unionByName(some)
    return rows


def delete(ids: DataFrame, root: str, layout=None) -> Version:
    """Takes the documents of a column ``doc_id`` out. Unknown ids and null do nothing."""
    spark = ids.sparkSession
    for _ in range(RETRIES):
        base, name = version(spark, root), uuid.uuid4().hex
        if not base.segments:
            return base
        place = f"{root}/deletes/{name}"
        ids.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().write.parquet(place)
        gone = spark.read.parquet(place)
        n, low, high = gone.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
        if not n:
            return base
        gone = F.broadcast(gone) if n <= MAX_BROADCAST_IDS else gone
        retracted = (layout or Items()).retract(root, base, gone, low, high, name)
        vector = Deletes(name, base.number, n)
        if done := _commit(spark, root, base, "delete", [*base.segments, *[Segment(name, base.number + 1, True)] * retracted], [*base.deletes, vector], base.sources):
            return done
        # Another writer was first, so what is alive has changed: counted anew.
        files.remove(spark, f"{root}/segments/{name}")
        files.remove(spark, place)
    raise ConcurrentCommit(root)


def compact(spark: SparkSession, root: str, target: str | None = None, layout=None) -> Version:
    """One segment of what is alive, as the next version, or as the first of another root.

    Writers go on meanwhile: what they have added or deleted since is kept beside the new segment. Only if the segments that were merged
    have gone, by a build or another compaction, it fails and changes nothing.
    """
    base = version(spark, root)
    if not base.segments:
        return base
    to, name, any_script = target or root, uuid.uuid4().hex, any(s.any_script for s in base.segments)
    (layout or Items()).rewrite(spark, root, base, to, name)
    for _ in range(RETRIES):
        onto = version(spark, to)
        if target is not None:
            segments, deletes, sources = [Segment(name, onto.number + 1, any_script=any_script)], [], base.sources
        elif set(base.segments) <= set(onto.segments):
            # Later delete vectors reach up to this version at least, and so to the new segment.
            segments = [Segment(name, base.number, any_script=any_script), *(s for s in onto.segments if s not in base.segments)]
            deletes, sources = [d for d in onto.deletes if d not in base.deletes], onto.sources
        else:
            break
        if done := _commit(spark, to, onto, "compact", segments, deletes, sources):
            return done
    files.remove(spark, f"{to}/segments/{name}")
    raise ConcurrentCommit(to)


def history(spark: SparkSession, root: str) -> DataFrame:
    """number, kind, at, segments, deletes of every version that is kept."""
    rows = [(v.number, v.kind, v.at, len(v.segments), len(v.deletes)) for v in (version(spark, root, n) for n in versions(spark, root))]
    return spark.createDataFrame(rows, "number long, kind string, at string, segments int, deletes int")


def as_of(spark: SparkSession, root: str, at: str) -> int:
    """The last version made at or before a time (ISO 8601, UTC)."""
    known = [v.number for v in (version(spark, root, n) for n in versions(spark, root)) if v.at <= at]
    if not known:
        raise ValueError(f"no version of {root} at {at}")
    return max(known)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Forgets all but the last ``keep`` versions and deletes what only the others list; gives the names."""
    known = versions(spark, root)
    old, kept = known[:-keep], [version(spark, root, n) for n in known[-keep:]]
    names = lambda v: {s.name for s in v.segments} | {d.name for d in v.deletes}
    used = set().union(*map(names, kept))
    free = sorted(set().union(*[names(version(spark, root, n)) for n in old]) - used) if old else []
    for n in old:
        files.remove(spark, _file(root, n))
    for name in free:
        files.remove(spark, f"{root}/segments/{name}")
        files.remove(spark, f"{root}/deletes/{name}")
    return free


class Indexes(dict):
    """(scope, type) -> index of a version; ``any_script``: lines are cut by the full word rules."""

    any_script = False


def load(spark: SparkSession, root: str, number: int | None = None, strict: bool = True) -> Indexes:
    """The six indexes of a version: ``token, freq``, for suffixes ``token_rev`` too.

    ``strict``: a dataset that is gone from the disk fails; else it is left out, and searches of it have no match.
    """
    held, found = version(spark, root, number), Indexes()
    found.any_script = any(s.any_script for s in held.segments)
    for scope, kind in ALL:
        key = "token_rev" if kind is SearchType.SUFFIX else "token"
        paths = [dataset(root, s.name, scope, _held(kind)) for s in held.segments]
        lost = [] if strict else [p for p in paths if not files.exists(spark, p)]
        if lost:
            log.warning("no index for %s, %s: %s", scope.value, kind.value, lost)
            continue
        rows = spark.read.parquet(*paths) if paths else spark.createDataFrame([], f"{key} string, freq long")
        if len(paths) > 1:
            # One row a token of the tokens that are left. Tests of a token pass the grouping and reach the scan.
            rows = rows.groupBy(key).agg(F.sum("freq").alias("freq")).where("freq > 0")
        found[scope, kind] = rows.select(F.reverse(key).alias("token"), "freq", key) if kind is SearchType.SUFFIX else rows
    return found
