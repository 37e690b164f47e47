"""``python -m textquarry.cli build CORPUS ROOT``, ``... search ROOT SCOPE TYPE TERM`` and ``... shell ROOT``.

The shell keeps the session and the index: each line ``SCOPE TYPE TERM`` is a search, ``:log`` shows the last messages, ``:quit`` ends it.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textquarry.enums import Mode, Scope, SearchType
from textquarry.functions.scoring import highlight, rank_label
from textquarry.journal import NAME, Journal
from textquarry.operators.search import search
from textquarry.plans.index import build_all, load_index
from textquarry.sources.corpus import read_text

log = logging.getLogger(f"{NAME}.cli")


def parse(line: str) -> tuple[Scope, SearchType, str]:
    """A search as typed: scope, type and a term that is not blank; the term may hold blanks inside."""
    parts = line.strip().split(None, 2)
    if len(parts) < 3:
        raise ValueError("a search is: word|line prefix|suffix|contains TERM")
    return Scope(parts[0]), SearchType(parts[1]), parts[2].strip()


def show(index: dict, scope: Scope, kind: SearchType, term: str, mode: Mode, k: int, tokens_only: bool, out=None) -> int:
    """Prints the matches, k at most, and gives their number."""
    began = time.monotonic()
    found = search(index, scope, kind, term, mode, k)
    if tokens_only:
        rows = [row.token for row in found.select("token").collect()]
    else:
        cut = highlight(F.col("token"), term)
        rows = [f"{r.label}{r.h.pre}[{r.h.hit}]{r.h.post}" for r in found.select(rank_label().alias("label"), cut.alias("h")).collect()]
    print(*rows, sep="\n", end="\n" if rows else "", file=out)
    took = time.monotonic() - began
    log.debug("%s %s %r: %d results in %.3f s", scope.value, kind.value, term, len(rows), took)
    if not tokens_only:
        print(f"{took:.3f} s", file=out)
    return len(rows)


def shell(spark: SparkSession, root: str, mode: Mode, k: int, lines=sys.stdin, out=None) -> None:
    """Searches line by line in one session. A line that is no search is answered by what is wrong with it."""
    with Journal() as journal:
        index = load_index(spark, root)
        for line in lines:
            command = line.strip()
            if command == ":quit":
                break
            if command == ":log":
                print(*journal.messages, sep="\n", file=out)
            elif command:
                try:
                    show(index, *parse(command), mode, k, False, out)
                except ValueError as problem:
                    log.debug("not a search: %s", problem)
                    print(f"? {problem}", file=out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textquarry")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("corpus")
    b.add_argument("root")
    b.add_argument("--any-script", action="store_true", help="full word boundaries for Han, kana, Thai and the like")
    s = sub.add_parser("search")
    s.add_argument("root")
    s.add_argument("scope", choices=[x.value for x in Scope])
    s.add_argument("type", choices=[x.value for x in SearchType])
    s.add_argument("term")
    s.add_argument("--tokens-only", action="store_true")
    i = sub.add_parser("shell")
    i.add_argument("root")
    for p in (s, i):
        p.add_argument("--mode", choices=[x.value for x in Mode], default="compat")
        p.add_argument("-k", type=int, default=100)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        print(f"{datetime.now():%H:%M:%S.%f}"[:-3], f"built in {build_all(read_text(spark, args.corpus), args.root, args.any_script):.3f} s")
    elif args.command == "shell":
        shell(spark, args.root, Mode(args.mode), args.k)
    else:
        if not args.term.strip():
            parser.error("the term is blank")
        show(load_index(spark, args.root), Scope(args.scope), SearchType(args.type), args.term.strip(), Mode(args.mode), args.k, args.tokens_only)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
