import hashlib
import random
import zlib
from collections import defaultdict

from oracle import connection, rows_of, sql_rows
from textquarry.llm import prefix_trie
from textquarry.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, id string, depth int, block int"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h, family = zlib.crc32(str(c).encode()) % 9, c - abs(c) % 5 * (1 if c >= 0 else -1)
        again = [*turns.get(family, [])[:h], *turns[c][h:]]
        for d in range(len(again) + 1):
            members[tuple(again[:d])].append(c)
        ends[tuple(again)].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.trie(frame).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])) for c in [*range(60), -7, -3, 10**12] for t in range(rng.randrange(9))]
    rows += [(c, t, "u", "same") for c in (200, 201, 202, 203) for t in range(3)]  # copies
    rows += [(300, t, "u", f"x{t}") for t in range(40)] + [(305, t, "u", f"x{t}") for t in range(25)]  # a long chain, and one that ends inside it
    rows += rows[:7] + [(None, 1, "u", "nobody"), (400, None, None, None), (401, 0, "u", "long " * 20_000)]
    assert found(spark, rows) == brute(rows)


def test_one_chain_empty_and_turnless(spark):
    assert found(spark, []) == []
    one = [(5, t, "u", str(t)) for t in range(100)]
    assert found(spark, one) == brute(one)
    alone = next(c for c in range(1001, 1100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # no family, and fewer turns than h
    assert found(spark, [(alone, 0, "u", "x")]) == [(alone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_caterpillar(spark):
    """A branch at every depth: the tree is peeled from below, one branching after another."""
    rows = [(5 * c, t, "u", f"{t}") for c in range(12) for t in range(c + 9)] + [(5 * c, c + 9, "u", f"end {c}") for c in range(12)]
    assert found(spark, rows) == brute(rows)


def test_many_ends_in_one_node(spark):
    rows = [(c, 0, "u", "hello") for c in range(9000)]
    assert found(spark, rows) == brute(rows)


def test_query(spark):
    sql = sql_rows(connection(SF), oracle_sql()["op12_prefix_trie"])
    assert rows_of(queries()["op12_prefix_trie"](spark, SF)) == sql and sql
