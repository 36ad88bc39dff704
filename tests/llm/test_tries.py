"""The prefix trie against one built node by node in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, g int"


@pytest.fixture(autouse=True, scope="module")
def parts_as_dealt(spark):
    """Else Spark would join these small parts to one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows):
    """The expected nodes of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
            if d:
                kids[rebuilt[c][: d - 1]].add(rebuilt[c][:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(node))
        up = members[node[:-1]][0] if node else None
        out.append((m[0], len(node), up, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def built(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in tries.trie(df, **how).collect())


@pytest.fixture(scope="module")
def talks():
    """Few different turns, so that prefixes are shared at every depth; a long conversation; odd rows."""
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc"])) for c in range(60) for t in range(r.randrange(1, 14))]
    rows += [(c, t, "user", "the same") for c in range(100, 130) for t in range(4)]  # a third of the conversations
    rows += [(200, t, "user", "long" if t % 7 else "x") for t in range(400)]
    rows += [(205 + c, t, "user", "nested") for c in range(0, 60, 5) for t in range(c + 9)]  # each hangs on the one before
    rows += [(301, None, None, None), (301, None, "user", "a"), (301, 0, "user", None), (301, 0, "user", None), (301, 3, "", "")]
    rows += [(None, 0, "user", "a"), (None, 1, "user", "b"), (302, 0, "user", "x" * 100_000), (304, 5, "user", "\u0000,\n")]
    return rows


def test_trie_equals_plain(spark, talks):
    assert built(spark, talks) == plain(talks)


@pytest.mark.parametrize("field", [5, 11])
def test_colliding_fingerprints_are_split(spark, talks, field):
    """Two residues of a tiny field: most prefixes of a depth collide with others."""
    some = [r for r in talks if r[0] is not None and r[0] < 130]
    assert built(spark, some, field=field) == plain(some)


def test_collisions_cost_rounds(spark, talks, monkeypatch):
    rounds = []
    split = tries._split
    monkeypatch.setattr(tries, "_split", lambda *a: rounds.append(1) or split(*a))
    some = [r for r in talks if r[0] is not None and r[0] < 20]
    assert built(spark, some) == plain(some) and not rounds
    assert built(spark, some, field=3) == plain(some) and rounds


def test_empty_tables_and_turnless_conversations(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 0, "user", "a"), (alone, 1, "user", "b")]  # its family's first is absent, so no turn is left
    assert built(spark, rows) == plain(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_ids_are_hashed_in_chunks(spark, talks, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 7)
    assert built(spark, talks) == plain(talks)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_go_on_over_parts(spark, parts):
    """A group of nine tenths of the rows is spread over all parts."""
    r = random.Random(1)
    rows = [(r.choice([5] * 9 + [2, 8]), i, r.randrange(97), r.randrange(1000)) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, i long, a long, b long").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(g.k, g.i): g for g in tries.running(df, "k", ["i"], ["a", "b"], [(10, 97), None]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == 700
    seen = defaultdict(lambda: [0, 0, 0])
    for k, i, a, b in sorted(rows):
        n, x, y = seen[k]
        after = [n + 1, (x + a * pow(10, -(n + 1), 97)) % 97, y + b]
        g = got[k, i]
        assert [g.place, g.a_sum, g.b_sum, g.a_before, g.b_before] == [*after, x, y]
        seen[k] = after


def test_no_task_reads_a_whole_conversation(spark):
    """One conversation of all rows is dealt over the parts."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("i"), (F.col("id") % 5).alias("a"))
    done = tries.running(rows, "k", ["i"], ["a"], [None])
    sizes = [r["n"] for r in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2500
