import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.perfect_hash import SlotTable
from lakeloom.llm.prefix_trie import prefix_trie
from lakeloom.llm.registry import ORACLE, QUERIES

from .helpers import SF, spark_rows, sql_rows


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in "c d k n h s b len rep load band part1 x1 parent".split():
        df = df.withColumn(c, F.lit("clash"))
    return sorted((tuple(r) for r in prefix_trie(df, **kw).collect()), key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 2, 5, 12, 14])):
            rows.append((c, turn, r.choice(["user", "user", "assistant"]), r.choice(["hi", "hé", "hi", None, "b" * 20])))
    return rows


@pytest.mark.parametrize("shard_nodes, ratio", [(200_000, 1000), (40, 2), (3, 4)])
def test_random_conversations(spark, shard_nodes, ratio):
    rows = conversations(shard_nodes, 60)
    assert trie(spark, rows, shard_nodes=shard_nodes, ratio=ratio) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, "user", "tie b"), (7, 0, "user", "tie a"),
            (7, 0, "user", "tie a"), (12, 3, "user", "late"), (3, 0, "a", "bc"), (8, 0, "ab", "c"), (1_000_003, 0, "user", "y" * 300_000)]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(10)]
    rows += [(500, t, "user", str(t % 3)) for t in range(700)]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, shard_nodes=50, ratio=3) == brute(rows)


def test_empty_table(spark):
    assert trie(spark, [(None, 0, "user", "x")]) == []


def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        a, b = (r.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        t = SlotTable(a, b)
        assert sorted(t.slots.tolist()) == list(range(n))
        assert (t.find(a, b) == t.slots).all()
        assert (t.find(a, b + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_against_sql(spark):
    assert spark_rows(QUERIES["op13_prefix_trie"](spark, SF)) == sql_rows(ORACLE["op13_prefix_trie"])
