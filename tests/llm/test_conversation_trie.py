import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversation_trie
from panelspark.llm.conversation_trie import prefix_trie, split_locally
from panelspark.operators import blocks

SCHEMA = "conv_id long, turn long, role string, text string"


def borrowed(c):
    return zlib.crc32(str(c).encode()) % 9


def brute(rows, share):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 5, [])[: borrowed(c)] + own[c][borrowed(c) :] if share else own[c] for c in own}
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    total = collections.defaultdict(lambda: [0, 0])
    for p, m in members.items():
        for d in range(len(p) + 1):
            t = total[p[:d]]
            t[0] += kids[p] == 0
            t[1] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], *total[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, share, **more):
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("h1", F.lit(1)).repartition(3)
    c = F.col("conv_id")
    how = {"base": c - c % 5, "borrowed": F.crc32(c.cast("string")) % 9} if share else {}
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie(spark, turns, **how, **more).collect())


def conversations(seed, n=60, deep=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        for i in range(rng.randint(1, 14)):
            rows.append((c, i, rng.choice(["user", "bot"]), rng.choice("ab") if kind < 0.7 else f"é{rng.random()}"))
    for i in range(deep):
        rows += [(100, i, "user", f"t{i}"), (101, i, "user", f"t{i}" if i < deep // 2 else f"u{i}")]
    rows += [(70, None, None, None), (70, 3, "user", "x"), (70, 3, "user", "x"), (72, 0, "user", "only"), (None, 1, "user", "lost"), (74, 0, "", ""), (76, 0, "user", "x" * 200_000)]
    return rows


@pytest.mark.parametrize("share", [False, True])
def test_nodes_equal_brute_force(spark, share):
    rows = conversations(share)
    assert found(spark, rows, share) == brute(rows, share)


def test_distributed_splits_of_deep_and_bushy_components(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 60)
    rows = conversations(5, 40, deep=150)
    assert found(spark, rows, False, local=12) == brute(rows, False)


def test_no_conversation(spark):
    assert found(spark, [], True) == [] and found(spark, [(None, 1, "a", "b")], True) == []


def test_many_ends_of_one_node_go_through_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(300)] + [(c, 1, "bot", "more") for c in range(0, 300, 3)]
    assert found(spark, rows, False) == brute(rows, False)


@pytest.mark.parametrize("seed", range(4))
def test_local_splits_add_up_subtrees(seed):
    rng = np.random.default_rng(seed)
    n = 400
    up = np.array([-1 if i % 100 == 0 else i - 1 if seed == 1 else rng.integers(i - i % 100, i) for i in range(n)])
    top = np.arange(n) - np.arange(n) % 100
    values, want, weight = rng.integers(0, 9, (n, 2)), np.zeros((n, 2), int), np.zeros(n, int)
    for i in range(n):
        j = i
        while j >= 0:
            want[j] += values[i]
            weight[j] += 1
            j = up[j]
    assert (split_locally(up, weight, top, values) == want).all()
