"""The trie of conversation prefixes, against a plain trie of the same conversations and against SQL."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def plain_trie(rows):
    """The contract, by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def found_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


ODD = [
    (0, 1, "u", "first one"), (0, 2, "a", "then"), (0, 3, None, "more words here"), (0, 3, "a", None), (1, None, "u", "null turn"), (1, 1, "u", "first one"), (1, 2, "a", "then"),
    (20, 1, "u", ""), (21, 1, "u", "x"), (21, 1, "u", "x"), (22, 5, "u", "one"), (45, 1, "u", "no first of its family"), (46, 2, "a", "b"), (None, 1, "u", "no id"),
    (-3, 1, "u", "below zero"), (-20, 1, "u", "its first"), (61, 1, "u\x00", "v"), (61, 2, "u", "\x00v"), (62, 1, "a", " \t"), (63, 1, "u", "w " * 50_000),
]


@pytest.mark.parametrize("width", [2, 4096])
def test_odd_rows(spark, width):
    rows = spark.createDataFrame(ODD, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in ("k", "depth", "ha", "n", "words", "n_convs", "up_id")))
    assert found_of(prefix_trie.prefix_trie(rows.repartition(5), width)) == plain_trie(ODD)
    assert prefix_trie.prefix_trie(rows.limit(0)).count() == 0


def many(seed, n):
    """Conversations of families, with copies, shared first turns, chains in which each goes on from the last one, and a very long one with its copy."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        length = int(rng.integers(1, 6))
        for t in range(length):
            rows.append((c, t, "ua"[t % 2], "the same first turn" if t == 0 and rng.random() < 0.5 else f"text {rng.integers(0, 3)} of {t}"))
    for c in range(1000, 1040):
        rows += [(c, t, "u", f"chain {t} " * (t % 3)) for t in range(c - 999)]
    for c in (5001, 5002, 5003):
        rows += [(c, t, "u", f"long {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("width", [3, 50, 4096])
def test_many(spark, width, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEPTHS", 64)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = many(width, 150)
    assert found_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7), width)) == plain_trie(rows)


def test_a_conversation_over_many_tasks(spark):
    """Its turns are put in order by many tasks, each of which holds a part."""
    rows = [(41, t, "u", f"t {t}") for t in range(4000)] + [(42, t, "u", f"t {t}") for t in range(4000)] + [(c, 0, "u", "x") for c in range(40)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
        assert turns.filter("conv_id = 41").select("pid").distinct().count() > 1
        ranked = prefix_trie.ranked_turns(turns)
        assert sorted(r["k"] for r in ranked.filter("conv_id = 42").collect()) == list(range(1, 4001))
        sums = {c: {r["k"]: (r["ta"], r["tb"]) for r in ranked.filter(F.col("conv_id") == c).collect()} for c in (41, 42)}
        assert sums[41] == sums[42]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("seed", range(8))
def test_centroid_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    chance = (0.0, 0.02, 0.3)[seed % 3]
    parent = [-1 if v == 0 or rng.random() < chance else int(rng.integers(max(0, v - (2 if seed % 2 else n)), v)) for v in range(n)]
    values = [(int(rng.integers(0, 100)), 1) for _ in range(n)]
    expected = [list(v) for v in values]
    for v in reversed(range(n)):
        if parent[v] >= 0:
            expected[parent[v]] = [x + y for x, y in zip(expected[parent[v]], expected[v], strict=True)]
    assert prefix_trie.centroid_sums(parent, values) == expected


def test_long_path_is_halved():
    """A path of 20 000 nodes takes additions in n log n, not in its square."""
    n = 20_000
    assert prefix_trie.centroid_sums([*range(-1, n - 1)], [(1,)] * n)[:3] == [[n], [n - 1], [n - 2]]


def test_equals_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert found_of(prefix_trie.op12_prefix_trie(spark, "/root/testdata/sf0.01")) == sorted((tuple(r) for r in db.execute(prefix_trie.OP12_SQL).fetchall()), key=repr)
