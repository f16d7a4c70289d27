"""The trie of conversations against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import pytest

from barloom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [x[1] for x in sorted(xs)] for c, xs in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]  # the rest has the sign of the id, as in SQL
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, who in members.items():
        bytes_ = len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * bytes_
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(who) if len(whole[c]) == len(node)).encode()).hexdigest())
        for node, who in members.items())


def found(spark, rows, **options):
    return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), **options).collect()))


def talk(seed: int, n: int):
    """Conversations that share hot beginnings, with copies, short ones and holes in the ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        same = rng.random() < 0.3
        for k in range(7 if same else rng.randint(1, 9)):
            text = "same" if same else rng.choice(["", "ja", "nein", "ü" * rng.randint(1, 4)])
            rows.append((c, k, "user" if k % 2 else None, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [4096, 40, 1])
def test_nodes_are_those_of_brute_force(spark, shared, container):
    rows = talk(container, 130)
    got = found(spark, rows, container=container)
    assert len(got) > 150 and got == brute(rows)


def test_edges(spark, shared):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    odd = [(0, None, None, None), (0, None, "a", "x"), (0, 2, "a", "x"), (0, 2, "a", "x"), (0, 2, "a", "b"), (7, 1, "a", None), (8, 5, "a", "x" * 5000)]
    assert found(spark, odd) == brute(odd)
    # id 3 has a beginning of 6 turns and no family to take it from: a member of the root alone
    assert found(spark, [(3, 0, "a", "x")]) == brute([(3, 0, "a", "x")])
    clash = spark.createDataFrame([(0, 1, "a", "x", 4, 5), (0, 0, "b", "y", 6, 7)], SCHEMA + ", s bigint, pos bigint")
    assert sorted(map(tuple, prefix_trie.trie(clash).collect())) == brute([(0, 1, "a", "x"), (0, 0, "b", "y")])


def test_long_conversations_cross_partitions_and_stretches(spark, shared, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, k, "a", f"t{k}") for c in (10, 11, 12, 13, 14, 20, 25) for k in range(150)] + talk(5, 20)
    assert found(spark, rows, container=30) == brute(rows)
