"""Context-tree weighting against a sequential tree, and the base score against plain counts."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import pytest

from barloom.llm import context_tree

LOWER = {ord(x): x.lower() for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DEPTH = context_tree.DEPTH


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def plus(x, y):
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


class Tree:
    """The weighted tree of every decision, node by node."""

    def __init__(self, texts):
        self.counts = collections.defaultdict(lambda: [0, 0])
        self.below = collections.defaultdict(set)
        for text in texts:
            for context, prefix, bit in self.decisions(text):
                for d in range(DEPTH + 1):
                    self.counts[context[:d], prefix][bit] += 1
                    if d:
                        self.below[context[: d - 1], prefix].add((context[:d], prefix))
        self.weights = {}
        for node in sorted(self.counts, key=lambda x: -len(x[0])):
            own = kt(*self.counts[node])
            self.weights[node] = own if len(node[0]) == DEPTH else plus(own, sum(self.weights[x] for x in self.below[node])) - math.log(2)

    @staticmethod
    def decisions(text):
        data = b"\xff" * DEPTH + text.translate(LOWER).encode() + b"\xff"
        for i in range(DEPTH, len(data)):
            for k in range(8):
                yield data[i - DEPTH : i][::-1], (256 | data[i]) >> (8 - k), data[i] >> (7 - k) & 1

    def log10(self, text):
        total = 0.0
        for context, prefix, bit in self.decisions(text):
            p, left = 0.0, 1.0
            for d in range(DEPTH + 1):
                node = context[:d], prefix
                n = self.counts.get(node, [0, 0])
                share = 1.0 if d == DEPTH else math.exp(kt(*n) - self.weights[node]) / 2 if node in self.weights else 0.5
                p += left * share * (n[bit] + 0.5) / (sum(n) + 1)
                left *= 1 - share
            total += math.log10(p)
        return total


def brute(docs):
    words = {i: re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [None] for i, (_, text) in enumerate(docs)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    counts = collections.Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    tree = Tree([text or "" for i, (_, text) in enumerate(docs) if not held[i]])
    return [
        (d, held[i], len(words[i]), sum(counts[w] > 0 for w in words[i]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]), tree.log10(text or ""))
        for i, (d, text) in enumerate(docs)
    ]


def check(spark, docs, **options):
    got = [tuple(r) for r in context_tree.scored(spark.createDataFrame(docs, "doc_id bigint, text string"), **options).collect()]
    want = brute(docs)
    order = lambda x: (x[0] is None, x[0] or 0, round(x[6], 2))
    got.sort(key=order)
    want.sort(key=order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4, abs=1e-3)
    return want


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "cat", "Über", "naïve", "sat", "on", "A", "mat", "日本"]
    return [(i, rng.choice(["", " ", "\n"]).join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(n)]


def test_scores_are_those_of_a_whole_tree(spark, shared):
    want = check(spark, corpus(1, 60))
    assert 0 < sum(x[1] for x in want) < 60


def test_texts_are_cut_into_pieces_without_a_trace(spark, shared):
    check(spark, [*corpus(2, 30), (100, "long " * 40 + "unbroken" * 20 + " end " + "x" * 70)], block=64)


def test_edges(spark, shared):
    assert context_tree.scored(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    check(spark, [(None, None), (1, ""), (1, ""), (2, "A a"), (2, "A a"), (3, None), (None, "b")])
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = check(spark, [(held, "nothing to learn from")])
    assert only[0][3:6] == (0, 0, 0.0)
    clash = spark.createDataFrame([(7, "x y", 1, 2)], "doc_id bigint, text string, row bigint, kind int")
    assert [tuple(r)[:3] for r in context_tree.scored(clash).collect()] == [tuple(brute([(7, "x y")])[0][:3])]
