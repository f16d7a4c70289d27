import random
import re

import pytest

from barloom.llm import ngram_join

SCHEMA = "doc_id bigint, text string, source string, component_id string, size int"


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n=4, percent=85):
    """{set: component} by comparing every pair."""
    nodes = {}
    for i, text, *_ in rows:
        own = shingles(text, n)
        if i is not None and own:
            nodes[own] = min(i, nodes.get(own, i))
    parent = {s: s for s in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(nodes)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(a)] = root(b)
    low = {}
    for s, i in nodes.items():
        low[root(s)] = min(i, low.get(root(s), i))
    return {s: low[root(s)] for s in nodes}


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(words, seed=1, group=40):
    rng = random.Random(seed)
    texts = [words(k, rng.choice([3, 7, 12, 30, 80, 200])) for k in range(60)]
    passage = words(999, 60)
    texts += [f"{words(500 + k, 20)} {passage}" for k in range(45)]  # a passage that many share
    texts += [f"{words(700 + k, 6)} {passage}" for k in range(45)]  # documents of little else
    base = words(77, 300)
    texts += [edited(base, rng, rng.choice([1, 2, 3, 5, 8])) for _ in range(group)]  # a large group of near copies
    for k in range(20):
        texts += [edited(texts[k], rng, 1) for _ in range(rng.randrange(4))]
    chain = words(88, 250)
    for _ in range(12):  # each near the one before it only
        chain = edited(chain, rng, 3)
        texts.append(chain)
    texts += [texts[3]] * 40 + [texts[5].upper(), "  " + texts[6].replace(" ", "\n\t ") + "\n"]
    texts += [None, "", " \n\t ", "one", "ONE", "one two", "one two three", "ONE two  three"]
    rng.shuffle(texts)
    return [(i * 3, t, "s", "c", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"rare": 4}, {"rare": 2, "most_frequent": 40}])
def test_every_component_as_by_brute_force(spark, shared, words, options):
    rows = corpus(words)
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        own = shingles(text)
        assert got[i].n_shingles == len(own)
        assert got[i].component_id == (want[own] if own else i)


@pytest.mark.parametrize(("n", "percent", "options"), [(5, 80, {}), (4, 50, {}), (5, 80, {"rare": 2}), (4, 50, {"rare": 1})])
def test_small_sets_and_lower_similarities(spark, shared, words, n, percent, options):
    rng = random.Random(percent)
    texts = [words(k, rng.randrange(1, 14), vocabulary=30) for k in range(40)]
    for k in range(160):
        own = rng.choice(texts).split()
        own = own[rng.randrange(3) :] + [f"w{rng.randrange(30)}" for _ in range(rng.randrange(3))]
        texts.append(" ".join(own) or "one")
    rows = [(i, t, "s", "c", 1) for i, t in enumerate(texts)] + corpus(words, seed=2, group=8)[:60]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA), n=n, percent=percent, **options).collect()}
    want = brute(rows, n, percent)
    assert len(set(want.values())) < len(want) - 20
    assert got == {r[0]: want[shingles(r[1], n)] if shingles(r[1], n) else r[0] for r in rows}


def test_blocks_of_a_long_list(spark, shared, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rows = corpus(words, seed=5)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA), rare=4).collect()}
    want = brute(rows)
    assert got == {r[0]: want[shingles(r[1])] if shingles(r[1]) else r[0] for r in rows}


def test_null_ids_repeated_rows_and_empty_tables(spark, shared, words):
    text = words(1, 60)
    rows = [(None, text, "s", "c", 1), (5, text, "s", "c", 1), (5, text, "s", "c", 1), (2, text + " end", None, None, None), (7, None, "s", "c", 1)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, None), (5, 2), (5, 2), (2, 2), (7, 7)], key=str)
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [2, 7, None]
    assert kept[0].asDict().keys() == dict.fromkeys(["doc_id", "text", "source", "component_id", "size"]).keys()
    assert ngram_join.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blobs_keep_their_values():
    import numpy as np

    values = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 5000))
    values[10:20] = values[10]
    assert (ngram_join._unpacked(ngram_join._packed(np.sort(values))) == np.sort(values)).all()


def test_a_long_list_may_cross_batches():
    import numpy as np
    import pyarrow as pa

    sig = np.array([1] * 3 + [2] * 50 + [3] * 2, np.int64)
    key = np.arange(len(sig), dtype=np.int64)
    size = np.full(len(sig), 10, np.int32)
    table = pa.record_batch([pa.array(sig), pa.array(key), pa.array(size)], ["sig", "k1", "size"])
    for step in (1, 7, 60):
        parts = list(ngram_join._list_pairs(85, 8)(iter([table.slice(a, step) for a in range(0, len(table), step)])))
        rows = [r for p in parts for r in p.to_pylist()]
        pairs = {(r["a"], r["b"]) for r in rows if r["sig"] is None}
        assert pairs == {(0, 1), (0, 2), (1, 2), (53, 54)}
        assert sorted(r["a"] for r in rows if r["sig"] is not None) == list(range(3, 53))
