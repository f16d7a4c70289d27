import numpy as np
import pytest

from barloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target string"


def level(sizes, weights, most=3):
    """Targets by sharing again and again what is above a source's limit."""
    total, capped, out = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(most * sizes[k] for k in capped)
        free = [k for k in range(len(sizes)) if k not in capped]
        for k in range(len(sizes)):
            out[k] = most * sizes[k] if k in capped else left * weights[k] / sum(weights[j] for j in free)
        over = {k for k in free if out[k] > most * sizes[k] + 1e-9}
        if not over:
            return out
        capped |= over


def test_targets_and_taken_words(spark, shared, words):
    rng = np.random.default_rng(3)
    rows, names = [], ["b", "a", "ä", None, "hot", "tiny"]
    for k, n in enumerate([400, 300, 30, 200, 2600, 2]):
        rows += [(len(rows) + j, words(j + 1000 * k, int(rng.integers(1, 120))), names[k], "x", "y") for j in range(n)]
    rows += [(10**6, None, "a", "x", "y"), (10**6 + 1, "", "empty", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    source = {i: s for i, _, s, *_ in rows}
    sizes = {}
    for i, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, level([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["copies"] <= 3
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 120
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_the_number_of_documents_is_balanced_too():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 2000, 3000)
    p = np.full(3000, 0.37)
    mixing.flight(p, size, rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert p.sum() == pytest.approx(0.37 * 3000)
    assert (p * size).sum() == pytest.approx(0.37 * size.sum())
    mixing.landing(p, size, rng)
    assert set(np.unique(p)) <= {0.0, 1.0}
    assert abs((p * size).sum() - 0.37 * size.sum()) <= 2000


def test_equal_sizes_and_few_documents():
    for n in (1, 2, 3, 50):
        p, rng = np.full(n, 0.5), np.random.default_rng(n)
        mixing.flight(p, np.full(n, 7), rng)
        mixing.landing(p, np.full(n, 7), rng)
        assert abs(p.sum() - n / 2) <= 0.5


def test_taken_rows_and_empty_tables(spark, shared, words):
    rows = [(k, words(k, 20), "a" if k % 4 else "b", "x", "y") for k in range(60)] + [(3, words(3, 20), "a", "x", "y"), (None, "some words", None, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    out = mixing.taken(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
