import random
import re

import pytest

from barloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, stratum string, n_words string, kept int"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "x\nx\n\n \n \nx", "é è é è é è é", "a|b # $ % & * < >", "a\x0bb\x0cc\rd", "tail\n", "\n\nhead", "same line\nsame line \nsame line",
    "日本 語　一 語", "w " * 3000, "\n".join(["repeat me now"] * 40), "a\x00b c", "a b a b a b a",
]


def test_counts_by_brute_force(spark, shared):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab \n|é") for _ in range(rng.randrange(200))) for _ in range(200)]
    rows = [(k, t, None, "x", "y", 1) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for r in quality.judged(spark.createDataFrame(rows, SCHEMA), labels).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def corpus(n=2400):
    """Good documents with few marks, bad ones with many; a stratum too small for itself and one without labels."""
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if bad:
            words = [w + "***" for w in words]
        rows.append((k, " ".join(words), rng.choice(["en", "en", "en", "fr"]) if k % 10 else "xx", "x", "y", 1))
        labels.append((k, 0 if bad else 1, 0))
    rows += [(n + k, " ".join(f"u{rng.randrange(10**6)}{'***' if k % 2 else ''}" for _ in range(60)), None, "x", "y", 1) for k in range(10)]
    return rows, labels


def test_bad_documents_go_and_good_ones_stay(spark, shared):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, marks, risk=0.2, least=300).collect()}
    assert all(got[i].kept == (q == 1) for i, q, _ in labels)
    assert [got[2400 + k].kept for k in range(10)] == [k % 2 == 0 for k in range(10)]  # the pooled cut-offs
    kept = quality.kept(docs, marks, risk=0.2, least=300)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_a_small_stratum_keeps_what_only_the_pool_certifies(spark, shared):
    rows, labels = corpus()
    rng = random.Random(3)
    rows += [(5000 + k, " ".join(f"v{rng.randrange(10**6)}***" for _ in range(60)), "sp", "x", "y", 1) for k in range(30)]
    labels += [(5000 + k, 1, 0) for k in range(30)]  # 30 good documents of some 2,000 with the habits of bad ones
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judged(docs, marks, risk=0.2, least=10**6).collect()}
    assert all(got[i] == (q == 1) for i, q, _ in labels)


def test_few_labels_reject_nothing(spark, shared):
    rows, labels = corpus(120)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert all(r.kept for r in quality.judged(docs, marks).collect())


def test_the_exact_tail():
    from math import comb

    for n, k, p in ((10, 0, 0.3), (10, 4, 0.3), (50, 7, 0.1), (5, 5, 0.9)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality._tail(n, k, p) == pytest.approx(want)
    assert quality._tail(10**6, 100, 0.01) == pytest.approx(0, abs=1e-12)


def test_the_risk_is_kept_on_fresh_documents():
    """Share of draws in which a certified cut-off rejects more good documents than it may."""
    import numpy as np
    import pandas as pd

    rng, broken, runs = np.random.default_rng(5), 0, 200
    risk = 0.05
    grid = quality.GRIDS["capitals"]
    choose = quality.certify(risk, 0.1)
    for _ in range(runs):
        x = rng.random(800)  # value of a good document; the true loss at a cut-off c is 1 - c
        steps = [int(sum(v <= c for c in grid)) for v in x]
        n = np.bincount(steps, minlength=len(grid) + 1)
        rows = pd.DataFrame({"stratum": "s", "rule": "capitals", "step": range(len(n)), "good": n, "bad": n * 100, "n_good": 800, "n_strata": 1})
        cutoff = choose(rows).cutoff[0]
        broken += not np.isnan(cutoff) and 1 - cutoff > risk / len(quality.GRIDS)
    assert broken <= 0.1 * runs


def test_conflicting_and_null_labels_and_repeated_rows(spark, shared):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en", "x", "y", 1), (1, text, "en", "x", "y", 1), (None, text, "en", "x", "y", 1)], SCHEMA)
    marks = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    assert [r.kept for r in quality.judged(docs, marks).collect()] == [True] * 3
    assert quality.kept(docs, marks).count() == 3
    assert quality.judged(docs.where("false"), marks).count() == 0
