"""Spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

from barloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(x): x.lower() for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w, k in n.items():
        near = [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 5 * k else None
        out[w] = [form, None, k, len(near), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def found(spark, docs, **options):
    rows = spelling.variants(spark.createDataFrame(docs, "doc_id bigint, text string"), **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def corpus(seed: int, size: int, alphabet: str, longest: int):
    """Words with dense neighbourhoods: each an edit or two away from another, with skewed counts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.randint(6, longest))) for _ in range(size // 8)]
    while len(words) < size:
        w = rng.choice(words)
        i, kind = rng.randint(0, len(w)), rng.randint(0, 2)
        words.append(w[:i] + (rng.choice(alphabet) if kind else "") + w[i + (kind < 2) :])
    counts = [max(1, int(rng.paretovariate(0.6)) * 3) for _ in words]
    bag = [w for w, k in zip(words, counts, strict=True) for _ in range(min(k, 900))]
    rng.shuffle(bag)
    return [(i if i % 11 else None, rng.choice(" .-\n") .join(bag[at : at + 40])) for i, at in enumerate(range(0, len(bag), 40))]


def test_variants_are_those_of_brute_force(spark):
    for docs in (corpus(1, 400, "abcéß", 9), corpus(2, 300, "ABstr×ÿ", 14), corpus(3, 200, "ab", 8)):
        want = brute(docs)
        assert len(want) > 60 and any(x[0] for x in want.values()) and found(spark, docs) == want


def test_every_frequent_gram_and_a_full_dictionary_agree(spark):
    docs = corpus(4, 300, "abcd", 10)
    want = brute(docs)
    assert found(spark, docs, often=0) == want
    assert found(spark, docs, often=0, most=16) == want
    assert found(spark, docs, often=10**9) == want


def test_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (2, ""), (None, "x" * 5), (3, "ab" * 9)]) == {}
    long = "wort" * 500
    docs = [(i, long + "a" + " " + long) for i in range(6)] + [(i, long) for i in range(7, 40)] + [(7, "naïve1naïveté NAÏVETÉ naïveté")] * 4
    assert found(spark, docs) == brute(docs)
    clash = spark.createDataFrame([(1, "letter " * 9 + "lettre " * 5, "x")] * 2, "word bigint, n string, key string")
    rows = spelling.variants(clash, id_col="word", text_col="n").collect()
    assert {r.word: r.n for r in rows} == {w: x[2] for w, x in brute([(1, "letter " * 9 + "lettre " * 5)] * 2).items()}


def test_paths_of_forms_end_at_their_root(spark):
    docs = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdhg " * 125 + "abcihg " * 625 + "abjihg " * 3125)]
    got = found(spark, docs)
    assert got == brute(docs) and max(len(x[1]) for x in got.values()) == 6
