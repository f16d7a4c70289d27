import random

import pytest

import corpus_pipeline
from barloom import session
from barloom.llm import mixing, ngram_join, pii, quality, queries
from tests.llm.test_encoding import check_packed


@pytest.fixture
def folder(spark, shared, tmp_path, words):
    rng = random.Random(11)
    rows = []
    for k in range(300):
        text = words(k, rng.randrange(20, 160), 10**6)
        if k % 9 == 0:
            text += " write to some.one@mail.example.com or +1 (555) 555-0100"
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    for k in range(60):
        text = rows[k * 3][1] + (" tail" if k % 2 else "")
        rows.append((300 + k, text, "en", None, len(text)))
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (None, words(5000, 90), "en", "s1", 5)]
    path = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_order_and_their_effects(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "best_fit"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        rows = docs.collect()
        if name != "best_fit":
            assert docs.columns == columns
        own = [r.doc_id for r in rows]
        if name == "quality_rules":
            assert set(own) == {i for i, r in before.items() if len((r.text or "").split()) >= 50}
        elif name == "near_duplicates":
            low = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(list(before.values()), docs.schema), n=5, percent=80).collect()}
            assert sorted(own, key=str) == sorted([i for i, c in low.items() if i == c], key=str)
            assert len(own) < len(before)
        elif name == "personal_data":
            assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {i: (pii.masked_text(r.text), len(pii.masked_text(r.text))) for i, r in before.items()}
            assert not any("@" in r.text for r in rows)
        elif name == "source_mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            assert sorted(own, key=str) == sorted([i for i, c in copies.items() for _ in range(c)], key=str)
        else:
            check_packed(rows, 2048)
        seen[name] = len(rows)
    held = len(session.copies(spark))
    assert corpus_pipeline.run(spark, folder).count() == seen["best_fit"]
    # one table per stage that ends before the last, and what the last one reads, are left
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session.copies(spark)[held:]]
    assert names == [n for n, _ in corpus_pipeline.STAGES[:-1]] + ["pieces"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_give_a_row_per_document(spark, folder, name):
    if name == "op10_html_main":
        spark.createDataFrame([(1, "u", "<p>x</p>"), (None, None, None)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
        assert queries.QUERIES[name](spark, folder).count() == 2
        return
    if name == "op12_prefix_trie":
        spark.createDataFrame([(1, 0, "user", "x"), (None, None, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        assert {r.depth for r in queries.QUERIES[name](spark, folder).collect()} <= {0, 1}
        return
    got = queries.QUERIES[name](spark, folder)
    if name == "op13_spelling":
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        return
    assert "doc_id" in got.columns
    n = got.count() if name not in ("op5_token_counts", "op9_packing") else got.select("doc_id").distinct().count()
    assert n == 363
