"""Repeated ids with other texts, letters whose case depends on their place, clashing names, empty stages."""

import pytest
from test_llm_cases import frame

import corpus_pipeline

BENCH = "item_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from factlake.session import ship_package

    ship_package(spark)


def test_rows_of_one_id_are_one_document(spark):
    from factlake.llm.ngram_jaccard_join import ngram_jaccard_components

    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    c = " ".join(f"c{i}" for i in range(40))
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (8, c), (9, c + " end"), (9, "of its own set here"), (4, None), (4, "")]
    got = ngram_jaccard_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (4, 4)}


def test_capital_sigma(spark):
    from factlake.llm.decontaminate import contamination

    docs = frame(spark, [(1, "ΑΣ.Α ΒΓ. ΓΔ ΔΕ ΕΖ ΖΗ ΗΘ ΘΙ ΙΚ"), (2, "ας α"), (3, "AΣ.A KK")])
    items = spark.createDataFrame([(1, "ΑΣ Α ΒΓ ΓΔ ΔΕ ΕΖ ΖΗ ΗΘ ΘΙ ΙΚ"), (2, "ΑΣ.Α")], BENCH)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, items).collect()}
    assert got == {1: (10, 10, 2, True), 2: (2, 0, 0, False), 3: (3, 0, 0, False)}


NAMES = ("row_key", "hit_row", "secret_blob", "secret_spans", "kept_id", "row", "blob", "found", "path", "component_id")


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame(
        [(1, "a text without anything", "en", "s", 23), (2, "password = abcdefgh12345", "en", "s", 24)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        docs = docs.selectExpr("*", f"doc_id + 100 AS {name}")
    from factlake.llm.decontaminate import clean_documents
    from factlake.llm.ngram_jaccard_join import one_of_each_group
    from factlake.llm.secret_ledger import redact_history

    items = spark.createDataFrame([(1, "nothing like it")], BENCH)
    for stage in (one_of_each_group, lambda d: clean_documents(d, items), redact_history):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) == {1, 2}
        assert all(rows[i][name] == i + 100 for i in rows for name in NAMES)
    assert "abcdefgh12345" not in rows[2].text and rows[1].text == "a text without anything"


def test_stages_of_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, "an item of a few words")], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
