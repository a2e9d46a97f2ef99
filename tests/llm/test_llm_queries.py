"""Each query over sf0.001 against a plain version, an exact round trip or held-out accuracy."""

import zlib

import duckdb
import numpy as np
import pytest
from brute_models import components
from brute_native import contamination, pii, secrets
from conftest import SF

from factlake.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def run(spark):
    from factlake.session import ship_package

    ship_package(spark)
    return lambda name: QUERIES[name](spark, SF).toPandas()


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_ngram_jaccard(run, documents):
    got = run("op1_ngram_jaccard")
    want = components([(d, t) for d, t, _ in documents])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert got["component_id"].nunique() < len(got)


def test_packing_round_trip(run, documents):
    from tokenizers import Tokenizer

    from factlake.llm.packing import default_tokenizer

    got = run("op2_packing")
    tokenizer = Tokenizer.from_file(default_tokenizer())
    for doc_id, text, _ in documents:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        pieces = got[got["doc_id"] == doc_id].sort_values("start")
        at = 0
        for p in pieces.itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at:at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert (sequence["offset"] == sequence["length"].cumsum().shift(fill_value=0)).all()
        assert sequence["length"].sum() <= 2048
    sizes = got.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.01 * sizes.sum()


def test_toxicity(run, spark):
    got = run("op3_toxicity").set_index("doc_id")
    assert got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_generalises(spark):
    from factlake.llm.common import table
    from factlake.llm.toxicity_ftrl import score_toxicity

    sf = "/root/testdata/sf0.1"
    got = score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").df().set_index("doc_id")["toxic"]
    known = got.join(labels, how="inner")
    held, learnt = known[known["held_out"]], known[~known["held_out"]]
    assert (learnt["predicted"] == learnt["toxic"]).mean() > 0.95
    assert held.loc[held["toxic"] == 1, "predicted"].mean() > 0.7
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.01


def test_main_text(run):
    import html
    import re

    got = run("op4_wrapper_induction").set_index("page_id")
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    for page_id, page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S).group(1)
        blocks = [
            " ".join(html.unescape(re.sub("<[^>]*(>|$)", " " if "br" in b else "", b)).split())
            for b in re.split(r"</?(?:p|h1)>", inner)
        ]
        assert got.loc[page_id, "text"] == "\n\n".join(b for b in blocks if b)
        assert got.loc[page_id, "n_chars"] == len(got.loc[page_id, "text"])


def test_neighbours(run):
    got = run("op5_collision_ann")
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    hits = asked = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(order) + 1))
        assert np.allclose(mine["score"], scores[np.searchsorted(ids, mine["vec_id"])], atol=1e-12, rtol=0)
        hits += len(set(mine["vec_id"]) & set(ids[order]))
        asked += len(order)
    assert hits >= 0.9 * asked


def _same(got, want):
    for row in got.to_dict("records"):
        expected = want[row["doc_id"]]
        assert {k: row[k] for k in expected} == expected


def test_pii(run, documents):
    got = run("op6_pii")
    assert len(got) == len(documents)
    _same(got, {d: pii(t) for d, t, _ in documents})


def test_secrets(run, documents):
    got = run("op7_secrets")
    assert len(got) == len(documents)
    _same(got, {d: secrets(t) for d, t, _ in documents})


def test_language(run, documents):
    got = run("op8_language").set_index("doc_id")
    right = [got.loc[d, "lang_pred"] == lang for d, _, lang in documents if lang and got.loc[d, "held_out"]]
    assert np.mean(right) > 0.95
    assert got["score"].between(0, 1).all()


def test_masked_lm(run, documents):
    got = run("op9_masked_lm")
    assert len(got) == len(documents)
    words = got["n_words"].sum()
    # Better than a guess among all ids.
    assert got["log_likelihood"].sum() / words > -np.log(1024)
    assert (got["log_likelihood"] <= 0).all()


def test_decontamination(run, documents):
    got = run("op10_decontaminate")
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(contamination([(d, t) for d, t, _ in documents], bench))
    assert sorted(map(tuple, got[names].itertuples(index=False))) == want
    assert got["contaminated"].any()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        from factlake.session import materialize

        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["near_duplicates"]
    groups = components(list(zip(before["doc_id"], before["text"], strict=True)), 5, 80)
    assert sorted(after["doc_id"]) == sorted({c for _, c in groups.values()})
    before, after = seen["decontamination"]
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    clean = [r[0] for r in contamination(list(zip(before["doc_id"], before["text"], strict=True)), bench) if not r[5]]
    assert sorted(after["doc_id"]) == sorted(clean)
    before, after = seen["secrets"]
    assert sorted(after["doc_id"]) == sorted(before["doc_id"])
    for text, chars in zip(after["text"], after["n_chars"], strict=True):
        assert sum(secrets(text)[f"n_{k}"] for k in ("assign", "access", "hex")) == 0
        assert chars == len(text)
    untouched = before.merge(after, on="doc_id")
    for row in untouched.itertuples():
        if not any(secrets(row.text_x)[f"n_{k}"] for k in ("assign", "access", "hex")):
            assert row.text_x == row.text_y
    before, after = seen["packing"]
    assert set(after["doc_id"]) == set(before["doc_id"])
    assert (after["length"] == after["ids"].map(len)).all()
