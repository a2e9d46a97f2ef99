"""One query per operator over its whole table, and SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlake.llm import oracles
from factlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op10_decontaminate": oracles.DECONTAMINATE,
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op13_grid_codes": oracles.GRID_CODES,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_ngram_jaccard(spark, sf_dir):
    from factlake.llm.ngram_jaccard_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_pii(spark, sf_dir):
    from factlake.llm.pii_boosting import find_personal_data, pii_digest

    return pii_digest(find_personal_data(table(spark, sf_dir, "documents")))


@query
def op7_secrets(spark, sf_dir):
    from factlake.llm.secret_ledger import scan_history, secret_digest

    return secret_digest(scan_history(table(spark, sf_dir, "documents")))


@query
def op10_decontaminate(spark, sf_dir):
    from factlake.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_packing(spark, sf_dir):
    from factlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op8_language(spark, sf_dir):
    from factlake.llm.language_ppm import predict_language

    return predict_language(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    from factlake.llm.toxicity_ftrl import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_collision_ann(spark, sf_dir):
    from factlake.llm.collision_ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op4_wrapper_induction(spark, sf_dir):
    from factlake.llm.wrapper_induction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op9_masked_lm(spark, sf_dir):
    from factlake.llm.masked_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query
def op13_grid_codes(spark, sf_dir):
    from factlake.llm.grid_codes import code_digest, learn_codebooks, write_codes

    embeddings = table(spark, sf_dir, "embeddings")
    codebooks = learn_codebooks(embeddings)
    return code_digest(write_codes(embeddings, codebooks), codebooks)


@query
def op12_quality_nbsvm(spark, sf_dir):
    from factlake.llm.quality_nbsvm import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_source_divergence(spark, sf_dir):
    from factlake.llm.source_divergence import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"))
