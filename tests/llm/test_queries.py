"""The registered queries of the corpus operators, run as they are."""

from __future__ import annotations

import pytest

import corpus_pipeline
from plumeworks.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_decontamination": "doc_id item_id edits",
    "op3_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_toxicity": "doc_id expected_severity",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_html_text": "page_id url text n_chars",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_embedding_dedup": "vec_id n_links component_id kept",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_gives_its_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    n = got.count()
    if name == "op7_html_text":
        assert n == spark.read.parquet(f"{SF}/pages.parquet").count()
    elif name == "op11_embedding_dedup":
        assert n == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif name in ("op2_decontamination", "op12_hard_negatives"):
        assert n > 0
    elif name == "op10_packing":
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
    else:
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.where("false") if name == empty else rows.limit(60)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() == 0) == (empty == "documents")
