"""The thin queries of the corpus operators, with their DuckDB twins."""

from __future__ import annotations

from pulsegrid.llm import exact_dedup, html_text, language_id, lz_fingerprint, media, merkle, mixing, ngram_join, packing, ranked_search, substring_dedup, token_files, toxicity
from pulsegrid.llm.common import table


def op2_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries():
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_mix": op2_mix, "op3_ngram_join": ngram_join.op3_ngram_join, "op4_pack": packing.op4_pack, "op5_token_files": token_files.op5_token_files, "op6_media": media.op6_media, "op7_toxicity": toxicity.op7_toxicity, "op8_language_id": language_id.op8_language_id, "op9_exact_dedup": op9_exact_dedup, "op10_html_text": html_text.op10_html_text,
        "op11_merkle": merkle.op11_merkle, "op12_lz_fingerprints": lz_fingerprint.op12_lz_fingerprints, "op13_search": ranked_search.op13_search}


def oracle_sql():
    """SQL where it can express the operator at whole size; the tests compare the others with brute force."""
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op2_mix": mixing.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_merkle": merkle.ORACLE, "op13_search": ranked_search.ORACLE}
