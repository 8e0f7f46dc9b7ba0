"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import exact_dedup, filter_audit, fingerprints, jaccard_join, language, packing, pii, quality, sentence_pieces, token_counts, toxicity, vector_codes, vector_search
from tidemark.llm.io import table


PIECES, WORD_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def op1_sentencepiece(spark, sf_dir):
    return sentence_pieces.encoding_report(table(spark, sf_dir, "documents"), PIECES)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_report(table(spark, sf_dir, "documents"), PIECES)


def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.language_report(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_top_k(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_exact_dedup,
        op3_token_counts,
        op4_packing,
        op5_fingerprints,
        op6_jaccard_join,
        op7_pii,
        op8_language,
        op9_quality,
        op10_toxicity,
        op11_filter_audit,
        op12_top_k,
        op13_vector_codes,
    )
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_top_k": vector_search.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
