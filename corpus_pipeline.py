"""A corpus pipeline of five stages over `documents`; every stage takes (spark, docs, sf_dir) and returns a DataFrame.

Toxic documents go, then exact copies, then near copies (five words, similarity 0.8), then personal data is masked in
the text; the last stage packs what is left into windows of 2048 ids.
"""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from tidemark.llm.io import materialise, table


def stage_toxicity(spark, docs, sf_dir):
    """docs without the toxic ones. Null and empty texts, rows without an id, repeats and columns of any name stay; without labels
    nothing goes; an empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_exact_dedup(spark, docs, sf_dir):
    """One row of each text, white space evened out: the smallest id, null ids last, of equal rows one. Null counts as empty; an
    empty table stays empty; all columns stay."""
    return exact_dedup.drop_exact_copies(docs)


def stage_jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies, the smallest id. Null and empty texts are linked with nothing; rows without an id
    and other rows of one id are documents of their own; an empty table stays empty; all columns stay."""
    return jaccard_join.drop_near_copies(docs)


def stage_pii(spark, docs, sf_dir):
    """docs with personal data masked in the text, and n_chars of the new text. Null texts stay null; no row goes; all columns stay."""
    return pii.redact_pii(docs)


def stage_packing(spark, docs, sf_dir):
    """A row per piece of a document in windows of 2048 ids. Null counts as empty, which is the closing id alone; repeated rows are
    packed each; an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("jaccard_join", stage_jaccard_join),
    ("pii", stage_pii),
    ("packing", stage_packing),
]


def run(spark, sf_dir):
    """The stages in order over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
