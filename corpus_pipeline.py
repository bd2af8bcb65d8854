"""A corpus from raw documents to tokens, stage by stage.

Every stage reads all rows that the one before it kept, and its result is written as Parquet in the
shared folder and read again. All stages but the last return the columns of ``documents``.

1. ``quality_rules`` drops documents that the base rule or the fitted trees reject.
2. ``near_dedup`` keeps one document of each group of near-copies, linked by SimHash fingerprints of
   their shingles of three words that differ in two bits at most: the one with the least id; of
   rows with that id, one.
3. ``secret_scan`` replaces every secret by a mark.
4. ``mix_sources`` repeats and cuts documents, so that sources have the words of their targets. A
   document has one row per pass that takes words of it; the text of a row is the taken stretches,
   joined by line feeds.
5. ``encode`` gives token numbers, and whether they decode to the text.

A null text counts as empty in all stages. Sources, languages and extra columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.llm import bpe, mixing, rules, secrets, simhash
from refsieve.llm.common import table
from refsieve.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trees = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.kept_documents(docs, trees)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return simhash.one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their secrets; ``n_chars`` follows the text."""
    return _measured(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mix takes, a row per pass."""
    return _measured(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, tokens, n_tokens, exact``: tokens of every text, and whether they give it back."""
    content = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded_rows(docs, content, public_tokenizers.PATTERN)


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` counted anew where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# Trees, fingerprints and tokens are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"corpus-{i + 1}")
    return docs
