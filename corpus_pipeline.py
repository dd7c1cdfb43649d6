"""documents -> language ID -> SimHash near-dedup -> decontamination -> mixing -> token-ID output.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs.  All but the last keep the columns of `documents`; the last has a row for each
document of the mix: doc_id, start, n_tokens, ids_crc32, read back from the packed files.  Those hold the
documents in the mix's order: its stage writes the rows in order of slots, and the last one keeps that order.

Near-dedup links fingerprints of 4 words' shingles at 4 bits, as the operator's query does, and texts
of a similarity of 0.8 or more in shingles of five words.

Defined results: documents with a null or empty text have no language and go in the first stage; null ids,
sources and labels are kept as they are; of repeated rows one stays; very long texts are read whole; an empty
table gives an empty result; other columns, whatever their names, are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import decontam, langid, mixing, simhash, token_pack
from quillstack.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, junk of letters, languages that no label has."""
    return langid.with_language(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id."""
    return simhash.without_copies(docs, similar=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item occur go."""
    return decontam.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources come near their targets; in the mix's order."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mix in Arrow files; a row for each document, read from them."""
    return token_pack.pack(docs, as_stored=True, words=token_pack.FEW_WORDS)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token-ID output", token_ids),
]
#: No stage but decontamination can be told in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
