"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

run() writes each stage's result as Parquet into the folder that driver and executors share and reads
it again as the next stage's documents.

Null, empty and wordless texts fail the quality rules. Rows without an id are judged and cleaned like
others, aren't compared with others as near duplicates, and are mixed and packed. Repeated rows, and rows
that share an id, stay together through all stages. Null sources are one source. Texts of any length are
read whole. Further columns pass through to the stage before the last, whatever their names. An empty table
gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import jaccard, lines, mixing, packing, quality
from trailmark.llm.common import materialize, table
from trailmark.llm.queries import PACKED_BY, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy lets pass."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of three lines and more that came before; emptied ones go."""
    return lines.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that is linked by similar shingles."""
    return jaccard.keep_first(docs, width=5, share=80, of=100)


def mixing_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file(PACKED_BY))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_by_source),
    ("packing", packed_sequences),
]

#: Token ids can't be had in SQL; tests/llm/test_pipeline_run.py compares run() with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
