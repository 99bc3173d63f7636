"""Corpus preparation: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import exact_dedup, packing, quality, simhash, suffix
from pagemill.llm.common import materialise, read_table

#: (name, function of spark, docs and sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("suffix-array dedup", suffix.stage),
    ("best-fit packing", packing.stage),
]

#: Learned scores, token ids and repeated byte strings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to all of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
