"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from pagemill.llm import bpe, collocations, exact_dedup, langid, lm, packing, periods, quality, shards, simhash, suffix, topk, warc
from pagemill.llm.common import read_table

QUERIES = {}
ORACLE = {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql.strip()


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(digest):
    return lambda spark, d: digest(read_table(spark, d, "documents"))


register("op1_suffix_dedup", documents(suffix.digest))
register("op2_bpe", documents(lambda docs: bpe.digest(docs, tokenizer())))
register("op3_quality", lambda spark, d: quality.digest(read_table(spark, d, "documents"), read_table(spark, d, "labels")))
register("op4_topk", lambda spark, d: topk.digest(read_table(spark, d, "embeddings")), topk.ORACLE_SQL)
register("op5_packing", documents(lambda docs: packing.digest(docs, tokenizer())))
register("op6_langid", documents(langid.digest))
register("op7_shards", documents(lambda docs: shards.digest(docs, tokenizer())))
register("op8_lm", documents(lambda docs: lm.digest(docs, order=3)))
register("op9_exact_dedup", documents(exact_dedup.digest), exact_dedup.ORACLE_SQL)
register("op10_simhash", documents(simhash.digest))
register("op12_periods", documents(periods.digest))
register("op13_collocations", documents(collocations.collocations), collocations.ORACLE_SQL)
register("op11_warc", lambda spark, d: warc.digest(read_table(spark, d, "pages")), warc.ORACLE_SQL)
