"""A corpus from raw documents to packed sequences.

Each stage is one operator of rolegrain.llm over all that its predecessor kept.
Filtering stages return whole rows with every column of documents; the last
returns one row per packed piece. Models are fitted on the labelled rows of the
source tables in sf_dir, so that a stage judges alike whatever came before.

Defined results: null, empty and letterless texts have no language and go in the
first stage, and so do texts that score as none of the learned languages; very
long texts are taken whole by every stage; of near-duplicates, equal ones
included, the smallest doc_id stays, and of rows that repeat it the one with the
first text; rows with a null doc_id are never duplicates; an empty table stays
empty; extra columns, whatever their names, are carried along until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolegrain.llm import decontam, dedup, langid, packing, tokens, toxicity
from rolegrain.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as one of the learned languages (operator 9)."""
    return langid.known(docs, langid.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rated toxic (operator 3)."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic")
    return toxicity.civil(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates of 80 % and more (operator 5, whose own contract is 85)."""
    return dedup.representatives(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (operator 2)."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens (operator 6)."""
    return packing.pack(docs, tokens.default_path())


STAGES = [("language_id", language), ("toxicity", toxic), ("minhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: Trained classifiers can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(spark, docs)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
