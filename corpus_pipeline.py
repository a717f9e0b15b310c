"""The corpus pipeline: language ID, quality classifier, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's rows to the folder
that the cluster shares and reads them again for the next one; what a stage leaves there beside its rows goes with its end, and its rows
once the next one has read them.

Defined cases: a row whose text is null, empty or without a letter is rejected by the first stage; a null lang, source or n_chars counts as
the operators say; rows without doc_id are never copies but of equal texts, and are packed; of repeated rows one stays; of copies the one of
the smallest doc_id stays; texts of any length are read whole; ties go as the operators say; an empty table gives an empty result; further
columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushgrid.llm import exact_dedup, langid, minhash, packing, quality_fm
from hushgrid.llm.common import discard, materialise, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("quality_classifier", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("best_fit_packing", pack)]

#: SQL can express neither the trained models nor the greedy packing; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            kept = materialise(stage(spark, docs, sf_dir), scoped=False)
        discard(spark, [docs])
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
