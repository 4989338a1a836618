"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. ``run`` writes each stage's rows to the shared folder and reads them back
as the next one's documents, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import ngram_jaccard, pow2_packing, quality_llr, template_decontam
from shelfscope.llm.queries import WORD_VOCABULARY
from shelfscope.llm.tables import read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the likelihood ratio rejects."""
    model = quality_llr.fit(docs, read(spark, sf_dir, "labels"))
    return quality_llr.judged(docs, model, carry=tuple(docs.columns)).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return template_decontam.cleaned(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each a sequence, with their ids."""
    return pow2_packing.packed(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Boosted counts, MinHash pruning and tokenisation have no SQL form; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
