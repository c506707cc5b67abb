"""A corpus cleaned and mixed: five operators, one after the other, over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from consigna.llm import decontaminate, jaccard, mixing, pii, quality
from consigna.llm.common import ship, staged, table

#: No SQL: rules are learned, sets are compared by candidates, and copies are drawn by pairs. The stages
#: are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    ship(spark)
    return quality.keep_good(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least id."""
    ship(spark)
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced in the text."""
    ship(spark)
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document taken, with its number of copies."""
    ship(spark)
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, f"stage-{at}")
    return docs
