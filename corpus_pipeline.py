"""A training corpus from raw documents, in stages that each build on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again for the next. All stages but the last return the columns of documents:

1. quality rules: documents that the learned decision list rejects go;
2. toxicity: documents that the classifier rejects go;
3. near duplicates: of documents linked by five-word shingles at a Jaccard similarity of 0.8
   or more, directly or through others, the one with the smallest doc_id stays;
4. secrets: what the forest judges a secret is replaced by a mark;
5. packing: the pieces of the documents and their places in training sequences.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import jaccard_join, packing, quality_rules, secrets, toxicity
from ledgerfold.llm.common import documents, stored

#: Words of a shingle and similarity in percent of near duplicates.
WORDS, PERCENT = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = toxicity.trained(docs, _labels(spark, sf_dir))
    rows = toxicity.scored(docs, weights, tuple(docs.columns), "_toxicity")
    return rows.where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, WORDS, PERCENT)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, "source" if "source" in docs.columns else None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no learned rules, classifier, forest or tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
