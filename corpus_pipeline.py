"""The corpus pipeline: STAGES in order, each over what the one before kept.

Language ID (texts without a clear language go), n-gram Jaccard join (one document of each group of near copies stays), PII
(personal data is replaced), mixing sources to target weights (copies in training order), packing. A stage gets the documents as
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one; all but the last
return the columns of documents, whatever further columns there are. ``n_chars`` follows the text where a stage changes it.

Nulls, empty texts, repeated rows and empty tables: as each operator defines them. A null or letterless text has no language and
goes at the first stage; rows without doc_id pass the second one unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import jaccard, language_id, mixing, packing, pii
from listwright.llm.common import quoted, table
from listwright.session import prepare, stage

#: A text none of whose languages holds this share of its words is rejected.
LEAST_SHARE = 0.35


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.select(*(length.alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.identified(docs, language_id.learn(docs, F.lit(True)), LEAST_SHARE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(pii.redact(docs, pii.learn(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language ID", known_language), ("n-gram Jaccard join", without_near_copies), ("PII", without_personal_data), ("mixing sources", mixed), ("packing", packed)]
#: SQL can't express the models and the tokenizer; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
