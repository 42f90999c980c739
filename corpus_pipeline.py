"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet in the shared folder and read again. All but the last return the columns of
documents.

Null and empty texts are ordinary documents of one class: the one of smallest id stays. Of repeated
rows, and of rows with one id, one stays; of rows with a null id one of each set of shingles, since no id tells them apart. Other
columns, whatever their names, are carried along to the last stage. Empty tables give empty ones; without labels
of both classes nothing is rejected as toxic, without a benchmark nothing as leaked.

Personal data are permuted with the key in the setting ``lexmill.pii.key``, or with a random one of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, packing, pii, simhash, toxicity
from lexmill.llm.common import drop, saved, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier rejects."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate class."""
    return simhash.deduplicated(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms under the session's own key; n_chars follows where a text changed."""
    out = pii.pseudonymised(docs, pii.configured_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_values") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, connected components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)  # the input table itself is not ours and stays
    return docs
