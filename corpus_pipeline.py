"""The corpus pipeline: toxicity, quality, near-duplicates, mixing and encoding, one after the other.

Each stage's result is written as Parquet to the shared folder and reread as the next one's documents. Near-duplicates are
documents whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or by others: one of each group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import read, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from folioscope.llm.toxicity import fit, without_toxic

    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from folioscope.llm.quality import fit, without_bad

    return without_bad(docs, fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from folioscope.llm.near_copies import one_of_each

    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from folioscope.llm.mixing import mix

    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.bpe import with_ids

    return with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]
#: SQL can't express the classifiers nor the encoding; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
