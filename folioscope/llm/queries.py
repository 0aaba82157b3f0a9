"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import oracles
from folioscope.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {"op11_resampling": oracles.resampling_sql(), "op12_repeats": oracles.repeats_sql(), "op13_clusters": oracles.clusters_sql()}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.toxicity import fit, score_texts

    docs = read(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, read(spark, sf_dir, "labels")))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.quality import fit, score_texts

    docs = read(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, read(spark, sf_dir, "labels")))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.mixing import plan

    return plan(read(spark, sf_dir, "documents"))


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.ann import search

    return search(read(spark, sf_dir, "embeddings"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.media import document_media

    return document_media(read(spark, sf_dir, "documents"))


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.chat import assemble, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(extra)
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    return read_back(assemble(rows, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.resampling import resample

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.repeats import without_repeats

    return without_repeats(read(spark, sf_dir, "documents"))


@query
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.clusters import cluster

    return cluster(read(spark, sf_dir, "embeddings"))
