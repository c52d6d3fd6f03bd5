"""The operators and the pipeline as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import decontaminate, exact_dedup, infill, language, licenses, line_dedup, mixing, pii, secrets, sharding, simhash, toxicity, tries
from kinetable.llm.oracle import SQL  # noqa: F401  (registered next to QUERIES)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, folder, "documents")))


@query
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no path: they are laid out as source/language/hundred of ids.

    The first document of a hundred is called LICENSE, so that it speaks for its folder if it
    states a licence; all others are plain files.
    """
    docs = table(spark, folder, "documents")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    place = F.concat_ws("/", "source", F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string"))
    place = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source", F.col("lang"))).otherwise(place)
    files = docs.select(F.col("doc_id").alias("file"), F.concat_ws("/", place, name).alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("file", "doc_id")


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"))


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, folder, "documents")))


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


@query
def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(table(spark, folder, "documents")))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.trie(table(spark, folder, "conversations"))


@query
def op13_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.languages(docs, language.fit(docs))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
