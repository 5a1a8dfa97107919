"""The driver's tables in the roles of the engine: samples, scored pairs, votes, findings, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators.curation import content_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their content key; the text stays behind wherever the key is enough."""
    return table(spark, sf_dir, "documents").withColumn("key", content_key(F.col("text")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples: gold by parity of doc_id, pairs of neighbours, a score from the numbers of the row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    gold = F.when(F.col("doc_id") % 2 == 0, "vuln").otherwise("safe")
    raw = ((F.col("n_chars") * 31 + F.col("doc_id") * 17) % 1000).cast("double") / F.lit(1000.0)
    score = raw + F.when(F.col("doc_id") % 2 == 0, F.lit(0.125)).otherwise(F.lit(0.0))
    return d.select("*", F.expr("doc_id div 2").alias("pair_id"), gold.alias("gold"), score.alias("score"))


#: DuckDB's form of samples() and scored().
SAMPLES = "samples AS (SELECT *, sha1(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) AS key FROM documents)"
SCORED = (
    "scored AS (SELECT doc_id, lang, source, n_chars, doc_id // 2 AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'vuln' ELSE 'safe' END AS gold,"
    " CAST((n_chars * 31 + doc_id * 17) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) + CASE WHEN doc_id % 2 = 0 THEN CAST(0.125 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM documents)"
)
