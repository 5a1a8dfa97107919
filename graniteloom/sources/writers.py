"""Sinks: split JSON lines, report tables, rule files, vector points, logs that go on, idempotent upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators.curation import rank_in_order
from graniteloom.operators.graphs import merged_graph
from graniteloom.operators.retrieval import knn


def json_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    rows.write.partitionBy(split).mode("overwrite").json(path)


def csv_report(rows: DataFrame, path: str) -> None:
    """A comparison table with a header; quotes inside cells are doubled."""
    rows.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def json_report(metrics: DataFrame, path: str) -> None:
    """One JSON object a row, nulls included."""
    metrics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def rule_lines(rules: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """One tab-separated line a rule; nulls are empty, and empty columns stay. The columns of extra follow only in rows
    that have a value in one of them."""
    line = F.concat_ws("\t", *(_cell(F.col(c)) for c in columns))
    if extra:
        more = F.concat_ws("\t", *(_cell(F.col(c)) for c in extra))
        line = F.when(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in extra)).isNotNull(), F.concat(line, F.lit("\t"), more)).otherwise(line)
    return rules.select(line.alias("value"))


def sanitizer_lines(rules: DataFrame) -> DataFrame:
    """category, comma-joined applies_to (* if there is none) and pattern as lines of a sanitizer file."""
    applies = F.coalesce(F.nullif(F.array_join("applies_to", ","), F.lit("")), F.lit("*"))
    return rules.select(F.concat_ws("\t", _cell(F.col("category")), applies, F.col("pattern")).alias("value"))


def propagation_lines(rules: DataFrame) -> DataFrame:
    """pattern and its moves (from, to; -1 is the return value) as lines of a propagation file."""

    def place(p: Column) -> Column:
        return F.when(p == -1, "return").otherwise(p.cast("string"))

    moves = F.array_join(F.transform("moves", lambda m: F.concat_ws(",", place(m["from"]), place(m["to"]))), ";")
    return rules.select(F.concat_ws("\t", F.col("pattern"), moves).alias("value"))


def vector_points(vectors: DataFrame, order: list[str], path: str) -> DataFrame:
    """vectors written with integer ids 0, 1, ... in a stated order, as the table that is read back."""
    rank_in_order(vectors, order, "id").withColumn("id", F.col("id") - 1).write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def verified(loaded: DataFrame, expected: int, probes: DataFrame, k: int = 1) -> DataFrame:
    """One row that tells whether a load of points (id, vector) holds: `expected` rows, unique ids, and every probe (id,
    vector) finds itself first."""
    counts = loaded.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
    found = knn(probes, loaded, k).where("rank = 1").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("q") == F.col("id")).alias("hits"))
    holds = (F.col("rows") == expected) & (F.col("ids") == F.col("rows")) & (F.col("hits") == F.col("probes"))
    return counts.join(found).withColumn("holds", holds)


def insert_if_absent(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """known and the rows of new whose keys it lacks; new keys that come twice keep one row, the least."""
    return merged_graph(known, new, keys)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the log at path lacks, and returns how many there were: a run that was stopped is
    simply run again."""
    spark: SparkSession = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = None
    fresh = rows if done is None else rows.join(done, keys, "left_anti")
    before = 0 if done is None else done.count()
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).select(*keys).distinct().count() - before
