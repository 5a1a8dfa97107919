"""State of iterative operators, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that setCheckpointDir() named. Where neither is set, a local session (tests)
    gets a folder of its own; on a cluster that would be a different one on every machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """rows without their lineage, checkpointed in the shared folder, so that a round neither repeats the rounds before
    it nor depends on one executor."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame) -> DataFrame:
    """rows without their lineage, as a Parquet table in the shared folder: what cut() does, for rows of plain types that
    later rounds read often or by a few columns."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table._written_path = path
    return table


#: Spark's setting that shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(rows: DataFrame) -> DataFrame:
    """written(rows); the shuffle files of its query go as soon as it is written. The table itself goes with drop(), or when
    the application ends."""
    spark = rows.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        table = written(rows)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    system, folder = _folder(spark, table._written_path)
    system.deleteOnExit(folder)
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() or settled() made and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written_path", None)
        if path is None:
            file = table._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            path = file.get() if file.isDefined() else None
        if path is not None:
            system, folder = _folder(table.sparkSession, path)
            system.delete(folder, True)


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder
