"""What the operators of this subpackage share: tables, words, arrays, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators.state import shared_dir

#: White space of the word definition; every other character belongs to a word.
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Paths that the open scopes below have written, the innermost last.
_scopes: list[list[str]] = []


def _path(df: DataFrame) -> str | None:
    return getattr(df, "_written_path", None)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's setting that shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors cost nothing.

    Shuffle files of the query go when it has been written: nothing reads them any more. The table's own files go with
    the scope they are written in (see Scratch), with forget(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = _path(df)
        if path is not None:
            _delete(df.sparkSession, path)
            for scope in _scopes:
                if path in scope:
                    scope.remove(path)


class Scratch:
    """A scope whose written tables go at its end, but for those that keep() names. What leaves the scope must be read
    from these alone: then no table is deleted that a lost executor's work could still need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.paths: list[str] = []
        _scopes.append(self.paths)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written if it is not yet, stays after the scope."""
        df = df if _path(df) else written(df)
        self.paths.remove(_path(df))
        if len(_scopes) > 1:
            _scopes[-2].append(_path(df))
        return df

    def __exit__(self, *_: object) -> None:
        _scopes.pop()
        for path in self.paths:
            _delete(self.spark, path)


def kept(keep: list[str], *made: str) -> list[str]:
    """The columns of keep that do not have the name of a result column: a result replaces what has its name."""
    taken = {m.lower() for m in made}
    return [c for c in keep if c.lower() not in taken]


def row_of(columns: list[str]) -> Column:
    """columns as one struct, so that no name of theirs can meet one of an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(True).alias("_"))


def fields_of(row: str, columns: list[str]) -> list[Column]:
    """The columns that row_of() packed."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sums of an array of numbers (or what another associative `join` makes of them).

    Each of log2(n) steps adds what stands 1, 2, 4, ... places before, so a long array costs n log n.
    """
    steps = F.sequence(F.lit(0), F.length(F.bin((F.size(values) - 1).cast("long"))) - 1)

    def step(a: Column, k: Column) -> Column:
        return F.transform(a, lambda v, i: let(F.get(a, i - F.pow(F.lit(2), k).cast("int")), lambda w: F.when(w.isNull(), v).otherwise(join(w, v))))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, step))


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words [^ \\t-\\r]+ of a text, as an array of strings."""
    flat = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def word_count(text: Column) -> Column:
    """Number of words [^ \\t-\\r]+ of a text: the ends of the runs, counted without cutting the text up."""
    flat = F.concat(F.translate(text, SPACES, " " * len(SPACES)), F.lit(" "))
    return F.regexp_count(flat, F.lit("[^ ] ")).cast("long")
