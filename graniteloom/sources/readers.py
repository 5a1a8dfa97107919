"""Readers with explicit schemas: JSON lines, feeds, CSV, rule tables, source trees."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.operators.feeds import entries
from graniteloom.operators.rules import compiling

SAMPLE = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField(
            "meta",
            T.StructType([T.StructField(c, T.StringType()) for c in ("cve_id", "language", "lang_group", "cwe_id", "severity", "published_date", "label", "source", "pair_id")]),
        ),
    ]
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = SAMPLE, optional: bool = False) -> DataFrame:
    """Rows of JSON lines; lines that do not parse keep their text in _corrupt_record. With optional, a missing path
    gives an empty table."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], wide)
        raise


def feed(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Items of a document that is a list, or an envelope with `data` or `vulnerabilities`."""
    text = spark.read.option("wholetext", True).text(path)
    many = T.ArrayType(item)
    envelope = T.StructType([T.StructField("data", many), T.StructField("vulnerabilities", many)])
    parsed = F.from_json("value", envelope)
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    items = F.when(is_list, F.from_json("value", many)).otherwise(F.coalesce(parsed["data"], parsed["vulnerabilities"]))
    return text.select(F.inline(items))


def variant_feed(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry): the entries of the feed documents below a path as variants, so that files of several versions, and
    entries of several shapes in one file, are one table; see feeds.entry_fields(). Documents that do not parse have none."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.input_file_name().alias("path"), F.explode(entries(F.col("value"))).alias("entry"))


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, quoted cells of several lines, doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Rules of five to eight tab-separated columns; an empty or missing column is null, but for the endpoint, which is
    all_args of a sink and return of a source. Lines of fewer columns are left out."""
    parts = F.split("value", "\t", -1)
    names = ("role", "category", "cwe", "match", "pattern", "arg_pattern", "endpoint", "rule_id")
    rows = spark.read.text(path).where(F.size(parts) >= 5).select(*(F.nullif(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)))
    return rows.withColumn("endpoint", F.coalesce("endpoint", F.when(F.col("role") == "sink", "all_args").otherwise("return")))


def sanitizer_table(spark: SparkSession, path: str) -> DataFrame:
    """(category, applies_to, pattern) of lines `category TAB categories TAB pattern`: applies_to is a list of categories, *
    for all; the pattern may hold tabs. Lines without all three, and patterns that do not compile, are left out."""
    parts = F.split("value", "\t", 3)
    names = F.filter(F.transform(F.split(F.element_at(parts, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = spark.read.text(path).where(F.size(parts) == 3).select(F.element_at(parts, 1).alias("category"), names.alias("applies_to"), F.trim(F.element_at(parts, 3)).alias("pattern"))
    return compiling(rows.where((F.col("pattern") != "") & (F.size("applies_to") > 0)), "pattern").where("compiles").drop("compiles")


def propagation_table(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, moves) of lines `pattern TAB from,to;from,to`: a place is a number, or `return`, which is -1. Moves that do
    not read so are left out, and lines without any move that does."""
    parts = F.split("value", "\t", 2)

    def place(x):
        return F.when(F.trim(x) == "return", F.lit(-1)).otherwise(F.trim(x).try_cast("int"))

    pairs = F.filter(F.transform(F.split(F.element_at(parts, 2), ";"), lambda m: F.split(m, ",")), lambda m: F.size(m) == 2)
    moves = F.filter(F.transform(pairs, lambda m: F.struct(place(m[0]).alias("from"), place(m[1]).alias("to"))), lambda m: m["from"].isNotNull() & m["to"].isNotNull())
    return spark.read.text(path).where(F.size(parts) == 2).select(F.element_at(parts, 1).alias("pattern"), moves.alias("moves")).where(F.size("moves") > 0)


def source_tree(
    spark: SparkSession, path: str, glob: str = "*", excluded: str = r"/(node_modules|vendor|dist|build|test)/", most_bytes: int = 2_000_000, suffixes: tuple[str, ...] = (), without: tuple[str, ...] = ()
) -> DataFrame:
    """(path, content) of the files below a folder whose names match, and end in one of `suffixes` (if any are given) and
    in none of `without`; excluded folders and large files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    chosen = files.where((F.col("length") <= most_bytes) & ~F.col("path").rlike(excluded))
    for names, wanted in ((suffixes, True), (without, False)):
        if names:
            ends = F.exists(F.array(*(F.lit(s) for s in names)), lambda s: F.endswith(F.col("path"), s))
            chosen = chosen.where(ends if wanted else ~ends)
    return chosen.select("path", F.decode("content", "utf-8").alias("content"))


#: The tables of a program graph, as an exporter writes them.
PROGRAM = {
    "methods": "id long, name string, full_name string, file string, line_start int, line_end int, parent long",
    "calls": "id long, method long, name string, full_name string, file string, line int, code string",
    "args": "call long, position int, code string, literal boolean",
    "params": "method long, position int, name string",
    "edges": "a long, b long, kind string",
}


def program_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a program graph below a folder (one Parquet folder each); one that is not there is empty."""
    found = {}
    for name, schema in PROGRAM.items():
        try:
            found[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found[name] = spark.createDataFrame([], schema)
    return found


def scanned_lines(files: DataFrame, name: str = r"^[ -]*name: *(.*)$", value: str = r"^ +([a-z_]+): *(.*)$") -> DataFrame:
    """(path, name, key, value) of simple indented lists (path, content): a name holds for the values below it."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    found = F.nullif(F.regexp_extract("line", name, 1), F.lit(""))
    down = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lines.select("path", "line", found.alias("own"), F.last(found, ignorenulls=True).over(down).alias("name"))
    pairs = carried.where(F.col("own").isNull()).select("path", "name", F.regexp_extract("line", value, 1).alias("key"), F.regexp_extract("line", value, 2).alias("value"))
    return pairs.where("key <> ''")


def cached(cache: DataFrame, wanted: DataFrame, frontend: str, key: str, value: str) -> DataFrame:
    """wanted (frontend, key) with the value cached under "frontend:key", else under the key alone (an older form)."""
    known = cache.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    spaced = wanted.withColumn("_full", F.concat_ws(":", F.col(frontend), F.col(key)))
    one = spaced.join(known, F.col("_full") == F.col("_key"), "left").withColumn("_first", F.col("_value")).drop("_key", "_value")
    two = one.join(known, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce("_first", "_value"))
    return two.drop("_key", "_value", "_first", "_full")
