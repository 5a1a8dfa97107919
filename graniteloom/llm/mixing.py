"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Sources get integer numbers of blocks by the highest quotients weight/(2k+1); inside a source, whole passes over it
come first and the rest is apportioned to hash shards of the source in the same way. In each shard the documents lie
in a seeded order, and the shard's quota is a run of blocks from a seeded start. No source is handled by one task:
only sums for each (source, shard) meet, and the order is made inside a shard. A source has a shard for every
SHARD_ROWS rows of the whole table, so shards do not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteloom.llm.common import documents, fields_of, kept, row_of, text_of, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
#: Least number of shards of a source, and rows of the whole table for each further one.
SHARDS, SHARD_ROWS = 256, 1 << 16
BLOCKS = 1 << 20
SEED = 20


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """parties with the integer column `out`: each group's `seats` dealt by the highest quotients weight/(2k+1).

    Ties go by `order`. Two divisors that surely give too few and too many seats leave about three quotients a party
    to be ranked, so the number of seats does not matter. Groups without weight get none.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(whole), F.sum(weight).over(whole)
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(0.0)
    bounded = (
        parties.withColumn("_n", n)
        .withColumn("_total", total)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2) + 0.5) - 1).cast("long"))
        .withColumn("_high", F.when(F.col(weight) > 0, F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    )
    keys = [*group, *order]
    ranked = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = ranked.orderBy(F.desc("_quotient"), *order)
    won = (
        bounded.where("_high > _low")
        .select(*keys, weight, "_open", F.explode(F.expr("sequence(_low, _high - 1)")).alias("_k"))
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .where("_rank <= _open")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        bounded.join(won, keys, "left")
        .withColumn(out, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long"))
        .drop("_n", "_total", "_low", "_high", "_open", "_won")
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """sources (_null, _src, source_size) with weight and target: all sizes shared by weight, each at most `most`
    times its source's size, the excess reshared until none is above.

    Sorted by the weight at which each source would be full, the full ones are a prefix, found with running sums.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy("_null", "_src")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sources.withColumn("weight", cycle).withColumn("_most", (F.col("source_size") * most).cast("double"))
    fill = one.orderBy(F.col("_most") / F.col("weight"), "_null", "_src")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    later = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(one) - F.coalesce(F.sum("_most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    return (
        named.withColumn("_level", level)
        .withColumn("_full", F.col("_most") <= F.col("_level") * F.col("weight"))
        .withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(one))
        .withColumn("target", F.when(F.col("_full"), F.col("_most")).otherwise(F.col("_level") * F.col("weight")))
        .drop("_level", "_most")
    )


def quotas(cells: DataFrame, blocks: int, weights: tuple[float, ...], most: int) -> DataFrame:
    """cells (_null, _src, _shard, _words) with source_size, target, _passes (over the whole source) and _rest (words)."""
    source = ["_null", "_src"]
    one = Window.partitionBy(F.lit(0))
    sources = targets(cells.groupBy(*source).agg(F.sum("_words").alias("source_size")), weights, most)
    sources = sources.withColumn("_all", F.sum("source_size").over(one)).withColumn("_block", F.greatest(F.lit(1), F.expr(f"_all div {blocks}")).cast("long"))
    sources = sources.withColumn("_seats_in", F.expr("_all div _block"))
    sources = sainte_lague(sources, [], source, "target", "_seats_in", "_seats")
    ceiling = F.col("source_size") * most
    words = F.when(F.col("_full"), ceiling).otherwise(F.least(F.col("_seats") * F.col("_block"), ceiling))
    sources = (
        sources.withColumn("_take", words.cast("long"))
        .withColumn("_passes", F.expr("CASE WHEN source_size > 0 THEN _take div source_size ELSE 0L END"))
        .withColumn("_left", F.col("_take") - F.col("_passes") * F.col("source_size"))
        .withColumn("_share", F.round(F.col("_left") / F.col("_block")).cast("long"))
        .select(*source, "source_size", "target", "_block", "_passes", "_share")
    )
    dealt = cells.join(sources, source).withColumn("_weight", F.col("_words").cast("double"))
    dealt = sainte_lague(dealt, source, ["_shard"], "_weight", "_share", "_quota")
    return dealt.withColumn("_rest", F.least(F.col("_quota") * F.col("_block"), F.col("_words"))).drop("_weight", "_share", "_quota")


def _place(seed: int, *parts: Column | str) -> Column:
    """60 bits of the MD5 digest of seed and parts, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def _laid(docs: DataFrame, row: Column, weights, most: int, shards: int | None, blocks: int, seed: int) -> DataFrame:
    """row, size, source_size, target, passes, head and tail of each row of docs."""
    shards = shards or max(SHARDS, -(-docs.count() // SHARD_ROWS))
    base = docs.select(
        row.alias("row"),
        word_count(text_of()).alias("size"),
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_src"),
        # Rows without an id of their own lie where their text puts them.
        _place(seed, F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of()))).alias("_at"),
        F.md5(text_of()).alias("_tie"),
    ).withColumn("_shard", F.pmod("_at", F.lit(shards)).cast("int"))
    base = written(base)
    cell = ["_null", "_src", "_shard"]
    quota = quotas(base.groupBy(*cell).agg(F.sum("size").alias("_words")), blocks, tuple(weights), most)
    order = Window.partitionBy(*cell).orderBy("_at", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = base.withColumn("_begin", F.sum("size").over(order) - F.col("size")).join(quota, cell)
    turn = F.pmod(_place(seed + 1, F.when(F.col("_null"), "null").otherwise("source"), "_src", F.col("_shard").cast("string")), F.greatest(F.lit(1), F.expr("_words div _block")))
    start = turn * F.col("_block")
    turned = laid.withColumn("_begin", F.when(F.col("_words") > 0, F.pmod(F.col("_begin") - start, F.nullif(F.col("_words"), F.lit(0)))).otherwise(0))
    # A row's words lie at [_begin, _begin + size), going on at 0 after _words; those below _rest are taken.
    head = F.greatest(F.lit(0), F.least(F.col("_rest") - F.col("_begin"), F.col("size")))
    tail = F.greatest(F.lit(0), F.least(F.col("_rest"), F.col("_begin") + F.col("size") - F.col("_words")))
    return turned.select("row", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("_passes").cast("long").alias("passes"), head.cast("long").alias("head"), tail.cast("long").alias("tail"))


def _taken() -> Column:
    return F.col("passes") * F.col("size") + F.col("head") + F.col("tail")


def plan(docs: DataFrame, keep: list[str], *, weights=WEIGHTS, most: int = MOST_TIMES, shards: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """keep, size, source_size, target and taken of each row.

    Sizes are words; a null or empty text has none and takes none. A null source is one source, after the others. Rows
    are told apart by their place in the table: a null or repeated doc_id is a row like any other, and of wholly equal
    rows either may be the one that is taken in part. An empty table gives an empty plan. A column of keep with the
    name of a result gives way to it.
    """
    made = ["size", "source_size", "target", "taken"]
    stay = kept(keep, *made)
    laid = _laid(docs, row_of(stay), weights, most, shards, blocks, seed)
    return laid.select(*fields_of("row", stay), "size", "source_size", "target", _taken().cast("long").alias("taken"))


def partial_text(text: Column, size: Column, head: Column, tail: Column) -> Column:
    """The first `head` and last `tail` words of a text, with the white space between words as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    chosen = F.filter(pieces, lambda _, i: (i < head) | (i >= size - tail))
    return F.when(head + tail >= size, text).otherwise(F.array_join(chosen, ""))


def mixed(docs: DataFrame, *, weights=WEIGHTS, most: int = MOST_TIMES, shards: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: each row once for each whole copy taken, and once with the words of its
    partial copy. Needs doc_id, source and text; n_chars follows the text if it is there. Null and repeated ids, odd
    texts and empty tables are as in plan(); other columns pass through whatever their names."""
    # Rows get a number that is written with them, so that the plan finds its row again whatever the ids are.
    body = written(docs.select(row_of(docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")))
    numbered = body.select(F.col("row").getField("doc_id").alias("doc_id"), F.col("row").getField("source").alias("source"), F.col("row").getField("text").alias("text"), "at")
    chosen = _laid(numbered, F.col("at"), weights, most, shards, blocks, seed).where(_taken() > 0)
    joined = body.join(chosen.select(F.col("row").alias("at"), "size", "passes", "head", "tail"), "at")
    copies = F.array_repeat(F.lit(True), F.col("passes").cast("int"))
    part = F.when(F.col("head") + F.col("tail") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    each = joined.withColumn("whole", F.explode(F.concat(copies, part)))
    given = F.col("row").getField("text")
    text = F.when(F.col("whole"), given).otherwise(partial_text(given, F.col("size"), F.col("head"), F.col("tail")))
    each = each.select("row", text.alias("new"))
    made = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return each.select(*(made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, its source's size and target, and the words taken, for every document."""
    return plan(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
