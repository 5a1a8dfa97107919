"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring is cut into a fixed number of cells, and each cell into strips by a second hash. A first pass sums the load of
each strip (a table of bounded size, whatever the input); walking the ring once over the cells' sums gives every shard
the stretches it holds: a cell's rows go to the shard of the next virtual node, and what a full shard cannot take
continues clockwise. A second pass ranks the rows inside their strip and looks the stretch up in that table, whose size
is bounded by cells + shards. The strips keep rows of one key, unless they are wholly equal, from meeting in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteloom.llm.common import documents, fields_of, kept, row_of, text_of, written

CELL_BITS = 14
STRIPS = 16
VIRTUAL_NODES = 64
LAWS = ("rows", "bytes")


def virtual_nodes(shards: int, per_shard: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. A shard's nodes depend on its number alone, so a shard more
    only adds nodes."""
    found = []
    for shard in range(shards):
        for copy in range(per_shard):
            digest = hashlib.sha256(f"{shard}/{copy}".encode()).digest()
            found.append((int.from_bytes(digest[:8], "big") >> (64 - cell_bits), shard))
    return sorted(found)


def stretches(loads: dict[int, int], shards: int, nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, shard, from, to) in units of load, from the load of each cell.

    Each shard takes total/shards (integers that differ by one at most), so all end full. Keys earlier on the ring
    come first.
    """
    total = sum(loads.values())
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    following = list(range(len(nodes) + 1))  # of each node, the first one at or after it that has room

    def next_open(at: int) -> int:
        path = []
        while True:
            if at == len(nodes):
                at = len(nodes)
                break
            if following[at] != at:
                path.append(at)
                at = following[at]
            elif room[nodes[at][1]] == 0:
                following[at] = at + 1
                path.append(at)
                at += 1
            else:
                break
        for p in path:
            following[p] = at
        return at

    out, node = [], 0
    for cell in sorted(loads):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        begin, end = 0, loads[cell]
        while begin < end:
            at = next_open(node)
            at = next_open(0) if at == len(nodes) else at
            shard = nodes[at][1]
            take = min(end - begin, room[shard])
            out.append((cell, shard, begin, begin + take))
            room[shard] -= take
            begin += take
    return out


def _offsets(pieces: list[tuple[int, int, int, int]], counts: list[int]) -> list[int]:
    """The first slot of each stretch within its shard."""
    filled: dict[int, int] = {}
    out = []
    for (_, shard, _, _), n in zip(pieces, counts, strict=True):
        out.append(filled.get(shard, 0))
        filled[shard] = out[-1] + n
    return out


def _values(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A small table of integers, as literal rows of the plan."""
    text = ";".join(",".join(map(str, row)) for row in rows)
    cells = F.transform(F.split(F.lit(text), ";"), lambda r: F.transform(F.split(r, ","), lambda v: v.cast("long")))
    return spark.range(1).select(F.explode(cells).alias("r")).select(*(F.col("r")[i].alias(n) for i, n in enumerate(names)))


def shard_rows(rows: DataFrame, key: str, size: str, shards: int, law: str = "rows", *, tie: list[str] | None = None) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard); columns of those names give way.

    law "rows": the shards' row counts differ by one at most. law "bytes": the sums of `size` (positive integers)
    differ by no more than about two rows' sizes. Rows with equal keys are told apart by `tie`; wholly equal rows
    are interchangeable. A null key is a key of its own. An empty table gives an empty one.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    spark = rows.sparkSession
    stay = kept(rows.columns, "shard", "slot")
    base = rows.select(row_of(stay).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("long").alias("size"), F.xxhash64(*(f"`{c}`" for c in (key, *(tie or [])))).alias("tie"))
    placed = base.withColumn("cell", F.shiftrightunsigned(F.xxhash64("key"), 64 - CELL_BITS)).withColumn("strip", F.pmod("tie", F.lit(STRIPS)))
    strips = written(placed.groupBy("cell", "strip").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    loads = {r["cell"]: int(r["load"]) for r in strips.groupBy("cell").agg(F.sum("n" if law == "rows" else "bytes").alias("load")).collect()}
    pieces = stretches(loads, shards, virtual_nodes(shards))
    if not pieces:
        return rows.select(*stay, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    order = Window.partitionBy("cell", "strip").orderBy("tie", "key", "size")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("cell").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = strips.select("cell", "strip", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in (("n", "_rank"), ("bytes", "_load"))))
    ranked = placed.withColumns({"rank": F.row_number().over(order) - 1, "load": F.sum("size").over(before) - F.col("size")}).join(F.broadcast(starts), ["cell", "strip"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("_rank")).withColumn("begin", F.col("rank") if law == "rows" else F.col("load") + F.col("_load"))

    def with_piece(extra: list[int]) -> DataFrame:
        table = _values(spark, [(i, c, s, b, e, x) for i, ((c, s, b, e), x) in enumerate(zip(pieces, extra, strict=True))], ["piece", "_cell", "shard", "_from", "_to", "_extra"])
        inside = (F.col("cell") == F.col("_cell")) & (F.col("begin") >= F.col("_from")) & (F.col("begin") < F.col("_to"))
        return ranked.join(F.broadcast(table), inside)

    def shown(found: DataFrame, slot: Column) -> DataFrame:
        return found.select(*fields_of("row", stay), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))

    if law == "rows":
        return shown(with_piece(_offsets(pieces, [e - b for _, _, b, e in pieces])), F.col("_extra") + F.col("rank") - F.col("_from"))
    seen = {r["piece"]: r for r in with_piece([0] * len(pieces)).groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).collect()}
    counts = [seen[i]["n"] if i in seen else 0 for i in range(len(pieces))]
    begins = [o - (seen[i]["first"] if i in seen else 0) for i, o in enumerate(_offsets(pieces, counts))]
    return shown(with_piece(begins), F.col("_extra") + F.col("rank"))


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 16 for its frame."""
    return (F.octet_length(text) + 16).cast("long")


def shard_documents(docs: DataFrame, shards: int = 40, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs; a null text counts as empty. Null and repeated ids are
    keys like any other; other columns are left out. An empty table gives an empty one."""
    sized = docs.select("doc_id", document_size(text_of()).alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return shard_rows(sized, "doc_id", "size", shards, law, tie=["text_crc32", "size"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law "rows"."""
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
