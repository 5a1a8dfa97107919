"""Bounded graph searches over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteloom.operators.curation import rank_in_order
from graniteloom.operators.state import cut


#: What a name is resolved by, in this order.
PRECEDENCE = ("user_input", "static_import", "prop_flow", "alias")


def _precedence(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in PRECEDENCE)), kind)


def resolve(starts: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 8) -> DataFrame:
    """(id, verdict, source, steps, path): each start's way up the edges (node, up, kind) to a source (node, kind).

    A node that is a source ends the way, a user input before a static import; else its edge goes on, a property flow
    before an alias, the smallest `up` among equals. Verdict: the source's kind, "cycle" if a node comes again,
    "unknown" at a dead end or after `depth` steps. path: the nodes, from the start on. One recursive query; a way has
    one row a step, so it never widens.
    """
    spark = starts.sparkSession
    first = F.min(F.struct(_precedence(F.col("kind")), "kind"))["kind"]
    known = sources.groupBy(F.col("node").alias("here")).agg(first.alias("kind"))
    up = edges.groupBy(F.col("node").alias("here")).agg(F.min(F.struct(_precedence(F.col("kind")).alias("p"), "up"))["up"].alias("up"))
    step_of = cut(known.join(up, "here", "full"))
    ways = _recursive(
        spark,
        f"""WITH RECURSIVE way(id, at, path, steps) AS (
          SELECT id, node, array(node), 0 FROM {{starts}}
          UNION ALL SELECT id, up, concat(path, array(up)), steps + 1 FROM way JOIN {{step_of}} ON at = here
          WHERE kind IS NULL AND up IS NOT NULL AND steps < {int(depth)} AND NOT array_contains(path, up))
        SELECT id, at, path, steps FROM way""",
        starts=starts.select("id", "node"),
        step_of=step_of,
    )
    verdict = (
        F.when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.col("up").isNull() | (F.col("steps") == depth), F.lit("unknown"))
        .when(F.array_contains("path", F.col("up")), F.lit("cycle"))
    )
    ended = ways.join(step_of, F.col("at") == F.col("here"), "left").withColumn("verdict", verdict).where("verdict IS NOT NULL")
    return ended.select("id", "verdict", F.when(F.col("kind").isNotNull(), F.col("at")).alias("source"), "steps", "path")


def _recursive(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A recursive query over DataFrames. Its depth is bounded in the query, so Spark's own bound on rows is lifted."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(query, **frames)


#: Starts that share a row of a search: the bits of a long.
BITS = 64


def reach(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): every node within `depth` edges (a to b) of a start, by the fewest hops, the start at 0.

    BITS starts are one search, each a bit of a long. A round is one join; a node goes on only with the starts that reach
    it for the first time, so a round is bounded by the nodes of each search and not by ways or (start, node) pairs.
    """
    step_of = cut(edges.select("a", "b").distinct())
    ranked = rank_in_order(starts.select("node").distinct(), ["node"])
    numbered = cut(ranked.select("node", F.expr(f"(rank - 1) div {BITS}").alias("_set"), F.expr(f"CAST((rank - 1) % {BITS} AS int)").alias("_bit")))
    front = numbered.select("_set", "node", F.expr("shiftleft(1L, _bit)").alias("bits"))
    seen, found = front, front.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = front.select("_set", F.col("node").alias("a"), "bits").join(step_of, "a").groupBy("_set", F.col("b").alias("node")).agg(F.bit_or("bits").alias("bits"))
        # One table a round holds what was known and what is new of it.
        both = seen.select("_set", "node", F.col("bits").alias("_old"), F.lit(0).cast("long").alias("_new"))
        both = both.unionByName(step.select("_set", "node", F.lit(0).cast("long").alias("_old"), F.col("bits").alias("_new")))
        both = cut(both.groupBy("_set", "node").agg(F.bit_or("_old").alias("_old"), F.bit_or("_new").alias("_new")))
        front = both.select("_set", "node", F.expr("_new & ~_old").alias("bits")).where("bits <> 0")
        seen = both.select("_set", "node", F.expr("_new | _old").alias("bits"))
        found = found.unionByName(front.withColumn("hops", F.lit(hop)))
    each = found.select("_set", "node", "hops", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), i -> (shiftright(bits, i) & 1L) = 1L)")).alias("_bit"))
    return each.join(numbered.withColumnRenamed("node", "start"), ["_set", "_bit"]).select("start", "node", "hops")


#: Edges of a node beyond which it is a hub.
HUB = 1024


def neighborhood(starts: DataFrame, edges: DataFrame, hops: int = 2, most: int = 64, most_edges: int = 256) -> DataFrame:
    """(start, n_nodes, n_edges, truncated): the induced graph of the `most` nodes nearest each start (by hops, then
    node), with its first `most_edges` edges (a to b); truncated if either limit left something out.

    The limit holds hop by hop: a node's neighbours beyond the first 2 * most + 2 in order can never be among those
    chosen, so a hub is not expanded. A node's neighbours are one row, and so are the nodes chosen for a start; both are
    bounded, as only nodes of HUB edges or fewer are gathered before the limit is applied.
    """
    plain = edges.select("a", "b")
    both = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB).select("a"))
    none, first = hubs.isEmpty(), 2 * most + 2

    def gathered(rows: DataFrame) -> DataFrame:
        """(a, near): a null node, too, is a neighbour; collecting alone would drop it."""
        return rows.repartition("a").groupBy("a").agg(F.transform(F.collect_list(F.struct("b")), lambda x: x["b"]).alias("near"))

    beside = gathered(both if none else both.join(hubs, "a", "left_anti"))
    if not none:
        ranked = both.join(hubs, "a", "left_semi").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("a").orderBy("b")))
        beside = beside.unionByName(gathered(ranked.where(F.col("_at") <= first)))
    beside = cut(beside.select("a", F.slice(F.sort_array(F.array_distinct("near")), 1, first).alias("near")))
    seen = starts.select(F.col("node").alias("start")).distinct().withColumn("nodes", F.array(F.struct(F.lit(0).alias("hops"), F.col("start").alias("node"))))
    for hop in range(1, hops + 1):
        front = seen.select("start", F.explode(F.filter("nodes", lambda n: n["hops"] == hop - 1)).alias("_n")).select("start", F.col("_n.node").alias("a"))
        step = front.join(beside, "a").select("start", "near").repartition("start").groupBy("start").agg(F.flatten(F.collect_list("near")).alias("_step"))
        fresh = F.slice(F.sort_array(F.array_except("_step", F.transform("nodes", lambda n: n["node"]))), 1, most + 1)
        fresh = F.transform(fresh, lambda n: F.struct(F.lit(hop).alias("hops"), n.alias("node")))
        every = F.when(F.col("_step").isNull(), F.col("nodes")).otherwise(F.slice(F.concat("nodes", fresh), 1, most + 1))
        seen = cut(seen.join(step, "start", "left").select("start", every.alias("nodes")))
    chosen = F.transform(F.slice("nodes", 1, most), lambda n: n["node"])
    sets = seen.select("start", chosen.alias("nodes"), F.size("nodes").alias("_all"))
    nodes = sets.select("start", F.explode("nodes").alias("a"))
    # A node's edges meet the chosen ones; a hub meets the at most `most` nodes chosen beside it.
    out = gathered(plain if none else plain.join(hubs, "a", "left_anti")).withColumnRenamed("near", "out")
    among = F.size(F.array_intersect("out", F.array_compact("nodes"))).cast("long").alias("_e")
    inner = nodes.join(out, "a").select("start", "out").join(sets.select("start", "nodes"), "start").select("start", among)
    if not none:
        large = nodes.join(hubs, "a", "left_semi").join(nodes.withColumnRenamed("a", "b"), "start").join(plain.distinct(), ["a", "b"], "left_semi")
        inner = inner.unionByName(large.select("start", F.lit(1).cast("long").alias("_e")))
    counted = sets.select("start", F.size("nodes").cast("long").alias("n_nodes"), "_all").join(inner.groupBy("start").agg(F.sum("_e").alias("_e")), "start", "left")
    e = F.coalesce("_e", F.lit(0))
    return counted.select("start", "n_nodes", F.least(e, F.lit(most_edges)).alias("n_edges"), ((F.col("_all") > most) | (e > most_edges)).alias("truncated"))


def evidence_verdict(kinds: Column) -> Column:
    """tainted if any evidence is, else safe if any is, else unknown; kinds: an array column."""
    return F.when(F.array_contains(kinds, "tainted"), "tainted").when(F.array_contains(kinds, "safe"), "safe").otherwise("unknown")


def adjusted_risk(base: Column, verdict: Column) -> Column:
    """Fixed values: +0.9 tainted, -1.0 safe, -0.2 unknown, kept within 0 and 10."""
    step = F.when(verdict == "tainted", 0.9).when(verdict == "safe", -1.0).otherwise(-0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), base + step))


def overridden_edges(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """edges (a, b) with those out of the nodes that rules (a, b) speak of replaced by the rules'."""
    return edges.select("a", "b").join(rules.select("a").distinct(), "a", "left_anti").unionByName(rules.select("a", "b"))


def flows(sources: DataFrame, sinks: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """(source, sink, hops, path): for every source and sink (node) that a way of at most `depth` edges joins, the shortest
    one, the least among equals. A round is one join; a way goes on only from nodes that it reaches for the first time."""
    step_of = cut(edges.select("a", "b").distinct())
    seen = sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path")).distinct()
    front = seen
    for _ in range(depth):
        step = front.select("source", F.col("node").alias("a"), "path").join(step_of, "a").select("source", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path"))
        front = cut(fresh)
        seen = seen.unionByName(front)
    return seen.join(sinks.select("node").distinct(), "node").select("source", F.col("node").alias("sink"), (F.size("path") - 1).alias("hops"), "path")


def enclosing(nodes: DataFrame, parents: DataFrame, meets: Column, depth: int = 8) -> DataFrame:
    """(node, ancestor, levels): the nearest ancestor, the node itself included, for which `meets` (a column over the
    columns of parents: node, parent and more) holds; null after `depth` levels. parents has a row for every node."""
    step_of = cut(parents.select(F.col("node").alias("at"), "parent", F.coalesce(meets, F.lit(False)).alias("hit")))
    open_ = nodes.select("node", F.col("node").alias("at"))
    done = None
    for level in range(depth + 1):
        seen = cut(open_.join(step_of, "at", "left"))
        last = F.col("hit") | F.col("parent").isNull() | F.lit(level == depth)
        ended = seen.where(F.coalesce(last, F.lit(True))).select("node", F.when(F.col("hit"), F.col("at")).alias("ancestor"), F.lit(level).alias("levels"))
        done = ended if done is None else done.unionByName(ended)
        open_ = seen.where(~F.coalesce(last, F.lit(True))).select("node", F.col("parent").alias("at"))
    return done


def merged_graph(known: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Nodes or edges of both, one a key: what is known stays as it is, so merging again changes nothing."""
    fresh = new.join(known.select(*key), key, "left_anti")
    rest = [c for c in known.columns if c not in key]
    one = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else fresh.select(*key).distinct()
    return known.unionByName(one.select(*known.columns))
