"""N-gram Jaccard join by signature trees.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Documents meet in
groups by the shingles of their prefixes (in one global order, linked sets share a shingle of their first fifth); the
order puts frequent shingles last, so a passage that many documents hold gathers nobody. Each group is a signature
tree: size classes, blocks of a class, small nodes, documents. Nodes hold OR-combined bitmaps of shingles and size
ranges; dual traversal drops node pairs whose largest possible overlap is too small, and pairs that are connected
already. Surviving pairs are checked exactly.

Before that, sets that cannot have a partner are put aside: a linked set shares at least a tenth of its size within
its first three tenths, and four fifths of its shingles in all. Equal sets are one. Nothing is capped: large groups are split into blocks, and the block
pairs of one group are as many tasks as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteloom.llm.common import Scratch, documents, fields_of, forget, row_of, written
from graniteloom.llm.components import components
from graniteloom.llm.shingles import set_key, shingle_sets

#: Frequent shingles that the order knows (a bound on what is broadcast), and shingles counted at a time.
FREQUENT, COUNTED = 1 << 18, 2_000_000
#: Most bytes of candidate ids (16 each) that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Documents of a block, shingles of a block, children of a tree node, bits of a signature.
BLOCK_DOCS, BLOCK_SHINGLES, FANOUT, BITS = 256, 1 << 18, 8, 1024


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Order:
    """The global order of shingles: those not known as frequent by hash, then the others by frequency."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.counts = tokens[at], counts[at]

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if len(self.tokens) == 0:
            return np.zeros(len(s), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)

    def prefix(self, s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `length` shingles of the sorted set s, and their frequencies."""
        f = self.frequency(s)
        at = np.lexsort((s, f))[:length]
        return s[at], f[at]


def _scan(docs: DataFrame) -> DataFrame:
    """Rows (id, n, k1, k2) of every document, and rows (token, count) of shingles found in two or more distinct sets
    of one stretch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(kept) if kept else np.zeros(0, np.uint64), return_counts=True)
            token, count = _signed(token[count > 1]), count[count > 1]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token), pa.array(count.astype(np.int64))], names)

        for batch in batches:
            n, a, b = [], [], []
            for _, s in shingle_sets(batch.column(1)):
                key = set_key(s)
                n.append(len(s))
                a.append(key[0])
                b.append(key[1])
                if len(s) and key[0] not in seen:
                    seen.add(key[0])
                    kept.append(s)
                    size += len(s)
                    if size >= COUNTED:
                        yield counted()
                        seen, kept, size = set(), [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], names)
        yield counted()

    names = ["id", "n", "k1", "k2", "token", "count"]
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _shared(docs: DataFrame, order) -> DataFrame:
    """Rows (k, token) of the shingles in the first three tenths of two or more sets, and rows (k, lacks): how many
    such shingles the set needs beside those known as frequent (which other sets hold for sure)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        prefix = Order(*order.value).prefix
        for batch in batches:
            tokens, keys, lacks = [], [], []
            for _, s in shingle_sets(batch.column(1)):
                if len(s) == 0 or (k := set_key(s)[0]) in seen:
                    continue
                seen.add(k)
                spare = len(s) // 10
                t, f = prefix(s, len(s) // 5 + 1 + spare)
                plain = t[f == 0]
                tokens.append(np.append(plain, np.array([k], dtype=np.int64).view(np.uint64)))
                keys.append(np.full(len(plain) + 1, k, dtype=np.int64))
                lacks.append(np.append(np.full(len(plain), -1), max(0, max(1, spare) - (len(t) - len(plain)))))
            if tokens:
                lack = pa.array(np.concatenate(lacks).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), pa.array(np.concatenate(keys)), lack], ["token", "k", "lacks"])

    rows = docs.mapInArrow(run, "token long, k long, lacks int")
    one = Window.partitionBy("token")
    return rows.withColumn("_lo", F.min("k").over(one)).withColumn("_hi", F.max("k").over(one)).where("lacks >= 0 OR _lo <> _hi").select("k", "token", "lacks")


def _candidates(docs: DataFrame, first: DataFrame, order) -> DataFrame:
    """Rows (id, n, s): the sorted shingles of one document of each set that may have a partner."""
    shared = written(_shared(docs, order))
    able = shared.groupBy("k").agg(F.max("lacks").alias("lacks"), F.count_distinct(F.when(F.col("lacks") < 0, F.col("token"))).alias("have"))
    able = able.where("have >= lacks").select(F.col("k").alias("k1"))
    reps = first.where("token IS NULL AND n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"))
    ids = written(reps.join(able, "k1").select(F.col("id").alias("_id")).distinct())
    forget(shared)
    chosen = docs.join(F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids, F.col("id") == F.col("_id")).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for at, s in shingle_sets(batch.column(1)):
                ids.append(at)
                sets.append(_signed(s))
                size += len(s)
                if size >= COUNTED:
                    yield packed(batch, ids, sets)
                    ids, sets, size = [], [], 0
            yield packed(batch, ids, sets)

    def packed(batch: pa.RecordBatch, ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "s"])

    able = written(chosen.mapInArrow(run, "id long, s array<long>").select("id", F.size("s").cast("long").alias("n"), "s"))
    # Of these, a linked set shares four fifths of all its shingles with others. Those known as frequent surely are
    # shared, and are counted where they lie: only the others, which few sets hold, meet by shingle.

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = Order(*order.value).frequency
        for batch in batches:
            ids, sizes, known, tokens = [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                plain = s[frequency(s) == 0]
                # One row more, without a partner for sure, keeps sets whose shingles are all frequent.
                tokens.append(np.append(plain, np.array([i], dtype=np.int64).view(np.uint64)))
                ids.append(np.full(len(plain) + 1, i, dtype=np.int64))
                sizes.append(np.full(len(plain) + 1, len(s), dtype=np.int64))
                known.append(np.append(np.full(len(plain), -1), len(s) - len(plain)))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), *(pa.array(np.concatenate(x)) for x in (ids, sizes, known))], ["token", "id", "n", "known"])

    each = able.select("id", "s").mapInArrow(rare, "token long, id long, n long, known long")
    one = Window.partitionBy("token")
    held = each.withColumn("_lo", F.min("id").over(one)).withColumn("_hi", F.max("id").over(one)).where("known >= 0 OR _lo <> _hi")
    have = F.count_if(F.col("known") < 0) + F.max(F.greatest("known", F.lit(0)))
    kept = held.groupBy("id", "n").agg(have.alias("have")).where("5 * have >= 4 * n").select("id")
    out = written(able.join(kept, "id"))
    forget(able, ids)
    return out


def _members(candidates: DataFrame, order) -> DataFrame:
    """Rows (token, id, n, c): the groups of two or more candidates by prefix shingle, c members each. Of groups with
    the same members one is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = Order(*order.value).prefix
        for batch in batches:
            tokens, ids, sizes = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                t, _ = prefix(s, len(s) // 5 + 1)
                tokens.append(_signed(t))
                ids.append(np.full(len(t), i, dtype=np.int64))
                sizes.append(np.full(len(t), len(s), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, ids, sizes)], ["token", "id", "n"])

    rows = written(candidates.select("id", "s").mapInArrow(run, "token long, id long, n long"))
    groups = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = groups.where("c > 1").groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token", "c")
    out = written(rows.join(kept, "token"))
    forget(rows)
    return out


class Forest:
    """Disjoint sets of rows."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(int(v), i) for i, v in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of BITS bits, and how many shingles of each set share a bit with another of it."""
    bits = np.zeros((len(sets), BITS), dtype=bool)
    for row, s in zip(bits, sets, strict=True):
        row[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64), np.array([len(s) for s in sets]) - bits.sum(1)


def surviving_pairs(sets: list[np.ndarray], sides: np.ndarray | None = None) -> np.ndarray:
    """Row pairs (i < j) that dual traversal of the signature tree over sets leaves, for the threshold 9 o >= 4 (a + b)
    (that is 100 o >= 80 u). sides: only pairs of unlike sides are wanted."""
    n = np.array([len(s) for s in sets])
    bitmap, excess = signatures(sets)
    levels = [(bitmap, excess, n, n)]
    while len(levels[-1][0]) > 1:
        b, e, lo, hi = levels[-1]
        at = np.arange(0, len(b), FANOUT)
        levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.maximum.reduceat(e, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
    pairs = np.zeros((1, 2), dtype=np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        b, e, lo, hi = levels[depth]
        if depth < len(levels) - 1:
            child = np.arange(FANOUT)
            left = (pairs[:, 0, None, None] * FANOUT + child[None, :, None]).repeat(FANOUT, 2).ravel()
            right = (pairs[:, 1, None, None] * FANOUT + child[None, None, :]).repeat(FANOUT, 1).ravel()
            ok = (left < len(b)) & (right < len(b)) & (left <= right)
            pairs = np.stack([left[ok], right[ok]], 1)
        kept = []
        for part in np.array_split(pairs, max(1, len(pairs) // 65536)):
            i, j = part[:, 0], part[:, 1]
            most = np.bitwise_count(b[i] & b[j]).sum(1, dtype=np.int64) + np.minimum(e[i], e[j])
            most = np.minimum(most, np.minimum(hi[i], hi[j]))
            near = (5 * hi[i] >= 4 * lo[j]) & (5 * hi[j] >= 4 * lo[i])
            kept.append(part[near & (9 * most >= 4 * (lo[i] + lo[j]))])
        pairs = np.concatenate(kept)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    if sides is not None:
        pairs = pairs[sides[pairs[:, 0]] != sides[pairs[:, 1]]]
    return pairs


def links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Linked pairs of ids that join all that links connect; rows with one label are connected already."""
    forest, out = Forest(labels), []
    for i, j in surviving_pairs(sets, sides).tolist():
        a, b = forest.find(i), forest.find(j)
        if a == b:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
            forest.up[b] = a
            out.append((int(ids[i]), int(ids[j])))
    return out


def _compared(rows: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) within the groups `key` of rows (id, label, side): side 2 meets all, sides 0 and 1 each other."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Near copies mostly share their least shingle, so they lie side by side in the tree.
        sets = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in group["s"]]
        at = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        side = group["side"].to_numpy()[at]
        one = bool((side == 2).all())
        found = links(group["id"].to_numpy()[at], group["label"].to_numpy()[at], [sets[i] for i in at], None if one else side)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.join(candidates.select("id", "s"), "id").groupBy(*key).applyInPandas(run, "a long, b long")


def _blocks(rows: DataFrame, part: list[str]) -> DataFrame:
    """rows with `block`: blocks of about BLOCK_DOCS documents and BLOCK_SHINGLES shingles within each `part`."""
    sums = rows.groupBy(*part).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("_blocks"))
    return rows.join(sums, part).withColumn("block", F.pmod(F.xxhash64("id", "token"), F.col("_blocks")).cast("int")).drop("_blocks")


def _size_class() -> Column:
    """Sets whose classes differ by more than one cannot link."""
    return F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int")


def links_of(candidates: DataFrame, order) -> DataFrame:
    """Links (a, b) that connect the candidates as all links would.

    Round one compares within single blocks, of the smallest and the largest group of each candidate. Round two takes
    every group that still has several components: all block pairs but those inside the group's largest component.
    """
    members = _members(candidates, order)
    small, large = Window.partitionBy("id").orderBy("c", "token"), Window.partitionBy("id").orderBy(F.desc("c"), "token")
    ranked = members.withColumn("_s", F.row_number().over(small)).withColumn("_l", F.row_number().over(large)).where("_s = 1 OR _l = 1").drop("_s", "_l")
    ranked = ranked.withColumn("class", F.when(F.col("c") > BLOCK_DOCS, _size_class()).otherwise(0))
    ranked = _blocks(ranked, ["token", "class"]).withColumn("label", F.col("id")).withColumn("side", F.lit(2))
    one = written(_compared(ranked, candidates, ["token", "class", "block"]))

    known = components(one).select("id", "component")
    labelled = members.join(known, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    counts = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    open_ = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_labels"), F.max_by("label", F.struct("m", "label")).alias("_major"), F.sum("t").alias("t")).where("_labels > 1")
    labelled = written(labelled.join(open_, "token").withColumn("minor", F.col("label") != F.col("_major")).drop("_labels", "_major"))
    one_task = (F.col("c") <= BLOCK_DOCS) & (F.col("t") <= BLOCK_SHINGLES)
    whole = labelled.where(one_task)
    whole = _compared(whole.withColumn("side", F.lit(2)), candidates, ["token"])
    parts = _blocks(labelled.where(~one_task).withColumn("class", _size_class()), ["token", "class", "minor"])
    parts = written(parts)
    node = parts.select("token", "class", "minor", "block").distinct()
    other = node.select("token", F.col("class").alias("class2"), F.col("minor").alias("minor2"), F.col("block").alias("block2"))
    mine, yours = F.struct("class", "minor", "block"), F.struct("class2", "minor2", "block2")
    pairs = node.join(other, "token").where((F.col("minor") | F.col("minor2")) & (F.abs(F.col("class") - F.col("class2")) <= 1) & (mine <= yours))
    pairs = pairs.withColumn("pair", F.struct("class", "minor", "block", "class2", "minor2", "block2"))
    same = mine == yours
    left = pairs.select("token", "class", "minor", "block", "pair", F.when(same, 2).otherwise(0).alias("side"))
    right = pairs.where(~same).select("token", F.col("class2").alias("class"), F.col("minor2").alias("minor"), F.col("block2").alias("block"), "pair", F.lit(1).alias("side"))
    dealt = parts.join(left.unionByName(right), ["token", "class", "minor", "block"])
    crossed = _compared(dealt, candidates, ["token", "pair"])
    return one.unionByName(whole).unionByName(crossed)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each row.

    A null or empty text, or one without words, has no shingles and links with nothing; a text of fewer than five
    words has its word sequence as its one shingle. Texts are read whole. Rows with the same doc_id are one document;
    a null doc_id links with nothing and its component_id is null. An empty table gives an empty one; other columns are
    left out.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        first = written(_scan(body))
        top = first.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
        order = spark.sparkContext.broadcast((top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["count"].to_numpy(dtype=np.int64)))
        found = written(links_of(_candidates(body, first, order), order))
        rows = first.where("token IS NULL").select("id", "n", "k1", "k2")
        classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
        equal = rows.where("n > 0").join(classes, ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        joined = components(found.unionByName(equal))
        out = rows.join(joined, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        return scratch.keep(out)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of near copies stays: that of the smallest doc_id, null last.

    Rows are told apart by their place in the table, so rows with a null or a repeated doc_id are documents like any
    other; of rows with equal ids the earlier stays. A row without words stays. Needs doc_id and text; all columns pass
    through whatever their names. An empty table gives an empty one.
    """
    body = written(docs.select(row_of(docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")))
    with Scratch(docs.sparkSession) as scratch:
        found = near_copies(body.select(F.col("at").alias("doc_id"), F.col("row").getField("text").alias("text")))
        ids = body.select(F.col("at").alias("doc_id"), F.col("row").getField("doc_id").alias("given"))
        first = F.min(F.struct(F.col("given").isNull(), F.col("given"), F.col("doc_id").alias("at")))
        stay = scratch.keep(found.join(ids, "doc_id").groupBy("component_id").agg(first.alias("first")).select("first.at"))
    return body.join(stay, "at", "left_semi").select(*fields_of("row", docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return near_copies(documents(spark, sf_dir))
