"""Near-duplicate embeddings by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the pairs of codewords form a grid of cells. A vector visits
cells in the order of their summed distances, by multi-sequence traversal of the two sorted lists of codewords, up to
the distance within which neighbours at the threshold lie with the target recall, measured when the codebooks are
fitted. Vectors met in the visited cells are verified by cosine in double precision. Vectors of each length have an
index of their own.

Equal vectors are one with a count. A vector visits its own cell and those after it in number, so a pair is met once.
Cells are split into blocks; a task verifies one block of visitors against one block of a cell as a matrix product and
keeps, beside the number of links of each vector, only as many links as connect what all links would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.llm.common import table, written
from graniteloom.llm.components import components

COSINE = 0.9
#: Vectors of a cell that are aimed at, least and most codewords of each half (their grid has 4e9 vectors' cells at
#: most; beyond, cells have more blocks), rows that fit them (20,000, or 16 a codeword), target recall at the threshold,
#: vectors of a block.
CELL, LEAST_CODEWORDS, MOST_CODEWORDS, SAMPLE, RECALL, BLOCK = 256, 4, 4096, 20_000, 0.998, 512
SEED = 3


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds from a seeded choice of rows."""
    words = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        for j in range(len(words)):
            if (near == j).any():
                words[j] = x[near == j].mean(0)
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :])


def region_distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distance of each x from each codeword's region, measured to the plane between it and x's own region: a
    lower bound of the true one."""
    d = _distances(x, words)
    own = d.argmin(1)
    between = np.sqrt(_distances(words[own], words)) + 1e-12
    gap = np.maximum(0.0, d - d[np.arange(len(x)), own][:, None]) / (2 * between)
    gap[np.arange(len(x)), own] = 0.0
    return gap * gap


def fit(rows: np.ndarray, cosine: float = COSINE, recall: float = RECALL, codewords: int = 64, seed: int = SEED) -> dict:
    """Codebooks of both halves, and the reach: the squared distance up to which cells are visited."""
    rng = np.random.default_rng(seed)
    x = _unit(rows)
    half = x.shape[1] // 2
    books = [_codebook(x[:, :half], codewords, rng), _codebook(x[:, half:], codewords, rng)]
    # Neighbours at the threshold, in random directions: how far are their cells?
    at = x[rng.integers(0, len(x), 8192)]
    turn = rng.standard_normal(at.shape)
    turn = _unit(turn - (turn * at).sum(1, keepdims=True) * at + 1e-12)
    near = cosine * at + np.sqrt(1 - cosine * cosine) * turn
    far = np.zeros(len(at))
    for book, part in zip(books, (slice(None, half), slice(half, None)), strict=True):
        cell = _distances(near[:, part], book).argmin(1)
        far += region_distances(at[:, part], book)[np.arange(len(at)), cell]
    return {"half": half, "books": books, "reach": float(np.quantile(far, recall)) + 1e-12}


def cells_of(x: np.ndarray, index: dict) -> np.ndarray:
    """The cell of each unit vector."""
    a, b = index["books"]
    half = index["half"]
    return _distances(x[:, :half], a).argmin(1) * len(b) + _distances(x[:, half:], b).argmin(1)


def visits(x: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells that each unit vector visits, nearest first, until their summed distance is beyond reach.

    Multi-sequence traversal of all rows in step: each of the first half's sorted codewords points to a place in the
    sorted codewords of the second half; the pointer of the least sum gives the next cell and moves on.
    """
    half, (a, b), reach = index["half"], index["books"], index["reach"]
    d1, d2 = region_distances(x[:, :half], a), region_distances(x[:, half:], b)
    first, second = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    s1, s2 = np.take_along_axis(d1, first, 1), np.take_along_axis(d2, second, 1)
    s2 = np.concatenate([s2, np.full((len(x), 1), np.inf)], 1)
    wide = max(1, int((s1 <= reach).sum(1).max(initial=1)))
    row, at = np.arange(len(x)), np.zeros((len(x), wide), dtype=np.int64)
    sums = s1[:, :wide] + s2[:, :1]
    rows, cells = [], []
    while len(row):
        j = sums.argmin(1)
        here = np.arange(len(row))
        open_ = sums[here, j] <= reach
        row, at, sums, j = row[open_], at[open_], sums[open_], j[open_]
        here = np.arange(len(row))
        place = at[here, j]
        rows.append(row)
        cells.append(first[row, j] * len(b) + second[row, place])
        at[here, j] = place + 1
        sums[here, j] = s1[row, j] + s2[row, place + 1]
    return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *cells])


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ids that connect what the links (a boolean matrix) connect, as stars of each component."""
    open_ = linked.any(1)
    out = []
    while open_.any():
        rows = np.zeros(len(left), dtype=bool)
        rows[int(open_.argmax())] = True
        while True:
            columns = linked[rows].any(0)
            more = linked[:, columns].any(1)
            if (more == rows).all():
                break
            rows = more
        hub = int(left[rows.argmax()])
        out += [(hub, int(v)) for v in np.concatenate([left[rows], right[columns]]) if v != hub]
        open_ &= ~rows
    return out


def indexes(same: DataFrame, cosine: float) -> dict[int, dict]:
    """The index of each length of vectors (n) that has more than a cell of them; the others are one cell."""
    lengths = same.groupBy("n").count().where(F.col("count") > CELL).collect()
    found = {}
    for n, count in sorted((r["n"], r["count"]) for r in lengths if r["n"] > 1):
        # Cells grow in number with the vectors, not in size.
        codewords = int(np.clip(np.ceil(np.sqrt(count / CELL)), LEAST_CODEWORDS, MOST_CODEWORDS))
        order = same.where(F.col("n") == n).orderBy(F.xxhash64(F.lit(SEED), "id"), "id")
        sample = order.limit(max(SAMPLE, 16 * codewords)).select("id", "x").toPandas().sort_values("id", kind="stable")
        found[n] = fit(np.array(sample["x"].tolist()), cosine, codewords=codewords)
    return found


def _by_length(part: pd.DataFrame):
    """(n, rows) of the rows of each length, at most 2,048 at a time."""
    for n, rows in part.groupby("n", sort=False):
        for at in range(0, len(rows), 2048):
            yield int(n), rows.iloc[at : at + 2048]


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    n_links: other rows found with a cosine of at least `cosine`; component_id: the smallest vec_id reachable by
    links, itself included; kept: whether that is its own. Vectors that are null, empty, zero, or hold null or
    non-finite numbers link with nothing, nor do rows with a null vec_id (their component_id is null, and they are
    kept); vectors of different lengths do not link. Different vectors of one vec_id are one item: they do not link with
    each other, and n_links is that of all of them. An empty table gives an empty one; other columns are left out.
    """
    spark = vectors.sparkSession
    x = F.col(embedding).cast("array<double>")
    fine = F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(x, lambda v: v != 0) & F.col(id).isNotNull(), F.lit(False))
    # Powers of two keep the squares finite and change no cosine; of one number only the sign counts.
    scale = F.when(F.size(x) == 1, F.abs(x[0])).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(x, F.abs))))))
    body = written(vectors.select(F.col(id).cast("long").alias("id"), F.when(fine, F.transform(x, lambda v: v / scale)).alias("x")))
    same = written(body.where("x IS NOT NULL").groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("n", F.size("x")))
    index = spark.sparkContext.broadcast(indexes(same, cosine))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in _by_length(batch):
                unit = _unit(np.array(part["x"].tolist()))
                cell = cells_of(unit, index.value[n]) if n in index.value else np.zeros(len(part), int)
                yield pd.DataFrame({"id": part["id"], "copies": part["copies"], "n": n, "x": list(unit), "cell": cell})

    points = written(same.mapInPandas(placed, "id long, copies long, n int, x array<double>, cell int"))

    def seen(part: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of the visits to a vector's own cell and to those after it."""
        own = part["cell"].to_numpy()
        if n not in index.value:
            return np.arange(len(part)), own
        row, cell = visits(np.array(part["x"].tolist()), index.value[n])
        later = cell >= own[row]
        return row[later], cell[later]

    def counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in _by_length(batch):
                cell, count = np.unique(seen(part, n)[1], return_counts=True)
                yield pd.DataFrame({"n": n, "cell": cell, "visits": count})

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in _by_length(batch):
                row, cell = seen(part, n)
                for at in range(0, len(row), 65536):
                    r, c = row[at : at + 65536], cell[at : at + 65536]
                    rows = part.iloc[r]
                    yield pd.DataFrame({"id": rows["id"], "copies": rows["copies"], "n": n, "x": rows["x"], "cell": c, "side": np.where(rows["cell"].to_numpy() == c, 2, 0)})

    # Blocks of a cell, and blocks of a cell's visitors; every pair of them is one small matrix product. Visitors of side
    # 2 are in their own cell, where a pair counts from its smaller id.
    grid = ["n", "cell"]
    crowds = points.mapInPandas(counting, "n int, cell int, visits long").groupBy(*grid).agg(F.ceil(F.sum("visits") / BLOCK).cast("int").alias("crowds"))
    sizes = points.groupBy(*grid).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(crowds, grid)
    sizes = written(sizes)
    salt = F.xxhash64("id", "cell")
    row = ["id", "copies", "x", "n", "cell"]
    visitors = points.mapInPandas(visiting, "id long, copies long, n int, x array<double>, cell int, side int").join(sizes, grid)
    visitors = visitors.select(*row, "side", F.pmod(salt, "crowds").cast("int").alias("crowd"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    owners = points.join(sizes, grid)
    owners = owners.select(*row, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), F.pmod(salt, "blocks").cast("int").alias("block"))
    met = visitors.unionByName(owners)

    def verified(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] != 1].sort_values("id"), group[group["side"] == 1].sort_values("id")
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        linked = np.array(left["x"].tolist()) @ np.array(right["x"].tolist()).T >= cosine
        linked &= np.where((left["side"] == 2).to_numpy()[:, None], a[:, None] < b[None, :], a[:, None] != b[None, :])
        counts = np.concatenate([linked @ right["copies"].to_numpy(), left["copies"].to_numpy() @ linked])
        ids = np.concatenate([a, b])
        some = counts > 0
        edges = np.array(spanning(linked, a, b), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([ids[some], edges[:, 0]]), "b": np.concatenate([ids[some], edges[:, 1]]), "links": np.concatenate([counts[some], np.zeros(len(edges), np.int64)])})

    found = written(met.groupBy("n", "cell", "crowd", "block").applyInPandas(verified, "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    joined = components(found.where("a <> b").select("a", "b")).select(F.col("id").alias("rep"), "component")
    # Only vectors that repeat need a look at their first id; the join is on those, so no key is common to all others.
    repeated = same.where("copies > 1").select(F.col("x").alias("same_x"), F.col("id").alias("first"), "copies")
    alike = body.where("x IS NOT NULL").join(repeated, F.col("x") == F.col("same_x"), "left").select("id", F.coalesce("first", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    alike = alike.join(links, "rep", "left").join(joined, "rep", "left")
    component = F.coalesce("component", "rep")
    fine_rows = alike.select(
        F.col("id").alias("vec_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept")
    )
    alone = body.where("x IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return fine_rows.unionByName(alone)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
