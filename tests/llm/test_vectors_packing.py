"""Operators 11 to 13 against brute force, and with odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteloom.llm import clustering, packing, queries, whitening
from tests.comparing import same
from tests.llm.test_llm import EDGE, docs

VECTORS = "vec_id long, embedding array<double>, label int, x array<long>, n string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, [1], "n", "c") for i, v in rows], VECTORS)


def drawn(n, d, seed=1):
    return np.random.default_rng(seed).normal(size=(n, d)).round(3)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(name, spark, sf_dir):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


# -- 13


def kmeans(rows, length, k, rounds, scale=1024, start="3:"):
    """By Python's integers, straight from the definition."""
    fine = [(i, [int(np.floor(scale * v)) for v in x]) for i, x in rows if x is not None and len(x) == length and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(fine, key=lambda r: (r[0] is None, hashlib.sha256(f"{start}{r[0]}".encode()).hexdigest(), r[1]))
    now = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(now)) for _, x in fine]

    for _ in range(rounds):
        at = assign()
        for j in range(len(now)):
            own = [x for (_, x), (_, c) in zip(fine, at, strict=True) if c == j]
            if own:
                now[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    at = assign()
    inertia = [sum(d for d, c in at if c == j) for j in range(len(now))]
    return sorted(((i, j, d, inertia[j], sum(inertia), now[j]) for (i, _), (d, j) in zip(fine, at, strict=True)), key=str)


def test_clusters_against_brute_force(spark):
    x = drawn(300, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i % 3].tolist()) for i in range(300, 420)]
    odd = [(None, x[7].tolist()), (5, x[5].tolist()), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [NAN]), (504, [1.0] * 5 + [INF]), (505, [1.0] * 5 + [None]), (506, [0.0, -0.0] * 3)]
    table = vectors(spark, rows + odd)
    for k, rounds in ((8, 10), (3, 1), (1, 2)):
        got = clustering.clustered(table, length=6, centroids=k, rounds=rounds, segment=4).collect()
        assert sorted((tuple(r) for r in got), key=str) == kmeans(rows + odd, 6, k, rounds)


def test_few_equal_and_no_vectors(spark):
    same_ones = [(i, [0.5, 0.25]) for i in range(5)]
    got = clustering.clustered(vectors(spark, same_ones), length=2, centroids=8).collect()
    assert sorted(tuple(r)[:5] for r in got) == [(i, 0, 0, 0, 0) for i in range(5)] and got[0]["centroid"] == [512, 256]
    none = clustering.clustered(vectors(spark, [(1, None), (2, [1.0])]), length=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    far = clustering.clustered(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e9, 1.0])]), length=2, centroids=2, rounds=1)
    assert far.count() == 3 and far.where("distance < 0 OR inertia < 0").count() == 0


def test_screening_measures_few_and_loses_none():
    rng = np.random.default_rng(5)
    for width, spread in ((64, 3), (7, 1), (64, 1 << 29)):
        x = rng.integers(-spread, spread + 1, (400, width)) + (rng.integers(0, 8, 400)[:, None] * 40 * (np.arange(width) < 16))
        c = x[rng.choice(400, 8, replace=False)]
        label, best, measured = clustering.nearest(x, clustering.segment_norms(x), c)
        every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert label.tolist() == [min((d, j) for j, d in enumerate(row))[1] for row in every] and best.tolist() == [min(row) for row in every]
        assert measured <= 400 * 8 and (spread != 3 or measured < 400 * 3)


# -- 11


def whitened_by_numpy(x, components=4):
    x = np.floor(256 * np.asarray(x, dtype=float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), [int(v) for v in fit.astype(object).sum(0)]
    centred = fit.astype(np.longdouble) - np.array(total, dtype=np.longdouble) / n
    values, parts = np.linalg.eigh((centred.T @ centred / n).astype(float))
    order = np.argsort(-values)[:components]
    z = (x.astype(np.longdouble) - np.array(total, dtype=np.longdouble) / n).astype(float) @ parts[:, order] / np.sqrt(values[order])
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    return n, deviation, z, values[order] / values.sum()


def test_whitening_against_numpy(spark):
    x = drawn(200, 6) * [5, 3, 2, 1, 0.5, 0.2] + [1e5, 0, -300, 2, 0, 7]
    x = np.concatenate([x, x[:50], x[:1].repeat(80, 0)])
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [NAN] * 6), (903, [INF] * 6), (904, [])]
    table = vectors(spark, [*((i, v.tolist()) for i, v in enumerate(x)), *odd])
    got = {r["vec_id"]: r for r in whitening.whitened(table, table.columns).collect()}
    n, deviation, z, share = whitened_by_numpy(x)
    assert set(got) == {*range(len(x)), 904} and got[904]["whitened"] == [] and got[904]["n"] is None
    signs = np.sign(z[0]) * np.sign(got[0]["whitened"])
    for i in range(len(x)):
        assert (got[i]["n"], got[i]["deviation"]) == (n, deviation[i])
        assert got[i]["whitened"] == pytest.approx(z[i] * signs, rel=1e-7, abs=1e-9) and got[i]["explained"] == pytest.approx(share, rel=1e-9)
        assert got[i]["identity_error"] < 1e-9
    assert (got[0]["label"], got[0]["x"], got[0]["cluster"]) == (0, [1], "c") and "embedding" in got[0]


def test_whitening_of_few_flat_and_no_vectors(spark):
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), ["vec_id"]).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, [None, None], [0.0, 0.0], None)] * 2
    two = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0])]), ["vec_id"]).collect()
    assert [(r["n"], r["whitened"]) for r in sorted(two, key=lambda r: r["vec_id"])] == [(2, [-1.0, None]), (2, [1.0, None]), (1, [None])]
    assert whitening.whitened(vectors(spark, []), ["vec_id"]).count() == 0
    far = whitening.whitened(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])]), ["vec_id"]).collect()
    assert [r["deviation"] for r in far if r["vec_id"] < 3] == [None, None]


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 8, 33):
        a = rng.normal(size=(d + 3, d))
        values, parts = whitening.jacobi(a.T @ a)
        assert values == pytest.approx(np.linalg.eigvalsh(a.T @ a)[::-1], rel=1e-10) and np.abs(parts.T @ parts - np.eye(d)).max() < 1e-13
    # A graded matrix D B D with a well-conditioned B: each eigenvalue has its digits, far below the rounding of the largest.
    scale = 10.0 ** -np.arange(0, 24, 4)
    b = np.eye(6) + 0.2 * np.ones((6, 6))
    values, _ = whitening.jacobi(scale[:, None] * b * scale)
    assert values[-1] == pytest.approx(scale[-1] ** 2 * (1 + 0.2 / (1 + 5 * 0.2)), rel=1e-6)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_scatter_is_exact():
    for most in (1000, 1 << 40):
        y = np.random.default_rng(3).integers(-most, most, (5000, 3))
        assert (whitening.scatter(y) == y.astype(object).T @ y.astype(object)).all()


# -- 12


def test_pieces_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path())
    texts = [*EDGE, "It's 2,500 é́ x y z İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "\x1c\x85 tab\tline\r\n", "x" * 9000, "<|ENDOFTEXT|>, A<|endoftext|>,", "e\u0301, e, \u0301, É. İ, I\u0307. x\u0338< y<\u0338", "don't, it'S. 'll' we'll'", "a.. b!?) C, d,e, f_ g; ª. ß, ÿ] ĳ, ǅ. ſ,", "\U0001f600 don't ＡＢ ﬁ", " ́ lead"]
    table = docs(spark, texts).withColumn("piece", F.lit("clash")).withColumn("key", F.lit(1))
    got = {}
    for r in packing.pieces(table, table.columns, packing.vocabulary_path(), capacity=64).collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert "key" in r and r["length"] * 4 == len(r["ids"])
    for i, text in enumerate(texts):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        rows = sorted(got[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in rows) == want
        assert [(r["piece"], r["start"]) for r in rows] == [(k, 64 * k) for k in range(len(rows))] and all(r["length"] == 64 for r in rows[:-1])
    assert packing.pieces(table.limit(0), ["doc_id"], packing.vocabulary_path()).count() == 0


def fewest(lengths, capacity):
    """Bins of the best packing, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in sorted({b for b in bins if b >= lengths[i]}):
            rest = list(bins)
            rest[rest.index(room)] -= lengths[i]
            go(i + 1, rest)
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


def test_bounds_and_best_fit_against_search():
    r = random.Random(8)
    met = 0
    for _ in range(200):
        capacity = r.choice([1, 2, 7, 10, 12, 30])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64))
        bin_, offset, free = packing.best_fit_decreasing(np.array(lengths, dtype=np.int64), capacity)
        best = fewest(lengths, capacity)
        assert bound <= best <= len(free) <= best + 1
        met += bound == best
        for j in range(len(free)):
            own = sorted((o, x) for o, x, b in zip(offset.tolist(), lengths, bin_.tolist(), strict=True) if b == j)
            assert [o for o, _ in own] == [0, *itertools.accumulate(x for _, x in own)][:-1] and sum(x for _, x in own) + free[j] == capacity
    assert met > 150


def test_exchange_saves_bins(spark):
    r = random.Random(6)
    for draw, slack in ((lambda: r.randint(1, 60), 6), (lambda: r.choice([34, 35, 51, 67]), 2), (lambda: 51, 0)):
        lengths = [draw() for _ in range(1500)] + [100] * 7
        rows = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
        alone, exchanged = (packing.layout(rows, capacity=100, part=60, rounds=k).toPandas() for k in (0, 8))
        bound = packing.lower_bound(np.bincount(lengths, minlength=101).astype(np.int64))
        for laid in (alone, exchanged):
            assert sorted(laid["key"]) == list(range(1507))
            laid["length"] = laid["key"].map(dict(enumerate(lengths)))
            for _, group in laid.sort_values("offset").groupby("sequence_id"):
                assert group["offset"].tolist() == [0, *itertools.accumulate(group["length"])][:-1] and group["length"].sum() <= 100
        used = [laid["sequence_id"].nunique() for laid in (alone, exchanged)]
        assert bound <= used[1] <= min(used[0], bound + slack)
    assert packing.layout(rows.limit(0)).count() == 0


def test_sequences_hold_every_id_once(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).unionByName(docs(spark, EDGE, 9000))
    cut = packing.keyed(packing.pieces(rows, ["doc_id"], packing.vocabulary_path()))
    laid = packing.layout(cut.select("key", "length"))
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(cut, laid).collect()}
    placed = cut.join(laid, "key").collect()
    assert len(placed) == cut.count() and sum(map(len, made.values())) == 4 * sum(r["length"] for r in placed)
    for r in placed:
        assert made[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert max(map(len, made.values())) <= 4 * packing.CAPACITY


def test_packing_query(spark, sf_dir):
    got = queries.queries()["op12_certified_packing"](spark, sf_dir).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path())
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(r["doc_id"], at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    assert got["sequence_id"].nunique() <= 1.02 * packing.lower_bound(np.bincount(got["length"], minlength=4097))
