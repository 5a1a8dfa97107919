import functools
import hashlib
import math
import os
import random
import re

from pyspark.sql import functions as F

from graniteloom.operators import curation as C
from graniteloom.operators import evaluation as E
from graniteloom.operators import findings as D
from graniteloom.operators import graphs as G
from graniteloom.operators import joins as J
from graniteloom.operators import retrieval as R

PAIRS = [("p1", "vuln", 0.9), ("p1", "safe", 0.1), ("p2", "vuln", 0.6), ("p2", "safe", 0.6), ("p3", "vuln", 0.2), ("p3", "safe", 0.3), ("p4", "vuln", 0.4), ("p4", "safe", 0.8)]


def test_content_key_joins_equal_code(spark):
    rows = spark.createDataFrame([(1, "int  x = 1;"), (2, "INT x = 1; "), (3, "int y = 1;")], "id int, text string").withColumn("k", C.content_key(F.col("text")))
    assert [r["id"] for r in C.dedup_first(rows, ["k"], ["id"]).orderBy("id").collect()] == [1, 3]


def test_hash_bucket_is_the_number_modulo_ten(spark):
    keys = ["CVE-2020-1", "x", "", "é"]
    got = [r["b"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(C.hash_bucket(F.col("k")).alias("b")).collect()]
    assert got == [int(hashlib.sha256(f"42:{k}".encode()).hexdigest(), 16) % 10 for k in keys]


def test_near_dup_pairs_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, "a b c d e f"), (2, 0, "a b c d e g"), (3, 1, "a b c d e f")], "id int, b int, text string")
    rows = rows.withColumn("g", F.col("id") % 2)
    got = C.near_dup_pairs(rows, "b", "g", "id", "text", 0.2).collect()
    assert [(r["id_a"], r["id_b"], round(r["jaccard"], 6)) for r in got] == [(1, 2, 0.333333)]
    assert C.near_dup_pairs(rows.withColumn("g", F.lit(1)), "b", "g", "id", "text", 0.2).count() == 0


def test_near_dup_pairs_are_those_of_all_sets(spark, monkeypatch):
    """Against brute force: copies, short, empty and null texts, odd white space and capitals, null groups and buckets, passages in
    many texts; whichever shingles are taken for frequent, the pairs are the same."""
    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice((3, 8, 40, 90)))] for _ in range(25)]
    passage = [f"p{i}" for i in range(12)]
    data = []
    for i in range(240):
        words = list(base[r.randrange(25)])
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = f"W{r.randrange(400)}"
        data.append((i, r.choice("ab"), r.choice("xyz"), r.choice((" ", "  ", "\n", "\t ")).join((words + passage) if i % 3 == 0 else words)))
    data += [(300, "a", "x", ""), (301, "a", "y", " \n"), (302, "a", "y", ""), (303, "a", "z", None), (304, None, "x", "q"), (305, None, "y", "q"), (306, "a", None, "q"), (307, "a", "x", "Q"), (308, "b", "x", "é\x0bü É"), (309, "b", "y", "É\x0bü é ")]
    sets = {}
    for i, b, g, t in data:
        if t is not None and b is not None and g is not None:
            w = re.sub(r"[ \t\r\n]+", " ", t.lower()).strip(" ").split(" ")
            sets.setdefault((b, g, frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1)))), i)
    want = {(i, j): len(s & t) / len(s | t) for (b, g, s), i in sets.items() for (c, h, t), j in sets.items() if i < j and b == c and g != h and len(s & t) >= 0.6 * len(s | t)}
    rows = spark.createDataFrame(data, "id long, b string, g string, text string")
    for sample, often in ((16, 8), (1, 2), (1, 30)):
        monkeypatch.setattr(C, "SAMPLE", sample)
        monkeypatch.setattr(C, "OFTEN", often)
        got = {(x["id_a"], x["id_b"]): x["jaccard"] for x in C.near_dup_pairs(rows, "b", "g", "id", "text", 0.6).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 100
    assert C.near_dup_pairs(rows.limit(0), "b", "g", "id", "text", 0.6).count() == 0


def test_only_first_shingles_are_dealt_out(spark, monkeypatch):
    """Texts that share a passage, but less than the threshold, are not compared; of the sets only the first shingles are rows."""
    made, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda d: made.append(cut(d)) or made[-1])
    rows = spark.createDataFrame([(i, 0, i, " ".join([f"p{j}" for j in range(30)] + [f"u{i}.{j}" for j in range(74)])) for i in range(20)], "id long, b int, g long, text string")
    assert C.near_dup_pairs(rows, "b", "g", "id", "text", 0.8).count() == 0
    assert "first" in made[0].columns and made[0].agg(F.sum(F.size("first"))).first()[0] == 20 * 21


def test_near_dup_pairs_write_no_whole_sets(spark, monkeypatch):
    """What is written are first shingles, pairs and where they meet; texts outside pairs are not sent to a place. Crowds that are
    cut up into blocks of two texts, and a filter of few bits, give the same pairs; what is done with is deleted."""
    made = []
    for name in ("cut", "settled"):
        monkeypatch.setattr(C, name, (lambda f: lambda d: made.append(f(d)) or made[-1])(getattr(C, name, C.cut)), raising=False)
    crowd = [(i, i % 3, " ".join([f"w{j}" for j in range(60)] + [f"u{i}.{j}" for j in range(i % 4)])) for i in range(30)]
    rows = spark.createDataFrame(crowd + [(100 + i, i % 3, " ".join(f"x{i}.{j}" for j in range(40))) for i in range(20)], "id long, g long, text string").withColumn("b", F.lit("b"))
    shingle = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    first = {}
    for i, g, t in crowd:
        first.setdefault((g, t), i)
    sets = {i: (g, shingle(t)) for (g, t), i in first.items()}
    want = {(i, j, round(len(s & t) / len(s | t), 9)) for i, (g, s) in sets.items() for j, (h, t) in sets.items() if i < j and g != h and len(s & t) >= 0.8 * len(s | t)}
    for block, bits, most in ((256, 27, 22), (2, 16, 1)):
        for name, value in (("BLOCK", block), ("MOST_BITS", bits), ("MOST_SENT", most)):
            monkeypatch.setattr(C, name, value, raising=False)
        made.clear()
        got = C.near_dup_pairs(rows, "b", "g", "id", "text", 0.8)
        assert {(x["id_a"], x["id_b"], round(x["jaccard"], 9)) for x in got.collect()} == want and got.count() == len(want) > 50
        assert not any("s" in d.columns for d in made)
        assert all(i < 100 for d in made if {"unit", "id_a"} <= set(d.columns) for r in d.select("id_a", "id_b").collect() for i in r)
        assert not any(os.path.exists(d._written_path.removeprefix("file:")) for d in made if {"key", "place"} & set(d.columns))


def test_pair_and_rank_metrics(spark):
    rows = spark.createDataFrame(PAIRS, "pair string, gold string, score double")
    judged = rows.select((F.col("gold") == "vuln").alias("gold"), (F.col("score") >= 0.5).alias("pred"), "score")
    got = E.with_rates(judged.agg(*E.confusion_aggs(F.col("gold"), F.col("pred")))).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["f1"]) == (2, 2, 2, 2, 0.5)
    assert E.auc(judged, [], "gold", "score").first()["auc"] == 9.5 / 16
    sides = E.pair_sides(rows, "pair", "gold", "score").withColumn("o", E.pair_outcome(F.col("vuln") >= 0.5, F.col("safe") >= 0.5))
    assert {r["pair"]: r["o"] for r in sides.collect()} == {"p1": "correct", "p2": "vulnerable", "p3": "benign", "p4": "reversed"}


def test_intervals_and_bands(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 20), ("f", "inner", 5, 9)], "file string, name string, start int, stop int")
    points = spark.createDataFrame([("f", 7, 7), ("f", 15, 15), ("f", 25, 25)], "file string, id int, line int")
    got = J.smallest_enclosing(points, spans, ["file"], "id", "line", "name", "start", "stop", 8).collect()
    assert {r["id"]: r["name"] for r in got} == {7: "inner", 15: "outer", 25: None}
    truth = spark.createDataFrame([("f", 1, 10)], "file string, id int, line int")
    found = spark.createDataFrame([("f", 7), ("f", 13), ("f", 11)], "file string, guess int")
    assert [J.has_near(truth, found, ["file"], "id", "line", "guess", t).first()["hit"] for t in (0, 1, 3)] == [False, True, True]


def test_way_to_a_source(spark):
    """A user input goes before an import, a property flow before an alias; the way itself comes along."""
    edges = [("c", "z", "alias"), ("c", "b", "prop_flow"), ("b", "a", "alias"), ("x", "y", "alias"), ("y", "x", "alias"), ("l", "m", "alias")]
    edges = spark.createDataFrame(edges, "node string, up string, kind string")
    sources = spark.createDataFrame([("a", "static_import"), ("a", "user_input")], "node string, kind string")
    starts = spark.createDataFrame([(1, "c"), (2, "x"), (3, "l"), (4, "a")], "id int, node string")
    got = {r["id"]: (r["verdict"], r["source"], r["steps"], r["path"]) for r in G.resolve(starts, edges, sources).collect()}
    assert got == {1: ("user_input", "a", 2, ["c", "b", "a"]), 2: ("cycle", None, 1, ["x", "y"]), 3: ("unknown", None, 1, ["l", "m"]), 4: ("user_input", "a", 0, ["a"])}


def test_risk_moves_with_the_verdict(spark):
    rows = spark.createDataFrame([("safe", 7.5), ("tainted", 7.5), ("unknown", 0.1)], "v string, b double")
    assert [round(r["r"], 6) for r in rows.select(G.adjusted_risk(F.col("b"), F.col("v")).alias("r")).collect()] == [6.5, 8.4, 0.0]


def test_merge_keeps_contributors_in_order(spark):
    rows = spark.createDataFrame([(1, 4, "A", 1, "high"), (1, 4, "B", 2, "high"), (2, 9, "B", 2, "high"), (3, 2, "B", 2, "low")], "cwe int, line int, engine string, rank int, sure string")
    got = D.merge(rows, ["cwe", "line"], "engine", "rank", (F.col("engine") == "A") | (F.col("sure") == "high")).collect()
    assert {(r["cwe"], r["line"]): r["contributors"] for r in got} == {(1, 4): "A,B", (2, 9): "B"}


def test_knn_order(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id int, vector array<double>")
    got = R.knn(spark.createDataFrame([(0, [1.0, 0.0])], "id int, vector array<double>"), points, 2).orderBy("rank").collect()
    assert [(r["id"], round(r["sim"], 6)) for r in got] == [(1, 1.0), (3, 0.6)]


def test_hubs_count_the_same(spark, monkeypatch):
    """A node of many edges meets the chosen nodes instead of all its neighbours."""
    r = random.Random(2)
    edges = spark.createDataFrame(sorted({("h", f"n{i:03d}") for i in range(120)} | {(f"n{r.randrange(120):03d}", f"n{r.randrange(120):03d}") for _ in range(300)}), "a string, b string")
    starts = spark.createDataFrame([("h",), ("n001",), ("n050",), ("alone",)], "node string")
    plain = sorted(map(tuple, G.neighborhood(starts, edges, 2, 20, 30).collect()))
    monkeypatch.setattr(G, "HUB", 3)
    assert sorted(map(tuple, G.neighborhood(starts, edges, 2, 20, 30).collect())) == plain and len(plain) == 4


def test_neighborhood_is_that_of_all_steps(spark, monkeypatch):
    """Against brute force: loops, edges both ways and twice, null nodes, starts without edges, one and three steps, either limit; nodes of
    many edges or none. A start's nodes are one row, and nothing is written that has a row for each of them."""
    r = random.Random(6)
    name = lambda i: f"n{i:02d}"
    data = [(name(r.randrange(40)), name(r.randrange(40))) for _ in range(110)] + [(name(1), name(1)), (name(2), name(3)), (name(3), name(2)), (name(2), name(3)), (name(4), None), (None, name(5))]
    starts = [name(i) for i in range(0, 40, 3)] + ["alone"]
    beside = {}
    for a, b in data:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    beside.pop(None)

    def brute(start, hops, most, most_edges):
        seen, front = [start], [start]
        for _ in range(hops):
            front = sorted({n for f in front for n in beside.get(f, ())} - set(seen), key=lambda n: (n is not None, n or ""))[: most + 1 - len(seen)]
            seen += front
        kept = set(seen[:most]) - {None}
        e = len({(a, b) for a, b in data if a in kept and b in kept})
        return start, len(seen[:most]), min(e, most_edges), len(seen) > most or e > most_edges

    made, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda d: made.append(cut(d)) or made[-1])
    frame = spark.createDataFrame(data, "a string, b string")
    for hub in (1024, 4):
        monkeypatch.setattr(G, "HUB", hub)
        for hops, most, most_edges in ((1, 6, 5), (3, 12, 256)):
            got = G.neighborhood(spark.createDataFrame([(s,) for s in starts], "node string"), frame, hops, most, most_edges)
            assert sorted(map(tuple, got.collect())) == sorted(brute(s, hops, most, most_edges) for s in starts)
    assert all(d.count() == len(starts) for d in made if "start" in d.columns)


def test_knn_is_that_of_all_pairs(spark, monkeypatch):
    """Blocks of every size give what comparing one by one does: copies by id, null, empty, zero, NaN and shorter vectors as SQL
    orders them; crowds of equal vectors and near ties included."""
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    data = [(i, [x * (1 + i % 3) for x in base[i % 12]]) for i in range(150)]
    data += [(200, None), (201, [0.0] * 6), (202, [float("nan")] + [1.0] * 5), (203, [1.0, 2.0]), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, []), (206, [1e200] * 6)]
    rows = spark.createDataFrame(data, "id long, vector array<double>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dots = [functools.reduce(lambda s, t: s + t[0] * t[1], zip(u, v), 0.0) for u, v in ((a, b), (a, a), (b, b))]
        low = math.sqrt(dots[1]) * math.sqrt(dots[2])
        return dots[0] / low if low > 0 and not math.isnan(low) else math.nan

    place = lambda s: -math.inf if s is None else math.inf if math.isnan(s) else s
    for size, floor in ((16_384, None), (40, None), (40, 0.5)):
        monkeypatch.setattr(R, "POINTS", size)
        monkeypatch.setattr(R, "QUERIES", size)
        got = {(x["q"], x["rank"]): (x["id"], str(x["sim"])) for x in R.knn(rows, rows, 5, floor).collect()}
        want = {}
        for q, a in data:
            sims = [(i, cosine(a, b)) for i, b in data]
            sims = [(i, s) for i, s in sims if floor is None or (s is not None and (math.isnan(s) or s >= floor))]
            for at, (i, s) in enumerate(sorted(sims, key=lambda t: (-place(t[1]), t[0]))[:5]):
                want[q, at + 1] = (i, str(s))
        assert got == want


def test_knn_has_no_row_a_pair(spark):
    """No join of queries with points: only the nearest of a block are rows."""
    rows = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    plan = R.knn(rows, rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_shingle_index_is_that_of_all_rows(spark, monkeypatch):
    """Crowds of copies, near copies, longer texts that hold a query and so rank before copies, short and null texts: as comparing all."""
    r = random.Random(7)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
    base = [" ".join(word() for _ in range(n)) for n in (3, 30, 45, 60, 120)]
    data = [(i, base[i % 5]) for i in range(60)]
    data += [(100 + i, base[4].replace(base[4].split()[i], "zz", 1)) for i in range(12)] + [(200 + i, base[3] + " " + base[4] + f" x{i}") for i in range(9)]
    data += [(300, None), (301, ""), (302, base[2].upper()), (303, "license text of all"), (304, "license text of all")]
    rows = spark.createDataFrame(data, "doc_id long, text string")
    joined = []
    monkeypatch.setattr(C, "cut", lambda d: joined.append((d.columns, d.localCheckpoint())) or joined[-1][1])
    got = {(x["q"], x["id"], x["shared"], round(x["jaccard"], 9)) for x in C.shingle_index(rows, "doc_id", "text", rows.where("doc_id % 5 < 4"), 20, 0.9).collect()}

    def grams(t):
        w = " ".join(t.lower().split()).split(" ")
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets, want = {i: grams(t) for i, t in data if t is not None}, set()
    for q, s in sets.items():
        if q % 5 < 4:
            found = sorted((-len(s & t), i) for i, t in sets.items() if i != q and s & t)[:20]
            want |= {(q, i, -n, round(-n / len(s | sets[i]), 9)) for n, i in found if -n / len(s | sets[i]) >= 0.9}
    assert got == want and len(got) > 500
    # What is looked up of a query is its rarest tenth, not all of it.
    rare = next(d for c, d in joined if c == ["qk", "need", "t"])
    assert rare.count() < sum(len(s) for s in {frozenset(s) for s in sets.values()}) / 5


def test_shingle_index_deals_out_no_whole_sets(spark, monkeypatch):
    """Rows that share nothing with a query's first shingles leave no shingle behind; queries may be other texts than the rows, ids
    may be null, and a row may be there twice."""
    made = []
    for name in ("cut", "settled"):
        monkeypatch.setattr(C, name, (lambda f: lambda d: made.append(f(d)) or made[-1])(getattr(C, name, C.cut)), raising=False)
    text = lambda i, n=40: " ".join(f"x{i}.{j}" for j in range(n))
    data = [(i, text(i)) for i in range(40)] + [(50, text(0) + " more"), (51, text(0)), (51, text(0)), (None, text(0)), (52, None)]
    rows = spark.createDataFrame(data, "id long, text string")
    queries = spark.createDataFrame([(0, text(0).upper()), (1, text(2) + " y"), (None, text(3)), (99, text(77))], "id long, text string")
    got = sorted((x["q"], x["id"], x["shared"], round(x["jaccard"], 6)) for x in C.shingle_index(rows, "id", "text", queries, 20, 0.9).collect())
    assert got == [(0, 50, 36, 0.972973), (0, 51, 36, 1.0), (0, 51, 36, 1.0), (1, 2, 36, 0.972973)]
    lists = [d.agg(F.sum(F.size(c))).first()[0] for d in made for c, kind in d.dtypes if kind == "array<bigint>"]
    assert lists and max(lists) < 40


def test_reach_by_shared_searches(spark, monkeypatch):
    """Starts that share a search keep their own hops, whatever the number that share one; a null start is itself alone."""
    r = random.Random(9)
    pairs = {(r.randrange(150), r.randrange(60)) for _ in range(260)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    starts = spark.createDataFrame([(i,) for i in range(150)] + [(None,), (3,), (999,)], "node long")
    want = {(None, None, 0)}
    for s in [*range(150), 999]:
        hops, front = {s: 0}, {s}
        for k in range(1, 5):
            front = {b for a, b in pairs if a in front} - hops.keys()
            hops |= dict.fromkeys(front, k)
        want |= {(s, n, h) for n, h in hops.items()}
    for bits in (64, 5):
        monkeypatch.setattr(G, "BITS", bits)
        got = G.reach(starts, edges, 4).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
