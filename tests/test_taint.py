import random

import pytest
from pyspark.sql import functions as F

from graniteloom.operators import taint


def graph(seed, nodes=40, rules=70):
    r = random.Random(seed)
    edges = sorted({(r.randrange(nodes), r.randrange(nodes)) for _ in range(70)})
    return edges, [(r.randrange(nodes), f"r{r.randrange(rules):02d}") for _ in range(25)], [(r.randrange(nodes), f"r{r.randrange(rules):02d}") for _ in range(60)]


def brute(edges, sinks, opened, depth):
    """(rule, source, sink): least of the shortest ways, by walking every way."""
    best = {}
    for source in {n for n, _ in opened}:
        ways = [(source,)]
        for _ in range(depth + 1):
            for way in ways:
                for rule in {r for n, r in sinks if n == way[-1]} & {r for n, r in opened if n == source}:
                    key = (rule, source, way[-1])
                    best[key] = min(best.get(key, (99, ())), (len(way), way))
            ways = [(*way, b) for way in ways for a, b in edges if a == way[-1]]
    return {k: list(v[1]) for k, v in best.items()}


def test_flows_by_rule_against_every_way(spark):
    """More rules than a word has bits, cycles, sources that are sinks, and nothing to find."""
    for seed, depth in ((1, 3), (2, 4)):
        edges, sinks, opened = graph(seed)
        everything = sinks + opened
        numbers = taint.numbered(spark.createDataFrame([(r,) for _, r in everything] + [(f"r{i:02d}",) for i in range(70)], "rule_id string"))
        assert numbers.agg(F.max("word")).first()[0] == 1
        label = lambda pairs: taint.labelled(spark.createDataFrame(pairs, "node long, rule_id string"), numbers, 2)  # noqa: B023, E731
        flows = taint.flows_by_rule(label(opened), label(sinks), spark.createDataFrame(edges, "a long, b long"), 2, depth)
        got = {(r["rule_id"], r["source"], r["sink"]): r["path"] for r in taint.by_rule(flows, numbers).collect()}
        assert got == brute(edges, sinks, opened, depth) and got
        assert taint.flows_by_rule(label(opened), label(sinks).limit(0), spark.createDataFrame(edges, "a long, b long"), 2, depth).count() == 0


def test_only_nodes_that_can_end_a_flow_are_visited(spark, monkeypatch):
    """A wide dead end and rules that a source is not open to cost no rows of the forward search."""
    edges = [(0, i) for i in range(100, 400)] + [(0, 1), (1, 2), (2, 3)] + [(i, i + 1000) for i in range(100, 400)]
    numbers = taint.numbered(spark.createDataFrame([("x",), ("y",)], "rule_id string"))
    label = lambda pairs: taint.labelled(spark.createDataFrame(pairs, "node long, rule_id string"), numbers, 1)
    rows, cut = [], taint.cut
    monkeypatch.setattr(taint, "cut", lambda d: (out := cut(d), "path" in d.columns and rows.append(out.count()))[0])
    flows = taint.flows_by_rule(label([(0, "x")]), label([(3, "x"), (1399, "y")]), spark.createDataFrame(edges, "a long, b long"), 1, 4)
    assert [(r["source"], r["sink"], r["path"]) for r in flows.collect()] == [(0, 3, [0, 1, 2, 3])] and sum(rows) == 4


def test_edges_through_calls(spark):
    maps = taint.propagation_maps(spark.createDataFrame([("f\t1,return;0,2",), ("g\tbad;1,2,3",), ("no tab",), ("h\t 1 , RETURN ;2, return",)], "value string"))
    assert sorted(map(tuple, maps.collect())) == [("f", 0, 2), ("f", 1, -1), ("h", 2, -1)]
    edges = [(1, 2, None, None, None), (3, 4, "f", 1, -1), (5, 6, "f", 1, 2), (7, 8, "g", 1, 2), (9, 10, "h", 2, -1), (11, 12, "h", 1, -1)]
    got = taint.through_calls(spark.createDataFrame(edges, "a long, b long, method string, arg int, to int"), maps)
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4), (7, 8), (9, 10)]


NODES = [
    (1, "parameter", "req", None, "HttpServletRequest", "m1", "f1", True),
    (2, "parameter", "name", None, "java.lang.String", "m1", "f1", True),
    (3, "parameter", "hidden", None, "java.lang.String", "m2", "f2", False),
    (4, "parameter", "this", None, "java.lang.String", "m2", "f2", True),
    (5, "source_call", None, "getParameter()", None, "m1", "f1", None),
    (6, "internal_parameter", "arg", None, None, "m3", "f2", None),
    (7, "field_access", None, " req.query.q", "java.lang.Object", "m1", "f1", None),
    (8, "field_access", None, "other.q", "java.lang.Object", "m1", "f1", None),
    (9, "index_access", None, "req[0]", "java.lang.Object", "m1", "f1", None),
    (10, "field_access", None, "this.path", "java.nio.file.Path", "m2", "f2", None),
    (11, "field_access", None, "this.log", "org.slf4j.Logger", "m2", "f2", None),
    (12, None, "x", "x", "java.lang.String", "m1", "f1", True),
]


@pytest.mark.parametrize(("mode", "want"), [("params", {1, 2, 3, 5, 6}), ("calls", {5, 6}), ("r2", {1, 2, 3, 5, 6, 7}), ("r2chain", {1, 2, 3, 5, 6, 7, 9}), ("java", {2, 5, 6, 10}), ("java_local", {2, 5, 6, 10}), ("java_file", {2, 5, 6, 10})])
def test_modes(spark, mode, want):
    nodes = spark.createDataFrame(NODES, "node long, kind string, name string, code string, type string, method string, file string, public boolean")
    found = taint.sources(nodes, mode)
    kinds = {r["node"]: r["source_kind"] for r in found.collect()}
    assert set(kinds) == want and found.columns == [*nodes.columns, "source_kind"]
    assert all(kinds.get(n, k) == k for n, k in ((2, "public_parameter"), (5, "explicit_source_api"), (6, "internal_parameter"), (7, "parameter_field_access"), (10, "instance_state")))
    sinks = spark.createDataFrame([(90, [1], "m1", "f1"), (91, [2], "m3", "f2")], "node long, labels array<long>, method string, file string")
    opened = {r["node"]: r["labels"] for r in taint.open_to(found, mode, sinks, 1).collect()}
    by = {"java_local": {2: [1], 5: [1], 6: [2]}, "java_file": {2: [1], 5: [1], 6: [2], 10: [2]}}
    assert opened == by.get(mode, dict.fromkeys(want, [-1]))
    with pytest.raises(ValueError, match="no such mode"):
        taint.sources(nodes, "all")


def test_sanitizers_by_category(spark):
    flows = spark.createDataFrame([("r", 1, [1, 2, 3, 2], "sqli"), ("s", 1, [1, 4], "xss")], "rule_id string, source long, path array<long>, category string")
    cleaners = spark.createDataFrame([(2, "sqli"), (3, "*"), (4, "sqli"), (3, "xss")], "node long, category string")
    got = {r["rule_id"]: (r["hits"], r["sanitized"]) for r in taint.sanitized(flows, cleaners, ["rule_id", "source"]).collect()}
    assert got == {"r": ([2, 3, 2], True), "s": ([], False)}


def test_marks_of_a_search_are_what_sanitized_finds(spark):
    """Cleaners of sources, middles and sinks, several of a node, of one category or all, over the flows of many rules."""
    edges, sinks, opened = graph(6)
    numbers = taint.numbered(spark.createDataFrame([(f"r{i:02d}",) for i in range(70)], "rule_id string"))
    label = lambda pairs: taint.labelled(spark.createDataFrame(pairs, "node long, rule_id string"), numbers, 2)
    cleaners = spark.createDataFrame([(n, c) for n in range(40) for c in "*012" if (n * 7 + ord(c)) % 9 == 0] + [(5, None)], "node long, category string")
    frame = spark.createDataFrame(edges, "a long, b long")
    category = (F.substring("rule_id", 3, 1).cast("int") % 3).cast("string")
    marked = taint.flows_by_rule(label(opened), label(sinks), frame, 2, 4, cleaners)
    plain = taint.flows_by_rule(label(opened), label(sinks), frame, 2, 4)
    assert [c for c in marked.columns if c not in plain.columns] == ["marks"]
    got = taint.cleaned(taint.by_rule(marked, numbers).withColumn("category", category))
    want = taint.sanitized(taint.by_rule(plain, numbers).withColumn("category", category), cleaners, ["rule_id", "source", "sink"])
    rows = lambda d: sorted(tuple(r[c] for c in ("rule_id", "source", "sink", "hops", "path", "category", "hits", "sanitized")) for r in d.collect())
    assert rows(got) == rows(want)
    assert {r["sanitized"] for r in got.collect()} == {True, False} and got.where("size(hits) > 1").count()


def test_needs_are_all_rules_within_a_number_of_edges(spark):
    edges, sinks, _ = graph(4, rules=3)
    numbers = taint.numbered(spark.createDataFrame([("r00",), ("r01",), ("r02",)], "rule_id string"))
    label = taint.labelled(spark.createDataFrame(sinks, "node long, rule_id string"), numbers, 1)
    want, bits = [{}], {f"r{i:02d}": 1 << i for i in range(3)}
    for node, rule in sinks:
        want[0][node] = want[0].get(node, 0) | bits[rule]
    for _ in range(3):
        want.append(dict(want[-1]))
        for a, b in edges:
            if b in want[-2]:
                want[-1][a] = want[-1].get(a, 0) | want[-2][b]
    got = taint.needs(label, spark.createDataFrame(edges, "a long, b long"), 1, 3).collect()
    assert [{r["node"]: r[f"need{h}_0"] for r in got if r[f"need{h}_0"]} for h in range(4)] == want and len(got) == len(want[3])


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_rows_of_flows_by_rule_are_not_shuffled(spark, sf_dir):
    """What cleans a flow comes with its way; a source's rules are joined before they are spread."""
    from graniteloom import plans

    assert not [line for line in exchanges(plans.queries()["rule_flows"](spark, sf_dir)) if "source" in line]
    assert not [line for line in exchanges(plans.queries()["rule_flow_counts"](spark, sf_dir)) if "rule_id" in line and "source" in line]


def test_sinks_of_rule_flows_are_looked_up_once(spark, sf_dir):
    """The rules a way ends with come from the search, so lines are not read and joined again for the result."""
    from graniteloom import plans

    assert "l_suppkey" not in plans.queries()["rule_flows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_search_shuffles_edges_once_and_no_first_step(spark, monkeypatch):
    """What nodes need is not written by itself, the sweep and the ways share the edges' shuffle, and a first step is not
    grouped: its ways are the only ones to their ends."""
    edges, sinks, opened = graph(5, rules=3)
    numbers = taint.numbered(spark.createDataFrame([("r00",), ("r01",), ("r02",)], "rule_id string"))
    label = lambda pairs: taint.labelled(spark.createDataFrame(pairs, "node long, rule_id string"), numbers, 1)
    frames, cut = [], taint.cut
    monkeypatch.setattr(taint, "cut", lambda d: (frames.append(d), cut(d))[1])
    found = taint.flows_by_rule(label(opened), label(sinks), spark.createDataFrame(edges, "a long, b long"), 1, 3)
    assert found.count() and not [d.columns for d in frames if "need0_0" in d.columns and "a" not in d.columns]
    ways, first = next(d for d in frames if "need0_0" in d.columns), [d for d in frames if "path" in d.columns][1]
    assert not [line for line in exchanges(first) if "source" in line]
    read = [line for line in ways._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line and "isnotnull(b#" in line]
    assert len(read) > 1 and all("isnotnull(a#" in line for line in read)


def test_lines_of_rule_flows_are_not_sorted(spark, sf_dir, monkeypatch):
    """Lines meet the open orders by hash; the orders that are no sinks do not come into it."""
    from graniteloom.plans import deciding

    frames, written = [], deciding.written
    monkeypatch.setattr(deciding, "written", lambda d: (frames.append(d), written(d))[1])
    deciding.rule_flows(spark, sf_dir)
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "ShuffledHashJoin" in line and "LeftSemi" in line]
    assert not [line for line in plan.splitlines() if "FileScan" in line and "o_custkey" in line and "o_orderstatus" not in line]
