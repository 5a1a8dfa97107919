"""Graph, evidence and decision queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graniteloom.operators import curation as C
from graniteloom.operators import findings as D
from graniteloom.operators import graphs as G
from graniteloom.operators import taint as TA
from graniteloom.operators.state import written
from graniteloom.plans.tables import table


def _calls(spark, sf_dir):
    """Orders as calls: their customer is the file, priority and status tell sources and sinks."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("file"), F.startswith("o_orderpriority", F.lit("1")).alias("param"), F.startswith("o_orderpriority", F.lit("2")).alias("call"), (F.col("o_orderstatus") == "P").alias("sink"))


def _data_edges(spark, sf_dir):
    """Data goes from a call to one of the next five, from even ones also to the seventh; an override sends every ninth to
    the second next alone."""
    calls = _calls(spark, sf_dir)
    plain = calls.select(F.col("node").alias("a"), (F.col("node") + F.col("file") % 5 + 1).alias("b")).unionByName(calls.where("node % 2 = 0").select(F.col("node").alias("a"), (F.col("node") + 7).alias("b")))
    rules = calls.where("node % 9 = 0").select(F.col("node").alias("a"), (F.col("node") + 2).alias("b"))
    return G.overridden_edges(plain, rules)


def _flows(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    found = G.flows(calls.where("param"), calls.where("sink"), _data_edges(spark, sf_dir), 4)
    return found.withColumn("sanitized", F.exists("path", lambda n: n % 11 == 0))


def reachable_flows(spark, sf_dir):
    """Shortest ways from sources to sinks, and whether a sanitizer lies on them."""
    return _flows(spark, sf_dir).select("source", "sink", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "sanitized")


def propagation_override(spark, sf_dir):
    """Edges by the number that leave a node, after the override."""
    out = _data_edges(spark, sf_dir).groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("b") - F.col("a")).alias("far"))
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("far").alias("far"))


def _code_nodes(spark, sf_dir):
    """Orders as nodes of code: their priority is the kind, sixteen neighbours are a method, their customer is the file."""
    o = table(spark, sf_dir, "orders")
    key, file, rank = F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
    kind = F.when(rank == "1", "parameter").when((rank == "2") & (key % 3 == 0), "source_call").when(rank == "3", "field_access").when(rank == "4", "index_access").when(key % 11 == 0, "internal_parameter")
    name = F.when(key % 8 == 0, "this").otherwise(F.concat(F.lit("p"), key % 4))
    code = F.when(key % 2 == 1, "this.f").otherwise(F.concat(F.lit("p"), key % 7, F.lit(".f")))
    type_ = F.when(file % 4 == 0, "java.lang.String").when(file % 4 == 1, "HttpServletRequestMap").when(file % 4 == 2, "int").otherwise("java.util.Map")
    return o.select(key.alias("node"), kind.alias("kind"), name.alias("name"), code.alias("code"), type_.alias("type"), F.expr("o_orderkey div 16").alias("method"), file.alias("file"), (file % 3 > 0).alias("public"))


def source_selection(spark, sf_dir):
    """Sources by mode and kind; in the modes that choose by place, those with a sink (an open order) there."""
    nodes = _code_nodes(spark, sf_dir)
    sinks = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.expr("o_orderkey div 16").alias("method"), F.col("o_custkey").alias("file"), F.array(F.lit(1).cast("long")).alias("labels"))
    every = None
    for mode in TA.MODES:
        found = TA.sources(nodes, mode)
        one = found.join(TA.open_to(found, mode, sinks, 1).select("node"), "node").groupBy(F.lit(mode).alias("mode"), "source_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("nodes"))
        every = one if every is None else every.unionByName(one)
    return every


#: How data goes through calls of some methods; the third and fourth line say nothing.
PROPAGATION = ("m0\t1,return;2,1", "m1\t0,return", "m2\tx,y", "m3")


def _rule_flows(spark, sf_dir, mode):
    """Flows of rules as labels, and their rows by rule: nations are the rules, regions their categories; an open order is a
    sink of its suppliers' nations."""
    nodes = _code_nodes(spark, sf_dir)
    numbers = TA.numbered(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id")))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("rule_id"))
    placed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 16").alias("method"), F.col("o_custkey").alias("file"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), "l_suppkey")
    pairs = lines.join(placed.select("node").hint("shuffle_hash"), "node", "left_semi").join(supplier, "l_suppkey").select("node", "rule_id")
    sinks = written(TA.labelled(pairs, numbers, 1).join(placed, "node"))
    inside = nodes.select(F.col("node").alias("a"), (F.col("node") + F.col("file") % 5 + 1).alias("b"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("long").alias("arg"), F.lit(None).cast("long").alias("to"))
    calls = nodes.where("node % 2 = 0").select(F.col("node").alias("a"), (F.col("node") + 7).alias("b"), F.concat(F.lit("m"), F.col("file") % 6).alias("method"), (F.col("node") % 3).alias("arg"), F.when(F.col("node") % 4 == 0, -1).otherwise(1).cast("long").alias("to"))
    maps = TA.propagation_maps(spark.range(1).select(F.explode(F.array(*map(F.lit, PROPAGATION))).alias("value")))
    edges = TA.through_calls(inside.unionByName(calls), maps)
    cleaners = nodes.where("node % 11 = 0").select("node", F.when(F.col("node") % 3 == 0, "*").otherwise((F.col("node") % 5).cast("string")).alias("category"))
    flows = TA.flows_by_rule(TA.open_to(TA.sources(nodes, mode), mode, sinks, 1), sinks, edges, 1, 4, cleaners)
    flows = flows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))  # once, not for each rule
    rules = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_regionkey").cast("string").alias("category"))
    return flows, numbers, TA.cleaned(TA.by_rule(flows, numbers).join(F.broadcast(rules), "rule_id"))


def rule_flows(spark, sf_dir):
    """The shortest way from a source to each sink of each rule with a sink in the source's file, and what cleans it."""
    found = _rule_flows(spark, sf_dir, "java_file")[2]
    return found.withColumn("hits", F.array_join(F.col("hits").cast("array<string>"), ">")).select("rule_id", "category", "source", "sink", "hops", "path", "hits", "sanitized")


def rule_flow_counts(spark, sf_dir):
    """Flows of every rule from all parameters, calls, and what is read from parameters. A source counts once for a rule and
    a number of hops, so its labels are joined before they are spread."""
    flows, numbers, found = _rule_flows(spark, sf_dir, "r2chain")
    ways = found.groupBy("rule_id", "hops").agg(F.count(F.lit(1)).alias("n"), F.count_if("sanitized").alias("sanitized"))
    starts = TA.by_rule(TA.labels_of(flows, ["source", "hops"], 1), numbers).groupBy("rule_id", "hops").agg(F.count(F.lit(1)).alias("sources"))
    return ways.join(starts, ["rule_id", "hops"])


def verdict_sanitized(spark, sf_dir):
    """The verdict on every customer's file; those whose id is divisible by 17 were not analysed."""
    owner = _calls(spark, sf_dir).select(F.col("node").alias("sink"), "file")
    flows = _flows(spark, sf_dir).select("sink", "sanitized").join(owner, "sink")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") % 17 != 0).alias("analysed"))
    return D.file_verdict(files, flows, "file", "sanitized").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("file").alias("files"))


def ancestor_walk(spark, sf_dir):
    """The nearest enclosing part of a kind, over a tree in which part k lies in part k div 3."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 3")).alias("parent"), "p_size")
    return G.enclosing(parts.select("node"), parts, F.col("p_size") % 6 == 0, 3)


def call_closure(spark, sf_dir):
    """Methods of a class (supplier) that its first one reaches in four calls, twelve at most, and how many of them have
    more than one definition."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 100 + F.col("l_partkey") % 20).alias("a"), (F.col("l_suppkey") * 100 + F.col("l_orderkey") % 20).alias("b"), "l_linenumber")
    twice = rows.groupBy(F.col("a").alias("node")).agg((F.count_distinct("l_linenumber") > 6).alias("ambiguous"))
    starts = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 100).alias("node"))
    found = G.reach(starts, rows.select("a", "b").distinct(), 4)
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("start").orderBy("hops", "node"))).join(twice, "node", "left")
    return ranked.groupBy("start").agg(F.count_if(F.col("at") <= 12).alias("methods"), F.count_if((F.col("at") <= 12) & F.col("ambiguous")).alias("ambiguous"), (F.count(F.lit(1)) > 12).alias("truncated"))


def suppression(spark, sf_dir):
    """Files with static evidence of safety and no tainted one."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or((F.col("value") > 50) & (F.col("event_type") == "error")).alias("static"), F.bool_or((F.col("value") > 220) & (F.col("event_type") != "error")).alias("tainted"))
    return kinds.groupBy((F.col("static") & ~F.col("tainted")).alias("suppressed")).agg(F.count(F.lit(1)).alias("n"))


def evidence_rows(spark, sf_dir):
    """Each piece of evidence with its verdict and fixed confidence, by kind."""
    kind = F.when(F.col("event_type") == "error", "static_asset").when(F.col("event_type") == "signup", "user_input").when(F.col("value") > 100, "prop_flow").otherwise("none")
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"))
    verdict = F.when(F.col("kind") == "static_asset", "safe").when(F.col("kind").isin("user_input", "prop_flow"), "tainted").otherwise("unknown")
    confidence = F.when(F.col("kind") == "static_asset", 0.95).when(F.col("kind") == "user_input", 0.9).when(F.col("kind") == "prop_flow", 0.7).otherwise(0.3)
    return rows.groupBy("kind", verdict.alias("verdict"), confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def import_resolve(spark, sf_dir):
    """The file that an import means: the first of its candidates that exists."""
    k = F.col("p_partkey") % 200
    imports = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("m"), k).alias("path"))
    names = spark.range(200).select(F.explode(F.filter(F.array(
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("m"), "id", F.lit(".ts"))), F.when((F.col("id") % 4 == 1) | (F.col("id") % 8 == 0), F.concat(F.lit("m"), "id", F.lit(".tsx"))),
        F.when(F.col("id") % 4 == 2, F.concat(F.lit("m"), "id", F.lit("/index.ts"))),
    ), lambda x: x.isNotNull())).alias("file"))
    tried = imports.select("p_partkey", F.posexplode(F.array(*(F.concat("path", F.lit(e)) for e in (".tsx", ".ts", "/index.ts")))).alias("rank", "file"))
    hit = tried.join(names, "file").groupBy("p_partkey").agg(F.min_by("file", "rank").alias("file"))
    return imports.join(hit, "p_partkey", "left").select("p_partkey", "file")


def prop_flow(spark, sf_dir):
    """Attributes of components that flow into a declared property of the imported file."""
    attributes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 15).alias("component"), F.col("l_linenumber").alias("prop")).distinct()
    imports = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("component")).withColumn("target", (F.col("file") + F.col("component")) % 50)
    declared = spark.range(50).select(F.col("id").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("prop")).where((F.col("target") + F.col("prop")) % 3 == 0)
    flows = attributes.join(imports, ["file", "component"]).join(declared, ["target", "prop"])
    return flows.groupBy("target", "prop").agg(F.count(F.lit(1)).alias("n"))


def context_extract(spark, sf_dir):
    """The first three words of each turn that are defined somewhere, with where."""
    defined = table(spark, sf_dir, "benchmark").select("item_id", F.explode(C.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.min("item_id").alias("item"))
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(C.tokens(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    first = words.groupBy("conv_id", "turn", "word").agg(F.min("pos").alias("pos")).join(defined, "word")
    ranked = first.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos"))).where("at <= 3")
    return ranked.select("conv_id", "turn", "at", "word", "item")


def template_expand(spark, sf_dir):
    """Entries joined with the templates of their class, one a language by hash, up to a limit."""
    entries = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 6).alias("cwe"))
    templates = spark.range(36).select(F.col("id").alias("template"), (F.col("id") % 5).alias("cwe"), F.when(F.col("id") % 3 == 0, "java").otherwise("python").alias("lang"))
    met = entries.join(F.broadcast(templates), "cwe")
    pick = F.md5(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("template").cast("string")))
    one = met.groupBy("o_orderkey", "lang").agg(F.min_by("template", pick).alias("template"))
    return one.orderBy("o_orderkey", "lang").limit(200)


def _findings(spark, sf_dir):
    """Order lines as findings of three engines, each with a path of lines to its own."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 120).alias("line"), F.col("l_quantity").cast("int").alias("weight"),
        F.when(F.col("l_returnflag") == "A", "graph").when(F.col("l_returnflag") == "N", "rules").otherwise("review").alias("engine"), F.col("l_linestatus").alias("status"),
    )
    return rows.withColumn("path", F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: (F.col("line") + i * 2).cast("long")))


def tier(spark, sf_dir):
    """Findings by how they meet the true line of their file."""
    f = _findings(spark, sf_dir)
    return f.groupBy(D.tier(F.col("line"), F.col("path"), F.col("file") % 120).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def critic_filter(spark, sf_dir):
    """Findings of each engine by what becomes of them under a critic."""
    f = _findings(spark, sf_dir)
    w, line = F.col("weight"), F.col("line")
    verdict = F.when(w % 4 == 0, "FALSE").when(w % 4 == 1, "TRUE").when(w % 4 == 2, "UNCERTAIN")
    basis = F.when(w % 5 == 1, line + 38).when(w % 5 > 1, line + w % 12)
    made = D.reviewed(verdict, F.when(w % 3 > 0, "High").otherwise("low"), basis, [line, F.when(F.col("l_linenumber") % 2 == 0, line + 40)], F.when(w % 7 > 0, "not reachable").otherwise(" "), w % 11 > 0)
    return f.select("engine", made.alias("c")).groupBy("engine", "c.verdict", "c.original", "c.suppressed").agg(F.count(F.lit(1)).alias("n"))


LANGUAGE_POLICIES = {"en": "TRUST_ENGINE", "de": "ENGINE_AS_SIGNAL", "fr": "ENGINE_AS_SIGNAL", "_default": "NO_BETTER"}


def policy_aggregate(spark, sf_dir):
    """Results by the policy of a language; every fourth length has no score, every seventh no engine verdict."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    d = D.by_language(d, LANGUAGE_POLICIES, "lang", "policy")
    n = F.col("n_chars")
    score, engine = F.when(n % 4 > 0, (n % 100) / 100), F.when(n % 7 == 0, "vuln").when(n % 7 > 1, "safe")
    graph = F.when(F.col("doc_id") % 6 == 0, "vuln").otherwise("unknown")
    made = D.policy(F.col("policy"), n % 5 == 0, score, engine, graph, F.lit(0.25), F.lit(0.6))
    return d.select("policy", made.alias("r")).groupBy("policy", "r.detected", "r.source", "r.status", "r.policy_fallback").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.score"), 6).alias("score"))


def evidence_rank(spark, sf_dir):
    """The best finding of each file by seven keys, and how many it has."""
    f = _findings(spark, sf_dir).withColumns({"critic": (F.col("weight") % 3).cast("int"), "kind": F.when(F.col("engine") == "graph", 0).when(F.col("engine") == "rules", 1).otherwise(2)})
    order = ["critic", "kind", F.size("path"), -F.col("weight"), "status", "line", "l_orderkey"]
    return D.best_per_file(f, "file", order).select("file", "line", "engine", "weight", "n_findings")


def query_dedup(spark, sf_dir):
    """One finding a (file, status, line): the one of the least order and number, with its path's length."""
    f = _findings(spark, sf_dir).withColumn("steps", F.size("path"))
    least = F.min(F.struct("l_orderkey", "l_linenumber", "steps"))
    return f.groupBy("file", "status", "line").agg(least.alias("x")).select("file", "status", "line", F.col("x.l_orderkey").alias("l_orderkey"), F.col("x.steps").alias("steps"))


def advisory(spark, sf_dir):
    """Findings with advisory evidence beside them; verdicts stay what they were."""
    f = _findings(spark, sf_dir).select("file", "line", F.when(F.col("weight") > 25, "vuln").otherwise("safe").alias("verdict"))
    notes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("file"), F.struct(F.round("s_acctbal", 0).alias("score"), F.col("s_nationkey").alias("origin")).alias("advice"))
    return f.join(notes, "file", "left").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count("advice").alias("advised"), F.sum("advice.score").alias("score"))


def two_pass(spark, sf_dir):
    """Files by the pass that gave a result: raw, wrapped, or none."""
    inputs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    first = inputs.where("n_chars % 3 = 0").select("doc_id", F.lit("raw").alias("how"))
    second = inputs.where("n_chars % 2 = 0").select("doc_id", F.lit("wrapped").alias("how"))
    return D.retried(inputs.select("doc_id"), first, second, "doc_id").groupBy("how", "passes").agg(F.count(F.lit(1)).alias("n"))


STAGED = D.Patterns(
    primitives=[("weak", ["###"], ["[$]{3}"], ["%%%"]), ("secret", ["token ?= ?[A-Za-z0-9]{6,}"], [], [])],
    sources={"en": [r"\bthe\b", "(?i)^of"], "de": ["und"], "fr": ["que"]},
    sinks={"first": {"en": ["tion", "ing"], "de": ["zu"]}, "query": {"en": ["er"], "de": ["ver"], "fr": ["ment"]}, "last": {"fr": ["eux"]}},
    cleaners={"first": ["shh", "ich"], "query": ["[0-9] ?[)]", "ble"]},
    needs={"query": ["[0-9]"]},
    bound=("query", ["[0-9]{2}"], ["@"]),
)


def multi_taint(spark, sf_dir):
    """The staged verdict on every document, its language's words being sources and sinks."""
    rows = table(spark, sf_dir, "documents").select("lang", D.staged_verdict(F.coalesce("text", F.lit("")), F.col("lang"), STAGED).alias("v"))
    return rows.groupBy("lang", "v.verdict", "v.category", "v.strong").agg(F.count(F.lit(1)).alias("n"))


def decoy_verdict(spark, sf_dir):
    """Values that may be tainted and overwritten, either of which may be unknown."""
    tainted = F.when(F.col("event_id") % 5 > 0, F.col("value") > 100)
    overwritten = F.when(F.col("event_id") % 7 > 0, F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy(D.three_valued(tainted, overwritten).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def context_attach(spark, sf_dir):
    """Findings in batches of 128 with the context of their file, and a status where it is missing."""
    f = C.rank_in_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "at")
    context = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("context"))
    met = f.join(context, "o_custkey", "left").select(F.expr("(at - 1) div 128").alias("batch"), F.when(F.col("context").isNull(), "missing").otherwise("ok").alias("status"))
    return met.groupBy("batch", "status").agg(F.count(F.lit(1)).alias("n"))


def budget_visible(spark, sf_dir):
    """Lines within a budget of tokens, and whether the line of interest is among them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 6).cast("int").alias("line"))
    return C.visible_prefix(rows, "doc_id", "text", "line", 120, lambda t: F.regexp_count(t, F.lit("[^ ]+")))


def graph_merge(spark, sf_dir):
    """Edges of two graphs merged twice: what is known stays, and the second time adds nothing."""
    known = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("w"))
    new = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (-F.col("o_orderkey")).alias("w"))
    once = G.merged_graph(known, new, ["o_custkey", "o_orderpriority"])
    return G.merged_graph(once, new, ["o_custkey", "o_orderpriority"])


def window_merge(spark, sf_dir):
    """Findings of overlapping windows, one a (file, line): an accepted one before the others, then by window."""
    f = _findings(spark, sf_dir).select("file", "line", (F.col("weight") <= 25).alias("open"), F.col("l_linenumber").alias("window"), "engine", "l_orderkey")
    return C.dedup_first(f, ["file", "line"], ["open", "window", "engine", "l_orderkey"])


def live_calls(spark, sf_dir):
    """Findings that no sanitizer takes away, of calls whose target is known."""
    flows = _flows(spark, sf_dir).where("NOT sanitized")
    calls = _calls(spark, sf_dir).select(F.col("node").alias("sink"), F.when(F.col("file") % 7 == 0, "<unresolved>").otherwise(F.concat(F.lit("m"), F.col("file") % 5)).alias("target"))
    return flows.join(calls, "sink").where("target <> '<unresolved>'").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        reachable_flows, propagation_override, source_selection, rule_flows, rule_flow_counts, verdict_sanitized, ancestor_walk, call_closure, suppression, evidence_rows, import_resolve, prop_flow, context_extract,
        template_expand, tier, critic_filter, policy_aggregate, evidence_rank, query_dedup, advisory, two_pass, multi_taint, decoy_verdict, context_attach, budget_visible, graph_merge, window_merge, live_calls,
    )
}

CALLS = """c AS (SELECT o_orderkey AS node, o_custkey AS file, o_orderpriority[1] = '1' AS param, o_orderpriority[1] = '2' AS call, o_orderstatus = 'P' AS sink FROM orders),
    e AS (SELECT DISTINCT a, b FROM (SELECT node AS a, node + file % 5 + 1 AS b FROM c WHERE node % 9 <> 0 UNION ALL SELECT node, node + 7 FROM c WHERE node % 2 = 0 AND node % 9 <> 0 UNION ALL SELECT node, node + 2 FROM c WHERE node % 9 = 0))"""
FLOWS = f"""WITH RECURSIVE {CALLS}, w AS (SELECT node AS source, node, [node] AS path FROM c WHERE param UNION ALL SELECT source, b, list_append(path, b) FROM w JOIN e ON a = node WHERE len(path) < 5),
    f AS (SELECT source, w.node AS sink, path, len(list_filter(path, lambda x: x % 11 = 0)) > 0 AS sanitized FROM w JOIN c ON c.node = w.node AND sink QUALIFY row_number() OVER (PARTITION BY source, w.node ORDER BY len(path), path) = 1)"""
CODE_NODES = """n AS (SELECT o_orderkey AS node, o_custkey AS file, o_orderkey // 16 AS method, o_orderstatus = 'P' AS sink, o_custkey % 3 > 0 AS public,
    CASE WHEN o_orderpriority[1] = '1' THEN 'parameter' WHEN o_orderpriority[1] = '2' AND o_orderkey % 3 = 0 THEN 'source_call' WHEN o_orderpriority[1] = '3' THEN 'field_access' WHEN o_orderpriority[1] = '4' THEN 'index_access' WHEN o_orderkey % 11 = 0 THEN 'internal_parameter' END AS kind,
    CASE WHEN o_orderkey % 8 = 0 THEN 'this' ELSE 'p' || o_orderkey % 4 END AS name, o_orderkey % 2 = 1 AS own, 'p' || o_orderkey % 7 AS root, o_custkey % 4 IN (0, 3) AS data FROM orders)"""
MODE_SOURCES = """m AS (SELECT * FROM (VALUES ('params'), ('calls'), ('r2'), ('r2chain'), ('java'), ('java_local'), ('java_file')) v(mode)),
    s AS (SELECT mode, node, method, file, CASE WHEN kind = 'parameter' AND name <> 'this' AND mode <> 'calls' AND (mode NOT LIKE 'java%' OR public AND data) THEN 'public_parameter' WHEN kind = 'internal_parameter' THEN kind WHEN kind = 'source_call' THEN 'explicit_source_api'
      WHEN mode LIKE 'java%' AND kind = 'field_access' AND own AND data THEN 'instance_state'
      WHEN mode LIKE 'r2%' AND (kind = 'field_access' OR mode = 'r2chain' AND kind = 'index_access') AND NOT own AND EXISTS (SELECT 1 FROM n q WHERE q.method = n.method AND q.kind = 'parameter' AND q.name = n.root) THEN 'parameter_field_access' END AS source_kind FROM n, m WHERE source_kind IS NOT NULL)"""
RULE_FLOWS = f"""WITH RECURSIVE {CODE_NODES}, {MODE_SOURCES},
    t AS (SELECT node, node + 7 AS b, 'm' || file % 6 AS m, node % 3 AS arg, CASE WHEN node % 4 = 0 THEN -1 ELSE 1 END AS too FROM n WHERE node % 2 = 0),
    e AS (SELECT node AS a, node + file % 5 + 1 AS b FROM n UNION SELECT node, b FROM t WHERE m NOT IN ('m0', 'm1') OR (m, arg, too) IN (('m0', 1, -1), ('m0', 2, 1), ('m1', 0, -1))),
    sr AS (SELECT DISTINCT l_orderkey AS node, s_nationkey AS rule_id FROM lineitem JOIN n ON node = l_orderkey AND sink JOIN supplier ON s_suppkey = l_suppkey),
    w AS (SELECT DISTINCT node AS source, node, [node] AS path FROM s WHERE mode = '{{mode}}' UNION ALL SELECT source, b, list_append(path, b) FROM w JOIN e ON a = node WHERE len(path) < 5),
    f AS (SELECT source, w.node AS sink, path FROM w JOIN n ON n.node = w.node AND sink QUALIFY row_number() OVER (PARTITION BY source, w.node ORDER BY len(path), path) = 1)"""
RULE_HITS = """h AS (SELECT g.*, CAST(n_regionkey AS VARCHAR) AS category, list_filter(path, lambda x: x % 11 = 0 AND (x % 3 = 0 OR x % 5 = n_regionkey)) AS hits FROM g JOIN nation ON n_nationkey = rule_id)"""
FOUND = """WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey AS file, l_partkey % 120 AS line, CAST(l_quantity AS INTEGER) AS weight, CASE l_returnflag WHEN 'A' THEN 'graph' WHEN 'N' THEN 'rules' ELSE 'review' END AS engine, l_linestatus AS status FROM lineitem)"""

ORACLE = {
    "reachable_flows": f"{FLOWS} SELECT source, sink, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path, sanitized FROM f",
    "propagation_override": f"WITH {CALLS}, x AS (SELECT node AS a, node + file % 5 + 1 AS b FROM c WHERE node % 9 <> 0 UNION ALL SELECT node, node + 7 FROM c WHERE node % 2 = 0 AND node % 9 <> 0 UNION ALL SELECT node, node + 2 FROM c WHERE node % 9 = 0), k AS (SELECT a, count(*) AS k, max(b - a) AS far FROM x GROUP BY 1) SELECT k, count(*) AS n, CAST(sum(far) AS BIGINT) AS far FROM k GROUP BY 1",
    "source_selection": f"""WITH {CODE_NODES}, place AS (SELECT node // 16 AS method, file FROM n WHERE sink), {MODE_SOURCES}
        SELECT mode, source_kind, count(*) AS n, CAST(sum(node) AS BIGINT) AS nodes FROM s
        WHERE CASE mode WHEN 'java_local' THEN method IN (SELECT method FROM place) WHEN 'java_file' THEN file IN (SELECT file FROM place) ELSE true END GROUP BY 1, 2""",
    "rule_flows": f"""{RULE_FLOWS.format(mode="java_file")}, g AS (SELECT f.*, rule_id FROM f JOIN sr ON sr.node = sink JOIN n ON n.node = source WHERE EXISTS (SELECT 1 FROM sr x JOIN n y ON y.node = x.node WHERE x.rule_id = sr.rule_id AND y.file = n.file)), {RULE_HITS}
        SELECT rule_id, category, source, sink, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path, array_to_string(hits, '>') AS hits, len(hits) > 0 AS sanitized FROM h""",
    "rule_flow_counts": f"""{RULE_FLOWS.format(mode="r2chain")}, g AS (SELECT f.*, rule_id FROM f JOIN sr ON sr.node = sink), {RULE_HITS}
        SELECT rule_id, CAST(len(path) - 1 AS INTEGER) AS hops, count(*) AS n, count(*) FILTER (len(hits) > 0) AS sanitized, count(DISTINCT source) AS sources FROM h GROUP BY 1, 2""",
    "verdict_sanitized": f"""{FLOWS}, s AS (SELECT c.file, bool_or(NOT sanitized) AS live FROM f JOIN c ON c.node = f.sink GROUP BY 1), v AS (SELECT c_custkey AS file, CASE WHEN c_custkey % 17 = 0 THEN 'unknown' WHEN live THEN 'vuln' WHEN live IS NOT NULL THEN 'safe_sanitized' ELSE 'safe' END AS verdict FROM customer LEFT JOIN s ON s.file = c_custkey)
        SELECT verdict, count(*) AS n, CAST(sum(file) AS BIGINT) AS files FROM v GROUP BY 1""",
    "ancestor_walk": """WITH RECURSIVE w AS (SELECT p_partkey AS node, p_partkey AS here, 0 AS levels FROM part UNION ALL SELECT node, here // 3, levels + 1 FROM w JOIN part ON p_partkey = here WHERE levels < 3 AND here > 0 AND p_size % 6 <> 0),
        l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY levels DESC) = 1) SELECT node, CASE WHEN p_size % 6 = 0 THEN here END AS ancestor, levels FROM l JOIN part ON p_partkey = here""",
    "call_closure": """WITH RECURSIVE r AS (SELECT l_suppkey * 100 + l_partkey % 20 AS a, l_suppkey * 100 + l_orderkey % 20 AS b, l_linenumber FROM lineitem), e AS (SELECT DISTINCT a, b FROM r), t AS (SELECT a AS node, count(DISTINCT l_linenumber) > 6 AS twice FROM r GROUP BY 1),
        w AS (SELECT s_suppkey * 100 AS start, s_suppkey * 100 AS node, 0 AS hops FROM supplier UNION SELECT start, b, hops + 1 FROM w JOIN e ON a = node WHERE hops < 4), m AS (SELECT start, node, min(hops) AS hops FROM w GROUP BY 1, 2),
        k AS (SELECT m.*, coalesce(twice, false) AS twice, row_number() OVER (PARTITION BY start ORDER BY hops, m.node) AS r FROM m LEFT JOIN t ON t.node = m.node) SELECT start, count(*) FILTER (r <= 12) AS methods, count(*) FILTER (r <= 12 AND twice) AS ambiguous, count(*) > 12 AS truncated FROM k GROUP BY 1""",
    "suppression": """WITH u AS (SELECT user_id, bool_or(value > 50 AND event_type = 'error') AS s, bool_or(value > 220 AND event_type <> 'error') AS t FROM events GROUP BY 1) SELECT s AND NOT t AS suppressed, count(*) AS n FROM u GROUP BY 1""",
    "evidence_rows": """WITH k AS (SELECT CASE WHEN event_type = 'error' THEN 'static_asset' WHEN event_type = 'signup' THEN 'user_input' WHEN value > 100 THEN 'prop_flow' ELSE 'none' END AS kind FROM events)
        SELECT kind, CASE kind WHEN 'static_asset' THEN 'safe' WHEN 'none' THEN 'unknown' ELSE 'tainted' END AS verdict, CAST(CASE kind WHEN 'static_asset' THEN 0.95 WHEN 'user_input' THEN 0.9 WHEN 'prop_flow' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS confidence, count(*) AS n FROM k GROUP BY ALL""",
    "import_resolve": """SELECT p_partkey, CASE WHEN k % 8 = 0 OR k % 4 = 1 THEN 'm' || k || '.tsx' WHEN k % 4 = 0 THEN 'm' || k || '.ts' WHEN k % 4 = 2 THEN 'm' || k || '/index.ts' END AS file FROM (SELECT p_partkey, p_partkey % 200 AS k FROM part)""",
    "prop_flow": """WITH a AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 15 AS component, l_linenumber AS prop FROM lineitem) SELECT (file + component) % 50 AS target, prop, count(*) AS n FROM a JOIN supplier ON s_suppkey = file
        WHERE component < 10 AND ((file + component) % 50 + prop) % 3 = 0 GROUP BY 1, 2""",
    "context_extract": """WITH d AS (SELECT word, min(item_id) AS item FROM (SELECT item_id, unnest(string_split(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), ' ')) AS word FROM benchmark) GROUP BY 1),
        t AS (SELECT conv_id, turn, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n]+', ' ', 'g')), ' ') AS w FROM conversations), f AS (SELECT conv_id, turn, word, min(pos) AS pos FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t) GROUP BY 1, 2, 3)
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS at, f.word, item FROM f JOIN d ON d.word = f.word QUALIFY at <= 3""".replace(" AS at,", ' AS "at",').replace("QUALIFY at", 'QUALIFY "at"'),
    "template_expand": """WITH t AS (SELECT i AS template, i % 5 AS cwe, CASE WHEN i % 3 = 0 THEN 'java' ELSE 'python' END AS lang FROM range(36) r(i)), m AS (SELECT o_orderkey, lang, template, row_number() OVER (PARTITION BY o_orderkey, lang ORDER BY md5(o_orderkey || ':' || template)) AS r FROM orders JOIN t ON t.cwe = o_custkey % 6)
        SELECT o_orderkey, lang, template FROM m WHERE r = 1 ORDER BY o_orderkey, lang LIMIT 200""",
    "tier": f"{FOUND} SELECT CASE WHEN line = file % 120 THEN 'exact' WHEN file % 120 > line AND (file % 120 - line) % 2 = 0 AND (file % 120 - line) // 2 <= l_linenumber THEN 'path_hit' WHEN abs(line - file % 120) <= 5 THEN 'near' ELSE 'miss' END AS tier, count(*) AS n FROM f GROUP BY 1",
    "critic_filter": f"""{FOUND}, v AS (SELECT engine, CASE weight % 4 WHEN 0 THEN 'FALSE' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'UNCERTAIN' END AS v, weight % 11 > 0 AS ok, CASE weight % 5 WHEN 0 THEN NULL WHEN 1 THEN line + 38 ELSE line + weight % 12 END AS basis, line, CASE WHEN l_linenumber % 2 = 0 THEN line + 40 END AS source_line, weight FROM f),
        g AS (SELECT *, coalesce(v = 'FALSE' AND weight % 3 > 0 AND weight % 7 > 0 AND (coalesce(line > 0 AND basis >= greatest(1, line - 6) AND basis <= line + 6, false) OR coalesce(basis >= greatest(1, source_line - 6) AND basis <= source_line + 6, false)), false) AS grounded FROM v)
        SELECT engine, CASE WHEN NOT ok OR v IS NULL THEN 'UNJUDGED' WHEN v = 'FALSE' AND NOT grounded THEN 'UNCERTAIN' ELSE v END AS verdict, CASE WHEN ok AND v = 'FALSE' AND NOT grounded THEN 'FALSE' END AS original, ok AND grounded AS suppressed, count(*) AS n FROM g GROUP BY 1, 2, 3, 4""",
    "policy_aggregate": """WITH d AS (SELECT CASE lang WHEN 'en' THEN 'TRUST_ENGINE' WHEN 'de' THEN 'ENGINE_AS_SIGNAL' WHEN 'fr' THEN 'ENGINE_AS_SIGNAL' ELSE 'NO_BETTER' END AS policy, n_chars % 5 = 0 AS llm, CASE WHEN n_chars % 4 > 0 THEN (n_chars % 100) / CAST(100 AS DOUBLE) END AS score,
          n_chars % 7 <> 1 AS ran, n_chars % 7 = 0 AS hit, doc_id % 6 = 0 AS graph FROM documents),
        trust AS (SELECT policy, hit OR llm OR graph AS detected, CASE WHEN hit THEN 'engine' WHEN llm THEN 'llm' WHEN graph THEN 'graph' ELSE 'llm' END AS source, CASE WHEN ran THEN 'DONE' ELSE 'PARTIAL' END AS status, score, false AS policy_fallback FROM d WHERE policy = 'TRUST_ENGINE'),
        moved AS (SELECT *, score + CASE WHEN hit THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS s FROM d WHERE policy = 'ENGINE_AS_SIGNAL' AND score IS NOT NULL),
        signal AS (SELECT policy, s >= CAST(0.6 AS DOUBLE) OR graph AS detected, CASE WHEN s >= CAST(0.6 AS DOUBLE) THEN 'llm+engine' WHEN graph THEN 'graph' ELSE 'llm+engine' END AS source, CASE WHEN ran THEN 'DONE' ELSE 'PARTIAL' END AS status, s AS score, false AS policy_fallback FROM moved),
        rest AS (SELECT policy, llm OR graph AS detected, CASE WHEN llm THEN 'llm' WHEN graph THEN 'graph' ELSE 'llm' END AS source, 'DONE' AS status, score, policy <> 'NO_BETTER' AS policy_fallback FROM d WHERE policy = 'NO_BETTER' OR policy = 'ENGINE_AS_SIGNAL' AND score IS NULL)
        SELECT policy, detected, source, status, policy_fallback, count(*) AS n, round(sum(score), 6) AS score FROM (FROM trust UNION ALL FROM signal UNION ALL FROM rest) GROUP BY 1, 2, 3, 4, 5""",
    "evidence_rank": f"""{FOUND} SELECT file, line, engine, weight, n_findings FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n_findings, row_number() OVER (PARTITION BY file ORDER BY weight % 3, CASE engine WHEN 'graph' THEN 0 WHEN 'rules' THEN 1 ELSE 2 END, l_linenumber, weight DESC, status, line, l_orderkey) AS r FROM f) WHERE r = 1""",
    "query_dedup": f"{FOUND} SELECT file, status, line, l_orderkey, l_linenumber AS steps FROM f QUALIFY row_number() OVER (PARTITION BY file, status, line ORDER BY l_orderkey, l_linenumber) = 1",
    "advisory": f"""{FOUND} SELECT CASE WHEN weight > 25 THEN 'vuln' ELSE 'safe' END AS verdict, count(*) AS n, count(s_suppkey) AS advised, sum(round(s_acctbal, 0)) AS score FROM f LEFT JOIN supplier ON s_suppkey = file AND s_acctbal > 0 GROUP BY 1""",
    "two_pass": "SELECT CASE WHEN n_chars % 3 = 0 THEN 'raw' WHEN n_chars % 2 = 0 THEN 'wrapped' END AS how, CASE WHEN n_chars % 3 = 0 THEN 1 WHEN n_chars % 2 = 0 THEN 2 ELSE 0 END AS passes, count(*) AS n FROM documents GROUP BY 1, 2",
    "multi_taint": r"""WITH t AS (SELECT lang, coalesce(text, '') AS t FROM documents), f AS (SELECT lang, lang IN ('en', 'de', 'fr') AS known, regexp_matches(t, '###') AND NOT regexp_matches(t, '[$]{3}') AS weak, regexp_matches(t, '%%%') AS ctx, regexp_matches(t, 'token ?= ?[A-Za-z0-9]{6,}') AS secret,
          regexp_matches(t, '[0-9]{2}') AND NOT regexp_matches(t, '@') AS bound, regexp_matches(t, '[0-9] ?[)]|ble') AS clean_q, regexp_matches(t, 'shh|ich') AS clean_f, regexp_matches(t, '[0-9]') AS digit,
          CASE lang WHEN 'en' THEN regexp_matches(t, '\bthe\b|^[Oo][Ff]') WHEN 'de' THEN contains(t, 'und') WHEN 'fr' THEN contains(t, 'que') ELSE false END AS src,
          CASE lang WHEN 'en' THEN regexp_matches(t, 'tion|ing') WHEN 'de' THEN contains(t, 'zu') ELSE false END AS sink_f, CASE lang WHEN 'en' THEN contains(t, 'er') WHEN 'de' THEN contains(t, 'ver') WHEN 'fr' THEN contains(t, 'ment') ELSE false END AS sink_q, lang = 'fr' AND contains(t, 'eux') AS sink_l FROM t),
        v AS (SELECT lang, CASE WHEN NOT known THEN ('unknown', '?', false) WHEN weak AND ctx THEN ('vuln', 'weak', false) WHEN weak THEN ('unknown', 'weak', false) WHEN secret THEN ('vuln', 'secret', false) WHEN bound AND clean_q THEN ('safe', 'query', true)
          WHEN sink_f AND clean_f THEN ('safe', 'first', true) WHEN sink_f AND src THEN ('vuln', 'first', false) WHEN sink_f THEN ('unknown', 'first', false) WHEN sink_q AND digit AND clean_q THEN ('safe', 'query', true) WHEN sink_q AND digit AND src THEN ('vuln', 'query', false)
          WHEN sink_q AND digit THEN ('unknown', 'query', false) WHEN sink_l AND src THEN ('vuln', 'last', false) WHEN sink_l THEN ('unknown', 'last', false) ELSE ('unknown', '?', false) END AS v FROM f)
        SELECT lang, v[1] AS verdict, v[2] AS category, v[3] AS strong, count(*) AS n FROM v GROUP BY 1, 2, 3, 4""",
    "decoy_verdict": """WITH e AS (SELECT CASE WHEN event_id % 5 > 0 THEN value > 100 END AS t, CASE WHEN event_id % 7 > 0 THEN event_type = 'error' END AS o FROM events), v AS (SELECT t AND NOT o AS live FROM e) SELECT CASE WHEN live THEN 'vuln' WHEN NOT live THEN 'safe' ELSE 'unknown' END AS verdict, count(*) AS n FROM v GROUP BY 1""",
    "context_attach": """WITH r AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS batch, c_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0) SELECT batch, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM r GROUP BY 1, 2""",
    "budget_visible": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        s AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '[^ ]+')) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM l), k AS (SELECT doc_id, count(*) FILTER (t <= 120) AS lines_kept, coalesce(max(t) FILTER (t <= 120), 0) AS tokens_kept FROM s GROUP BY 1)
        SELECT *, doc_id % 6 > 0 AND doc_id % 6 <= lines_kept AS visible FROM k""",
    "window_merge": f"""{FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY weight <= 25, l_linenumber, engine, l_orderkey) AS r, count(*) OVER (PARTITION BY file, line) AS n_copies FROM f)
        SELECT file, line, weight <= 25 AS open, l_linenumber AS "window", engine, l_orderkey, n_copies FROM r WHERE r = 1""",
    "live_calls": f"{FLOWS} SELECT 'm' || c.file % 5 AS target, count(*) AS n FROM f JOIN c ON c.node = f.sink WHERE NOT sanitized AND c.file % 7 <> 0 GROUP BY 1",
    "graph_merge": "SELECT o_custkey, o_orderpriority, coalesce(min(o_orderkey) FILTER (o_orderkey % 2 = 0), -max(o_orderkey)) AS w FROM orders GROUP BY 1, 2",
}
