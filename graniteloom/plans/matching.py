"""Joins, windows, graph, finding and retrieval queries, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graniteloom.operators import findings as D
from graniteloom.operators import graphs as G
from graniteloom.operators import joins as J
from graniteloom.operators import retrieval as R
from graniteloom.operators.curation import rank_in_order
from graniteloom.plans.tables import table


def hash_lookup(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def fallback_join(spark, sf_dir):
    """A rate by exact (part, supplier) where there is one, else by part."""
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.where("l_quantity > 45").groupBy(F.concat_ws(":", "l_partkey", "l_suppkey").alias("k")).agg(F.max("l_linenumber").alias("v"))
    wild = lines.groupBy(F.col("l_partkey").alias("w")).agg(F.min("l_linenumber").alias("v"))
    keyed = lines.select("l_orderkey", "l_linenumber", F.concat_ws(":", "l_partkey", "l_suppkey").alias("k"), F.col("l_partkey").alias("w"))
    return J.first_of(keyed, exact, wild, "k", "w", "v").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def key_intersection(spark, sf_dir):
    one = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    two = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey").distinct()
    return one.join(two, "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


def semi_allowlist(spark, sf_dir):
    allowed = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(allowed, "l_partkey", "left_semi").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def left_default(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def ordinal_join(spark, sf_dir):
    """Two files of equal order: rows are numbered by their order and joined by the number; rows whose keys disagree are
    counted."""
    orders = table(spark, sf_dir, "orders")
    one = rank_in_order(orders.select("o_orderkey", F.col("o_custkey").alias("a")), ["o_orderkey"], "at")
    two = rank_in_order(orders.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, -1).otherwise(F.col("o_custkey")).alias("b")), ["o_orderkey"], "at")
    return one.select("at", "a").join(two.select("at", "b"), "at", "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("misaligned"))


def _spans(spark, sf_dir):
    """A span of its user's time for every event, of 20,000 to a million seconds."""
    at = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("name"), at.alias("start"), (at + (F.col("event_id") % 50 + 1) * 20000).alias("stop"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("at"))


def interval_containment(spark, sf_dir):
    met = J.containing(_points(spark, sf_dir), _spans(spark, sf_dir), ["user_id"], "at", "start", "stop", 200_000)
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


def smallest_enclosing(spark, sf_dir):
    return J.smallest_enclosing(_points(spark, sf_dir), _spans(spark, sf_dir), ["user_id"], "id", "at", "name", "start", "stop", 200_000)


def _ends(spark, sf_dir):
    operator = (F.col("name") % 3 == 0).alias("operator")
    return _spans(spark, sf_dir).select("user_id", F.col("stop").alias("b"), "name", operator)


def tolerance_join(spark, sf_dir):
    """Whether a span of the user ends near each event."""
    return J.has_near(_points(spark, sf_dir), _ends(spark, sf_dir), ["user_id"], "id", "at", "b", 5_000)


def nearest_line(spark, sf_dir):
    """The end of a span nearest to each event: one not before it first, then by distance, then no operator."""
    return J.nearest(_points(spark, sf_dir), _ends(spark, sf_dir), ["user_id"], "id", "at", "b", "operator", "name", 100_000)


def line_ladder(spark, sf_dir):
    """Truths (every line of every order) with another line of the order within 0, 1, 3 and 10: all, and those in and out
    of sight (the first four lines)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    guess = lines.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_partkey").alias("guess"))
    gap = lines.join(guess, "l_orderkey").where("l_linenumber <> other").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.abs(F.col("l_partkey") - F.col("guess"))).alias("gap"))
    known = lines.join(gap, ["l_orderkey", "l_linenumber"], "left").select("gap", (F.col("l_linenumber") <= 4).alias("seen"))
    scopes = F.array(F.lit("all"), F.when(F.col("seen"), "visible").otherwise("invisible"))
    each = known.select("gap", F.explode(scopes).alias("scope"))
    steps = F.inline(F.array(*(F.struct(F.lit(t).alias("tolerance"), F.coalesce(F.col("gap") <= t, F.lit(False)).alias("hit")) for t in (0, 1, 3, 10))))
    return each.select("scope", steps).groupBy("scope", "tolerance").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


RULES = [
    ("r1", "host", "full", "https?://m[.][^/]+/.*"),
    ("r2", "number", "name", "[0-9]+"),
    ("r3", "script", "code", "track[(][0-9]+[)]"),
    ("r4", "feed", "name", "[0-9]+.utm_source=feed"),
    ("r5", "partial", "name", "[0-9]"),
    ("r6", "style", "code", "margin:0"),
]


def rule_match(spark, sf_dir):
    """Rules against the name (last part), the full address and the code of pages: the first two match as a whole."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "([^/]*)$", 1).alias("name"), "html")
    found = J.rule_matches(pages, RULES, ["page_id"], {"name": "name", "full": "url", "code": "html"})
    return found.groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("pages"))


def candidate_agg(spark, sf_dir):
    """Counts, the three smallest distinct samples, the two most frequent values and the latest time of each event type
    and user group. Distinct values are counted first, and a group passes on a few of them only."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("grp"), F.floor("value").alias("v"), "ts")
    key = ["event_type", "grp"]
    values = e.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    picks = []
    for name, order, most in (("samples", ["v"], 3), ("top", [F.desc("n"), "v"], 2)):
        few = values.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("at") <= most)
        picks.append(few.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"].cast("string")), ",").alias(name)))
    sums = values.groupBy(*key).agg(F.sum("n").alias("n"), F.max("ts").alias("latest"))
    return sums.join(picks[0], key).join(picks[1], key)


def locf(spark, sf_dir):
    """The last login before or at each event, carried forward."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("event_id") % 4 == 0, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(mark, ignorenulls=True).over(w).alias("mark"))


def finding_dedupe(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("category"), "l_orderkey")
    return D.dedupe(f, ["file", "line", "category"], ["l_orderkey"])


def _engines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    engine = F.when(F.col("size") % 3 == 0, "graph").when(F.col("size") % 3 == 1, "rules").otherwise("review")
    return c.select("conv_id", (F.col("turn") % 3).alias("line"), engine.alias("engine"), F.when(engine == "graph", 1).when(engine == "rules", 2).otherwise(3).alias("rank"), (F.col("size") % 7).alias("weight"))


def merge_findings(spark, sf_dir):
    return D.merge(_engines(spark, sf_dir), ["conv_id", "line"], "engine", "rank", (F.col("engine") != "review") | (F.col("weight") > 3))


def _edges(spark, sf_dir, flows="true"):
    """Ways up between customers: property flows from the orders that `flows` chooses, aliases from every order."""
    o = table(spark, sf_dir, "orders")
    flow = o.where(flows).select(F.col("o_custkey").alias("node"), (F.col("o_custkey") * 7 % 1501 + 1).alias("up"), F.lit("prop_flow").alias("kind"))
    alias = o.select(F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 1499).alias("up"), F.lit("alias").alias("kind"))
    return flow.unionByName(alias).distinct()


def taint_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    user = c.where("node % 26 = 0").withColumn("kind", F.lit("user_input"))
    static = c.where("node % 13 = 0").withColumn("kind", F.lit("static_import"))
    found = G.resolve(c.select(F.col("node").alias("id"), "node"), _edges(spark, sf_dir, "o_orderkey % 3 > 0"), user.unionByName(static), 8)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


def var_length_path(spark, sf_dir):
    """Nodes within six steps of every customer whose id is divisible by 50, and its segment, if it has one."""
    edges = _edges(spark, sf_dir).select(F.col("node").alias("a"), F.col("up").alias("b"))
    starts = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("segment"))
    return G.reach(starts, edges, 6).join(segments, "node", "left").select("start", "node", "hops", "segment")


def neighborhood(spark, sf_dir):
    """What lies within two steps of every customer: orders, and their parts."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("a"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("b"))
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey")).alias("b"))
    starts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    return G.neighborhood(starts, o.unionByName(p), 2, 64)


def evidence_verdict(spark, sf_dir):
    kind = F.when(F.col("value") > 90, "tainted").when(F.col("value") > 50, "safe").otherwise("unknown")
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(kind).alias("kinds"))
    return files.groupBy(G.evidence_verdict(F.col("kinds")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def risk_score(spark, sf_dir):
    verdict = F.when(F.col("event_id") % 3 == 0, "tainted").when(F.col("event_id") % 3 == 1, "safe").otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", F.round(G.adjusted_risk(F.col("event_id") % 21 / F.lit(2.0), verdict), 6).alias("risk"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    e = _vectors(spark, sf_dir)
    return R.knn(e.where("id % 50 = 0"), e, 5).select("q", "id", "rank", F.round("sim", 5).alias("sim"))


def knn_filtered(spark, sf_dir):
    """The same among the vectors of odd labels, at a similarity of at least a half."""
    e = _vectors(spark, sf_dir)
    return R.knn(e.where("id % 50 = 0"), e.where("label % 2 = 1"), 5, 0.5).select("q", "id", "rank", F.round("sim", 5).alias("sim"))


QUERIES = {
    f.__name__: f
    for f in (
        hash_lookup, fallback_join, key_intersection, semi_allowlist, resume_anti, left_default, ordinal_join, interval_containment, smallest_enclosing, tolerance_join, nearest_line,
        line_ladder, rule_match, candidate_agg, locf, finding_dedupe, merge_findings, taint_resolve, var_length_path,
        neighborhood, evidence_verdict, risk_score, knn, knn_filtered,
    )
}

SPANS = "spans AS (SELECT user_id, event_id AS name, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + (event_id % 50 + 1) * 20000 AS stop FROM events)"
POINTS = "points AS (SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events)"
ENGINES = """f AS (SELECT conv_id, turn % 3 AS line, CASE length(text) % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'rules' ELSE 'review' END AS engine, length(text) % 3 + 1 AS rank, length(text) % 7 AS weight FROM conversations)"""
ENDS = "ends AS (SELECT user_id, stop AS b, name, name % 3 = 0 AS operator FROM spans)"
EDGES = """edges AS (SELECT DISTINCT o_custkey AS node, o_custkey * 7 % 1501 + 1 AS up, 1 AS p FROM orders WHERE o_orderkey % 3 > 0 UNION SELECT o_custkey, o_orderkey % 1499, 2 FROM orders)"""
ALL_EDGES = EDGES.replace(" WHERE o_orderkey % 3 > 0", "")
RULE_ROWS = ", ".join(f"('{i}', '{c}', '{m}', '{p}')" for i, c, m, p in RULES)

ORACLE = {
    "hash_lookup": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "fallback_join": """WITH e AS (SELECT l_partkey, l_suppkey, max(l_linenumber) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2), w AS (SELECT l_partkey, min(l_linenumber) AS v FROM lineitem GROUP BY 1)
        SELECT coalesce(e.v, w.v) AS v, count(*) AS n FROM lineitem l LEFT JOIN e ON l.l_partkey = e.l_partkey AND l.l_suppkey = e.l_suppkey LEFT JOIN w ON l.l_partkey = w.l_partkey GROUP BY 1""",
    "key_intersection": "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "semi_allowlist": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY 1",
    "resume_anti": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "left_default": "SELECT lang, coalesce(quality, -1) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "ordinal_join": "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 97 = 0 AND o_custkey <> -1) AS misaligned FROM orders",
    "interval_containment": f"WITH {SPANS}, {POINTS} SELECT id, count(*) AS n, min(name) AS first FROM points p JOIN spans s ON p.user_id = s.user_id AND pos BETWEEN start AND stop GROUP BY 1",
    "smallest_enclosing": f"""WITH {SPANS}, {POINTS}, r AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY stop - start, name) AS r FROM points p LEFT JOIN spans s ON p.user_id = s.user_id AND pos BETWEEN start AND stop)
        SELECT id, name FROM r WHERE r = 1""",
    "tolerance_join": f"WITH {SPANS}, {POINTS}, {ENDS} SELECT id, EXISTS (SELECT 1 FROM ends s WHERE s.user_id = p.user_id AND abs(b - pos) <= 5000) AS hit FROM points p",
    "nearest_line": f"""WITH {SPANS}, {POINTS}, {ENDS}, r AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY b < pos, abs(b - pos), operator, name) AS r FROM points p JOIN ends s ON p.user_id = s.user_id AND abs(b - pos) <= 100000)
        SELECT id, name FROM r WHERE r = 1""",
    "line_ladder": """WITH g AS (SELECT a.l_orderkey, a.l_linenumber, min(abs(a.l_partkey - b.l_partkey)) AS gap FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2),
        k AS (SELECT g.gap, a.l_linenumber <= 4 AS seen FROM lineitem a JOIN g USING (l_orderkey, l_linenumber)), e AS (SELECT gap, 'all' AS scope FROM k UNION ALL SELECT gap, CASE WHEN seen THEN 'visible' ELSE 'invisible' END FROM k)
        SELECT scope, t AS tolerance, count(*) FILTER (gap <= t) AS hits, count(*) AS n FROM e, (VALUES (0), (1), (3), (10)) v(t) GROUP BY 1, 2""",
    "rule_match": f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name, html FROM pages)
        SELECT rule_id, category, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS pages FROM p JOIN (VALUES {RULE_ROWS}) r(rule_id, category, match, pattern)
        ON CASE match WHEN 'name' THEN regexp_full_match(name, pattern) WHEN 'full' THEN regexp_full_match(url, pattern) ELSE regexp_matches(html, pattern) END GROUP BY 1, 2""",
    "candidate_agg": """WITH v AS (SELECT event_type, user_id % 10 AS grp, CAST(floor(value) AS BIGINT) AS v, count(*) AS n, max(ts) AS ts FROM events GROUP BY 1, 2, 3)
        SELECT event_type, grp, CAST(sum(n) AS BIGINT) AS n, max(ts) AS latest, array_to_string(list(v ORDER BY v)[1:3], ',') AS samples, array_to_string(list(v ORDER BY n DESC, v)[1:2], ',') AS top FROM v GROUP BY 1, 2""",
    "locf": "SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mark FROM events",
    "finding_dedupe": """WITH r AS (SELECT l_suppkey AS file, l_linenumber AS line, l_returnflag AS category, min(l_orderkey) AS l_orderkey, count(*) - 1 AS n_duplicates FROM lineitem GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, category) - 1 AS uid FROM r""",
    "merge_findings": f"""WITH {ENGINES}, d AS (SELECT DISTINCT conv_id, line, engine, rank FROM f WHERE engine <> 'review' OR weight > 3)
        SELECT conv_id, line, min_by(engine, rank) AS first_engine, string_agg(engine, ',' ORDER BY rank) AS contributors FROM d GROUP BY 1, 2""",
    "taint_resolve": f"""WITH RECURSIVE {EDGES}, up AS (SELECT node, up FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY p, up) AS r FROM edges) WHERE r = 1),
        src AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 26 = 0 THEN 'user_input' ELSE 'static_import' END AS kind FROM customer WHERE c_custkey % 13 = 0),
        w AS (SELECT c_custkey AS id, c_custkey AS here, [c_custkey] AS path, 0 AS step FROM customer
          UNION ALL SELECT id, up, list_append(path, up), step + 1 FROM w JOIN up ON node = here WHERE step < 8 AND here NOT IN (SELECT node FROM src) AND NOT list_contains(path, up)),
        e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC) AS r FROM w)
        SELECT id, CASE WHEN kind IS NOT NULL THEN kind WHEN up IS NULL OR step = 8 THEN 'unknown' ELSE 'cycle' END AS verdict, CASE WHEN kind IS NOT NULL THEN here END AS source, step AS steps, array_to_string(path, '>') AS path
        FROM e LEFT JOIN src ON src.node = here LEFT JOIN up ON up.node = here WHERE r = 1""",
    "var_length_path": f"""WITH RECURSIVE {ALL_EDGES}, w AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey % 50 = 0
          UNION SELECT start, up, hops + 1 FROM w JOIN edges ON edges.node = w.node WHERE hops < 6) SELECT start, node, min(hops) AS hops, max(c_mktsegment) AS segment FROM w LEFT JOIN customer ON c_custkey = node GROUP BY 1, 2""",
    "neighborhood": """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        s AS (SELECT 'c' || c_custkey AS start FROM customer), h AS (SELECT start, start AS node, 0 AS hops FROM s UNION ALL SELECT start, b, 1 FROM s JOIN u ON a = start
          UNION ALL SELECT start, y.b, 2 FROM s JOIN u x ON x.a = start JOIN u y ON y.a = x.b), m AS (SELECT start, node, min(hops) AS hops FROM h GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, node) AS r, count(*) OVER (PARTITION BY start) AS c FROM m), k AS (SELECT * FROM r WHERE r <= 64),
        g AS (SELECT x.start, count(*) AS n FROM e JOIN k x ON x.node = e.a JOIN k y ON y.node = e.b AND x.start = y.start GROUP BY 1)
        SELECT k.start, count(*) AS n_nodes, least(coalesce(max(g.n), 0), 256) AS n_edges, max(c) > 64 OR coalesce(max(g.n), 0) > 256 AS truncated FROM k LEFT JOIN g ON g.start = k.start GROUP BY 1""",
    "evidence_verdict": """WITH u AS (SELECT user_id, max(CASE WHEN value > 90 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) AS k FROM events GROUP BY 1)
        SELECT CASE k WHEN 2 THEN 'tainted' WHEN 1 THEN 'safe' ELSE 'unknown' END AS verdict, count(*) AS n FROM u GROUP BY 1""",
    "risk_score": """SELECT event_id, round(greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), event_id % 21 / CAST(2 AS DOUBLE) + CAST(CASE event_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN -1.0 ELSE -0.2 END AS DOUBLE))), 6) AS risk FROM events""",
    "knn": """WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(a, CAST(embedding AS DOUBLE[])) AS sim FROM q, embeddings)
        SELECT q, id, rank, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "knn_filtered": """WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(a, CAST(embedding AS DOUBLE[])) AS sim FROM q, embeddings WHERE label % 2 = 1)
        SELECT q, id, rank, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.5) WHERE rank <= 5""",
}
