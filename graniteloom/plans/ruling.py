"""Rule queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graniteloom.operators import rules as U
from graniteloom.plans.tables import table

ARG_RULES = [("a1", "arg_literal", "RF"), ("a2", "arg_literal", ".*O"), ("a3", "arg_count", 4), ("a4", "arg_literal", "N")]
SANITIZERS = [("^c", ["*"]), ("widget", ["ECONOMY"]), ("(small|large)", ["PROMO", "LARGE"]), ("gadget$", ["*"])]


def _rules(spark, sf_dir):
    """Parts as rules: some with an unknown role or match, a broken pattern, or a path in it."""
    k = F.col("p_partkey")
    role = F.when(k % 3 == 0, "sink").when(k % 3 == 1, "source").when(k % 30 == 2, "other").otherwise("sanitizer")
    match = F.when(F.col("p_size") % 4 == 0, "name").when(F.col("p_size") % 4 == 1, "full").when(F.col("p_size") % 20 == 2, "odd").otherwise("code")
    pattern = F.concat(F.col("p_name"), F.when(k % 11 == 0, "(").when(k % 13 == 0, " a/b").otherwise(""))
    return table(spark, sf_dir, "part").select(k.alias("id"), role.alias("role"), match.alias("match"), pattern.alias("pattern"), F.col("p_type").alias("category"), F.concat(F.lit("CWE-"), k % 7).alias("cwe"), (F.col("p_size") / 50).alias("confidence"))


def _allowed(spark, sf_dir):
    return _rules(spark, sf_dir).where("cwe <> 'CWE-3' OR category = 'ECONOMY'").select("category", "cwe")


def rule_valid(spark, sf_dir):
    """Rules by the first test they fail."""
    return U.verdict(_rules(spark, sf_dir), _allowed(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def rule_ids(spark, sf_dir):
    """Valid rules with their ids, and whether they may be enforced: those whose pattern is exactly their call's full name."""
    judged = U.verdict(_rules(spark, sf_dir), _allowed(spark, sf_dir)).where("verdict = 'valid'")
    k = F.col("id")
    name = F.regexp_replace(F.trim("pattern"), " ", ".")
    exact = judged.withColumns({
        "full_name": F.when(k % 7 > 0, name), "pattern": F.when(k % 2 == 0, U.exact_pattern(name)).otherwise(F.col("pattern")), "internal": k % 4 == 0, "resolved": k % 5 > 0, "confidence": F.when(F.col("confidence") >= 0.3, "High").otherwise("low"),
        "endpoint": F.when(k % 9 == 0, "arg:0").when(k % 9 < 5, "return").otherwise(F.concat(F.lit("arg:"), k % 9)), "rule_id": F.when(k % 10 == 0, F.concat(F.lit("own."), k)),
    })
    return U.identified(exact, "made.").select("id", "rule_id", "enforce")


def _sets(spark, sf_dir):
    rows = _rules(spark, sf_dir)
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


def rule_merge(spark, sf_dir):
    """Rules written by hand and generated ones, one a pattern and match; the hand's goes first."""
    hand, made = _sets(spark, sf_dir)
    return U.merged([("hand", hand), ("generated", made)], ["match", "pattern"])


def rule_conflicts(spark, sf_dir):
    """Patterns that the sets give different roles."""
    return rule_merge(spark, sf_dir).where("n_roles > 1").groupBy("merged_from").agg(F.count(F.lit(1)).alias("n"), F.max("n_roles").alias("most"))


def rule_compose(spark, sf_dir):
    """Rules in force by mode: in shadow those by hand, when enforced also the generated ones that may be."""
    hand, made = _sets(spark, sf_dir)
    eligible = made.join(rule_ids(spark, sf_dir).where("enforce").select("id"), "id", "left_semi")
    shadow = hand.withColumn("mode", F.lit("shadow"))
    enforce = hand.unionByName(eligible).withColumn("mode", F.lit("enforce"))
    return shadow.unionByName(enforce).groupBy("mode", "role").agg(F.count(F.lit(1)).alias("n"))


def cache_override(spark, sf_dir):
    """Rules after the cache: it changes the role of some and takes others away."""
    rules = _rules(spark, sf_dir)
    cache = rules.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "none").otherwise("sink").alias("role"))
    return U.overridden(rules, cache, ["id"], ["role"]).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def overlay_update(spark, sf_dir):
    """Balances after a table of changes, and how many changes name no customer."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    changes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 37).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "CHANGED").alias("c_mktsegment"), F.round("s_acctbal", 2).alias("c_acctbal"))
    out, unknown = U.overlaid(base, changes, "k", ["c_mktsegment", "c_acctbal"])
    counts = out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return counts.unionByName(unknown.agg(F.lit("unknown").alias("c_mktsegment"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")))


def local_packages(spark, sf_dir):
    """Calls (three parts each, whose names are the full names) that are not all of the repository's own packages."""
    k = F.col("p_partkey")
    name = F.when(k % 17 == 0, "<unresolved>").when(k % 19 == 0, "").otherwise(F.concat_ws(".", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit(".")), F.concat(F.lit("m"), F.col("p_size"))))
    calls = table(spark, sf_dir, "part").select(F.expr("p_partkey div 3").alias("call"), name.alias("name"))
    packages = table(spark, sf_dir, "part").where("p_size > 45").select(F.concat_ws(".", F.lower("p_type"), F.regexp_extract("p_name", "^[a-z]+", 0)).alias("package")).distinct().where("package < 'q'")
    return U.without_local(calls, "call", "name", packages, "package").groupBy("call").agg(F.count(F.lit(1)).alias("names"))


def retry_fill(spark, sf_dir):
    """The latest parsed answer of each conversation; those without one are asked again."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.length("text") + F.col("conv_id")) % 3 == 0, F.md5("text")).alias("answer"))
    return U.latest_answers(c, "conv_id", "turn", "answer")


def rule_args(spark, sf_dir):
    """Rules on the arguments of calls: an order is a call, its lines are the arguments."""
    calls = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("args"))
    return U.argument_matches(calls, ["l_orderkey"], "args", ARG_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("calls"))


def sanitizer_join(spark, sf_dir):
    """Sanitizers that hold for the elements of flows."""
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("pattern"), F.array(*(F.lit(a) for a in applies)).alias("applies_to")) for p, applies in SANITIZERS))))
    elements = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("code"), F.col("p_type").alias("category"))
    return U.sanitizing(elements, rules, "code", "category").groupBy("pattern", "category").agg(F.count(F.lit(1)).alias("n"))


def rule_index(spark, sf_dir):
    """Pages that the rules of a table match: words of the benchmark are rules, as they are, with a gap, or at a word's begin."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("rule_id")).distinct()
    kind, w = F.length("rule_id") % 3, F.col("rule_id")
    pattern = F.when(kind == 0, w).when(kind == 1, F.concat(F.left(w, F.lit(4)), F.lit("[a-z]+"), F.right(w, F.lit(2)))).otherwise(F.concat(F.lit("(?:^|[^a-zA-Z])"), w))
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return U.matches_of(pages, ["page_id"], "html", words.withColumn("pattern", pattern)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


def path_suffix(spark, sf_dir):
    """Paths of two kinds of report that mean one file: either is the end of the other."""
    parts = F.split(F.regexp_replace("url", "^https?://|[?#].*$", ""), "/")
    pages = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    one = pages.where("size(parts) > 1").select("page_id", F.concat_ws("/", F.get("parts", F.lit(0)), F.element_at("parts", -1)).alias("a"))
    two = pages.where("page_id % 2 = 0 AND size(parts) > 1").select(F.col("page_id").alias("other"), F.when(F.col("page_id") % 3 == 0, F.element_at("parts", -1)).otherwise(F.concat(F.lit("repo/"), F.get("parts", F.lit(0)), F.lit("/"), F.element_at("parts", -1))).alias("b"))
    return U.suffix_matches(one, two, "a", "b").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"))


def hierarchy_accept(spark, sf_dir):
    """Guessed classes that are the true one, its parent or a child; class k is a child of k div 2."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("truth"), ((F.col("l_partkey") % 60 + F.col("l_quantity").cast("long") % 7) / (1 + F.col("l_linenumber") % 2)).cast("long").alias("guess"))
    tree = spark.range(1, 120).select(F.expr("id div 2").alias("parent"), F.col("id").alias("child"))
    found = U.accepted(lines, "truth", "guess", tree)
    return found.groupBy((F.col("truth") == F.col("guess")).alias("exact"), "accepted").agg(F.count(F.lit(1)).alias("n"))


def prefix_map_match(spark, sf_dir):
    """Findings whose class begins as their category allows; "*" allows all."""
    allow = F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("*"))).when(F.col("p_type") == "STANDARD", F.array(F.lit("Brand#1"), F.lit("Brand#2"))).otherwise(F.array(F.lit("Brand#3")))
    rows = table(spark, sf_dir, "part").select("p_type", U.prefix_allowed(F.col("p_brand"), allow).alias("allowed"))
    return rows.groupBy("p_type", "allowed").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_valid, rule_ids, rule_merge, rule_conflicts, rule_compose, cache_override, overlay_update, local_packages, retry_fill, rule_args, sanitizer_join, rule_index, path_suffix, hierarchy_accept,
        prefix_map_match,
    )
}

R = """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'sink' WHEN p_partkey % 3 = 1 THEN 'source' WHEN p_partkey % 30 = 2 THEN 'other' ELSE 'sanitizer' END AS role,
    CASE WHEN p_size % 4 = 0 THEN 'name' WHEN p_size % 4 = 1 THEN 'full' WHEN p_size % 20 = 2 THEN 'odd' ELSE 'code' END AS match, p_name || CASE WHEN p_partkey % 11 = 0 THEN '(' WHEN p_partkey % 13 = 0 THEN ' a/b' ELSE '' END AS pattern,
    p_type AS category, 'CWE-' || p_partkey % 7 AS cwe, p_size / CAST(50 AS DOUBLE) AS confidence FROM part),
  v AS (SELECT *, CASE WHEN role = 'other' THEN 'role' WHEN match = 'odd' THEN 'match' WHEN contains(pattern, '(') THEN 'regex' WHEN contains(pattern, '/') THEN 'path' WHEN cwe = 'CWE-3' AND category <> 'ECONOMY' THEN 'category' ELSE 'valid' END AS verdict FROM r),
  q AS (SELECT id, role, match, cwe, confidence, replace(trim(pattern), ' ', '.') AS name, CASE WHEN id % 2 = 0 THEN '^' || replace(replace(trim(pattern), ' ', '.'), '.', '\\.') || '$' ELSE pattern END AS pattern, CASE WHEN id % 9 < 5 THEN 'return' ELSE 'arg:' || id % 9 END AS endpoint FROM v WHERE verdict = 'valid' AND id % 9 > 0),
  i AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'own.' || id ELSE 'made.' || left(sha256(role || '|' || cwe || '|' || pattern || '|' || endpoint), 16) END AS rule_id,
    id % 7 > 0 AND id % 2 = 0 AND id % 5 > 0 AND match = 'full' AND confidence >= CAST(0.3 AS DOUBLE) AND role IN ('sink', 'source', 'sanitizer') AS enforce FROM q),
  m AS (SELECT match, pattern, arg_min(role, (id % 2, role)) AS role, CASE WHEN min(id % 2) = max(id % 2) THEN CASE WHEN min(id % 2) = 0 THEN 'hand' ELSE 'generated' END ELSE 'hand+generated' END AS merged_from, count(DISTINCT role) AS n_roles FROM r GROUP BY 1, 2)"""

ORACLE = {
    "rule_valid": f"{R} SELECT verdict, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v GROUP BY 1",
    "rule_ids": f"{R} SELECT * FROM i",
    "rule_merge": f"{R} SELECT * FROM m",
    "rule_conflicts": f"{R} SELECT merged_from, count(*) AS n, max(n_roles) AS most FROM m WHERE n_roles > 1 GROUP BY 1",
    "rule_compose": f"{R}, a AS (SELECT 'shadow' AS mode, role FROM r WHERE id % 2 = 0 UNION ALL SELECT 'enforce', role FROM r WHERE id % 2 = 0 OR id IN (SELECT id FROM i WHERE enforce)) SELECT mode, role, count(*) AS n FROM a GROUP BY 1, 2",
    "cache_override": f"{R}, o AS (SELECT id, CASE WHEN id % 5 = 1 THEN 'sink' ELSE role END AS role FROM r WHERE id % 5 <> 0) SELECT role, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY 1",
    "overlay_update": """WITH c AS (SELECT s_suppkey * 37 AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'CHANGED' END AS seg, round(s_acctbal, 2) AS bal FROM supplier), o AS (SELECT coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(bal, round(c_acctbal, 2)) AS b FROM customer LEFT JOIN c ON k = c_custkey)
        SELECT c_mktsegment, count(*) AS n, round(sum(b), 2) AS total FROM o GROUP BY 1 UNION ALL SELECT 'unknown', count(*), round(sum(bal), 2) FROM c WHERE k NOT IN (SELECT c_custkey FROM customer)""",
    "local_packages": """WITH n AS (SELECT p_partkey // 3 AS call, CASE WHEN p_partkey % 17 = 0 THEN '<unresolved>' WHEN p_partkey % 19 = 0 THEN '' ELSE lower(p_type) || '.' || replace(p_name, ' ', '.') || '.m' || p_size END AS name FROM part),
        p AS (SELECT DISTINCT lower(p_type) || '.' || regexp_extract(p_name, '^[a-z]+') AS package FROM part WHERE p_size > 45 AND package < 'q'), l AS (SELECT call, name <> '' AND NOT starts_with(name, '<') AND EXISTS (SELECT 1 FROM p WHERE starts_with(name, package || '.')) AS own FROM n)
        SELECT call, count(*) AS names FROM l GROUP BY 1 HAVING NOT bool_and(own)""",
    "retry_fill": "WITH c AS (SELECT conv_id, turn, CASE WHEN (length(text) + conv_id) % 3 = 0 THEN md5(text) END AS a FROM conversations) SELECT conv_id, max_by(a, turn) FILTER (a IS NOT NULL) AS answer, count(a) = 0 AS missing FROM c GROUP BY 1",
    "rule_args": """WITH c AS (SELECT l_orderkey, list(l_returnflag || l_linestatus) AS a FROM lineitem GROUP BY 1), h AS (SELECT l_orderkey, unnest([CASE WHEN list_contains(a, 'RF') THEN 'a1' END, CASE WHEN len(list_filter(a, lambda x: ends_with(x, 'O'))) > 0 THEN 'a2' END, CASE WHEN len(a) = 4 THEN 'a3' END, CASE WHEN list_contains(a, 'N') THEN 'a4' END]) AS rule_id FROM c)
        SELECT rule_id, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS calls FROM h WHERE rule_id IS NOT NULL GROUP BY 1""",
    "sanitizer_join": "SELECT pattern, p_type AS category, count(*) AS n FROM part JOIN (VALUES ('^c', ['*']), ('widget', ['ECONOMY']), ('(small|large)', ['PROMO', 'LARGE']), ('gadget$', ['*'])) r(pattern, applies) ON (list_contains(applies, '*') OR list_contains(applies, p_type)) AND regexp_matches(p_name, pattern) GROUP BY 1, 2",
    "rule_index": """WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS rule_id FROM benchmark),
        p AS (SELECT rule_id, CASE length(rule_id) % 3 WHEN 0 THEN rule_id WHEN 1 THEN left(rule_id, 4) || '[a-z]+' || right(rule_id, 2) ELSE '(?:^|[^a-zA-Z])' || rule_id END AS pattern FROM r)
        SELECT rule_id, count(*) AS n, min(page_id) AS first FROM p JOIN pages ON regexp_matches(html, pattern) GROUP BY 1""",
    "path_suffix": """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/') AS p FROM pages), o AS (SELECT page_id, p[1] || '/' || p[-1] AS a FROM p WHERE len(p) > 1), t AS (SELECT page_id AS other, CASE WHEN page_id % 3 = 0 THEN p[-1] ELSE 'repo/' || p[1] || '/' || p[-1] END AS b FROM p WHERE page_id % 2 = 0 AND len(p) > 1)
        SELECT page_id, count(*) AS n, min(other) AS first FROM o JOIN t ON ends_with('/' || a, '/' || b) OR ends_with('/' || b, '/' || a) GROUP BY 1""",
    "hierarchy_accept": """WITH l AS (SELECT l_partkey % 60 AS t, CAST(floor((l_partkey % 60 + CAST(l_quantity AS BIGINT) % 7) / CAST(1 + l_linenumber % 2 AS DOUBLE)) AS BIGINT) AS g FROM lineitem)
        SELECT t = g AS exact, t = g OR (g BETWEEN 1 AND 119 AND g // 2 = t) OR (t BETWEEN 1 AND 119 AND t // 2 = g) AS accepted, count(*) AS n FROM l GROUP BY 1, 2""",
    "prefix_map_match": "SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN true WHEN 'STANDARD' THEN starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') ELSE starts_with(p_brand, 'Brand#3') END AS allowed, count(*) AS n FROM part GROUP BY 1, 2",
}
