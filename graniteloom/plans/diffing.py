"""Diff and line queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graniteloom import functions as N
from graniteloom.operators import curation as C
from graniteloom.operators import diffs as X
from graniteloom.plans.tables import table

RULES = [("CWE-1", "(?i)th"), ("CWE-2", "[0-9]{3}"), ("CWE-3", "[@#$]")]
WORDS = {"articles": ["The", "und", "la"], "addresses": ["@"], "none": []}
PATTERNS = [("CWE-0", "e"), ("CWE-1", "[0-9]"), ("CWE-2", "^[A-Z]")]


def _lines(spark, sf_dir):
    """Documents read as diffs: their clauses are lines, every seventh of them a hunk's header."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.\n,]")).alias("pos", "body"))
    k = F.col("pos") % 7
    side = F.when(F.length("body") % 3 == 0, "-").when(F.length("body") % 3 == 1, "+").otherwise(" ")
    header = F.concat(F.lit("@@ -"), F.col("pos") * 10 + 1, F.lit(",7 +"), F.col("pos") * 10 + 3, F.lit(",7 @@"))
    return rows.select("doc_id", "pos", F.when(k == 1, header).otherwise(F.concat(side, "body")).alias("line"))


def _changed(spark, sf_dir):
    return X.numbered(_lines(spark, sf_dir), ["doc_id"], "pos", "line")


def diff_line_no(spark, sf_dir):
    """Numbers of both sides of all lines of hunks, summed by document and side."""
    found = _changed(spark, sf_dir).groupBy("doc_id", "side")
    return found.agg(F.count(F.lit(1)).alias("n"), F.max("hunk").alias("hunks"), F.sum("old_no").alias("old"), F.sum("new_no").alias("new"))


def representative_line(spark, sf_dir):
    return X.representative(_changed(spark, sf_dir), ["doc_id"])


def commit_cap(spark, sf_dir):
    """Documents of one to thirty deleted lines."""
    return X.commit_size(_changed(spark, sf_dir), ["doc_id"])


def path_exclusion(spark, sf_dir):
    """Pages whose path is one of code of interest, with paths made of the address."""
    kinds = F.array(*(F.lit(p) for p in ("src/", "tests/", "vendor/x/", "lib/", "dist/")))
    path = F.concat(F.get(kinds, (F.col("page_id") % 5).cast("int")), F.element_at(F.split("url", "/"), -1), F.when(F.col("page_id") % 11 == 0, ".lock").otherwise(".py"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.where(~F.col("path").rlike(X.EXCLUDED_PATHS)).groupBy((F.col("page_id") % 5).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def noise_lines(spark, sf_dir):
    """Changed lines that say something, by side."""
    return _changed(spark, sf_dir).where(X.telling(F.col("body"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


def keyword_filter(spark, sf_dir):
    """Rows that match the pattern of their class; classes without a pattern pass."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("CWE-"), F.col("doc_id") % 5).alias("cwe"), F.coalesce("text", F.lit("")).alias("text"))
    patterns = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("cwe"), F.lit(p).alias("pattern")) for c, p in PATTERNS))))
    return X.class_filter(rows, patterns, "cwe", "text").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


def identical_pair(spark, sf_dir):
    """Pairs whose sides differ after white space and case are normalised."""
    after = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(F.concat("text", F.lit(" x")))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", C.content_key(F.col("text")).alias("a"), C.content_key(after).alias("b"))
    return rows.groupBy((F.col("doc_id") % 3).alias("kind")).agg(F.count_if(F.col("a") == F.col("b")).alias("identical"), F.count_if(F.col("a") != F.col("b")).alias("kept"))


def banned_string(spark, sf_dir):
    """Pages with banned words outside scripts and styles."""
    banned = X.banned_outside(F.col("html"), "<(?:script|style)>.*?</(?:script|style)>", "margin|track|e</a>")
    return table(spark, sf_dir, "pages").groupBy(banned.alias("banned")).agg(F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("pages"))


def diff_findings(spark, sf_dir):
    """Lines of each class that rules find among the added lines."""
    found = X.rule_findings(_changed(spark, sf_dir), ["doc_id"], RULES)
    return found.select("doc_id", "cls", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def keyword_lines(spark, sf_dir):
    """Lines of each class's words, in any case, or the first line of the first hunk."""
    found = X.keyword_lines(_changed(spark, sf_dir), ["doc_id"], WORDS)
    return found.select("doc_id", "cls", F.size("lines").alias("n"), F.md5(F.array_join(F.col("lines").cast("array<string>"), ",")).alias("lines"), "fallback")


def caller_window(spark, sf_dir):
    """Two lines around the first line of a document that holds a digit."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "[.\n,]"))).alias("lines"))
    at = F.array_position(F.transform("lines", lambda x: x.rlike("[0-9]")), True).cast("int")
    hit = rows.withColumn("at", at).where("at > 0")
    return hit.select("doc_id", F.col("at").alias("line"), F.md5(F.array_join(X.around(F.col("lines"), F.col("at"), 2), "|")).alias("digest"))


def path_sample(spark, sf_dir):
    """Ten steps at most of the way through each customer's orders."""
    path = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("path"))
    return path.select("o_custkey", F.size("path").alias("n"), F.array_join(X.evenly(F.col("path")).cast("array<string>"), ">").alias("steps"))


def path_union(spark, sf_dir):
    """Steps of all paths of a file, distinct by line and code, by line."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 40).alias("line"), "l_returnflag").distinct()
    packed = steps.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "l_returnflag"))).alias("s"))
    return packed.select("file", F.array_join(F.transform("s", lambda x: F.concat(x["line"].cast("string"), x["l_returnflag"])), " ").alias("steps"))


def marker(spark, sf_dir):
    """A mark before the third line of every document that has one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "[.\n,]"))).alias("lines"))
    return rows.where(F.size("lines") >= 3).select("doc_id", F.md5(F.array_join(X.inserted(F.col("lines"), F.lit(3), ">>>"), "|")).alias("digest"))


def line_chunks(spark, sf_dir):
    """Chunks of whole lines of up to 400 characters; a file is of interest if one of its chunks is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = X.cut_up(docs, "doc_id", "text", 400)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.col("stop") - F.col("start")).alias("longest"), F.bool_or(F.col("stop") - F.col("start") > 400).alias("over"))


def overlap_windows(spark, sf_dir):
    """Overlapping windows of up to 600 characters, begun and ended at lines where there are some: their number, sum of
    lengths and last end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = X.cut_up(docs, "doc_id", "text", 600, windows=True)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.max("stop").alias("last"))


def multi_file_diff(spark, sf_dir):
    """Lines of diffs over several files by file: marks of files and ends are no lines, a file without paths is left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.\n,]")).alias("pos", "body"))
    pos, k, side = F.col("pos"), F.col("pos") % 13, F.when(F.length("body") % 3 == 0, "-").when(F.length("body") % 3 == 1, "+").otherwise(" ")
    marks = {0: F.when(pos % 52 == 26, "diff --git broken").otherwise(F.concat(F.lit("diff --git a/f"), pos, F.lit(".py b/g"), pos, F.lit(".py"))), 1: F.lit("--- a/f"), 2: F.lit("+++ b/g"), 3: F.concat(F.lit("@@ -"), pos * 10 + 1, F.lit(",9 +"), pos * 10 + 3, F.lit(",9 @@")), 9: F.lit("\\ No newline at end of file")}
    line = F.concat(side, "body")
    for at, mark in marks.items():
        line = F.when(k == at, mark).otherwise(line)
    found = X.numbered(rows.select("doc_id", "pos", line.alias("line")), ["doc_id"], "pos", "line")
    return found.groupBy("doc_id", "file", "post_path", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("old_no").alias("old"), F.sum("new_no").alias("new"))


def line_diff(spark, sf_dir):
    """What an edit of each document changes: every fifth clause in capitals, every seventh taken out."""
    lines = F.split(F.coalesce("text", F.lit("")), "[.\n,]")
    edited = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] % 7 > 0), lambda s: F.when(s["i"] % 5 == 0, F.upper(s["x"])).otherwise(s["x"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("a"), F.array_join(edited, "\n").alias("b"))
    return docs.select("doc_id", N.line_counts("a", "b").alias("c")).select("doc_id", "c.*")


QUERIES = {
    f.__name__: f
    for f in (
        diff_line_no, representative_line, commit_cap, path_exclusion, noise_lines, keyword_filter, identical_pair, banned_string, diff_findings, keyword_lines, caller_window, path_sample,
        path_union, marker, line_chunks, overlap_windows, multi_file_diff, line_diff,
    )
}

NOISE = X.NOISE_LINES
SPLIT = "string_split_regex(coalesce(text, ''), '[.\\n,]')"
CHANGED = f"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts({SPLIT}, 1) - 1 AS pos, unnest({SPLIT}) AS body FROM documents),
    h AS (SELECT *, pos % 7 = 1 AS header, sum(CASE WHEN pos % 7 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hunk,
      max(CASE WHEN pos % 7 = 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS first FROM l),
    s AS (SELECT doc_id, pos, CAST(hunk AS BIGINT) AS hunk, first, CASE length(body) % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS side, body FROM h WHERE hunk > 0 AND NOT header),
    c AS (SELECT *, CASE WHEN side <> '+' THEN first * 10 + 1 + CAST(sum((side <> '+')::INT) OVER w AS BIGINT) - 1 END AS old_no, CASE WHEN side <> '-' THEN first * 10 + 3 + CAST(sum((side <> '-')::INT) OVER w AS BIGINT) - 1 END AS new_no
      FROM s WINDOW w AS (PARTITION BY doc_id, hunk ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
TELLING = f"NOT regexp_matches(body, '{NOISE}')"

ORACLE = {
    "diff_line_no": f"{CHANGED} SELECT doc_id, side, count(*) AS n, max(hunk) AS hunks, CAST(sum(old_no) AS BIGINT) AS old, CAST(sum(new_no) AS BIGINT) AS new FROM c GROUP BY 1, 2",
    "representative_line": f"{CHANGED}, t AS (SELECT * FROM c WHERE side = '-' AND {TELLING}) SELECT doc_id, min_by(old_no, hunk * 1000000000 + old_no) AS line, count(DISTINCT hunk) AS n_hunks FROM t GROUP BY 1",
    "commit_cap": f"{CHANGED} SELECT doc_id, count(*) FILTER (side = '-') AS n_deleted FROM c GROUP BY 1 HAVING n_deleted BETWEEN 1 AND 30",
    "path_exclusion": "SELECT page_id % 5 AS kind, count(*) AS n FROM pages WHERE page_id % 5 IN (0, 3) AND page_id % 11 <> 0 GROUP BY 1",
    "noise_lines": f"{CHANGED} SELECT side, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM c WHERE {TELLING} GROUP BY 1",
    "keyword_filter": "SELECT 'CWE-' || doc_id % 5 AS cwe, count(*) AS n FROM documents WHERE CASE doc_id % 5 WHEN 0 THEN contains(coalesce(text, ''), 'e') WHEN 1 THEN regexp_matches(coalesce(text, ''), '[0-9]') WHEN 2 THEN regexp_matches(coalesce(text, ''), '^[A-Z]') ELSE true END GROUP BY 1",
    "identical_pair": "SELECT doc_id % 3 AS kind, count(*) FILTER (doc_id % 3 < 2) AS identical, count(*) FILTER (doc_id % 3 = 2) AS kept FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "banned_string": "SELECT regexp_matches(regexp_replace(html, '(?s)<(?:script|style)>.*?</(?:script|style)>', ' ', 'g'), 'margin|track|e</a>') AS banned, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS pages FROM pages GROUP BY 1",
    "diff_findings": f"{CHANGED}, f AS (SELECT DISTINCT doc_id, cls, new_no FROM c JOIN (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in RULES) + f") r(cls, pattern) ON regexp_matches(body, pattern) WHERE side = '+' AND {TELLING}) SELECT doc_id, cls, string_agg(new_no, ',' ORDER BY new_no) AS lines FROM f GROUP BY 1, 2",
    "keyword_lines": f"""{CHANGED}, n AS (SELECT * FROM c WHERE new_no IS NOT NULL), b AS (SELECT doc_id, min_by(new_no, hunk * 1000000000 + new_no) AS start FROM n GROUP BY 1), k AS (SELECT * FROM (VALUES ('articles', 'the|und|la'), ('addresses', '@'), ('none', NULL)) v(cls, words)),
        f AS (SELECT doc_id, cls, list(new_no ORDER BY new_no) AS l FROM n JOIN k ON regexp_matches(lower(body), words) WHERE side = '+' GROUP BY 1, 2), r AS (SELECT b.doc_id, k.cls, coalesce(l, [start]) AS l, l IS NULL AS fallback FROM b CROSS JOIN k LEFT JOIN f ON f.doc_id = b.doc_id AND f.cls = k.cls)
        SELECT doc_id, cls, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, ',')) AS lines, fallback FROM r""",
    "caller_window": f"""WITH l AS (SELECT doc_id, {SPLIT} AS l FROM documents), a AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '[0-9]')), true) AS line FROM l)
        SELECT doc_id, line, md5(array_to_string(l[greatest(1, line - 2) : line + 2], '|')) AS digest FROM a WHERE line > 0""",
    "path_sample": """WITH p AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS p FROM orders GROUP BY 1)
        SELECT o_custkey, len(p) AS n, array_to_string(CASE WHEN len(p) <= 10 THEN p ELSE list_transform(range(10), lambda i: p[round_even(i * (len(p) - 1) / CAST(9 AS DOUBLE), 0)::INT + 1]) END, '>') AS steps FROM p""",
    "path_union": "WITH s AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 40 AS line, l_returnflag AS r FROM lineitem) SELECT file, string_agg(line || r, ' ' ORDER BY line, r) AS steps FROM s GROUP BY 1",
    "marker": f"WITH l AS (SELECT doc_id, {SPLIT} AS l FROM documents) SELECT doc_id, md5(array_to_string(list_concat(l[1:2], ['>>>'], l[3:]), '|')) AS digest FROM l WHERE len(l) >= 3",
    "multi_file_diff": """WITH l AS (SELECT doc_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS body FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.\\n,]') AS b FROM documents)),
        h AS (SELECT *, pos // 13 * 13 AS start, CASE length(body) % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS side FROM l WHERE pos % 13 > 3 AND pos % 13 <> 9 AND pos // 13 * 13 % 52 <> 26),
        c AS (SELECT *, CASE WHEN side <> '+' THEN (start + 3) * 10 + CAST(count(*) FILTER (side <> '+') OVER w AS BIGINT) END AS old_no, CASE WHEN side <> '-' THEN (start + 3) * 10 + 2 + CAST(count(*) FILTER (side <> '-') OVER w AS BIGINT) END AS new_no
          FROM h WHERE NOT (side = '-' AND starts_with(body, '--') OR side = '+' AND starts_with(body, '++')) WINDOW w AS (PARTITION BY doc_id, start ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, 'f' || start || '.py' AS file, 'g' || start || '.py' AS post_path, side, count(*) AS n, CAST(sum(old_no) AS BIGINT) AS old, CAST(sum(new_no) AS BIGINT) AS new FROM c GROUP BY 1, 2, 3, 4""",
    "line_chunks": """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM d),
        e AS (SELECT doc_id, i, len(l) AS n, CAST(sum(length(x) + CASE WHEN i < len(l) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM (SELECT doc_id, l, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s)),
        f AS (SELECT doc_id, i, n, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY i), 0) AS start FROM e WHERE true), m AS (SELECT * FROM f WHERE stop > start OR n = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM m),
        w AS (SELECT doc_id, k, c, start AS begin, stop, 0 AS part FROM r WHERE k = 1 UNION ALL
          SELECT r.doc_id, r.k, r.c, CASE WHEN r.start > w.begin AND r.stop - w.begin > 400 THEN r.start ELSE w.begin END, r.stop, CASE WHEN r.start > w.begin AND r.stop - w.begin > 400 THEN w.part + 1 ELSE w.part END FROM w JOIN r ON r.doc_id = w.doc_id AND r.k = w.k + 1),
        p AS (SELECT doc_id, part, max(stop) - min(begin) AS n FROM w GROUP BY 1, 2) SELECT doc_id, count(*) AS chunks, max(n) AS longest, bool_or(n > 400) AS over FROM p GROUP BY 1""",
}
