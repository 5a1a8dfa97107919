"""Curation queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteloom.operators import curation as C
from graniteloom.plans.tables import SAMPLES, samples, table

BUCKET = (
    "(list_sum(list_transform(string_split(sha256('42:' || {0}), ''), lambda c: strpos('0123456789abcdef', c) - 1)) * 6"
    " - 5 * (strpos('0123456789abcdef', right(sha256('42:' || {0}), 1)) - 1)) % 10"
)
LANGUAGES = {"en": "english", "de": "german", "fr": "french"}


def _leaking(spark, sf_dir):
    """(doc_id, item_id, shared) of the documents that hold a benchmark passage."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return C.contained(docs, "doc_id", "text", held, "item_id", "passage")


def curate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length band, first of equal texts, leakage of held-out texts and passages out, hash split: counts by split and
    language."""
    rows = samples(spark, sf_dir).where(C.length_band(F.col("text"))).select("doc_id", "lang", "n_chars", "key")
    held = table(spark, sf_dir, "benchmark").select(C.content_key(F.col("text")).alias("key"))
    kept = C.without_leaks(C.dedup_first(rows, ["key"], ["doc_id"]), held, ["key"])
    kept = C.without_leaks(kept, _leaking(spark, sf_dir), ["doc_id"])
    split = F.when(C.hash_bucket(F.col("doc_id")) == 0, "val").otherwise("train")
    counts = kept.groupBy(split.alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_copies").alias("n_rows"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return counts


def len_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(C.length_band(F.col("text"), 40, 1600))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def dedup_first(spark, sf_dir):
    return C.dedup_first(samples(spark, sf_dir).select("doc_id", "key"), ["key"], ["doc_id"]).select("key", "doc_id", "n_copies")


def dedup_two_keys(spark, sf_dir):
    rows = samples(spark, sf_dir).select("doc_id", "source", "n_chars", "key")
    one = C.dedup_first(rows, ["source", "n_chars"], ["doc_id"]).drop("n_copies")
    return C.dedup_first(one, ["key"], ["doc_id"]).select("doc_id", "source", "n_chars")


def filter_trace(spark, sf_dir):
    rules = [("language", F.col("lang").isin(*LANGUAGES)), ("short", F.length(F.trim("text")) >= 40), ("long", F.length(F.trim("text")) <= 4000), ("source", F.col("source") != "src3")]
    return table(spark, sf_dir, "documents").groupBy(C.first_failing(rules).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def lang_map(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("language", C.mapped(F.col("lang"), LANGUAGES)).where("language IS NOT NULL")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def ext_lang(spark, sf_dir):
    name = F.regexp_extract("url", r"([^/?#]*)$", 1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("none")
    return table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def label_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("after"), F.upper("p_name").alias("before"))
    return C.label_unpivot(rows, ["p_partkey"], "before", "after")


def severity_bucket(spark, sf_dir):
    score = F.when(F.col("s_suppkey") % 10 == 0, "UNKNOWN").otherwise(F.pmod(F.col("s_suppkey"), F.lit(11)).cast("string"))
    return table(spark, sf_dir, "supplier").groupBy(C.severity(score).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def leak_anti(spark, sf_dir):
    """Documents that are a held-out text, by content, or hold one of its passages are left out: one anti-join each."""
    rows = samples(spark, sf_dir).select("doc_id", "source", "key")
    held = table(spark, sf_dir, "benchmark").select(C.content_key(F.col("text")).alias("key"))
    kept = C.without_leaks(C.without_leaks(rows, held, ["key"]), _leaking(spark, sf_dir), ["doc_id"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def leaking_items(spark, sf_dir):
    """The leaking documents themselves, with the item and the shingles they share with it."""
    return _leaking(spark, sf_dir)


def temporal_split(spark, sf_dir):
    out = C.temporal_split(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


def group_split(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    ranked = C.rank_in_order(groups, [F.sha2(F.concat(F.lit("42:"), F.col("id").cast("string")), 256), F.col("id")])
    total = groups.agg(F.expr("count(1) div 9").alias("_most"))
    return ranked.join(F.broadcast(total)).select("id", F.when(F.col("rank") <= F.col("_most"), "val").otherwise("train").alias("split"))


def stratified_sample(spark, sf_dir):
    return C.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)


def quota_fill(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("size"))
    return C.quota_fill(groups, "lang", "source", "size", 0.3)


def split_leak(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(C.hash_bucket(F.col("event_id")) == 0, "val").otherwise("train").alias("split"))
    return C.split_leaks(rows, "user_id", "split")


def near_dup_pairs(spark, sf_dir):
    """Near copies of one language in different sources."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return C.near_dup_pairs(rows, "lang", "source", "doc_id", "text", 0.8).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


def shingle_index(spark, sf_dir):
    """The texts most like every document whose id is divisible by 50, among the 20 that share most shingles with it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = C.shingle_index(rows, "doc_id", "text", rows.where("doc_id % 50 = 0"))
    return found.withColumn("jaccard", F.round("jaccard", 6))


def line_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.numbered_lines(F.col("text"))).alias("digest"))


def budget_truncate(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("cost", F.length("line") + 1)
    return C.budget_prefix(lines, "doc_id", "pos", "cost", 800)


def group_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def topk_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


def cross_tab(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cube = rows.cube("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    return cube.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("level")), 6))


def nested_first_match(spark, sf_dir):
    """The first turn that meets a predicate, else the first: one minimum a conversation, and no list of its turns."""
    first = F.min(F.struct(F.col("role") != "assistant", "turn", "role"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first.alias("t"))
    return turns.select("conv_id", F.col("t.turn").alias("turn"), F.col("t.role").alias("role"))


def reject_filter(spark, sf_dir):
    bad = F.col("text").rlike(r"\*\*\*|%%%") | (F.length("text") < 40)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(bad).alias("rejected"), F.count_if(~bad).alias("kept"))


def source_cap(spark, sf_dir):
    """Safe rows of a hashed order are kept while the share of vuln rows stays at least 0.3."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    cap = rows.agg(F.floor(F.sum("toxic") / F.lit(0.3) - F.sum("toxic")).alias("_most"))
    safe = C.rank_in_order(rows.where("toxic = 0"), [F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256), F.col("doc_id")])
    return rows.where("toxic = 1").unionByName(safe.join(F.broadcast(cap)).where(F.col("rank") <= F.col("_most")).select("doc_id", "toxic"))


def rollup_overlap(spark, sf_dir):
    """Languages by the text sizes they share: sizes of intersection and difference of every two sets."""
    sets = table(spark, sf_dir, "documents").select("lang", F.expr("n_chars div 100").alias("size")).distinct()
    total = sets.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    two = sets.select(F.col("lang").alias("other"), "size").join(sets, "size").where("lang <> other").groupBy("lang", "other").agg(F.count(F.lit(1)).alias("both"))
    every = total.join(total.select(F.col("lang").alias("other")), F.col("lang") != F.col("other"))
    return every.join(two, ["lang", "other"], "left").select("lang", "other", F.coalesce("both", F.lit(0)).alias("n_both"), (F.col("n") - F.coalesce("both", F.lit(0))).alias("only"))


QUERIES = {
    f.__name__: f
    for f in (
        curate_split, len_filter, dedup_first, dedup_two_keys, filter_trace, lang_map, ext_lang, label_unpivot, severity_bucket, leak_anti, leaking_items, shingle_index, temporal_split, group_split,
        stratified_sample, quota_fill, split_leak, near_dup_pairs, line_number, budget_truncate, group_count, topk_count, cross_tab, nested_first_match, reject_filter,
        source_cap, rollup_overlap,
    )
}

KEY = "sha1(lower(trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g'))))"
SHINGLE = """(SELECT DISTINCT {0}, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM
    (SELECT {0}, string_split(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), ' ') AS w FROM {1})))"""
LEAKING = f"""ds AS {SHINGLE.format("doc_id", "documents")}, bs AS {SHINGLE.format("item_id", "benchmark")}, bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
    leaking AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (t) JOIN bn USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= CAST(0.5 AS DOUBLE) * n)"""
ORACLE = {
    "curate_split": f"""WITH {SAMPLES}, {LEAKING}, kept AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY key) AS c
        FROM samples WHERE length(trim(text)) BETWEEN 40 AND 12000)
        SELECT CASE WHEN {BUCKET.format("doc_id")} = 0 THEN 'val' ELSE 'train' END AS split, lang, count(*) AS n, CAST(sum(c) AS BIGINT) AS n_rows, round(avg(n_chars), 6) AS mean_chars
        FROM kept WHERE r = 1 AND key NOT IN (SELECT {KEY.format("text")} FROM benchmark) AND doc_id NOT IN (SELECT doc_id FROM leaking) GROUP BY ALL""",
    "len_filter": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE length(trim(text)) BETWEEN 40 AND 1600 GROUP BY lang",
    "dedup_first": f"WITH {SAMPLES} SELECT key, min(doc_id) AS doc_id, count(*) AS n_copies FROM samples GROUP BY key",
    "dedup_two_keys": f"""WITH {SAMPLES}, one AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) = 1)
        SELECT doc_id, source, n_chars FROM one QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""",
    "filter_trace": """SELECT CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN length(trim(text)) < 40 THEN 'short' WHEN length(trim(text)) > 4000 THEN 'long'
        WHEN source = 'src3' THEN 'source' ELSE 'kept' END AS outcome, count(*) AS n FROM documents GROUP BY 1""",
    "lang_map": "SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END AS language, count(*) AS n FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY 1",
    "ext_lang": """WITH p AS (SELECT regexp_extract(url, '([^/?#]*)$', 1) AS name FROM pages)
        SELECT CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE 'none' END AS ext, count(*) AS n FROM p GROUP BY 1""",
    "label_unpivot": "SELECT p_partkey, 'vuln' AS label, upper(p_name) AS value FROM part UNION ALL SELECT p_partkey, 'safe', lower(p_name) FROM part",
    "severity_bucket": """WITH s AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(s_suppkey % 11 AS DOUBLE) END AS v FROM supplier)
        SELECT CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN v >= 9 THEN 'CRITICAL' WHEN v >= 7 THEN 'HIGH' WHEN v >= 4 THEN 'MEDIUM' WHEN v > 0 THEN 'LOW' ELSE 'NONE' END AS severity, count(*) AS n FROM s GROUP BY 1""",
    "leak_anti": f"""WITH {SAMPLES}, {LEAKING} SELECT source, count(*) AS n FROM samples
        WHERE key NOT IN (SELECT {KEY.format("text")} FROM benchmark) AND doc_id NOT IN (SELECT doc_id FROM leaking) GROUP BY source""",
    "leaking_items": f"WITH {LEAKING} SELECT * FROM leaking",
    "shingle_index": f"""WITH ds AS {SHINGLE.format("doc_id", "documents")}, n AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1),
        m AS (SELECT a.doc_id AS q, b.doc_id AS id, count(*) AS shared FROM ds a JOIN ds b ON a.t = b.t AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY shared DESC, id) AS r FROM m), j AS (SELECT q, id, shared, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS j FROM r JOIN n x ON x.doc_id = q JOIN n y ON y.doc_id = id WHERE r <= 20)
        SELECT q, id, shared, round(j, 6) AS jaccard FROM j WHERE j >= CAST(0.95 AS DOUBLE)""",
    "temporal_split": """WITH g AS (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_custkey) AS r, count(*) OVER () AS n FROM g)
        SELECT CASE WHEN r <= greatest(1, n // 10) THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM r GROUP BY 1""",
    "group_split": """WITH g AS (SELECT DISTINCT o_custkey AS id FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || id), id) AS r, count(*) OVER () AS n FROM g)
        SELECT id, CASE WHEN r <= n // 9 THEN 'val' ELSE 'train' END AS split FROM r""",
    "stratified_sample": """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
        WHERE r <= greatest(1, CAST(round(n * CAST(0.1 AS DOUBLE)) AS BIGINT))""",
    "quota_fill": """WITH g AS (SELECT lang, source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1, 2), w AS (SELECT *, CAST(sum(size) OVER (PARTITION BY lang ORDER BY sha256('42:' || source), source
        ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(sum(size) OVER (PARTITION BY lang) AS BIGINT) AS total FROM g) SELECT lang, source, size FROM w WHERE before < total * CAST(0.3 AS DOUBLE)""",
    "split_leak": f"""WITH e AS (SELECT user_id, CASE WHEN {BUCKET.format("event_id")} = 0 THEN 'val' ELSE 'train' END AS split FROM events)
        SELECT user_id, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM e GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "near_dup_pairs": f"""WITH ds AS {SHINGLE.format("doc_id", "documents")}, k AS (SELECT doc_id, string_agg(t, chr(1) ORDER BY t) AS k, count(*) AS n FROM ds GROUP BY 1),
        c AS (SELECT min(doc_id) AS doc_id, lang, source, n FROM k JOIN documents USING (doc_id) GROUP BY lang, source, k, n), s AS (SELECT doc_id, lang, source, n, t FROM c JOIN ds USING (doc_id)),
        m AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS c, any_value(a.n) AS x, any_value(b.n) AS y FROM s a JOIN s b ON a.t = b.t AND a.lang = b.lang AND a.source <> b.source AND a.doc_id < b.doc_id GROUP BY 1, 2)
        SELECT id_a, id_b, round(CAST(c AS DOUBLE) / (x + y - c), 6) AS jaccard FROM m WHERE CAST(c AS DOUBLE) / (x + y - c) >= CAST(0.8 AS DOUBLE)""",
    "line_number": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)
        SELECT doc_id, md5(string_agg(lpad(CAST(i AS VARCHAR), 4, ' ') || ': ' || line, chr(10) ORDER BY i)) AS digest FROM l GROUP BY doc_id""",
    "budget_truncate": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
        s AS (SELECT doc_id, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM l)
        SELECT doc_id, count(*) FILTER (t <= 800) AS lines_kept, coalesce(max(t) FILTER (t <= 800), 0) AS cost_kept, count(*) AS n_lines FROM s GROUP BY 1""",
    "group_count": "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2",
    "topk_count": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
    "cross_tab": """WITH c AS (SELECT lang, quality, toxic, count(*) AS n, CAST(grouping_id(lang, quality, toxic) AS BIGINT) AS level FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality, toxic))
        SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY level), 6) AS share FROM c""",
    "nested_first_match": """SELECT conv_id, coalesce(min(turn) FILTER (role = 'assistant'), min(turn)) AS turn,
        coalesce(min_by(role, turn) FILTER (role = 'assistant'), min_by(role, turn)) AS role FROM conversations GROUP BY 1""",
    "reject_filter": """SELECT source, count(*) FILTER (contains(text, '***') OR contains(text, '%%%') OR length(text) < 40) AS rejected,
        count(*) FILTER (NOT (contains(text, '***') OR contains(text, '%%%') OR length(text) < 40)) AS kept FROM documents GROUP BY 1""",
    "source_cap": """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM labels)
        SELECT doc_id, toxic FROM r WHERE toxic = 1 OR r <= (SELECT floor(sum(toxic) / CAST(0.3 AS DOUBLE) - sum(toxic)) FROM labels)""",
    "rollup_overlap": """WITH d AS (SELECT DISTINCT lang, n_chars // 100 AS size FROM documents), l AS (SELECT lang, count(*) AS n FROM d GROUP BY 1),
        b AS (SELECT x.lang, y.lang AS other, count(*) AS c FROM d x JOIN d y ON x.size = y.size AND x.lang <> y.lang GROUP BY 1, 2)
        SELECT x.lang, y.lang AS other, coalesce(c, 0) AS n_both, x.n - coalesce(c, 0) AS only FROM l x JOIN l y ON x.lang <> y.lang LEFT JOIN b ON b.lang = x.lang AND b.other = y.lang""",
}
