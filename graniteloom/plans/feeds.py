"""Feed and sample-text queries and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graniteloom.operators import curation as C
from graniteloom.operators import feeds as V
from graniteloom.operators.state import shared_dir
from graniteloom.plans.tables import table
from graniteloom.sources import paging

LANGUAGES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "src1": "first source"}
CUE = "(?i) (that|dass|que) "


def _feed(spark, sf_dir):
    """Orders as entries of a feed: nested scores by version, a status, a class and a date."""
    o = table(spark, sf_dir, "orders")
    value = F.round(F.col("o_totalprice") % 100 / 10, 1)

    def metric(present, kind):
        return F.when(present, F.struct(value.alias("score"), F.lit(kind).alias("version")))

    k = F.col("o_orderkey") % 7
    metrics = F.struct(metric(k == 0, "4.0").alias("v40"), metric(k.isin(1, 2), "3.1").alias("v31"), metric(k.isin(2, 3), "3.0").alias("v30"), metric(k.isin(3, 4, 5), "2.0").alias("v2"))
    return o.select(
        "o_orderkey",
        F.concat(F.lit("CVE-"), F.year("o_orderdate"), F.lit("-"), F.col("o_orderkey")).alias("cve_id"),
        metrics.alias("metrics"),
        F.when(F.col("o_orderstatus") == "P", "Rejected").otherwise("Analyzed").alias("status"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("CWE-"), F.col("o_custkey") % 40)).otherwise("NVD-noinfo").alias("cwe"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"),
    )


def _scored(spark, sf_dir):
    m = V.preferred(*(F.col(f"metrics.{v}") for v in ("v40", "v31", "v30", "v2")))
    rows = _feed(spark, sf_dir).select("*", m["score"].alias("score"), m["version"].alias("version"))
    return rows.withColumn("severity", C.severity(F.coalesce(F.col("score").cast("string"), F.lit("none"))))


def cvss_precedence(spark, sf_dir):
    """The score of the newest version that an entry has, and its severity."""
    return _scored(spark, sf_dir).groupBy("version", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


def cpe_products(spark, sf_dir):
    """Up to five products an entry, from names of which some are of another kind."""
    name = F.when(F.col("l_suppkey") % 9 == 0, "other:1").otherwise(F.concat_ws(":", F.lit("cpe:2.3:a"), F.concat(F.lit("vendor"), F.col("l_suppkey") % 5), F.concat(F.lit("product"), F.col("l_partkey") % 3), F.lit("*")))
    cpes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(name).alias("cpes"))
    return cpes.select("l_orderkey", F.array_join(V.products(F.col("cpes")), ",").alias("products"))


def cve_text(spark, sf_dir):
    """The text of each entry that is embedded, N/A for what is missing, by its digest."""
    said = V.described(CVE=F.col("cve_id"), Severity=F.col("severity"), Score=F.col("score"), Class=F.when(F.col("cwe") != "NVD-noinfo", F.col("cwe")), Published=F.col("published"))
    return _scored(spark, sf_dir).select("cve_id", F.md5(said).alias("digest"))


def feed_age(spark, sf_dir):
    """Entries that are not rejected and have a class, by their age in years on a day."""
    rows = _feed(spark, sf_dir).where((F.col("status") != "Rejected") & F.startswith("cwe", F.lit("CWE-")))
    age = V.age_days(F.col("published"), "2002-01-01")
    return rows.groupBy(F.floor(age / 365).alias("years")).agg(F.count(F.lit(1)).alias("n"), F.min(age).alias("least"), F.max(age).alias("most"))


def newest_first(spark, sf_dir):
    """The twenty newest entries; a report, so the limit is its meaning."""
    return _feed(spark, sf_dir).orderBy(F.desc("published"), "o_orderkey").limit(20).select("cve_id", "published", "status")


def score_stats(spark, sf_dir):
    """Mean, largest and smallest score and number of entries of each severity, with its place in the fixed order."""
    found = _scored(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.max("score").alias("most"), F.min("score").alias("least"))
    return found.withColumn("place", V.severity_place(F.col("severity")))


def reason_sentence(spark, sf_dir):
    """The sentence of each document that gives a reason, and how it was found."""
    r = V.reason(F.coalesce("text", F.lit("")), CUE)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(r)).alias("r"))
    return rows.select("doc_id", "r.tier", F.md5("r.reason").alias("digest"))


def prompt_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(V.prompt(F.col("lang"), F.coalesce("text", F.lit("")), "Is this code vulnerable?")).alias("digest"))


def lang_resolve(spark, sf_dir):
    """A language from free names: whole name, token, then part of it."""
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("source", F.lit("?")).alias("source"), (F.col("n_chars") % 3).alias("k"))
    name = F.when(F.col("k") == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).when(F.col("k") == 1, F.concat_ws(" / ", "source", "lang")).otherwise(F.concat_ws("-", "source", "lang"))
    return d.groupBy(V.language_of(name, LANGUAGES).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def url_owner(spark, sf_dir):
    """Owner and name, as the first two parts of an address."""
    return table(spark, sf_dir, "pages").select("page_id", V.repository(F.col("url")).alias("repo"))


def ext_language(spark, sf_dir):
    """File extension to language by a literal map; what has no known one is other."""
    exts = ["a.py", "b.test.js", "c.java", "README", "d.PY", "e.rs", ".py"]
    name = F.get(F.array(*(F.lit(n) for n in exts)), (F.col("p_partkey") % len(exts)).cast("int"))
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    language = F.when(F.contains(name, F.lit(".")), C.mapped(ext, {"py": "python", "js": "javascript", "java": "java"}))
    return table(spark, sf_dir, "part").groupBy(F.coalesce(language, F.lit("other")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def severity_fallback(spark, sf_dir):
    """Severity by score; without a number by the word given, if it is one of the known ones; else UNKNOWN."""
    given = F.when(F.col("s_suppkey") % 4 == 0, "high").when(F.col("s_suppkey") % 4 == 1, "n/a").otherwise((F.col("s_suppkey") % 11).cast("string"))
    by_score = C.severity(given)
    word = F.upper(given)
    severity = F.when(by_score != "UNKNOWN", by_score).when(word.isin(*V.SEVERITIES), word).otherwise("UNKNOWN")
    return table(spark, sf_dir, "supplier").groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def union_sources(spark, sf_dir):
    """Rows of two sources with unlike columns, by name; what a source lacks is null."""
    one = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("documents").alias("origin"))
    two = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("origin", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def total_order(spark, sf_dir):
    """Places in the order of five keys."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return C.rank_in_order(rows, ["lang", F.desc("source"), "n_chars", "doc_id"], "place").select("doc_id", "place")


def filter_two_keys(spark, sf_dir):
    """Unique by id, then long enough, then unique by content: a row that the first key drops claims no content."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "source", (F.col("n_chars") % 400).cast("string")).alias("id"), "n_chars", C.content_key(F.col("text")).alias("key"))
    one = C.dedup_first(rows, ["id"], ["doc_id"]).drop("n_copies").where("n_chars >= 200")
    return C.dedup_first(one, ["key"], ["doc_id"]).select("doc_id", "id")


def paged_feed(spark, sf_dir):
    """Documents as pages of a feed of 200 items, read back page by page: their entries and lengths by page and language."""
    base = f"{shared_dir(spark)}/feeds/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    paging.write_pages(docs, F.struct("doc_id", "lang", "n_chars"), ["doc_id"], base)
    spark.dataSource.register(paging.PagedFeed)
    rows = spark.read.format("paged_feed").option("base", base).load().select("index", F.from_json("item", "doc_id long, lang string, n_chars long").alias("i"))
    return rows.groupBy(F.expr("index div 200").alias("page"), "i.lang").agg(F.count(F.lit(1)).alias("n"), F.sum("i.n_chars").alias("chars"))


def variant_versions(spark, sf_dir):
    """Entries of one document of mixed versions and shapes: their scores and severities by version."""
    n = F.col("n_chars")
    score, severity = F.concat((n % 10).cast("string"), F.lit(".5")), F.when(n % 2 == 0, "HIGH").otherwise("LOW")

    def metric(name, inside):
        data = F.concat(F.lit('{"baseScore": '), score, F.when(F.lit(inside), F.concat(F.lit(', "baseSeverity": "'), severity, F.lit('"}'))).otherwise(F.concat(F.lit('}, "baseSeverity": "'), severity, F.lit('"'))))
        return F.concat(F.lit(f'"metrics": {{"{name}": [{{"type": "Secondary", "cvssData": {{"baseScore": 9.9}}}}, {{"type": "Primary", "cvssData": '), data, F.lit("}]}"))

    body = F.when(n % 5 == 0, metric("cvssMetricV40", True)).when(n % 5 == 1, metric("cvssMetricV31", True)).when(n % 5 == 2, metric("cvssMetricV30", True)).when(n % 5 == 3, metric("cvssMetricV2", False)).otherwise(F.concat(F.lit('"severity": "'), severity, F.lit('", "score": '), score))
    entry = F.concat(F.lit('{"id": "D-'), F.col("doc_id"), F.lit('", '), body, F.lit("}"))
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"cve": '), entry, F.lit("}"))).otherwise(entry)
    many = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("page"), wrapped.alias("entry")).groupBy("page").agg(F.array_join(F.collect_list("entry"), ", ").alias("e"))
    document = F.when(F.col("page") % 3 == 0, F.concat(F.lit("["), "e", F.lit("]"))).when(F.col("page") % 3 == 1, F.concat(F.lit('{"data": ['), "e", F.lit("]}"))).otherwise(F.concat(F.lit('{"vulnerabilities": ['), "e", F.lit("]}")))
    found = many.select(F.explode(V.entries(document)).alias("v")).select(V.entry_fields(F.col("v")).alias("f"))
    return found.groupBy("f.version", "f.severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f.score"), 2).alias("total"), F.count_distinct("f.id").alias("ids"))


QUERIES = {
    f.__name__: f
    for f in (
        cvss_precedence, cpe_products, cve_text, feed_age, newest_first, score_stats, reason_sentence, prompt_text, lang_resolve, url_owner, ext_language, severity_fallback, union_sources, paged_feed, variant_versions,
        total_order, filter_two_keys,
    )
}

SEVERITY = "CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END"
FEED = f"""WITH f AS (SELECT o_orderkey, 'CVE-' || year(o_orderdate) || '-' || o_orderkey AS cve_id, round(o_totalprice % 100 / 10, 1) AS value, o_orderkey % 7 AS k, CASE WHEN o_orderstatus = 'P' THEN 'Rejected' ELSE 'Analyzed' END AS status,
    CASE WHEN o_custkey % 5 > 0 THEN 'CWE-' || o_custkey % 40 ELSE 'NVD-noinfo' END AS cwe, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders),
    v AS (SELECT *, CASE WHEN k = 6 THEN NULL ELSE value END AS score, CASE WHEN k = 0 THEN '4.0' WHEN k IN (1, 2) THEN '3.1' WHEN k = 3 THEN '3.0' WHEN k IN (4, 5) THEN '2.0' END AS version FROM f), s AS (SELECT *, {SEVERITY} AS severity FROM v)"""
NAMES = "['C++', 'modern c++ code', 'Python', 'cpython', 'go', 'golang', 'C', 'objective c', 'Java', 'javascript-es6', 'cobol', 'x-py-y']"
TONGUE = "CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END"

ORACLE = {
    "cvss_precedence": f"{FEED} SELECT version, severity, count(*) AS n, round(sum(score), 2) AS total FROM s GROUP BY 1, 2",
    "cpe_products": """WITH c AS (SELECT DISTINCT l_orderkey, 'vendor' || l_suppkey % 5 || ':product' || l_partkey % 3 AS p FROM lineitem WHERE l_suppkey % 9 <> 0), t AS (SELECT l_orderkey, array_to_string(list(p ORDER BY p)[1:5], ',') AS p FROM c GROUP BY 1)
        SELECT o.l_orderkey, coalesce(p, '') AS products FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN t USING (l_orderkey)""",
    "cve_text": f"""{FEED} SELECT cve_id, md5('CVE: ' || cve_id || '. Severity: ' || severity || '. Score: ' || coalesce(CAST(score AS VARCHAR), 'N/A') || '. Class: ' || CASE WHEN cwe = 'NVD-noinfo' THEN 'N/A' ELSE cwe END || '. Published: ' || published) AS digest FROM s""",
    "feed_age": f"""{FEED}, a AS (SELECT date_diff('day', CAST(published AS DATE), DATE '2002-01-01') AS age FROM f WHERE status <> 'Rejected' AND starts_with(cwe, 'CWE-'))
        SELECT CAST(floor(age / CAST(365 AS DOUBLE)) AS BIGINT) AS years, count(*) AS n, min(age) AS least, max(age) AS most FROM a GROUP BY 1""",
    "newest_first": f"{FEED} SELECT cve_id, published, status FROM f ORDER BY published DESC, o_orderkey LIMIT 20",
    "score_stats": f"{FEED} SELECT severity, count(*) AS n, round(avg(score), 4) AS mean, max(score) AS most, min(score) AS least, list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE', 'UNKNOWN'], severity) AS place FROM s GROUP BY 1",
    "reason_sentence": """WITH s AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 30 AND 400) AS f FROM documents),
        c AS (SELECT *, list_filter(f, lambda x: regexp_matches(x, '(?i) (that|dass|que) '))[1] AS c FROM s)
        SELECT doc_id, CASE WHEN c IS NOT NULL THEN 'causal' WHEN len(f) > 0 THEN 'plain' ELSE 'cut' END AS tier, md5(coalesce(c, f[1], left(text, 400))) AS digest FROM c""",
    "prompt_text": """SELECT doc_id, md5('Is this code vulnerable?' || chr(10) || 'Language: ' || coalesce(lang, 'unknown') || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10)) AS digest FROM documents""",
    "paged_feed": "WITH p AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS page, lang, n_chars FROM documents) SELECT page, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM p GROUP BY 1, 2",
    "variant_versions": """WITH e AS (SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN '4.0' WHEN 1 THEN '3.1' WHEN 2 THEN '3.0' WHEN 3 THEN '2.0' END AS version, CASE WHEN n_chars % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, n_chars % 10 + CAST(0.5 AS DOUBLE) AS score FROM documents)
        SELECT version, severity, count(*) AS n, round(sum(score), 2) AS total, count(DISTINCT doc_id) AS ids FROM e GROUP BY 1, 2""",
    "lang_resolve": f"""SELECT CASE WHEN n_chars % 3 = 0 THEN {TONGUE} WHEN n_chars % 3 = 1 THEN CASE WHEN source = 'src1' THEN 'first source' ELSE {TONGUE} END WHEN contains(source, 'src1') THEN 'first source' END AS language, count(*) AS n FROM documents GROUP BY 1""",
    "url_owner": """WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS p FROM pages) SELECT page_id, CASE WHEN len(p) > 2 AND p[2] <> '' AND p[3] <> '' THEN p[2] || '/' || p[3] END AS repo FROM p""",
    "ext_language": "SELECT ['python', 'javascript', 'java', 'other', 'python', 'other', 'python'][p_partkey % 7 + 1] AS language, count(*) AS n FROM part GROUP BY 1",
    "severity_fallback": f"""WITH g AS (SELECT s_suppkey % 4 AS k, CASE WHEN s_suppkey % 4 > 1 THEN CAST(s_suppkey % 11 AS DOUBLE) END AS score FROM supplier)
        SELECT CASE WHEN k = 0 THEN 'HIGH' ELSE {SEVERITY} END AS severity, count(*) AS n FROM g GROUP BY 1""",
    "union_sources": "SELECT origin, lang, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT doc_id AS id, lang, 'documents' AS origin FROM documents UNION ALL SELECT item_id, NULL, 'benchmark' FROM benchmark) GROUP BY 1, 2",
    "total_order": "SELECT doc_id, row_number() OVER (ORDER BY lang, source DESC, n_chars, doc_id) AS place FROM documents",
    "filter_two_keys": """WITH d AS (SELECT doc_id, source || ':' || n_chars % 400 AS id, n_chars, sha1(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) AS key FROM documents),
        one AS (SELECT * FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1) WHERE n_chars >= 200) SELECT doc_id, id FROM one QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""",
}
