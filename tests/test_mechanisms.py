"""Sketches, counters of a pass, and feeds of several shapes."""

import json

from pyspark.sql import functions as F

from graniteloom.operators import curation, feeds, sketches
from graniteloom.sources import readers


def test_sketches_merge_within_their_bounds(spark, tmp_path):
    """Stored a group, read back and merged: as good as one over all rows."""
    rows = spark.range(60_000).select((F.col("id") % 12).alias("part"), (F.col("id") % 3).alias("grp"), F.concat(F.lit("k"), F.col("id") % 20_000).alias("key"), (F.col("id") * 7919 % 60_000).alias("v"))
    sketches.sketched(rows, ["part", "grp"], "key", "v").write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    got = sketches.merged(stored, ["grp"]).select("n", sketches.distinct_count().alias("d"), *(sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))), sketches.rank_of(F.lit(30_000).cast("long")).alias("r"))
    for r in got.collect():
        assert r["n"] == 20_000 and abs(r["d"] - 20_000) < sketches.DISTINCT_ERROR * 20_000
        assert all(abs(r[f"q{i}"] / 60_000 - q) < sketches.RANK_ERROR for i, q in enumerate((0.1, 0.5, 0.99))) and abs(r["r"] - 0.5) < sketches.RANK_ERROR
    whole = sketches.merged(stored, [])
    assert abs(whole.select(sketches.distinct_count()).first()[0] - 20_000) < sketches.DISTINCT_ERROR * 20_000
    bins = sketches.binned(rows, "v", whole, 5).groupBy("bin").count().collect()
    assert sorted(r["bin"] for r in bins) == list(range(5)) and all(abs(r["count"] / 60_000 - 0.2) < 2 * sketches.RANK_ERROR for r in bins)
    assert sketches.merged(stored.limit(0), ["grp"]).count() == 0


def test_counters_of_the_writing_pass(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = [("language", F.col("lang").isin("en", "de")), ("short", F.length(F.trim("text")) >= 40), ("long", F.length(F.trim("text")) <= 4000)]
    got = curation.kept_and_counted(docs, rules, f"{tmp_path}/kept")
    want = {r[0]: r[1] for r in docs.groupBy(curation.first_failing(rules)).count().collect()}
    assert {k: n for k, n in got.items() if n} == want and set(got) == {"kept", "language", "short", "long"}
    kept = spark.read.parquet(f"{tmp_path}/kept")
    assert kept.columns == docs.columns and kept.count() == got["kept"]
    assert curation.kept_and_counted(docs.limit(0), rules, f"{tmp_path}/none") == dict.fromkeys(got, 0)


ENTRIES = [
    ({"cve": {"id": "A", "vulnStatus": "Analyzed", "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hello"}], "metrics": {"cvssMetricV31": [{"type": "Secondary", "cvssData": {"baseScore": 1.0, "baseSeverity": "LOW"}}, {"type": "Primary", "cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}], "cvssMetricV2": [{"type": "Primary", "baseSeverity": "HIGH", "cvssData": {"baseScore": 7.5}}]}}}, ("A", "Analyzed", "hello", "3.1", 9.8, "CRITICAL")),
    ({"id": "B", "descriptions": [{"lang": "fr", "value": "salut"}], "metrics": {"cvssMetricV2": [{"type": "Secondary", "baseSeverity": "HIGH", "cvssData": {"baseScore": 7.5}}]}}, ("B", None, "salut", "2.0", 7.5, "HIGH")),
    ({"id": "C", "metrics": {"cvssMetricV40": [{"type": "Primary", "cvssData": {"baseScore": 5, "baseSeverity": "MEDIUM"}}], "cvssMetricV30": [{"cvssData": {"baseScore": 1.5}}]}}, ("C", None, None, "4.0", 5.0, "MEDIUM")),
    ({"id": "D", "metrics": {"cvssMetricV31": [], "cvssMetricV30": [{"cvssData": {"baseScore": 1.5}}]}}, ("D", None, None, "3.0", 1.5, None)),
    ({"cve_id": "E", "description": "plain", "severity": "LOW", "score": "3.5"}, ("E", None, "plain", None, 3.5, "LOW")),
    ({"id": 7, "metrics": "odd", "descriptions": 3}, ("7", None, None, None, None, None)),
]


def test_feeds_of_several_versions(spark, tmp_path):
    """Entries of all versions in one file, lists and envelopes, and documents that are none."""
    items = [e for e, _ in ENTRIES]
    documents = {"list": items, "data": {"data": items, "vulnerabilities": [{"id": "no"}]}, "nvd": {"totalResults": 6, "vulnerabilities": items}, "empty": [], "other": {"x": 1}, "text": "nothing"}
    for name, d in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    (tmp_path / "broken.json").write_text("[{")
    found = readers.variant_feed(spark, str(tmp_path)).select("path", feeds.entry_fields(F.col("entry")).alias("f")).collect()
    for name in ("list", "data", "nvd"):
        assert [tuple(r["f"]) for r in found if r["path"].endswith(f"{name}.json")] == [w for _, w in ENTRIES]
    assert len(found) == 18
