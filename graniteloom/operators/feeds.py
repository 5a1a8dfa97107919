"""Vulnerability feeds: choices among nested values, text forms, ages, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the worst on.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE", "UNKNOWN")


def preferred(*choices: Column) -> Column:
    """The first of several nested values that is there."""
    return F.coalesce(*choices)


def first_match(items: Column, meets) -> Column:
    """The first element that meets a predicate, else the first."""
    return F.coalesce(F.get(F.filter(items, meets), F.lit(0)), F.get(items, F.lit(0)))


def severity_place(severity: Column) -> Column:
    """The place of a severity in their fixed order, from 1 on; 0 for another value."""
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity).cast("int")


def products(cpes: Column, most: int = 5) -> Column:
    """The first `most` distinct vendor:product in order, of names cpe:2.3:part:vendor:product:...; others are left out."""
    parts = F.transform(F.filter(cpes, lambda c: F.startswith(c, F.lit("cpe:2.3:")) & (F.size(F.split(c, ":")) > 4)), lambda c: F.split(c, ":"))
    return F.slice(F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.concat_ws(":", p[3], p[4])))), 1, most)


def described(**fields: Column) -> Column:
    """"Name: value" for each field, "N/A" for null and empty ones, joined by ". "."""
    return F.concat_ws(". ", *(F.concat(F.lit(f"{name.replace('_', ' ')}: "), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("N/A"))) for name, value in fields.items()))


def age_days(day: Column, reference: str) -> Column:
    """Whole days from a day to the reference day; null for what is no date."""
    return F.datediff(F.lit(reference).cast("date"), day.try_cast("date"))


def sentences(text: Column) -> Column:
    """A text cut after . ! or ? where white space follows."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")


def reason(text: Column, cue: str, least: int = 30, most: int = 400) -> Column:
    """struct<reason, tier>: the first sentence of fitting length that holds a cue ("causal"), else the first of fitting
    length ("plain"), else the first `most` characters ("cut")."""
    fitting = F.filter(F.transform(sentences(text), lambda x: F.trim(x)), lambda s: F.length(s).between(least, most))
    causal, plain = F.get(F.filter(fitting, lambda s: s.rlike(cue)), F.lit(0)), F.get(fitting, F.lit(0))
    tier = F.when(causal.isNotNull(), "causal").when(plain.isNotNull(), "plain").otherwise("cut")
    return F.struct(F.coalesce(causal, plain, F.left(text, F.lit(most))).alias("reason"), tier.alias("tier"))


def prompt(language: Column, code: Column, question: str) -> Column:
    """A question about fenced code."""
    return F.concat(F.lit(f"{question}\nLanguage: "), F.coalesce(language, F.lit("unknown")), F.lit("\n```\n"), code, F.lit("\n```\n"))


def language_of(name: Column, table: dict[str, str]) -> Column:
    """A language by its whole name, else by one of its tokens (between white space, slashes, commas and brackets), else by a
    key of three letters or more inside it; longer keys first."""
    low = F.lower(F.trim(name))
    keys = sorted(table, key=lambda k: (-len(k), k))
    found = F.lit(None).cast("string")
    for holds in (lambda k: F.contains(low, F.lit(k)) if len(k) >= 3 else F.lit(False), lambda k: F.array_contains(F.split(low, r"[\s/,()]+"), k), lambda k: low == k):
        choice = F.lit(None).cast("string")
        for k in reversed(keys):
            choice = F.when(holds(k), table[k]).otherwise(choice)
        found = F.coalesce(choice, found)
    return found


def repository(url: Column) -> Column:
    """owner/name of a repository address of several hosts, null if it is none."""
    return F.nullif(F.regexp_extract(url, r"^(?:https?://|git@)[^/:]+[/:]([^/]+/[^/?#]+?)(?:[.]git)?(?:[/?#].*)?$", 1), F.lit(""))


#: The names of an entry's scores, the newest version first.
SCORES = (("4.0", "cvssMetricV40"), ("3.1", "cvssMetricV31"), ("3.0", "cvssMetricV30"), ("2.0", "cvssMetricV2"))


def entries(document: Column) -> Column:
    """The entries of a feed (JSON text) as an array of variants, whatever their shapes: a list, or an envelope with `data`
    or else `vulnerabilities`; null for text that is no JSON or holds neither."""
    v = F.try_parse_json(document)
    many = "array<variant>"
    return F.coalesce(F.try_variant_get(v, "$", many), F.try_variant_get(v, "$.data", many), F.try_variant_get(v, "$.vulnerabilities", many))


def _at(entry: Column, path: str, kind: str) -> Column:
    """A value of an entry, which may be wrapped in `cve`."""
    return F.coalesce(F.try_variant_get(entry, f"$.{path}", kind), F.try_variant_get(entry, f"$.cve.{path}", kind))


def entry_fields(entry: Column) -> Column:
    """struct<id, status, description, version, score, severity> of an entry of any version of the feed.

    description: the English one of a list, else the first, else a plain string. The score is that of the newest version the
    entry has, its source's primary one first; version 2 keeps its severity beside the score's data, not in it.
    """
    listed = _at(entry, "descriptions", "array<struct<lang string, value string>>")
    description = F.coalesce(first_match(listed, lambda d: d["lang"] == "en")["value"], _at(entry, "description", "string"))
    kind = "array<struct<type string, baseSeverity string, cvssData struct<baseScore double, baseSeverity string>>>"
    choices = []
    for version, name in SCORES:
        m = first_match(_at(entry, f"metrics.{name}", kind), lambda x: x["type"] == "Primary")
        choices.append(F.when(m["cvssData"]["baseScore"].isNotNull(), F.struct(F.lit(version).alias("version"), m["cvssData"]["baseScore"].alias("score"), F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]).alias("severity"))))
    plain = F.struct(F.lit(None).cast("string").alias("version"), _at(entry, "score", "double").alias("score"), _at(entry, "severity", "string").alias("severity"))
    best = F.coalesce(*choices, plain)
    return F.struct(F.coalesce(_at(entry, "id", "string"), _at(entry, "cve_id", "string")).alias("id"), _at(entry, "vulnStatus", "string").alias("status"), description.alias("description"), *(best[c].alias(c) for c in ("version", "score", "severity")))
