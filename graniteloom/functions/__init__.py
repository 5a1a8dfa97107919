"""Functions over text and answers: fields, fences, dates, differences of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graniteloom.functions.linediff import changed_lines, changed_places, diff_counts, hunk_text, line_counts, line_steps, sequence_ratio


__all__ = [
    "answer",
    "changed_lines",
    "changed_places",
    "day",
    "diff_counts",
    "extended",
    "fenced",
    "field",
    "hunk_text",
    "json_items",
    "line_shingles",
    "line_counts",
    "line_steps",
    "log_gap",
    "sequence_ratio",
    "set_similarity",
    "without_thinking",
    "year",
]


def fenced(text: Column) -> Column:
    """The body of the first code fence, else the text."""
    body = F.regexp_extract(text, r"(?s)```[A-Za-z0-9+#]*\n(.*?)```", 1)
    return F.when(body != "", body).otherwise(text)


def without_thinking(text: Column) -> Column:
    """A text without its <think> blocks, closed or not."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))


def field(text: Column, *names: str) -> Column:
    """The value of the first line "name: value" of one of the names, bold marks aside; null without one."""
    plain = F.regexp_replace(text, r"[*]{2}", "")
    pattern = r"(?im)^[ \t]*(?:%s)[ \t]*:[ \t]*(.+?)[ \t]*$" % "|".join(names)
    return F.nullif(F.regexp_extract(plain, pattern, 1), F.lit(""))


def answer(text: Column) -> Column:
    """struct<label, cwe, severity> of a labelled answer: label is vuln, safe or parse_fail."""
    plain = without_thinking(text)
    said = F.lower(field(plain, "label", "verdict", "vulnerable"))
    label = F.when(said.isin("vuln", "vulnerable", "yes", "true"), "vuln").when(said.isin("safe", "no", "false", "not vulnerable"), "safe").otherwise("parse_fail")
    return F.struct(label.alias("label"), F.nullif(F.regexp_extract(F.upper(field(plain, "cwe")), "CWE-[0-9]+", 0), F.lit("")).alias("cwe"), F.upper(field(plain, "severity")).alias("severity"))


def json_items(text: Column, schema: str) -> Column:
    """The items of the first JSON array in a text; null if there is none that parses."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), f"array<{schema}>")


def year(text: Column) -> Column:
    """The year of the first date-like part of a text."""
    return F.regexp_extract(text, "(?:19|20)[0-9]{2}", 0).try_cast("int")


def day(text: Column) -> Column:
    """The day of an ISO time, by its first ten characters."""
    return F.left(text, F.lit(10)).try_cast("date")


def log_gap(a: Column, b: Column, floor: float = -30.0) -> Column:
    """The difference of two log probabilities, neither below the floor; a missing one is the floor."""
    low = F.lit(floor)
    return F.greatest(F.coalesce(a, low), low) - F.greatest(F.coalesce(b, low), low)


def extended(x: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """The line through two points at x."""
    return F.lit(y1) + (x - F.lit(x1)) * F.lit((y2 - y1) / (x2 - x1))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def line_shingles(text: Column, k: int = 3) -> Column:
    """The distinct runs of k trimmed lines that are not empty; fewer lines are one run."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - k, F.lit(0))), lambda i: F.array_join(F.slice(lines, i + 1, k), "\n"))
    return F.array_distinct(runs)
