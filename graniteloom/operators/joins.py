"""Joins on intervals, bands and patterns, with an equi key wherever the semantics give one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """points joined with the spans (start to stop, both included) of their key that contain them.

    Spans are dealt to the bins of `width` they touch, so a key with many spans is no nested loop.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    dealt = spans.where(F.col(start) <= F.col(stop)).withColumn("_bin", F.explode(bins))
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    return placed.join(dealt, [*key, "_bin"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("_bin")


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: list[str], id: str, at: str, name: str, start: str, stop: str, width: int) -> DataFrame:
    """(id, name): the shortest span that contains each point (the smallest name among equals); null without one."""
    found = containing(points.select(*key, id, at), spans, key, at, start, stop, width)
    best = found.groupBy(id).agg(F.min_by(name, F.struct(F.col(stop) - F.col(start), F.col(name))).alias(name))
    return points.select(id).join(best, id, "left")


def within_band(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, band: int) -> DataFrame:
    """left joined with the rows of right of the same key with |a - b| <= band, by bins of the band's width."""
    size = max(1, band)
    near = F.floor(F.col(a) / size)
    spread = left.withColumn("_bin", F.explode(F.array(near - 1, near, near + 1)))
    return spread.join(right.withColumn("_bin", F.floor(F.col(b) / size)), [*key, "_bin"]).where(F.abs(F.col(a) - F.col(b)) <= band).drop("_bin")


def has_near(left: DataFrame, right: DataFrame, key: list[str], id: str, a: str, b: str, band: int) -> DataFrame:
    """left's ids with `hit`: whether a row of right lies within the band."""
    hits = within_band(left.select(*key, id, a), right.select(*key, b).distinct(), key, a, b, band).select(id).distinct().withColumn("hit", F.lit(True))
    return left.select(id).join(hits, id, "left").select(id, F.coalesce("hit", F.lit(False)).alias("hit"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], id: str, a: str, b: str, operator: str, other: str, band: int) -> DataFrame:
    """(id, other): the nearest row of right within the band: one not before a first, then by distance, then one that is
    no operator (a boolean column), then by `other`."""
    met = within_band(left.select(*key, id, a), right, key, a, b, band)
    order = F.struct(F.col(b) < F.col(a), F.abs(F.col(b) - F.col(a)), F.col(operator), F.col(other))
    return met.groupBy(id).agg(F.min_by(other, order).alias(other))


def first_of(keyed: DataFrame, exact: DataFrame, wild: DataFrame, key: str, wild_key: str, value: str) -> DataFrame:
    """keyed with `value` from the exact key, else from the wildcard key."""
    exact = exact.select(key, F.col(value).alias("_exact"))
    wild = wild.select(wild_key, F.col(value).alias("_wild"))
    return keyed.join(exact, key, "left").join(wild, wild_key, "left").withColumn(value, F.coalesce("_exact", "_wild")).drop("_exact", "_wild")


def rule_matches(calls: DataFrame, rules: list[tuple[str, str, str, str]], keep: list[str], columns: dict[str, str]) -> DataFrame:
    """keep, rule_id and category of every rule (id, category, match, pattern) that holds for a call.

    match says what a pattern is for, and columns where that stands: `name` and `full` must match as a whole, `code`
    somewhere in it. The rules are one array of verdicts in one projection, so a row is read once and nothing is joined.
    """
    verdicts: list[Column] = []
    for rule_id, category, match, pattern in rules:
        expression = pattern if match == "code" else f"^(?:{pattern})$"
        verdicts.append(F.when(F.col(columns[match]).rlike(expression), F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"))))
    return calls.select(*keep, F.inline(F.array_compact(F.array(*verdicts))))
