"""Findings of several engines: deduplication, merging, ranking, suppression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteloom.operators.curation import rank_within


def _first(rows: DataFrame, key: list[str], order: list[Column | str], count: str) -> DataFrame:
    """The first row of each key in an order (the other columns settle ties), and the number of its rows: a minimum with
    partial aggregation, so a key with very many rows is no task of its own."""
    rest = [c for c in rows.columns if c not in key]
    places = [(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate([*order, *rest])]
    found = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*places)).alias("_row"), F.count(F.lit(1)).alias(count))
    return found.select(*(F.col(c) if c in key else F.col("_row")[c].alias(c) for c in rows.columns), count)


def dedupe(findings: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One finding a key, with n_duplicates and uid (0, 1, ... by key within the first key column). The order is rising."""
    one = _first(findings, key, order, "_n").withColumn("n_duplicates", F.col("_n") - 1).drop("_n")
    return rank_within(one, key[0], key[1:], "uid").withColumn("uid", F.col("uid") - 1)


def merge(findings: DataFrame, key: list[str], engine: str, rank: str, accepted: Column) -> DataFrame:
    """key, first_engine and contributors (distinct, in the engines' order) of the accepted findings."""
    rows = findings.where(accepted).groupBy(*key, engine).agg(F.min(rank).alias("_rank"))
    packed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_rank", engine))).alias("_all"))
    names = F.transform("_all", lambda x: x[engine])
    return packed.select(*key, F.element_at(names, 1).alias("first_engine"), F.array_join(names, ",").alias("contributors"))


def best_per_file(findings: DataFrame, file: str, order: list[Column | str]) -> DataFrame:
    """The first finding of each file in the (rising) order of its evidence, with n_findings."""
    return _first(findings, [file], order, "n_findings")


#: Fixed value: lines shown on either side of a finding's lines.
SHOWN = 6


def reviewed(verdict: Column, confidence: Column, basis: Column, lines: list[Column], reason: Column, evidence: Column, shown: int = SHOWN) -> Column:
    """struct<verdict, original, suppressed> of a critic's verdict on a finding.

    Findings whose evidence did not match what was to be sent, and those without a verdict, are UNJUDGED. A FALSE of high
    confidence with a reason and a basis within the lines shown (around the finding's lines, from 1 on) suppresses the
    finding; any other FALSE becomes UNCERTAIN, with FALSE as its original. Only suppressed findings go.
    """
    near = F.lit(False)
    for line in lines:
        near = near | F.coalesce((line > 0) & basis.between(F.greatest(F.lit(1), line - shown), line + shown), F.lit(False))
    false = verdict == "FALSE"
    grounded = F.coalesce(false & (F.lower(confidence) == "high") & near & (F.length(F.trim(reason)) > 0), F.lit(False))
    judged = F.coalesce(evidence, F.lit(False)) & verdict.isNotNull()
    said = F.when(~judged, "UNJUDGED").when(false & ~grounded, "UNCERTAIN").otherwise(verdict)
    return F.struct(said.alias("verdict"), F.when(judged & false & ~grounded, "FALSE").alias("original"), (judged & grounded).alias("suppressed"))


#: How an engine's verdict enters the result.
POLICIES = ("TRUST_ENGINE", "ENGINE_AS_SIGNAL", "NO_BETTER", "INCONCLUSIVE")


def policy(name: Column, detected: Column, score: Column, engine: Column, graph: Column, delta: Column, tau: Column) -> Column:
    """struct<detected, source, status, score, policy_fallback> of a model's answer (detected, score), an engine's verdict
    (null if it did not run) and a graph's (vuln or other), by a policy.

    TRUST_ENGINE takes the engine's finding first, then the model's, then the graph's. ENGINE_AS_SIGNAL adds delta to the
    score where the engine finds something and compares with tau, then asks the graph; without a score, delta or tau it is
    NO_BETTER with policy_fallback. NO_BETTER and INCONCLUSIVE leave the engine out. The status of the first two is PARTIAL
    without an engine, else DONE.
    """
    hit, drawn, said = (F.coalesce(c, F.lit(False)) for c in (engine == "vuln", graph == "vuln", detected))
    trust = name == "TRUST_ENGINE"
    fallback = (name == "ENGINE_AS_SIGNAL") & (score.isNull() | delta.isNull() | tau.isNull())
    signal = (name == "ENGINE_AS_SIGNAL") & ~fallback
    sum_ = score + F.when(hit, delta).otherwise(0.0)
    over = signal & (sum_ >= tau)
    source = F.when(trust & hit, "engine").when(over, "llm+engine").when(~signal & said, "llm").when(drawn, "graph").when(signal, "llm+engine").otherwise("llm")
    found = F.when(signal, over | drawn).otherwise((trust & hit) | said | drawn)
    status = F.when((trust | signal) & engine.isNull(), "PARTIAL").otherwise("DONE")
    return F.struct(found.alias("detected"), source.alias("source"), status.alias("status"), F.when(signal, sum_).otherwise(score).alias("score"), fallback.alias("policy_fallback"))


def tier(line: Column, path: Column, truth: Column, near: int = 5) -> Column:
    """How a finding meets a true line: exact, on its path, near it, or not."""
    return F.when(line == truth, "exact").when(F.array_contains(path, truth), "path_hit").when(F.abs(line - truth) <= near, "near").otherwise("miss")


def file_verdict(files: DataFrame, flows: DataFrame, file: str, sanitized: str) -> DataFrame:
    """file and verdict: vuln with a flow that is not sanitized, safe_sanitized with sanitized ones only, safe without
    any, unknown for files that were not analysed (files: file, analysed)."""
    sums = flows.groupBy(file).agg(F.bool_or(~F.col(sanitized)).alias("_live"), F.count(F.lit(1)).alias("_n"))
    verdict = F.when(~F.col("analysed"), "unknown").when(F.col("_live"), "vuln").when(F.col("_n") > 0, "safe_sanitized").otherwise("safe")
    return files.join(sums, file, "left").select(file, verdict.alias("verdict"))


def retried(inputs: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Every input with the result of the first pass, else of the second, else none: as many rows as inputs."""
    missing = inputs.select(key).join(first, key, "left_anti")
    found = first.withColumn("passes", F.lit(1)).unionByName(second.join(missing, key, "left_semi").withColumn("passes", F.lit(2)))
    return inputs.join(found, key, "left").fillna(0, ["passes"])


@dataclass(frozen=True)
class Patterns:
    """What a staged verdict looks for. Patterns are lists; any of a list is enough.

    primitives: (category, weak, unless, context): a weak construct, not beside a strong one, is a finding where the context
    (if there is one) matches too, else undecided. sources: by language. sinks: by category and language, in the order in
    which categories are tried. cleaners: by category. needs: what a category's sinks ask for beside them. bound: (category,
    keyword, concat): a keyword with a cleaner of the category and no concatenation is surely safe.
    """

    primitives: list[tuple[str, list[str], list[str], list[str]]] = field(default_factory=list)
    sources: dict[str, list[str]] = field(default_factory=dict)
    sinks: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    cleaners: dict[str, list[str]] = field(default_factory=dict)
    needs: dict[str, list[str]] = field(default_factory=dict)
    bound: tuple[str, list[str], list[str]] | None = None


def staged_verdict(text: Column, language: Column, patterns: Patterns) -> Column:
    """struct<verdict, category, strong>: vuln, safe or unknown, by the first stage that decides.

    Primitives first, whatever the language's sources; then the bound query, which is strongly safe; then the categories in
    order: a sink (with what its category needs) beside a cleaner of the category is strongly safe, beside a source vuln,
    alone unknown. Nothing found is unknown, and so is a language without patterns. One projection.
    """

    def has(list_: list[str]) -> Column:
        return text.rlike("|".join(f"(?:{p})" for p in list_)) if list_ else F.lit(False)

    def by_language(lists: dict[str, list[str]]) -> Column:
        out = F.lit(False)
        for name, list_ in lists.items():
            out = F.when(language == name, has(list_)).otherwise(out)
        return out

    def said(verdict: str, category: str, strong: bool = False) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(category).alias("category"), F.lit(strong).alias("strong"))

    known = F.coalesce(language.isin(*{*patterns.sources, *(x for s in patterns.sinks.values() for x in s)}), F.lit(False))
    stages = [(~known, said("unknown", "?"))]
    for category, weak, unless, context in patterns.primitives:
        here = has(weak) & ~has(unless)
        stages.append((here, F.when(has(context), said("vuln", category)).otherwise(said("unknown", category)) if context else said("vuln", category)))
    if patterns.bound:
        category, keyword, concat = patterns.bound
        stages.append((has(keyword) & ~has(concat) & has(patterns.cleaners.get(category, [])), said("safe", category, True)))
    source = by_language(patterns.sources)
    for category, sinks in patterns.sinks.items():
        there = by_language(sinks) & (has(patterns.needs[category]) if category in patterns.needs else F.lit(True))
        stages.append((there, F.when(has(patterns.cleaners.get(category, [])), said("safe", category, True)).when(source, said("vuln", category)).otherwise(said("unknown", category))))
    out = said("unknown", "?")
    for holds, verdict in reversed(stages):
        out = F.when(holds, verdict).otherwise(out)
    return out


def three_valued(tainted: Column, overwritten: Column) -> Column:
    """vuln, safe or unknown of a value that may be tainted and may be overwritten by a constant; null is unknown."""
    live = tainted & ~overwritten
    return F.when(live, "vuln").when(~live, "safe").otherwise("unknown")


def by_language(rows: DataFrame, policies: dict[str, str], language: str, out: str) -> DataFrame:
    """rows with the policy of their language, else that of "_default"."""
    table = F.create_map(*(F.lit(x) for pair in policies.items() for x in pair))
    return rows.withColumn(out, F.coalesce(F.try_element_at(table, F.col(language)), F.lit(policies["_default"])))
