"""Grading of findings against truths: sets, intervals, points, arms, gates and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteloom.operators.curation import rank_within
from graniteloom.operators.evaluation import ratio


def set_grade(truths: DataFrame, findings: DataFrame, key: list[str], by: str) -> DataFrame:
    """by, tp, fp, fn: distinct keys (of which `by` is one) in both, only found, only true."""
    t = truths.select(*key).distinct().withColumn("_t", F.lit(1))
    f = findings.select(*key).distinct().withColumn("_f", F.lit(1))
    both = t.join(f, key, "full")
    return both.groupBy(by).agg(F.count("_t").alias("_nt"), F.count("_f").alias("_nf"), F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp")).select(by, "tp", (F.col("_nf") - F.col("tp")).alias("fp"), (F.col("_nt") - F.col("tp")).alias("fn"))


def rounded_points(rows: DataFrame, case: str, line: str, hit: Column) -> DataFrame:
    """case, hits, false_lines: distinct reported lines that hit, and those that do not."""
    lines = rows.where(F.col(line).isNotNull()).groupBy(case, line).agg(F.bool_or(hit).alias("_hit"))
    return lines.groupBy(case).agg(F.count_if("_hit").alias("hits"), F.count_if(~F.col("_hit")).alias("false_lines"))


#: The points of a case.
POINTS = {"tp": 5, "tn": 2, "fp": -1, "fn": 0}


def case_points(cases: DataFrame, findings: DataFrame, truths: DataFrame, accepted: DataFrame) -> DataFrame:
    """case, tp, fp, tn, fn and points of each case (case, vulnerable, cls).

    A finding (case, line, cls) hits a vulnerable case if its line is one of the truths (case, line), or its class is the
    case's own or one accepted for it (cls, ok). A vulnerable case with a hit is a true positive, and each further distinct
    line without one a false one; without a hit all its lines are false and the case is missed. All lines of a safe case are
    false; a case without findings is a true or a false negative.
    """
    truth = truths.select("case", "line").distinct().withColumn("_line", F.lit(True))
    pairs = accepted.select(F.col("cls").alias("_cls"), F.col("ok").alias("_ok")).distinct().withColumn("_near", F.lit(True))
    known = cases.select("case", "vulnerable", F.col("cls").alias("_cls"))
    met = findings.where("line IS NOT NULL").select("case", "line", F.col("cls").alias("_ok")).distinct().join(known, "case").join(truth, ["case", "line"], "left").join(pairs, ["_cls", "_ok"], "left")
    hit = F.col("_line").isNotNull() | F.col("_near").isNotNull() | F.col("_ok").eqNullSafe(F.col("_cls"))
    lines = met.groupBy("case", "line").agg(F.bool_or(hit).alias("_hit")).groupBy("case").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_hit").alias("_h"))
    n, h, vulnerable = F.coalesce("_n", F.lit(0)), F.coalesce("_h", F.lit(0)), F.col("vulnerable")
    found = vulnerable & (h > 0)
    out = cases.join(lines, "case", "left").select("case", found.cast("long").alias("tp"), F.when(found, n - h).otherwise(n).alias("fp"), (~vulnerable & (n == 0)).cast("long").alias("tn"), (vulnerable & (h == 0)).cast("long").alias("fn"))
    return out.withColumn("points", sum((F.col(k) * v for k, v in POINTS.items()), F.lit(0).cast("long")))


def unit_grade(units: DataFrame, alerts: DataFrame, key: str, unit: str, start: str, stop: str, at: str, cls: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Units (intervals of a class) with `found`, and alerts with `matched`: an alert of the class inside the interval. Alerts
    have a key of their own in the column alert."""
    if "alert" not in alerts.columns:
        raise ValueError("alerts need a column alert that tells them apart")
    dealt = units.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    inside = alerts.withColumn("_bin", F.floor(F.col(at) / width)).join(dealt, [key, cls, "_bin"]).where(F.col(at).between(F.col(start), F.col(stop)))
    met = inside.select(unit, "alert").distinct()
    found = units.join(met.select(unit).distinct().withColumn("found", F.lit(True)), unit, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    matched = alerts.join(met.select("alert").distinct().withColumn("matched", F.lit(True)), "alert", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return found, matched


def _rates(tp: Column, fp: Column, fn: Column, prefix: str = "") -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {f"{prefix}precision": precision, f"{prefix}recall": recall, f"{prefix}f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))}


def group_summary(groups: DataFrame, found: DataFrame, matched: DataFrame, group: str, cls: str) -> DataFrame:
    """One row over groups (group, expected): groups, the share of groups with a unit found, units found and missed, alerts
    that match nothing (all, and those of the group's expected class), alerts of other classes, and the rates of both.

    found: units of the expected classes with found; matched: the active alerts with matched.
    """
    units = found.groupBy(group).agg(F.count_if("found").alias("tp"), F.count_if(~F.col("found")).alias("fn"))
    wanted = matched.join(F.broadcast(groups), group).withColumn("_own", F.col(cls).eqNullSafe(F.col("expected")))
    alerts = wanted.groupBy(group).agg(F.count(F.lit(1)).alias("active"), F.count_if(~F.col("_own")).alias("unrelated"), F.count_if(F.col("_own") & ~F.col("matched")).alias("target_fp"))
    each = groups.join(units, group, "left").join(alerts, group, "left").fillna(0, ["tp", "fn", "active", "unrelated", "target_fp"])
    sums = each.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("tp") > 0).alias("_detected"), *(F.sum(c).alias(c) for c in ("tp", "fn", "target_fp", "unrelated", "active")))
    sums = sums.withColumns({"fp": F.col("target_fp") + F.col("unrelated"), "group_recall": ratio(F.col("_detected"), F.col("groups"))}).drop("_detected")
    tp, fn = F.col("tp"), F.col("fn")
    return sums.withColumns(_rates(tp, F.col("fp"), fn) | _rates(tp, F.col("target_fp"), fn, "target_"))


def critic_report(rows: DataFrame, by: str, pair: str, label: str, answer: str) -> DataFrame:
    """by and the figures of a critic whose answer is YES (says safe), NO or something unparsed, on rows labelled vuln or safe.

    accuracy and that of always saying NO with the margin between them; over pairs with a parsed answer to both sides, the
    share that is answered differently and the share answered right; T3 is UNMEASURED below ten pairs, PASS if pairs are
    answered differently more often than YES is said, else FAIL. Promising: a margin of 0.15, five YES and less than a fifth
    unparsed.
    """
    said, vuln = F.col(answer).isin("YES", "NO"), F.col(label) == "vuln"
    yes = F.col(answer) == "YES"
    sums = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(said).alias("scored"), F.count_if(~F.coalesce(said, F.lit(False))).alias("unparsed"), F.count_if(yes).alias("yes"),
        F.count_if((yes & ~vuln) | ((F.col(answer) == "NO") & vuln)).alias("_right"), F.count_if(said & vuln).alias("_vuln"),
    )
    sides = rows.where(said).groupBy(by, pair).agg(F.max(F.when(vuln, F.col(answer))).alias("v"), F.max(F.when(F.col(label) == "safe", F.col(answer))).alias("s")).where("v IS NOT NULL AND s IS NOT NULL")
    pairs = sides.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.expr("v <> s")).alias("_differ"), F.count_if(F.expr("v = 'NO' AND s = 'YES'")).alias("_both"))
    out = sums.join(pairs, by, "left").fillna(0, ["pairs", "_differ", "_both"])
    rates = {"accuracy": ratio(F.col("_right"), F.col("scored")), "always_no": ratio(F.col("_vuln"), F.col("scored")), "disagreement": ratio(F.col("_differ"), F.col("pairs")), "pair_correct": ratio(F.col("_both"), F.col("pairs")), "yes_rate": ratio(F.col("yes"), F.col("scored")), "unparsed_rate": ratio(F.col("unparsed"), F.col("n"))}
    out = out.withColumns(rates).withColumn("margin", F.col("accuracy") - F.col("always_no"))
    t3 = F.when(F.col("pairs") < 10, "UNMEASURED").when(F.col("disagreement") > F.col("yes_rate"), "PASS").otherwise("FAIL")
    promising = (F.round("margin", 4) >= 0.15) & (F.col("yes") >= 5) & (F.round("unparsed_rate", 4) < 0.20)
    return out.withColumns({"t3": t3, "promising": promising}).drop("_right", "_vuln", "_differ", "_both")


#: The least number of findings of a gate, the precisions it asks for, and the baseline of unknowns.
GATE_CASES, GATE_PRECISION, GATE_LOW, UNKNOWN_BASELINE = 20, 0.60, 0.80, 0.916


def engine_gate(n: Column, precision: Column, low: Column, unknown_rate: Column) -> Column:
    """How an engine may be used, by the number and precision of its findings and the interval's lower end: INCONCLUSIVE below
    20 findings, TRUST_ENGINE, ENGINE_AS_SIGNAL, NO_BETTER (also with as many unknowns as the baseline), else
    INCONCLUSIVE."""
    precise = precision >= GATE_PRECISION
    return F.when(n < GATE_CASES, "INCONCLUSIVE").when(precise & (low >= GATE_LOW), "TRUST_ENGINE").when(precise, "ENGINE_AS_SIGNAL").when((precision < GATE_PRECISION) | (unknown_rate >= UNKNOWN_BASELINE), "NO_BETTER").otherwise("INCONCLUSIVE")


def gate(value: Column, low: Column, high: Column, target: float) -> Column:
    """GO if the whole interval is above the target, KILL if it is below, WEAK if only the value is above, else
    INCONCLUSIVE; null without a value is INCONCLUSIVE."""
    return F.when(low > target, "GO").when(high < target, "KILL").when(value > target, "WEAK").otherwise("INCONCLUSIVE")


def measured(value: Column, n: Column, least: int = 10) -> Column:
    """UNMEASURED below `least` cases, else the verdict of a share against a half."""
    return F.when(n < least, "UNMEASURED").when(value > 0.5, "PASS").otherwise("FAIL")


def provenance(gaps: Column, band: int) -> Column:
    """graph_only without a line of the other side, overlap within the band, else ambiguous; gaps: the least distance."""
    return F.when(gaps.isNull(), "graph_only").when(gaps <= band, "overlap").otherwise("ambiguous")


def first_cause(causes: list[tuple[str, Column]], rest: str) -> Column:
    """The name of the first cause that holds."""
    found = F.lit(rest)
    for name, holds in reversed(causes):
        found = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(found)
    return found


def hash_select(rows: DataFrame, group: str, id: str, most: int, seed: int = 42, without: DataFrame | None = None) -> DataFrame:
    """The `most` rows of each group with the lowest SHA-256 of "seed:id", after those of `without` are taken out. The
    limit holds in every partition before rows are shuffled."""
    left = rows if without is None else rows.join(without.select(id), id, "left_anti")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")), 256)
    return left.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order, id))).where(F.col("_at") <= most).drop("_at")


def coin(id: Column, seed: int = 42) -> Column:
    """0 or 1 by the SHA-256 of "seed:id", whatever the label."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), id.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(2)).cast("int")


def proportional_fill(rows: DataFrame, group: str, order: list[Column | str], limit: int) -> DataFrame:
    """`limit` rows: of each group round(limit * its share) in order, and what is missing from the rest in the order of
    all rows."""
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    laid = rank_within(rows, group, order, "_at").join(sizes, F.col(group) == F.col("_group")).join(F.broadcast(total)).drop("_group")
    quota = laid.withColumn("_first", F.col("_at") <= F.round(F.lit(limit) * F.col("_n") / F.col("_all")))
    chosen, rest = quota.where("_first"), quota.where("NOT _first")
    missing = chosen.agg((F.lit(limit) - F.count(F.lit(1))).alias("_missing"))
    more = rest.orderBy(*order).limit(limit).withColumn("_place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(missing)).where(F.col("_place") <= F.col("_missing"))
    return chosen.select(*rows.columns).unionByName(more.select(*rows.columns))


#: The recalls at which an envelope is read.
RECALLS = (0.90, 0.75, 0.50, 0.30, 0.20, 0.10)


def envelope(auc: Column, recall: Column) -> Column:
    """struct<fpr, precision>: the least false positive rate and the largest precision at a recall that an AUC allows, for a
    concave curve and as many positives as negatives: fpr = max(0, recall - (2 auc - 1))."""
    fpr = F.greatest(F.lit(0.0), recall - (2 * auc - 1))
    return F.struct(fpr.alias("fpr"), F.coalesce(F.try_divide(recall, recall + fpr), F.lit(1.0)).alias("precision"))


def joint_cells(rows: DataFrame, bins: DataFrame, bin: str, cue: str, hit: Column) -> DataFrame:
    """bin, cue, n and accuracy of every cell, empty ones too."""
    counts = rows.groupBy(bin, cue).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"))
    every = bins.select(bin, F.explode(F.array(F.lit(True), F.lit(False))).alias(cue))
    return every.join(counts, [bin, cue], "left").fillna(0, ["n"])
