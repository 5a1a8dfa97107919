"""Evaluation of detectors: confusion metrics, pairs, rank statistics, thresholds and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteloom.functions.draws import multiplicities
from graniteloom.operators.curation import rank_in_order


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_aggs(gold: Column, pred: Column) -> list[Column]:
    """tp, fp, fn, tn of two booleans; null counts as false."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(pred, F.lit(False))
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """counts with recall, fpr, prec and f1 (0 where the denominator is)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "prec": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def f_beta(counts: DataFrame, beta: float) -> DataFrame:
    """counts with f_beta = (1 + b²) tp / ((1 + b²) tp + b² fn + fp)."""
    b = beta * beta
    return counts.withColumn("f_beta", ratio(F.col("tp") * (1 + b), F.col("tp") * (1 + b) + F.col("fn") * b + F.col("fp")))


def pair_sides(rows: DataFrame, pair: str, gold: str, value: str) -> DataFrame:
    """(pair, vuln, safe) of the pairs that have one row of each label."""
    g = F.col(gold)
    sides = rows.groupBy(pair).agg(
        F.count_if(g == "vuln").alias("_v"), F.count_if(g == "safe").alias("_s"), F.max(F.when(g == "vuln", F.col(value))).alias("vuln"), F.max(F.when(g == "safe", F.col(value))).alias("safe")
    )
    return sides.where("_v = 1 AND _s = 1").drop("_v", "_s")


def pair_outcome(vuln_flagged: Column, safe_flagged: Column) -> Column:
    """The outcome of a pair that has both sides by the verdicts on them; a verdict that is null (no parsed answer) makes it
    parse_fail, which counts like any other."""
    return (
        F.when(vuln_flagged.isNull() | safe_flagged.isNull(), "parse_fail").when(vuln_flagged & ~safe_flagged, "correct").when(vuln_flagged & safe_flagged, "vulnerable").when(~vuln_flagged & ~safe_flagged, "benign").otherwise("reversed")
    )


def auc(rows: DataFrame, by: list[str], gold: str, score: str) -> DataFrame:
    """by, n_pos, n_neg and auc, ties counting a half; null where a class is empty.

    Equal scores are summed first, so the window runs over distinct scores of a group.
    """
    g = F.col(gold)
    steps = rows.groupBy(*by, score).agg(F.count_if(g).alias("p"), F.count_if(~g).alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("n").over(part.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = steps.withColumn("_won", F.col("p") * (below + F.col("n") / 2))
    sums = won.groupBy(*by).agg(F.sum("_won").alias("_won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return sums.withColumn("auc", F.try_divide(F.col("_won"), (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("_won")


def threshold_counts(rows: DataFrame, by: list[str], gold: str, score: str) -> DataFrame:
    """by, tau and the confusion counts of `score >= tau` at every distinct score: running sums, no join with a grid."""
    g = F.col(gold)
    steps = rows.groupBy(*by, F.col(score).alias("tau")).agg(F.count_if(g).alias("_p"), F.count_if(~g).alias("_n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    down = part.orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumns({"tp": F.sum("_p").over(down), "fp": F.sum("_n").over(down), "_P": F.sum("_p").over(part), "_N": F.sum("_n").over(part)})
    return out.withColumns({"fn": F.col("_P") - F.col("tp"), "tn": F.col("_N") - F.col("fp")}).drop("_p", "_n", "_P", "_N")


def strided_grid(rows: DataFrame, score: str, places: int = 3, steps: int = 200) -> DataFrame:
    """tau: every (n div steps)-th distinct score, rounded, and 0."""
    values = rows.select(F.round(score, places).alias("tau")).distinct()
    ranked = rank_in_order(values, ["tau"])
    step = values.agg(F.greatest(F.lit(1), F.expr(f"count(1) div {steps}")).alias("_step"))
    chosen = ranked.join(F.broadcast(step)).where((F.col("rank") - 1) % F.col("_step") == 0).select("tau")
    return chosen.unionByName(rows.sparkSession.range(1).select(F.lit(0.0).alias("tau"))).distinct()


def grid_counts(rows: DataFrame, gold: str, score: str, grid: DataFrame, places: int = 3) -> DataFrame:
    """tau and the confusion counts of `score >= tau` for a grid of at most `places` decimals.

    Scores are summed by the largest number of that many decimals that they reach, which decides the same at every tau:
    the one running sum is over at most a few thousand steps, however many scores there are.
    """
    g, near = F.col(gold), F.round(score, places)
    reached = F.when(near > F.col(score), F.round(near - 10**-places, places)).otherwise(near)
    steps = rows.groupBy(reached.alias("tau")).agg(F.count_if(g).alias("p"), F.count_if(~g).alias("n"))
    both = steps.select("tau", "p", "n", F.lit(0).alias("on")).unionByName(grid.select("tau", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("on")))
    both = both.groupBy("tau").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("on").alias("on"))
    down = Window.orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy(F.lit(0))
    out = both.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "_P": F.sum("p").over(all_), "_N": F.sum("n").over(all_)}).where("on = 1")
    return out.select("tau", "tp", "fp", (F.col("_P") - F.col("tp")).alias("fn"), (F.col("_N") - F.col("fp")).alias("tn"))


def quantile_pick(counts: DataFrame, by: list[str], value: str, n: str, picks: dict[str, str]) -> DataFrame:
    """by and, for each name in picks, the value at a place (1, 2, ...) of the sorted rows: an expression over _n, their
    number. counts holds how many rows (n) have a value, so a window meets distinct values only."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = part.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = counts.withColumns({"_upto": F.sum(n).over(upto), "_n": F.sum(n).over(part)})
    return laid.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") >= F.expr(e), F.col(value))).alias(name) for name, e in picks.items()))


def best_threshold(curve: DataFrame, by: list[str], cap: float | None = None) -> DataFrame:
    """The tau of the highest f1 (the smallest tau among equals), of those with fpr <= cap if any has it, else of all."""
    meets = F.lit(True) if cap is None else F.col("fpr") <= cap
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = curve.withColumn("_at", F.row_number().over(part.orderBy(F.desc(meets), F.desc("f1"), "tau")))
    return ranked.where("_at = 1").drop("_at")


def spearman(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Rank correlation with ordinal ranks: ties are broken by `tie`, not averaged."""
    ranked = rank_in_order(rank_in_order(rows.select(x, y, tie), [x, tie], "_x"), [y, tie], "_y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))


def quantile_bins(rows: DataFrame, value: str, id: str, k: int) -> DataFrame:
    """rows with bin 0 to k - 1: how many of the k - 1 order-statistic cuts xs[n * i div k] are <= the value."""
    ranked = rank_in_order(rows, [value, id], "_rank")
    cuts = rows.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.expr(f"transform(sequence(1, {k - 1}), i -> _n * i div {k} + 1)")).alias("_rank"))
    found = ranked.join(F.broadcast(cuts), "_rank").agg(F.collect_list(value).alias("_cuts"))
    return rows.join(F.broadcast(found)).withColumn("bin", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")


def bootstrap_counts(rows: DataFrame, group: str, replicates: int, preds: tuple[str, ...] = ("pred",), seed: int = 42) -> DataFrame:
    """rep and, for each of several verdicts on the same rows, a struct of that name with its weighted tp, fp, fn and tn:
    rows are summed by group first, and all verdicts meet the same weights in one pass. A task draws for its groups and
    hands on one row a replicate."""
    names = [f"{p}_{n}" for p in preds for n in ("tp", "fp", "fn", "tn")]
    aggs = [a.alias(n) for n, a in zip(names, (a for p in preds for a in confusion_aggs(F.col("gold"), F.col(p))), strict=True)]

    def summed(batches):
        sums = np.zeros((replicates, len(names)), np.int64)
        for batch in batches:
            # Products of doubles are exact here: a batch's sums stay far below 2**53.
            counts = batch[names].to_numpy("float64")
            for reps, w in multiplicities(batch["_unit"].tolist(), replicates, seed):
                sums[reps - 1] += (w.astype("float64") @ counts).astype(np.int64)
        yield pd.DataFrame({"rep": np.arange(1, replicates + 1)} | {n: sums[:, i] for i, n in enumerate(names)})

    # Few groups make many draws: they are dealt out before, or adaptive execution would leave them to one task.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = rows.groupBy(group).agg(*aggs).repartition(parts, group).select(F.col(group).cast("string").alias("_unit"), *names)
    drawn = units.mapInPandas(summed, "rep int, " + ", ".join(f"{n} long" for n in names))
    sums = drawn.groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))
    return sums.select("rep", *(F.struct(*(F.col(f"{p}_{n}").alias(n) for n in ("tp", "fp", "fn", "tn"))).alias(p) for p in preds))


def bootstrap_aucs(rows: DataFrame, group: str, gold: str, scores: tuple[str, ...], replicates: int, seed: int = 42) -> DataFrame:
    """(rep, side, auc): the AUC of each of several scores under the same resamples of groups, ties counting a half, null
    where a class is drawn empty. A null score is below all others.

    Rows are laid in the order of scores, groups last, so equal scores may lie in several tasks. A batch hands on three
    steps a replicate: what has its first score, what has its last one, and what lies between, which no other batch
    shares, with the pairs won inside. Sums are whole numbers.
    """

    def steps(batches):
        for batch in batches:
            for side, part in batch.groupby("side", sort=False):
                x, g = part["x"].to_numpy(), part["g"].to_numpy(bool)
                new = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
                first = np.concatenate([[0], np.flatnonzero(new) + 1])
                last = len(first) - 1
                spans = [s for s in dict.fromkeys([(0, 1), (1, last), (max(1, last), last + 1)]) if s[0] < s[1]]
                out = np.zeros((len(spans), 3, replicates), np.int64)
                for reps, w in multiplicities(part["_unit"].tolist(), replicates, seed):
                    p, n = (np.add.reduceat(w * on, first, axis=1, dtype=np.int64) for on in (g, ~g))
                    for i, (a, b) in enumerate(spans):
                        p_, n_ = p[:, a:b], n[:, a:b]
                        total = p_.sum(1), n_.sum(1)
                        inner = (p_ * (2 * (np.cumsum(n_, axis=1) - n_) + n_)).sum(1) - total[0] * total[1]
                        out[i][:, reps - 1] = *total, inner
                for (a, _), (p, n, inner) in zip(spans, out, strict=True):
                    yield pd.DataFrame({"rep": np.arange(1, replicates + 1), "side": side, "x": x[first[a]], "p": p, "n": n, "inner": inner})

    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias("x")) for i, c in enumerate(scores)))
    each = rows.select(F.col(group).cast("string").alias("_unit"), F.coalesce(F.col(gold), F.lit(False)).alias("g"), F.inline(sides))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = each.repartitionByRange(parts, "side", "x", "_unit").sortWithinPartitions("side", "x", "_unit")
    found = laid.mapInPandas(steps, "rep int, side int, x double, p long, n long, inner long")
    met = found.groupBy("rep", "side", "x").agg(*(F.sum(c).alias(c) for c in ("p", "n", "inner")))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("rep", "side").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = met.withColumn("won", F.col("p") * (2 * below + F.col("n")) + F.col("inner"))
    sums = won.groupBy("rep", "side").agg(F.sum("won").alias("won"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    name = F.element_at(F.array(*(F.lit(c) for c in scores)), F.col("side") + 1)
    return sums.select("rep", name.alias("side"), F.try_divide(F.col("won") / 2, (F.col("P") * F.col("N")).cast("double")).alias("auc"))


def interval(values: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """lo and hi: the places int(n * (1 - level) / 2) and int(n * (1 + level) / 2), from 0 on, of the sorted values."""
    ranked = values.select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(value)) - 1).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_n"))
    place = lambda share: F.floor(F.col("_n") * F.lit(round(share, 9)))
    return ranked.agg(F.max(F.when(F.col("_at") == place((1 - level) / 2), F.col("v"))).alias("lo"), F.max(F.when(F.col("_at") == place((1 + level) / 2), F.col("v"))).alias("hi"))


def combined(answer: Column, graph: Column, strong: Column) -> dict[str, Column]:
    """The rules R0 to R4 over a model's answer (boolean), a graph verdict (vuln, safe or other) and whether that is a strong
    one. R0: the answer. R1: a vulnerable graph verdict is final, so is a strong safe one. R2: the graph only adds. R3: a
    strong safe verdict only takes away. R4: both, the veto first."""
    found, veto = F.coalesce(graph == "vuln", F.lit(False)), F.coalesce((graph == "safe") & strong, F.lit(False))
    answer = F.coalesce(answer, F.lit(False))
    return {"r0": answer, "r1": found | (answer & ~veto), "r2": answer | found, "r3": answer & ~veto, "r4": (answer | found) & ~veto}


def macro_f1(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row a class (gold or predicted) with tp, fp, fn and rates; null predictions are invalid and count as misses.

    Counts come from the confusion table, whose size is that of the classes.
    """
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).count()
    each = cells.select(F.inline(F.array(F.struct(F.col("g").alias("cls"), F.col("g"), F.col("p"), F.col("count")), F.struct(F.col("p").alias("cls"), F.col("g"), F.col("p"), F.col("count"))))).where("cls IS NOT NULL")
    hit = F.col("g").eqNullSafe(F.col("p"))
    return each.groupBy("cls").agg(
        (F.sum(F.when(hit, F.col("count")).otherwise(0)) / 2).cast("long").alias("tp"),
        F.sum(F.when(~hit & (F.col("p") == F.col("cls")), F.col("count")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("g") == F.col("cls")), F.col("count")).otherwise(0)).alias("fn"),
    )
