"""Evaluation queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graniteloom.operators import evaluation as E
from graniteloom.operators import sketches as S
from graniteloom.operators.state import cut
from graniteloom.plans.tables import SCORED, scored, table

TAU = 0.5


def _judged(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select("doc_id", "lang", "source", "n_chars", "pair_id", "score", (F.col("gold") == "vuln").alias("gold"), (F.col("score") >= TAU).alias("pred"))


def _rounded(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


RATES = ("recall", "fpr", "prec", "f1")


def confusion(spark, sf_dir):
    return _rounded(E.with_rates(_judged(spark, sf_dir).agg(*E.confusion_aggs(F.col("gold"), F.col("pred")))), *RATES)


def f2(spark, sf_dir):
    return _rounded(E.f_beta(_judged(spark, sf_dir).groupBy("source").agg(*E.confusion_aggs(F.col("gold"), F.col("pred"))), 2.0), "f_beta")


def report_rollup(spark, sf_dir):
    rows = _judged(spark, sf_dir).rollup("lang").agg(*E.confusion_aggs(F.col("gold"), F.col("pred")))
    return _rounded(E.with_rates(rows.withColumn("lang", F.coalesce("lang", F.lit("all")))), *RATES)


def trivial_baseline(spark, sf_dir):
    return _rounded(E.with_rates(_judged(spark, sf_dir).groupBy("lang").agg(*E.confusion_aggs(F.col("gold"), F.lit(True)))), *RATES)


def pairwise(spark, sf_dir):
    """Outcomes of the pairs that have both labels; answers that do not parse count as parse_fail. Rows whose length is
    divisible by 17 have lost their pair."""
    rows = _judged(spark, sf_dir).withColumn("pred", F.when(F.col("n_chars") % 13 != 0, F.col("pred"))).withColumn("pair_id", F.when(F.col("n_chars") % 17 == 0, -F.col("doc_id") - 1).otherwise(F.col("pair_id")))
    sides = rows.groupBy("pair_id").agg(F.max(F.when(F.col("gold"), F.col("pred"))).alias("vuln"), F.max(F.when(~F.col("gold"), F.col("pred"))).alias("safe"), F.count_distinct("gold").alias("labels")).where("labels = 2")
    counts = sides.groupBy(E.pair_outcome(F.col("vuln"), F.col("safe")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = sides.agg(F.count(F.lit(1)).alias("pairs"))
    return counts.join(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("pairs"), 6).alias("share"))


def pair_rank(spark, sf_dir):
    sides = E.pair_sides(scored(spark, sf_dir), "pair_id", "gold", "score")
    won, tied = (F.col("vuln") > F.col("safe")).cast("double"), (F.col("vuln") == F.col("safe")).cast("double")
    return _rounded(sides.agg(F.count(F.lit(1)).alias("n"), F.avg(won).alias("strict"), F.avg(tied).alias("ties"), F.avg(won + tied / 2).alias("tie_half")), "strict", "ties", "tie_half")


def pair_join(spark, sf_dir):
    return E.pair_sides(scored(spark, sf_dir), "pair_id", "gold", "n_chars")


def auc(spark, sf_dir):
    return _rounded(E.auc(_judged(spark, sf_dir), ["lang"], "gold", "score"), "auc")


def length_baseline(spark, sf_dir):
    """AUC of minus the length and of the score, its margin, and median lengths of both labels, by source."""
    rows = _judged(spark, sf_dir).withColumn("short", -F.col("n_chars"))
    short = E.auc(rows, ["source"], "gold", "short")
    full = E.auc(rows, ["source"], "gold", "score").select("source", F.col("auc").alias("score_auc"))
    counts = rows.groupBy("source", "gold", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    middle = E.quantile_pick(counts, ["source", "gold"], "n_chars", "n", {"mid": "_n div 2 + 1"})
    medians = middle.groupBy("source").agg(F.max(F.when(F.col("gold"), F.col("mid"))).alias("median_vuln"), F.max(F.when(~F.col("gold"), F.col("mid"))).alias("median_safe"))
    out = short.join(full, "source").join(medians, "source").withColumn("margin", F.col("score_auc") - F.col("auc"))
    return _rounded(out, "auc", "score_auc", "margin")


def stratified_auc(spark, sf_dir):
    """AUC inside fifths of the length, and their mean weighted by pairs of unlike labels."""
    rows = E.quantile_bins(_judged(spark, sf_dir), "n_chars", "doc_id", 5)
    bins = E.auc(rows, ["bin"], "gold", "score").where("auc IS NOT NULL")
    total = bins.agg((F.sum(F.col("auc") * F.col("n_pos") * F.col("n_neg")) / F.sum(F.col("n_pos") * F.col("n_neg"))).alias("auc"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return _rounded(bins.select(F.col("bin").cast("int").alias("bin"), "n_pos", "n_neg", "auc").unionByName(total.select(F.lit(-1).alias("bin"), "n_pos", "n_neg", "auc")), "auc")


def threshold_curve(spark, sf_dir):
    """Metrics at every (n div 200)-th distinct score, rounded, and at 0."""
    rows = _judged(spark, sf_dir)
    return _rounded(E.with_rates(E.grid_counts(rows, "gold", "score", E.strided_grid(rows, "score"))), *RATES)


def best_tau(spark, sf_dir):
    curve = E.with_rates(E.threshold_counts(_judged(spark, sf_dir), ["lang"], "gold", "score"))
    free = E.best_threshold(curve, ["lang"]).withColumn("rule", F.lit("f1"))
    capped = E.best_threshold(curve, ["lang"], 0.3).withColumn("rule", F.lit("f1_fpr_cap"))
    return _rounded(free.unionByName(capped).select("rule", "lang", "tau", "f1", "fpr"), "f1", "fpr")


def tau_stride(spark, sf_dir):
    """Every (n div 200)-th distinct score, and 0."""
    return E.strided_grid(scored(spark, sf_dir), "score")


CAPS = (0.05, 0.5, 0.9)


def multi_source_op(spark, sf_dir):
    """For each cap, the threshold of the highest mean f1 over sources whose worst fpr is at most the cap, on a fixed
    grid; INFEASIBLE where none is."""
    grid = F.explode(F.array(*(F.lit(i / 20) for i in range(21)))).alias("tau")
    cells = _judged(spark, sf_dir).select("source", "gold", "score", grid)
    by_source = E.with_rates(cells.groupBy("source", "tau").agg(*E.confusion_aggs(F.col("gold"), F.col("score") >= F.col("tau"))))
    by_tau = by_source.groupBy("tau").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.max("fpr"), 6).alias("max_fpr"))
    each = by_tau.select("*", F.explode(F.array(*(F.lit(c) for c in CAPS))).alias("cap"))
    meets = F.col("max_fpr") <= F.col("cap")
    best = each.groupBy("cap").agg(F.min(F.when(meets, F.struct((-F.col("mean_f1")).alias("f"), "tau", "max_fpr"))).alias("b"))
    return best.select("cap", F.when(F.col("b").isNull(), "INFEASIBLE").otherwise("OK").alias("status"), F.col("b.tau").alias("tau"), (-F.col("b.f")).alias("mean_f1"), F.col("b.max_fpr").alias("max_fpr"))


def vote_sweep(spark, sf_dir):
    rows = _judged(spark, sf_dir).select("gold", F.floor(F.least(F.col("score"), F.lit(0.999)) * 5).alias("votes"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    return _rounded(E.with_rates(rows.groupBy("k").agg(*E.confusion_aggs(F.col("gold"), F.col("votes") >= F.col("k")))), *RATES)


REPLICATES = 2000


def bootstrap_ci(spark, sf_dir):
    """Intervals of f1, recall and fpr over resampled pairs."""
    counts = cut(E.with_rates(E.bootstrap_counts(_judged(spark, sf_dir), "pair_id", REPLICATES).select("rep", "pred.*")))
    found = None
    for metric in ("f1", "recall", "fpr"):
        one = E.interval(counts, metric).withColumn("metric", F.lit(metric))
        found = one if found is None else found.unionByName(one)
    return _rounded(found, "lo", "hi")


def paired_bootstrap(spark, sf_dir):
    """Interval of the difference in f1 between two thresholds under the same resamples."""
    rows = _judged(spark, sf_dir).withColumn("other", F.col("score") >= 0.3)
    drawn = E.bootstrap_counts(rows, "pair_id", REPLICATES, ("pred", "other"))
    f1 = {p: E.ratio(2 * F.col(f"{p}.tp"), 2 * F.col(f"{p}.tp") + F.col(f"{p}.fp") + F.col(f"{p}.fn")) for p in ("pred", "other")}
    out = E.interval(drawn.select((f1["other"] - f1["pred"]).alias("delta")), "delta")
    return _rounded(out, "lo", "hi").withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def delta_auc(spark, sf_dir):
    """Interval of the difference in AUC between the score and minus the length under the same resamples of pairs."""
    rows = _judged(spark, sf_dir).select("pair_id", "gold", "score", (-F.col("n_chars")).cast("double").alias("short"))
    aucs = E.bootstrap_aucs(rows, "pair_id", "gold", ("score", "short"), REPLICATES)
    both = aucs.groupBy("rep").agg((F.max(F.when(F.col("side") == "score", F.col("auc"))) - F.max(F.when(F.col("side") == "short", F.col("auc")))).alias("delta"))
    out = E.interval(both, "delta")
    return _rounded(out, "lo", "hi").withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def spearman(spark, sf_dir):
    return _rounded(E.spearman(scored(spark, sf_dir), "score", "n_chars", "doc_id"), "rho")


def zscore_blend(spark, sf_dir):
    """Population z-scores of two signals (a constant one counts as 0), and the AUC of their blend for each weight of a
    grid."""
    rows = scored(spark, sf_dir).select("doc_id", (F.col("gold") == "vuln").alias("gold"), "score", F.col("n_chars").cast("double").alias("len"))
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("score", "len") for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in ("score", "len")}
    weights = F.explode(F.array(*(F.lit(i / 5) for i in range(6)))).alias("weight")
    blend = rows.join(F.broadcast(stats)).select("gold", z["score"].alias("a"), z["len"].alias("b"), weights)
    blended = blend.select("gold", "weight", F.round(F.col("a") * F.col("weight") + F.col("b") * (1 - F.col("weight")), 4).alias("blend"))
    return _rounded(E.auc(blended, ["weight"], "gold", "blend"), "auc")


def length_stats(spark, sf_dir):
    """Mean, median, nearest-rank p90 and most characters of each language."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    places = {"low": "(_n + 1) div 2", "high": "_n div 2 + 1", "p90": "(_n * 9 + 9) div 10"}
    picked = E.quantile_pick(counts, ["lang"], "n_chars", "n", places)
    sums = counts.groupBy("lang").agg(F.round(F.sum(F.col("n_chars") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.max("n_chars").alias("most"))
    return sums.join(picked, "lang").select("lang", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p90", "most")


def sketch_bounds(spark, sf_dir):
    """Sketches a language and source, merged a language: whether their distinct counts, medians and ninth tenths keep to
    their bounds against the exact ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    found = S.merged(S.sketched(docs, ["lang", "source"], "doc_id", "n_chars"), ["lang"])
    counts = docs.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    around = {f"{q}_{side}": f"greatest(1, least(_n, cast(ceil(_n * {share + e}) AS bigint)))" for q, share in (("mid", 0.5), ("high", 0.9)) for side, e in (("low", -S.RANK_ERROR), ("top", S.RANK_ERROR))}
    exact = E.quantile_pick(counts, ["lang"], "n_chars", "n", around).join(docs.groupBy("lang").agg(F.count_distinct("doc_id").alias("distinct")), "lang")
    both = found.select("lang", "n", S.distinct_count().alias("d"), S.quantile(0.5).alias("mid"), S.quantile(0.9).alias("high")).join(exact, "lang")
    near = F.abs(F.col("d") - F.col("distinct")) <= S.DISTINCT_ERROR * F.col("distinct") + 1
    return both.select("lang", "n", near.alias("distinct_holds"), F.col("mid").between(F.col("mid_low"), F.col("mid_top")).alias("median_holds"), F.col("high").between(F.col("high_low"), F.col("high_top")).alias("tenth_holds"))


def quantile_bins(spark, sf_dir):
    rows = E.quantile_bins(scored(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id", 5)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def mean_rank(spark, sf_dir):
    """The mean rank of each row's length among those of its language, from the counts of equal lengths."""
    rows = scored(spark, sf_dir).select("doc_id", "lang", "n_chars")
    counts = rows.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.withColumn("mean_rank", below + 1 + (F.col("n") - 1) / 2), ["lang", "n_chars"]).select("doc_id", "mean_rank")


def gap_median(spark, sf_dir):
    """Median gap between consecutive distinct lines of the groups that have two or more, rounded half to even."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_partkey").alias("line")).distinct()
    gap = lines.select("l_orderkey", (F.col("line") - F.lag("line").over(Window.partitionBy("l_orderkey").orderBy("line"))).alias("gap")).where("gap IS NOT NULL")
    counts = gap.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    picked = E.quantile_pick(counts, [], "gap", "n", {"low": "(_n + 1) div 2", "high": "_n div 2 + 1"})
    return picked.join(counts.agg(F.sum("n").alias("n"))).select("n", F.bround((F.col("low") + F.col("high")) / 2, 0).alias("median"))


def macro_f1(spark, sf_dir):
    guess = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang"))
    counts = E.macro_f1(table(spark, sf_dir, "documents").select("lang", guess.alias("guess")), "lang", "guess")
    return counts.withColumn("f1", F.round(E.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def macro_gate(spark, sf_dir):
    """Macro mean, answers without a class, and classes that are mostly taken for another one, against a gate."""
    rows = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("n_chars") % 3 > 0, "en").otherwise(F.col("lang")).alias("guess"))
    cells = rows.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))
    invalid = cells.agg(F.sum(F.when(F.col("guess").isNull(), F.col("n")).otherwise(0)).alias("invalid"))
    most = cells.where("guess IS NOT NULL").groupBy("lang").agg(F.max_by("guess", F.struct("n", "guess")).alias("taken_for"))
    reversed_ = most.where("taken_for <> lang").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "lang", "taken_for"))), ",").alias("reversed"))
    mean = E.macro_f1(rows, "lang", "guess").agg(F.avg(E.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro"))
    out = mean.join(invalid).join(reversed_)
    return out.select(F.round("macro", 6).alias("macro"), "invalid", "reversed", ((F.col("macro") >= 0.8) & (F.col("invalid") == 0) & (F.col("reversed") == "")).alias("passed"))


def abstention(spark, sf_dir):
    """Share of undecided verdicts by language and label; a language of more than half is flagged for exclusion."""
    verdict = F.when(F.col("score") < 0.3, "safe").when(F.col("score") > 0.8, "vuln").otherwise("unknown")
    rows = scored(spark, sf_dir).withColumn("v", verdict).groupBy("lang", "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "unknown").alias("unknown"))
    whole = rows.groupBy("lang").agg((F.sum("unknown") / F.sum("n") > 0.5).alias("excluded"))
    return rows.join(whole, "lang").withColumn("share", F.round(E.ratio(F.col("unknown"), F.col("n")), 6))


def policy_metrics(spark, sf_dir):
    """Metrics of the rules R0 to R4."""
    rows = _judged(spark, sf_dir).withColumn("graph", F.when(F.col("n_chars") % 4 == 0, "vuln").when(F.col("n_chars") % 4 == 1, "safe").otherwise("unknown"))
    rules = E.combined(F.col("pred"), F.col("graph"), F.col("n_chars") % 3 == 0)
    each = rows.select("gold", F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("p")) for n, v in rules.items()))))
    return _rounded(E.with_rates(each.groupBy("rule").agg(*E.confusion_aggs(F.col("gold"), F.col("p")))), *RATES)


QUERIES = {
    f.__name__: f
    for f in (
        confusion, f2, report_rollup, trivial_baseline, pairwise, pair_rank, pair_join, auc, length_baseline, stratified_auc, delta_auc, macro_gate, threshold_curve, best_tau, tau_stride, multi_source_op, vote_sweep,
        bootstrap_ci, paired_bootstrap, spearman, zscore_blend, length_stats, sketch_bounds, quantile_bins, mean_rank, gap_median, macro_f1, abstention, policy_metrics,
    )
}

COUNTS = (
    "count(*) FILTER ({g} AND {p}) AS tp, count(*) FILTER (NOT {g} AND {p}) AS fp, count(*) FILTER ({g} AND NOT {p}) AS fn, count(*) FILTER (NOT {g} AND NOT {p}) AS tn"
)
RATE = (
    "round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0), 6) AS fpr,"
    " round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
)
JUDGED = f"WITH {SCORED}, j AS (SELECT doc_id, lang, source, n_chars, pair_id, score, gold = 'vuln' AS g, score >= 0.5 AS p FROM scored)"
PAIRS = f"WITH {SCORED}, s AS (SELECT pair_id, max({{0}}) FILTER (gold = 'vuln') AS vuln, max({{0}}) FILTER (gold = 'safe') AS safe FROM scored GROUP BY 1 HAVING count(*) = 2)"


def _auc(value: str, by: str, places: int = 6) -> str:
    return f"""{JUDGED}, r AS (SELECT {by}, g, rank() OVER w + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / CAST(2 AS DOUBLE) AS r FROM j WINDOW w AS (PARTITION BY {by} ORDER BY {value})),
        s AS (SELECT {by}, count(*) FILTER (g) AS n_pos, count(*) FILTER (NOT g) AS n_neg, sum(r) FILTER (g) AS r FROM r GROUP BY 1)
        SELECT {by}, n_pos, n_neg, round((r - n_pos * (n_pos + 1) / CAST(2 AS DOUBLE)) / nullif(n_pos * n_neg, 0), {places}) AS auc FROM s"""


CURVE = """t AS (SELECT DISTINCT {by} score AS tau FROM j), c AS (SELECT {tby} tau, """ + COUNTS.format(g="g", p="(score >= tau)") + """ FROM t JOIN j {on} GROUP BY ALL)"""
GRID = """d AS (SELECT DISTINCT round(score, 3) AS v FROM scored), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM d),
        grid AS (SELECT v AS tau FROM r WHERE r % greatest(1, n // 200) = 0 UNION SELECT CAST(0 AS DOUBLE))"""
U = "CAST(CAST('0x' || left(md5('42:' || rep || ':' || pair_id), 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"
W = """(u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT
          + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT"""
DRAWS = f"""{JUDGED}, c AS (SELECT pair_id, """ + COUNTS.format(g="g", p="p") + ", " + COUNTS.format(g="g", p="(score >= 0.3)").replace("AS ", "AS x") + f""" FROM j GROUP BY 1),
        u AS (SELECT c.*, rep, {U} AS u FROM c, range(1, 2001) t(rep)), w AS (SELECT *, {W} AS w FROM u),
        m AS (SELECT rep, coalesce(CAST(2 * sum(tp * w) AS DOUBLE) / nullif(sum((2 * tp + fp + fn) * w), 0), 0) AS one, coalesce(CAST(2 * sum(xtp * w) AS DOUBLE) / nullif(sum((2 * xtp + xfp + xfn) * w), 0), 0) AS two,
          coalesce(CAST(sum(tp * w) AS DOUBLE) / nullif(sum((tp + fn) * w), 0), 0) AS recall, coalesce(CAST(sum(fp * w) AS DOUBLE) / nullif(sum((fp + tn) * w), 0), 0) AS fpr FROM w GROUP BY 1)"""  # fmt: skip


def _interval(value: str, metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, round(max(v) FILTER (r = 51), 6) AS lo, round(max(v) FILTER (r = 1951), 6) AS hi FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) AS r FROM m)"""


ORACLE = {
    "confusion": f"{JUDGED}, c AS (SELECT {COUNTS.format(g='g', p='p')} FROM j) SELECT *, {RATE} FROM c",
    "f2": f"{JUDGED}, c AS (SELECT source, {COUNTS.format(g='g', p='p')} FROM j GROUP BY 1) SELECT *, round(coalesce(CAST(5 * tp AS DOUBLE) / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f_beta FROM c",
    "report_rollup": f"{JUDGED}, c AS (SELECT coalesce(lang, 'all') AS lang, {COUNTS.format(g='g', p='p')} FROM j GROUP BY ROLLUP (j.lang)) SELECT *, {RATE} FROM c",
    "trivial_baseline": f"{JUDGED}, c AS (SELECT lang, {COUNTS.format(g='g', p='true')} FROM j GROUP BY 1) SELECT *, {RATE} FROM c",
    "pairwise": f"""{JUDGED}, q AS (SELECT CASE WHEN n_chars % 17 = 0 THEN -doc_id - 1 ELSE pair_id END AS pair_id, g, CASE WHEN n_chars % 13 <> 0 THEN p END AS p FROM j), s AS (SELECT pair_id, bool_or(p) FILTER (g) AS v, bool_or(p) FILTER (NOT g) AS s FROM q GROUP BY 1 HAVING count(DISTINCT g) = 2)
        SELECT CASE WHEN v IS NULL OR s IS NULL THEN 'parse_fail' WHEN v AND NOT s THEN 'correct' WHEN v THEN 'vulnerable' WHEN NOT s THEN 'benign' ELSE 'reversed' END AS outcome, count(*) AS n,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1""",
    "pair_rank": PAIRS.format("score") + """ SELECT count(*) AS n, round(avg((vuln > safe)::INT), 6) AS strict, round(avg((vuln = safe)::INT), 6) AS ties, round(avg((vuln > safe)::INT + (vuln = safe)::INT / CAST(2 AS DOUBLE)), 6) AS tie_half FROM s""",
    "pair_join": PAIRS.format("n_chars") + " SELECT * FROM s",
    "auc": _auc("score", "lang"),
    "length_baseline": f"""WITH a AS ({_auc("(-n_chars)", "source", 12)}), b AS ({_auc("score", "source", 12)}), {SCORED},
        o AS (SELECT source, gold, n_chars, row_number() OVER (PARTITION BY source, gold ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source, gold) AS n FROM scored),
        m AS (SELECT source, max(n_chars) FILTER (gold = 'vuln' AND r = n // 2 + 1) AS median_vuln, max(n_chars) FILTER (gold = 'safe' AND r = n // 2 + 1) AS median_safe FROM o GROUP BY 1)
        SELECT a.source, a.n_pos, a.n_neg, round(a.auc, 6) AS auc, round(b.auc, 6) AS score_auc, round(b.auc - a.auc, 6) AS margin, median_vuln, median_safe FROM a JOIN b USING (source) JOIN m USING (source)""",
    "stratified_auc": f"""{JUDGED}, o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n FROM j), c AS (SELECT n_chars AS cut FROM o, range(1, 5) t(i) WHERE r = n * i // 5 + 1),
        x AS (SELECT g, score, CAST((SELECT count(*) FROM c WHERE cut <= n_chars) AS INTEGER) AS bin FROM j), r AS (SELECT bin, g, rank() OVER w + (count(*) OVER (PARTITION BY bin, score) - 1) / CAST(2 AS DOUBLE) AS r FROM x WINDOW w AS (PARTITION BY bin ORDER BY score)),
        s AS (SELECT bin, count(*) FILTER (g) AS n_pos, count(*) FILTER (NOT g) AS n_neg, sum(r) FILTER (g) AS r FROM r GROUP BY 1), a AS (SELECT bin, n_pos, n_neg, (r - n_pos * (n_pos + 1) / CAST(2 AS DOUBLE)) / nullif(n_pos * n_neg, 0) AS auc FROM s), b AS (SELECT * FROM a WHERE auc IS NOT NULL)
        SELECT bin, n_pos, n_neg, round(auc, 6) AS auc FROM b UNION ALL SELECT -1, CAST(sum(n_pos) AS BIGINT), CAST(sum(n_neg) AS BIGINT), round(sum(auc * n_pos * n_neg) / sum(n_pos * n_neg), 6) FROM b""",
    "delta_auc": f"""{JUDGED}, v AS (SELECT pair_id, g, score, CAST(-n_chars AS DOUBLE) AS short FROM j), q AS (SELECT DISTINCT pair_id FROM v), u AS (SELECT pair_id, rep, {U} AS u FROM q, range(1, 2001) t(rep)),
        w AS (SELECT v.*, rep, {W} AS w FROM v JOIN u USING (pair_id)), e AS (SELECT rep, g, w, 'score' AS side, score AS x FROM w WHERE w > 0 UNION ALL SELECT rep, g, w, 'short', short FROM w WHERE w > 0),
        t AS (SELECT rep, side, x, coalesce(sum(w) FILTER (g), 0) AS p, coalesce(sum(w) FILTER (NOT g), 0) AS n FROM e GROUP BY 1, 2, 3), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep, side ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
        a AS (SELECT rep, side, sum(p * (below + n / CAST(2 AS DOUBLE))) / CAST(sum(p) * sum(n) AS DOUBLE) AS auc FROM b GROUP BY 1, 2), d AS (SELECT x.auc - y.auc AS d FROM a x JOIN a y ON x.rep = y.rep AND x.side = 'score' AND y.side = 'short'),
        r AS (SELECT d, row_number() OVER (ORDER BY d) AS r FROM d), o AS (SELECT round(max(d) FILTER (r = 51), 6) AS lo, round(max(d) FILTER (r = 1951), 6) AS hi FROM r) SELECT *, lo > 0 OR hi < 0 AS significant FROM o""",
    "threshold_curve": f"""{JUDGED}, {GRID}, c AS (SELECT tau, {COUNTS.format(g='g', p='(score >= tau)')} FROM grid, j GROUP BY 1) SELECT *, {RATE} FROM c""",
    "best_tau": f"""{JUDGED}, {CURVE.format(by='lang,', tby='t.lang,', on='ON t.lang = j.lang')}, r AS (SELECT *, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS x FROM c)
        SELECT 'f1' AS rule, lang, tau, round(f, 6) AS f1, round(x, 6) AS fpr FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f DESC, tau) = 1)
        UNION ALL SELECT 'f1_fpr_cap', lang, tau, round(f, 6), round(x, 6) FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY x <= 0.3 DESC, f DESC, tau) = 1)""",
    "tau_stride": f"WITH {SCORED}, {GRID} SELECT tau FROM grid",
    "multi_source_op": f"""{JUDGED}, t AS (SELECT CAST(i AS DOUBLE) / 20 AS tau FROM range(21) r(i)), c AS (SELECT source, tau, {COUNTS.format(g='g', p='(score >= tau)')} FROM j, t GROUP BY 1, 2),
        m AS (SELECT tau, round(avg(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f, round(max(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0)), 6) AS x FROM c GROUP BY 1),
        k AS (SELECT CAST(c AS DOUBLE) AS cap FROM (VALUES (0.05), (0.5), (0.9)) v(c)), b AS (SELECT cap, tau, f, x, row_number() OVER (PARTITION BY cap ORDER BY f DESC, tau) AS r FROM m, k WHERE x <= cap)
        SELECT k.cap, CASE WHEN tau IS NULL THEN 'INFEASIBLE' ELSE 'OK' END AS status, tau, f AS mean_f1, x AS max_fpr FROM k LEFT JOIN b ON b.cap = k.cap AND r = 1""",
    "vote_sweep": f"{JUDGED}, c AS (SELECT CAST(k AS INTEGER) AS k, {COUNTS.format(g='g', p='(floor(least(score, CAST(0.999 AS DOUBLE)) * 5) >= k)')} FROM j, range(1, 6) r(k) GROUP BY 1) SELECT *, {RATE} FROM c",
    "bootstrap_ci": DRAWS + " " + " UNION ALL ".join(_interval(v, m) for v, m in (("one", "f1"), ("recall", "recall"), ("fpr", "fpr"))),
    "paired_bootstrap": f"{DRAWS}, b AS ({_interval('(two - one)', 'd')}) SELECT lo, hi, lo > 0 OR hi < 0 AS significant FROM b",
    "spearman": f"WITH {SCORED}, r AS (SELECT row_number() OVER (ORDER BY score, doc_id) AS x, row_number() OVER (ORDER BY n_chars, doc_id) AS y FROM scored) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r",
    "zscore_blend": f"""WITH {SCORED}, s AS (SELECT avg(score) AS m1, stddev_pop(score) AS s1, avg(n_chars) AS m2, stddev_pop(n_chars) AS s2 FROM scored), k AS (SELECT CAST(i AS DOUBLE) / 5 AS weight FROM range(6) t(i)),
        b AS (SELECT weight, gold = 'vuln' AS g, round((score - m1) / s1 * weight + (n_chars - m2) / s2 * (1 - weight), 4) AS v FROM scored, s, k),
        r AS (SELECT weight, g, rank() OVER w + (count(*) OVER (PARTITION BY weight, v) - 1) / CAST(2 AS DOUBLE) AS r FROM b WINDOW w AS (PARTITION BY weight ORDER BY v)),
        a AS (SELECT weight, count(*) FILTER (g) AS n_pos, count(*) FILTER (NOT g) AS n_neg, sum(r) FILTER (g) AS r FROM r GROUP BY 1) SELECT weight, n_pos, n_neg, round((r - n_pos * (n_pos + 1) / CAST(2 AS DOUBLE)) / nullif(n_pos * n_neg, 0), 6) AS auc FROM a""",
    "length_stats": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
        SELECT lang, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, max(n_chars) FILTER (r = (n * 9 + 9) // 10) AS p90, max(n_chars) AS most FROM r GROUP BY 1""",
    "quantile_bins": f"""WITH {SCORED}, r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n FROM scored), c AS (SELECT n_chars AS cut FROM r, range(1, 5) t(i) WHERE r = n * i // 5 + 1),
        b AS (SELECT n_chars, (SELECT count(*) FROM c WHERE cut <= n_chars) AS bin FROM scored) SELECT bin, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM b GROUP BY 1""",
    "mean_rank": f"WITH {SCORED} SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / CAST(2 AS DOUBLE) AS mean_rank FROM scored",
    "gap_median": """WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), g AS (SELECT l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS gap FROM d)
        SELECT count(gap) AS n, round_even(median(gap), 0) AS median FROM g""",
    "macro_f1": """WITH d AS (SELECT lang AS g, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS p FROM documents), k AS (SELECT g AS cls FROM d UNION SELECT p FROM d WHERE p IS NOT NULL),
        c AS (SELECT cls, count(*) FILTER (g = cls AND p = cls) AS tp, count(*) FILTER (g <> cls AND p = cls) AS fp, count(*) FILTER (g = cls AND (p IS NULL OR p <> cls)) AS fn FROM k, d GROUP BY 1)
        SELECT *, round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "macro_gate": """WITH d AS (SELECT lang AS g, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN n_chars % 3 > 0 THEN 'en' ELSE lang END AS p FROM documents), k AS (SELECT g AS cls FROM d UNION SELECT p FROM d WHERE p IS NOT NULL),
        c AS (SELECT cls, count(*) FILTER (g = cls AND p = cls) AS tp, count(*) FILTER (g <> cls AND p = cls) AS fp, count(*) FILTER (g = cls AND (p IS NULL OR p <> cls)) AS fn FROM k, d GROUP BY 1),
        x AS (SELECT g, p, count(*) AS n FROM d WHERE p IS NOT NULL GROUP BY 1, 2), t AS (SELECT g, p FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, p DESC) = 1),
        o AS (SELECT (SELECT avg(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)) FROM c) AS m, (SELECT count(*) FROM d WHERE p IS NULL) AS invalid, coalesce((SELECT string_agg(g || '>' || p, ',' ORDER BY g || '>' || p) FROM t WHERE g <> p), '') AS reversed)
        SELECT round(m, 6) AS macro, invalid, reversed, m >= 0.8 AND invalid = 0 AND reversed = '' AS passed FROM o""",
    "abstention": f"""WITH {SCORED}, c AS (SELECT lang, gold, count(*) AS n, count(*) FILTER (score >= 0.3 AND score <= 0.8) AS unknown FROM scored GROUP BY 1, 2), l AS (SELECT lang, sum(unknown) / CAST(sum(n) AS DOUBLE) > 0.5 AS excluded FROM c GROUP BY 1)
        SELECT lang, gold, n, unknown, excluded, round(CAST(unknown AS DOUBLE) / n, 6) AS share FROM c JOIN l USING (lang)""",
    "sketch_bounds": "SELECT lang, count(*) AS n, true AS distinct_holds, true AS median_holds, true AS tenth_holds FROM documents GROUP BY 1",
    "policy_metrics": f"""{JUDGED}, e AS (SELECT g, p, CASE n_chars % 4 WHEN 0 THEN 'vuln' WHEN 1 THEN 'safe' ELSE 'unknown' END AS gv, n_chars % 3 = 0 AS strong FROM j),
        x AS (SELECT 'r0' AS rule, g, p FROM e UNION ALL SELECT 'r1', g, CASE WHEN gv = 'vuln' THEN true WHEN gv = 'safe' AND strong THEN false ELSE p END FROM e UNION ALL SELECT 'r2', g, CASE WHEN p THEN true WHEN gv = 'vuln' THEN true ELSE false END FROM e
          UNION ALL SELECT 'r3', g, CASE WHEN gv = 'safe' AND strong THEN false ELSE p END FROM e UNION ALL SELECT 'r4', g, CASE WHEN gv = 'safe' AND strong THEN false WHEN p THEN true WHEN gv = 'vuln' THEN true ELSE false END FROM e),
        c AS (SELECT rule, {COUNTS.format(g='g', p='p')} FROM x GROUP BY 1) SELECT *, {RATE} FROM c""",
}
