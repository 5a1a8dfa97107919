"""Grading queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graniteloom.operators import curation as C
from graniteloom.operators import evaluation as E
from graniteloom.operators import grading as Q
from graniteloom.plans.curating import BUCKET
from graniteloom.plans.evaluating import COUNTS, JUDGED, PAIRS, RATE, RATES, _auc, _judged, _rounded
from graniteloom.plans.tables import SCORED, scored, table

KEYWORDS = ["the", "und", "que", "$$$", "token"]


def _lines(spark, sf_dir):
    """Order lines as findings: file, method, class and line; truths are the returned ones."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 50).alias("method"), (F.col("l_partkey") % 12).alias("cwe"), (F.col("l_partkey") % 300).alias("line"), "l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"
    )


def instance_grade(spark, sf_dir):
    """Distinct (file, method, class) by class: in truth and findings, and the totals over classes."""
    rows = _lines(spark, sf_dir)
    by = Q.set_grade(rows.where("l_returnflag = 'R'"), rows.where("l_linestatus = 'O'"), ["file", "method", "cwe"], "cwe")
    total = by.agg(F.lit(-1).cast("long").alias("cwe"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return _rounded(E.with_rates(by.unionByName(total).withColumn("tn", F.lit(0).cast("long"))).drop("fpr", "tn"), "recall", "prec", "f1")


def castle_points(spark, sf_dir):
    """Points of orders as cases: two of three are vulnerable, their open lines are findings, their returned ones the truth;
    a class is accepted with its half and its doubles."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), (F.col("l_partkey") % 12).alias("cls"), (F.col("l_partkey") % 9).alias("line"), "l_returnflag", "l_linestatus")
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), (F.col("o_orderkey") % 3 > 0).alias("vulnerable"), (F.col("o_custkey") % 12).alias("cls"))
    accepted = rows.select("cls").distinct().select("cls", F.explode(F.array(F.expr("cls div 2"), F.col("cls") * 2, F.col("cls") * 2 + 1)).alias("ok"))
    points = Q.case_points(cases, rows.where("l_linestatus = 'O' AND l_returnflag <> 'N'"), rows.where("l_returnflag = 'R' AND l_linestatus = 'F'"), accepted)
    return points.groupBy("tp", "tn", "fn", "points").agg(F.count(F.lit(1)).alias("n"), F.sum("fp").alias("fp"))


def unit_grade(spark, sf_dir):
    """Intervals of a class in a file, and alerts inside and outside of them."""
    rows = _lines(spark, sf_dir)
    unit = F.concat_ws(":", "l_orderkey", "l_linenumber")
    units = rows.where("l_returnflag = 'R'").select(unit.alias("unit"), "file", "cwe", F.col("line").alias("start"), (F.col("line") + F.col("l_linenumber")).alias("stop"))
    alerts = rows.where("l_linestatus = 'O'").select(unit.alias("alert"), "file", "cwe", "line")
    found, matched = Q.unit_grade(units, alerts, "file", "unit", "start", "stop", "line", "cwe", 16)
    a = found.groupBy("cwe").agg(F.count_if("found").alias("tp"), F.count_if(~F.col("found")).alias("fn"))
    b = matched.groupBy("cwe").agg(F.count_if(~F.col("matched")).alias("fp"), F.count_if("matched").alias("alerts_in"))
    return a.join(b, "cwe", "full").select("cwe", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fn", "fp", "alerts_in")))


def unit_summary(spark, sf_dir):
    """Suppliers of a nation as files of a project: recall of projects, units found, and alerts of the project's class and of
    others; alerts with little tax are sanitized."""
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("project"))
    rows = table(spark, sf_dir, "lineitem").join(F.broadcast(nation), "l_suppkey")
    unit = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax")
    rows = rows.select(unit.alias("unit"), "project", F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 12).alias("cwe"), (F.col("l_partkey") % 3000).alias("line"), "l_linenumber", "l_returnflag", "l_linestatus", "l_tax").distinct()
    groups = nation.select("project").distinct().withColumn("expected", F.col("project").cast("long") % 12)
    own = rows.where("l_returnflag = 'R'").join(F.broadcast(groups), "project").where("cwe = expected")
    units = own.select("unit", "project", "file", "cwe", F.col("line").alias("start"), (F.col("line") + F.col("l_linenumber")).alias("stop"))
    alerts = rows.where("l_linestatus = 'O' AND l_tax > 0.02").select(F.col("unit").alias("alert"), "project", "file", "cwe", "line")
    found, matched = Q.unit_grade(units, alerts, "file", "unit", "start", "stop", "line", "cwe", 16)
    return _rounded(Q.group_summary(groups, found, matched, "project", "cwe"), "group_recall", "precision", "recall", "f1", "target_precision", "target_recall", "target_f1")


def ambiguous_join(spark, sf_dir):
    """Findings by base name: no file of that name, one (strict), or several (lenient), and how many."""
    files = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 70).alias("base"))
    findings = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90).alias("base"))
    counts = files.groupBy("base").agg(F.count(F.lit(1)).alias("n_files"), F.min("s_suppkey").alias("file"))
    met = findings.join(counts, "base", "left")
    kind = F.when(F.col("n_files").isNull(), "unresolved").when(F.col("n_files") == 1, "strict").otherwise("lenient")
    return met.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_files").alias("files"), F.sum("file").alias("first"))


def score_attach(spark, sf_dir):
    """Scores by (pair, label): those attached and missed, and keys that are not unique."""
    cases = scored(spark, sf_dir).select("pair_id", "gold")
    scores = scored(spark, sf_dir).where("n_chars % 10 > 0").select("pair_id", "gold", "score")
    double = scores.groupBy("pair_id", "gold").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = cases.join(scores, ["pair_id", "gold"], "left").groupBy("gold").agg(F.count("score").alias("attached"), F.count_if(F.col("score").isNull()).alias("missed"))
    return met.join(double.agg(F.count(F.lit(1)).alias("repeated")))


def adjacent_pairs(spark, sf_dir):
    """Rows paired with the next in order, and pairs whose rows are not of one conversation and opposite roles."""
    turns = C.rank_in_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], "at")
    pairs = turns.groupBy(F.expr("(at - 1) div 2").alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("c"), F.count_distinct("role").alias("r"))
    return pairs.agg(F.count_if(F.expr("n = 2")).alias("pairs"), F.count_if(F.expr("n = 2 AND c = 1 AND r = 2")).alias("sound"))


def cohort_assign(spark, sf_dir):
    """Earlier training ids go, earlier test ids are the test cohort, the rest is split by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    earlier = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "test").when(F.col("quality") == 1, "train").otherwise("val").alias("was"))
    rows = docs.join(earlier.where("was <> 'test'"), "doc_id", "left_anti").join(earlier.where("was = 'test'"), "doc_id", "left")
    cohort = F.when(F.col("was") == "test", "test").when(C.hash_bucket(F.col("doc_id")) == 0, "val").otherwise("train")
    return rows.groupBy(cohort.alias("cohort"), "lang").agg(F.count(F.lit(1)).alias("n"))


def time_prefix(spark, sf_dir):
    """The oldest seventy in a hundred orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ranked = C.rank_in_order(orders, ["o_orderdate", "o_orderkey"], "at")
    most = orders.agg(F.floor(F.count(F.lit(1)) * F.lit(0.7)).alias("most"))
    return ranked.join(F.broadcast(most)).where("at <= most").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"), F.sum("o_orderkey").alias("keys"))


def hash_select(spark, sf_dir):
    """Three cases a class by hash, after those used in development are out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    used = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return Q.hash_select(rows, "source", "doc_id", 3, without=used)


def keyed_coin(spark, sf_dir):
    """Sides by hash, and labels shuffled by another hash: agreement with the labels stays near a half."""
    rows = scored(spark, sf_dir).select("doc_id", "gold", Q.coin(F.col("doc_id")).alias("side"), Q.coin(F.col("doc_id"), 7).alias("shuffled"))
    return rows.groupBy("gold", "side", "shuffled").agg(F.count(F.lit(1)).alias("n"))


def half_split(spark, sf_dir):
    """Half of each label's rows in hashed order, the smaller half on odd counts."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    order = [F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256), F.col("doc_id")]
    sizes = rows.groupBy(F.col("quality").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    ranked = C.rank_within(rows, "quality", order, "at").join(sizes, F.col("quality") == F.col("q"))
    return ranked.select("doc_id", F.when(F.expr("at <= n div 2"), "a").otherwise("b").alias("half"))


def proportional_fill(spark, sf_dir):
    """A hundred documents by the shares of their languages, longest first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return Q.proportional_fill(rows, "lang", [F.desc("n_chars"), F.col("doc_id")], 100)


def quota_backfill(spark, sf_dir):
    """Groups of a language up to its quota, then from the others by hash until all quotas together are met."""
    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("size"))
    first = C.quota_fill(groups, "lang", "source", "size", 0.2)
    left = groups.join(first.select("lang", "source"), ["lang", "source"], "left_anti")
    order = Window.orderBy(F.sha2(F.concat(F.lit("43:"), "lang", "source"), 256)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goal = groups.agg((F.sum("size") * F.lit(0.4)).alias("goal")).join(first.agg(F.sum("size").alias("have")))
    more = left.withColumn("before", F.sum("size").over(order) - F.col("size")).join(F.broadcast(goal)).where(F.col("before") + F.col("have") < F.col("goal"))
    return first.withColumn("pass", F.lit(1)).unionByName(more.select("lang", "source", "size", F.lit(2).alias("pass")))


def upper_median(spark, sf_dir):
    """The middle element, the upper one of two, of each language's lengths."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    return E.quantile_pick(counts, ["lang"], "n_chars", "n", {"middle": "_n div 2 + 1"})


def stop_on_first(spark, sf_dir):
    """Turns of each conversation up to the first that holds a long answer."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") > 300).alias("hit"))
    first = rows.groupBy("conv_id").agg(F.min(F.when(F.col("hit"), F.col("turn"))).alias("first"))
    return rows.join(first, "conv_id").where(F.col("first").isNull() | (F.col("turn") <= F.col("first"))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("read"), F.bool_or("hit").alias("found"))


def accuracy_report(spark, sf_dir):
    """Accuracy of label, class and category in percent, and the mean time, by language."""
    rows = _judged(spark, sf_dir).select("lang", (F.col("gold") == F.col("pred")).alias("a"), (F.col("n_chars") % 5 > 0).alias("c"), (F.col("n_chars") % 9 > 0).alias("k"), (F.col("n_chars") % 700).alias("ms"))

    def percent(c):
        return F.round(100 * F.avg(c.cast("double")), 1)

    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), percent(F.col("a")).alias("label"), percent(F.col("a") & F.col("c")).alias("cwe"), percent(F.col("k")).alias("category"), F.round(F.avg("ms"), 1).alias("latency"))


def exact_class_f2(spark, sf_dir):
    """F2 over a set of truth keys, where the class must agree too."""
    rows = _lines(spark, sf_dir)
    truth = rows.where("l_returnflag = 'R'").groupBy("file", "line").agg(F.min("cwe").alias("truth"))
    found = rows.where("l_linestatus = 'O'").groupBy("file", "line").agg(F.min("cwe").alias("cwe"))
    both = truth.join(found, ["file", "line"], "full")
    kinds = {"binary": F.col("truth").isNotNull() & F.col("cwe").isNotNull(), "exact": F.coalesce(F.col("truth") == F.col("cwe"), F.lit(False))}
    each = both.select("truth", "cwe", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("hit")) for k, v in kinds.items()))))
    counts = each.groupBy("kind").agg(F.count_if("hit").alias("tp"), F.count_if(F.col("cwe").isNotNull() & ~F.col("hit")).alias("fp"), F.count_if(F.col("truth").isNotNull() & ~F.col("hit")).alias("fn"))
    return _rounded(E.f_beta(counts, 2.0), "f_beta")


def keyword_asymmetry(spark, sf_dir):
    """Shares of vuln and safe rows that hold each keyword, and the keyword of the largest difference."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2 == 0).alias("vuln"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.select("vuln", F.inline(F.array(*(F.struct(F.lit(w).alias("word"), F.contains("text", F.lit(w)).cast("double").alias("has")) for w in KEYWORDS))))
    rates = each.groupBy("word").agg(F.avg(F.when(F.col("vuln"), F.col("has"))).alias("vuln"), F.avg(F.when(~F.col("vuln"), F.col("has"))).alias("safe"))
    gap = F.abs(F.round(F.col("vuln") - F.col("safe"), 9))
    top = rates.agg(F.max_by("word", F.struct(gap, "word")).alias("top"))
    return _rounded(rates.join(F.broadcast(top)).select("word", "vuln", "safe", (F.col("word") == F.col("top")).alias("largest")), "vuln", "safe")


def distinct_sets(spark, sf_dir):
    """Distinct customers and parts of each nation's orders, and the nations of each part."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "o_custkey", "o_orderpriority").distinct()
    return rows.groupBy("c_nationkey").agg(F.count_distinct("o_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


def critic_metrics(spark, sf_dir):
    """A critic's figures by source; low scores say YES, every thirteenth length does not parse."""
    rows = _judged(spark, sf_dir)
    answer = F.when(F.col("n_chars") % 13 == 0, "UNPARSED").when(F.col("score") < 0.5, "YES").otherwise("NO")
    out = Q.critic_report(rows.select("source", "pair_id", F.when(F.col("gold"), "vuln").otherwise("safe").alias("label"), answer.alias("answer")), "source", "pair_id", "label", "answer")
    return _rounded(out, "accuracy", "always_no", "margin", "disagreement", "pair_correct", "yes_rate", "unparsed_rate")


def precision_gate(spark, sf_dir):
    """Precision of an engine's findings in each source with its normal interval, two verdicts on it: against a target, and on
    how the engine may be used. Every ninth length is unknown."""
    rows = _judged(spark, sf_dir)
    known = F.col("n_chars") % 9 > 0
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("all"), F.count_if(known & F.col("pred")).alias("n"), F.count_if(known & F.col("pred") & F.col("gold")).alias("tp"), F.count_if(~known).alias("unknown"))
    counts = counts.withColumn("prec", E.ratio(F.col("tp"), F.col("n")))
    half = 1.96 * F.sqrt(F.try_divide(F.col("prec") * (1 - F.col("prec")), F.col("n")))
    rows = counts.withColumns({"lo": F.round(F.col("prec") - half, 6), "hi": F.round(F.col("prec") + half, 6), "prec": F.round("prec", 6), "unknown_rate": F.round(E.ratio(F.col("unknown"), F.col("all")), 6)})
    use = Q.engine_gate(F.col("n"), F.col("prec"), F.col("lo"), F.col("unknown_rate"))
    return rows.select("source", "n", "prec", "lo", "hi", "unknown_rate", Q.gate(F.col("prec"), F.col("lo"), F.col("hi"), 0.55).alias("verdict"), use.alias("use"))


def arm_metrics(spark, sf_dir):
    """Arms of a repository bench: share of files flagged, recall across and inside of files, and precision."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") % 10 < 3).alias("truth"), (F.col("o_custkey") % 2 == 0).alias("cross"), (F.col("o_totalprice") % 10 < 5).alias("s1"), (F.col("o_custkey") % 3 == 0).alias("s2"))
    arms = {"S1": F.col("s1"), "S2": F.col("s2"), "C1": F.col("s1") | F.col("s2"), "C2": F.col("s1") & F.col("s2")}
    each = rows.select("truth", "cross", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), v.alias("flag")) for a, v in arms.items()))))
    hit = F.col("flag") & F.col("truth")
    counts = each.groupBy("arm").agg(
        F.avg(F.col("flag").cast("double")).alias("flag_rate"), E.ratio(F.count_if(hit & F.col("cross")), F.count_if(F.col("truth") & F.col("cross"))).alias("recall_cross"),
        E.ratio(F.count_if(hit & ~F.col("cross")), F.count_if(F.col("truth") & ~F.col("cross"))).alias("recall_single"), F.count_if(F.col("flag") & ~F.col("truth")).alias("fp_files"),
        E.ratio(F.count_if(hit), F.count_if("flag")).alias("prec"),
    )
    return _rounded(counts, "flag_rate", "recall_cross", "recall_single", "prec")


def engine_union(spark, sf_dir):
    """Files that any of four engines flags, and those that only one does."""
    o = table(spark, sf_dir, "orders")
    flagged = [o.where(F.col("o_orderkey") % k == 0).select("o_custkey").distinct().withColumn("engine", F.lit(f"e{k}")) for k in (2, 3, 5, 7)]
    every = flagged[0].unionByName(flagged[1]).unionByName(flagged[2]).unionByName(flagged[3])
    counts = every.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.min("engine").alias("engine"))
    return counts.groupBy(F.when(F.col("k") == 1, F.col("engine")).otherwise("several").alias("engine")).agg(F.count(F.lit(1)).alias("n"))


def failure_cause(spark, sf_dir):
    """The first cause that explains a missed truth."""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    cause = Q.first_cause([("not_parsed", F.col("l_quantity") < 5), ("no_source", F.col("l_discount") < 0.02), ("sanitized", F.col("l_returnflag") == "A"), ("wrong_line", F.col("l_tax") > 0.06)], "unknown")
    return rows.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def envelope(spark, sf_dir):
    """The least false positive rate and the largest precision that each source's AUC allows at some recalls."""
    rows = E.auc(_judged(spark, sf_dir), ["source"], "gold", "score").where("auc IS NOT NULL")
    each = rows.select("source", F.round("auc", 9).alias("auc"), F.explode(F.array(*(F.lit(r) for r in Q.RECALLS))).alias("recall"))
    bound = Q.envelope(F.col("auc"), F.col("recall"))
    return each.select("source", "recall", F.round(bound["fpr"], 4).alias("fpr_min"), F.round(bound["precision"], 4).alias("precision_max"))


def argmax_agreement(spark, sf_dir):
    """Agreement of the decision at 0 of a centred score with a stored one."""
    rows = _judged(spark, sf_dir).select("lang", ((F.col("score") - 0.5) >= 0).alias("a"), F.when(F.col("n_chars") % 8 == 0, ~F.col("pred")).otherwise(F.col("pred")).alias("b"))
    return rows.groupBy("lang").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"))


def joint_cells(spark, sf_dir):
    """Accuracy by length class and a cue, empty cells too."""
    length = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 1000, "middle").when(F.col("n_chars") < 10**9, "long").otherwise("huge")
    rows = _judged(spark, sf_dir).select(length.alias("bin"), (F.col("n_chars") % 3 == 0).alias("cue"), (F.col("gold") == F.col("pred")).alias("hit"))
    bins = spark.range(1).select(F.explode(F.array(*(F.lit(b) for b in ("short", "middle", "long", "huge")))).alias("bin"))
    return _rounded(Q.joint_cells(rows, bins, "bin", "cue", F.col("hit")), "accuracy")


def overlap_report(spark, sf_dir):
    """Customers of two years: in both, and as a share of either."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    one, two = (o.where(F.col("y") == y).select("o_custkey") for y in (1996, 1998))
    counts = one.intersect(two).agg(F.count(F.lit(1)).alias("shared")).join(one.agg(F.count(F.lit(1)).alias("a"))).join(two.agg(F.count(F.lit(1)).alias("b")))
    return counts.select("shared", "a", "b", F.round(E.ratio(100 * F.col("shared"), F.col("a")), 4).alias("of_a"), F.round(E.ratio(100 * F.col("shared"), F.col("b")), 4).alias("of_b"))


def counterbalance(spark, sf_dir):
    """Pair accuracy with either side first: mean, gap and ties."""
    sides = E.pair_sides(scored(spark, sf_dir), "pair_id", "gold", "score")
    bias = F.lit(0.1)
    each = sides.select((F.col("vuln") + bias > F.col("safe")).cast("double").alias("a"), (F.col("vuln") > F.col("safe") + bias).cast("double").alias("b"), (F.col("vuln") == F.col("safe")).cast("double").alias("t"))
    out = each.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("first"), F.avg("b").alias("second"), F.avg("t").alias("ties"))
    return _rounded(out.withColumns({"mean": (F.col("first") + F.col("second")) / 2, "gap": F.col("first") - F.col("second")}), "first", "second", "ties", "mean", "gap")


def arm_matrix(spark, sf_dir):
    """Arms made of two signals, with all-vuln and all-safe beside them, overall and by language."""
    rows = _judged(spark, sf_dir).withColumn("graph", F.col("n_chars") % 4 == 0)
    arms = {"model": F.col("pred"), "graph": F.col("graph"), "either": F.col("pred") | F.col("graph"), "both": F.col("pred") & F.col("graph"), "all_vuln": F.lit(True), "all_safe": F.lit(False)}
    each = rows.select("lang", "gold", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), v.alias("p")) for a, v in arms.items()))))
    counts = each.groupingSets([["arm"], ["arm", "lang"]], "arm", "lang").agg(*E.confusion_aggs(F.col("gold"), F.col("p")))
    return _rounded(E.with_rates(counts.withColumn("lang", F.coalesce("lang", F.lit("all")))), *RATES)


def suppression_count(spark, sf_dir):
    """Positives that another engine vetoes, by truth."""
    rows = _judged(spark, sf_dir)
    veto = F.col("n_chars") % 3 == 0
    return rows.groupBy("gold").agg(F.count_if(F.col("pred")).alias("positives"), F.count_if(F.col("pred") & veto).alias("vetoed"))


def budget_total(spark, sf_dir):
    """Running cost of turns by their token use, for each conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.length("text") * F.when(F.col("role") == "assistant", 15).otherwise(3) / 1000, 4).alias("cost"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", "turn", F.round(F.sum("cost").over(upto), 4).alias("spent"))


def alias_hit(spark, sf_dir):
    """Texts that name the class they should, by a word of it or one of its aliases."""
    aliases = [("en", ["the", "this"]), ("de", ["und", "der"]), ("fr", ["que", "les"]), ("es", ["los", "una"])]
    names = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("lang"), F.array(*(F.lit(x) for x in a)).alias("names")) for c, a in aliases))))
    rows = table(spark, sf_dir, "documents").select("lang", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    hit = F.exists("names", lambda x: F.contains(F.col("text"), x))
    return rows.join(F.broadcast(names), "lang").groupBy("lang").agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))


def convention_sensitivity(spark, sf_dir):
    """Recall of each language with undecided verdicts taken as vuln and as safe, against a largest difference."""
    rows = scored(spark, sf_dir).select("lang", (F.col("gold") == "vuln").alias("g"), (F.col("score") > 0.7).alias("sure"), F.col("score").between(0.45, 0.7).alias("open"))
    each = rows.select("lang", "g", F.inline(F.array(F.struct(F.lit("vuln").alias("as"), (F.col("sure") | F.col("open")).alias("p")), F.struct(F.lit("safe").alias("as"), F.col("sure").alias("p")))))
    recall = each.groupBy("lang", "as").agg(E.ratio(F.count_if(F.col("g") & F.col("p")), F.count_if("g")).alias("r"))
    gap = recall.groupBy("lang").agg((F.max("r") - F.min("r")).alias("gap"))
    return gap.select("lang", F.round("gap", 6).alias("gap"), (F.round("gap", 6) > 0.1).alias("sensitive"))


def fingerprint_persist(spark, sf_dir):
    """Findings of two versions that are one by file, class and normalised sink; a project without any is clean."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project"), (F.col("l_partkey") % 25).alias("cwe"), F.lower(F.concat("l_returnflag", F.lit("()"))).alias("sink"), "l_linestatus")
    one, two = (rows.where(F.col("l_linestatus") == s).select("project", "cwe", "sink") for s in ("F", "O"))
    both = one.intersect(two).groupBy("project").agg(F.count(F.lit(1)).alias("persisting"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project")).join(both, "project", "left").select("project", F.coalesce("persisting", F.lit(0)).alias("persisting"), F.col("persisting").isNull().alias("clean"))


def token_difference(spark, sf_dir):
    """Pairs in which one side has words that the other lacks."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), F.array_distinct(C.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    pairs = rows.where("side = 0").select("pair", F.col("w").alias("a")).join(rows.where("side = 1").select("pair", F.col("w").alias("b")), "pair")
    return pairs.select("pair", F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))


def context_subset(spark, sf_dir):
    """Lines of a document that stand in its source's texts as a whole (every other line is changed)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    context = docs.select("doc_id", "source", F.when(F.col("pos") % 2 == 0, F.col("line")).otherwise(F.concat("line", F.lit("!"))).alias("line"))
    known = docs.select("source", "line").distinct().withColumn("known", F.lit(True))
    met = context.join(known, ["source", "line"], "left")
    return met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count("known").alias("known"))


def provenance(spark, sf_dir):
    """Findings of one kind by the nearest line of another: alone, overlapping or ambiguous."""
    rows = _lines(spark, sf_dir)
    a = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "line")
    b = rows.where("l_returnflag = 'A'").select("l_orderkey", F.col("line").alias("other"))
    gap = a.join(b, "l_orderkey", "left").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.abs(F.col("line") - F.col("other"))).alias("gap"))
    return gap.groupBy(Q.provenance(F.col("gap"), 30).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def ensemble_vote(spark, sf_dir):
    """Either of two models, and a calibrated sum of both where both speak."""
    rows = scored(spark, sf_dir).select((F.col("gold") == "vuln").alias("g"), F.col("score").alias("a"), F.when(F.col("n_chars") % 6 > 0, (F.col("n_chars") % 100) / 100).alias("b"))
    either = (F.col("a") >= 0.6) | F.coalesce(F.col("b") >= 0.6, F.lit(False))
    calibrated = F.when(F.col("b").isNull(), F.col("a") >= 0.6).otherwise(F.round(F.col("a") * 0.7 + F.col("b") * 0.3, 9) >= 0.55)
    each = rows.select("g", F.inline(F.array(F.struct(F.lit("or").alias("rule"), either.alias("p")), F.struct(F.lit("calibrated").alias("rule"), calibrated.alias("p")))))
    return _rounded(E.with_rates(each.groupBy("rule").agg(*E.confusion_aggs(F.col("g"), F.col("p")))), *RATES)


QUERIES = {
    f.__name__: f
    for f in (
        instance_grade, castle_points, unit_grade, unit_summary, ambiguous_join, score_attach, adjacent_pairs, cohort_assign, time_prefix, hash_select, keyed_coin, half_split, proportional_fill,
        quota_backfill, upper_median, stop_on_first, accuracy_report, exact_class_f2, keyword_asymmetry, distinct_sets, critic_metrics, precision_gate, arm_metrics, engine_union,
        failure_cause, envelope, argmax_agreement, joint_cells, overlap_report, counterbalance, arm_matrix, suppression_count, budget_total, alias_hit, convention_sensitivity,
        fingerprint_persist, token_difference, context_subset, provenance, ensemble_vote,
    )
}

LINES = """WITH r AS (SELECT l_suppkey AS file, l_orderkey % 50 AS method, l_partkey % 12 AS cwe, l_partkey % 300 AS line, l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem)"""
J, B = JUDGED, BUCKET
TOKENS = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n]+', ' ', 'g')), ' ')"


def _share(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


ORACLE = {
    "instance_grade": f"""{LINES}, t AS (SELECT DISTINCT file, method, cwe FROM r WHERE l_returnflag = 'R'), f AS (SELECT DISTINCT file, method, cwe FROM r WHERE l_linestatus = 'O'),
        b AS (SELECT coalesce(t.cwe, f.cwe) AS cwe, t.file AS t, f.file AS f FROM t FULL JOIN f ON t.file = f.file AND t.method = f.method AND t.cwe = f.cwe),
        c AS (SELECT cwe, count(*) FILTER (t IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM b GROUP BY ROLLUP (cwe))
        SELECT coalesce(cwe, -1) AS cwe, tp, fp, fn, round({_share('tp', 'tp + fn')}, 6) AS recall, round({_share('tp', 'tp + fp')}, 6) AS prec, round({_share('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""",
    "castle_points": """WITH f AS (SELECT DISTINCT l_orderkey AS c, l_partkey % 12 AS ok, l_partkey % 9 AS line FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'N'), t AS (SELECT DISTINCT l_orderkey AS c, l_partkey % 9 AS line FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
        k AS (SELECT o_orderkey AS c, o_orderkey % 3 > 0 AS v, o_custkey % 12 AS cls FROM orders),
        l AS (SELECT k.c, f.line, bool_or(t.c IS NOT NULL OR ok = cls OR ok = cls // 2 OR ok = 2 * cls OR ok = 2 * cls + 1) AS hit FROM f JOIN k ON k.c = f.c LEFT JOIN t ON t.c = f.c AND t.line = f.line GROUP BY 1, 2),
        s AS (SELECT c, count(*) AS n, count(*) FILTER (hit) AS h FROM l GROUP BY 1), r AS (SELECT v, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM k LEFT JOIN s USING (c)),
        e AS (SELECT CASE WHEN n = 0 AND v THEN (0, 0, 0, 1, 0) WHEN n = 0 THEN (0, 0, 1, 0, 2) WHEN NOT v THEN (0, n, 0, 0, -n) WHEN h > 0 THEN (1, n - h, 0, 0, 5 - (n - h)) ELSE (0, n, 0, 1, -n) END AS p FROM r)
        SELECT CAST(p[1] AS BIGINT) AS tp, CAST(p[3] AS BIGINT) AS tn, CAST(p[4] AS BIGINT) AS fn, CAST(p[5] AS BIGINT) AS points, count(*) AS n, CAST(sum(p[2]) AS BIGINT) AS fp FROM e GROUP BY 1, 2, 3, 4""",
    "unit_grade": f"""{LINES}, u AS (SELECT l_orderkey || ':' || l_linenumber AS unit, file, cwe, line AS a, line + l_linenumber AS b FROM r WHERE l_returnflag = 'R'), k AS (SELECT l_orderkey || ':' || l_linenumber AS alert, file, cwe, line FROM r WHERE l_linestatus = 'O'),
        m AS (SELECT unit, alert FROM u JOIN k ON u.file = k.file AND u.cwe = k.cwe AND line BETWEEN a AND b), x AS (SELECT cwe, count(*) FILTER (unit IN (SELECT unit FROM m)) AS tp, count(*) FILTER (unit NOT IN (SELECT unit FROM m)) AS fn FROM u GROUP BY 1),
        y AS (SELECT cwe, count(*) FILTER (alert NOT IN (SELECT alert FROM m)) AS fp, count(*) FILTER (alert IN (SELECT alert FROM m)) AS alerts_in FROM k GROUP BY 1)
        SELECT coalesce(x.cwe, y.cwe) AS cwe, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(alerts_in, 0) AS alerts_in FROM x FULL JOIN y ON x.cwe = y.cwe""",
    "unit_summary": f"""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, s_nationkey AS project, l_suppkey AS file, l_partkey % 12 AS cwe, l_partkey % 3000 AS line, l_linenumber, l_returnflag, l_linestatus, l_tax, s_nationkey % 12 AS expected FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
        u AS (SELECT row_number() OVER () AS unit, project, file, cwe, line AS a, line + l_linenumber AS b FROM r WHERE l_returnflag = 'R' AND cwe = expected), k AS (SELECT row_number() OVER () AS alert, project, file, cwe, line, cwe = expected AS own FROM r WHERE l_linestatus = 'O' AND l_tax > 0.02),
        m AS (SELECT unit, alert FROM u JOIN k ON u.file = k.file AND u.cwe = k.cwe AND line BETWEEN a AND b), f AS (SELECT *, unit IN (SELECT unit FROM m) AS hit FROM u), g AS (SELECT *, alert IN (SELECT alert FROM m) AS hit FROM k),
        c AS (SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier) AS groups, (SELECT count(DISTINCT project) FROM f WHERE hit) AS d, (SELECT count(*) FROM f WHERE hit) AS tp, (SELECT count(*) FROM f WHERE NOT hit) AS fn,
          (SELECT count(*) FROM g WHERE own AND NOT hit) AS target_fp, (SELECT count(*) FROM g WHERE NOT own) AS unrelated, (SELECT count(*) FROM g) AS active),
        x AS (SELECT *, target_fp + unrelated AS fp, {_share('d', 'groups')} AS gr, {_share('tp', '(tp + target_fp + unrelated)')} AS p, {_share('tp', '(tp + fn)')} AS q, {_share('tp', '(tp + target_fp)')} AS o FROM c)
        SELECT groups, tp, fn, target_fp, unrelated, active, fp, round(gr, 6) AS group_recall, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1,
        round(o, 6) AS target_precision, round(q, 6) AS target_recall, round(coalesce(2 * o * q / nullif(o + q, 0), 0), 6) AS target_f1 FROM x""",
    "ambiguous_join": """WITH c AS (SELECT s_suppkey % 70 AS base, count(*) AS n, min(s_suppkey) AS file FROM supplier GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'strict' ELSE 'lenient' END AS kind, count(*) AS n, CAST(sum(c.n) AS BIGINT) AS files, CAST(sum(file) AS BIGINT) AS first
        FROM orders LEFT JOIN c ON base = o_orderkey % 90 GROUP BY 1""",
    "score_attach": f"""WITH {SCORED} SELECT gold, count(*) FILTER (n_chars % 10 > 0) AS attached, count(*) FILTER (n_chars % 10 = 0) AS missed, CAST(0 AS BIGINT) AS repeated FROM scored GROUP BY 1""",
    "adjacent_pairs": """WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS r FROM conversations), p AS (SELECT r // 2 AS p, count(*) AS n, count(DISTINCT conv_id) AS c, count(DISTINCT role) AS k FROM r GROUP BY 1)
        SELECT count(*) FILTER (n = 2) AS pairs, count(*) FILTER (n = 2 AND c = 1 AND k = 2) AS sound FROM p""",
    "cohort_assign": f"""WITH e AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 1 THEN 'train' ELSE 'val' END AS was FROM labels)
        SELECT CASE WHEN was = 'test' THEN 'test' WHEN {B.format("d.doc_id")} = 0 THEN 'val' ELSE 'train' END AS cohort, lang, count(*) AS n FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id WHERE was IS NULL OR was = 'test' GROUP BY 1, 2""",
    "time_prefix": """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT count(*) AS n, max(o_orderdate) AS newest, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r WHERE r <= floor(n * CAST(0.7 AS DOUBLE))""",
    "hash_select": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) <= 3",
    "keyed_coin": f"""WITH {SCORED} SELECT gold, CAST(CAST('0x' || left(sha256('42:' || doc_id), 8) AS BIGINT) % 2 AS INTEGER) AS side, CAST(CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) % 2 AS INTEGER) AS shuffled, count(*) AS n FROM scored GROUP BY ALL""",
    "half_split": """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) <= count(*) OVER (PARTITION BY quality) // 2 THEN 'a' ELSE 'b' END AS half FROM labels""",
    "proportional_fill": """WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS t FROM documents), q AS (SELECT *, r <= round(CAST(100 * n AS DOUBLE) / t) AS first FROM r),
        x AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY n_chars DESC, doc_id) AS p FROM q) SELECT doc_id, lang, n_chars FROM x WHERE first OR p <= 100 - (SELECT count(*) FROM q WHERE first)""",
    "quota_backfill": """WITH g AS (SELECT lang, source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1, 2), w AS (SELECT *, CAST(sum(size) OVER (PARTITION BY lang ORDER BY sha256('42:' || source), source ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(sum(size) OVER (PARTITION BY lang) AS BIGINT) AS total FROM g),
        f AS (SELECT lang, source, size, before < total * CAST(0.2 AS DOUBLE) AS first FROM w), m AS (SELECT *, CAST(sum(size) OVER (ORDER BY sha256('43:' || lang || source) ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM f WHERE NOT first)
        SELECT lang, source, size, 1 AS pass FROM f WHERE first UNION ALL SELECT lang, source, size, 2 FROM m WHERE before + (SELECT sum(size) FROM f WHERE first) < (SELECT sum(size) * CAST(0.4 AS DOUBLE) FROM g)""",
    "upper_median": "SELECT lang, n_chars AS middle FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r = n // 2 + 1",
    "stop_on_first": """WITH c AS (SELECT conv_id, turn, length(text) > 300 AS hit FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (hit) AS first FROM c GROUP BY 1)
        SELECT conv_id, count(*) AS read, bool_or(hit) AS found FROM c JOIN f USING (conv_id) WHERE first IS NULL OR turn <= first GROUP BY 1""",
    "accuracy_report": f"""{J} SELECT lang, count(*) AS n, round(100 * avg((g = p)::INT), 1) AS label, round(100 * avg((g = p AND n_chars % 5 > 0)::INT), 1) AS cwe, round(100 * avg((n_chars % 9 > 0)::INT), 1) AS category, round(avg(n_chars % 700), 1) AS latency FROM j GROUP BY 1""",
    "exact_class_f2": f"""{LINES}, t AS (SELECT file, line, min(cwe) AS truth FROM r WHERE l_returnflag = 'R' GROUP BY 1, 2), f AS (SELECT file, line, min(cwe) AS cwe FROM r WHERE l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT truth, cwe FROM t FULL JOIN f USING (file, line)),
        e AS (SELECT 'binary' AS kind, truth, cwe, truth IS NOT NULL AND cwe IS NOT NULL AS hit FROM b UNION ALL SELECT 'exact', truth, cwe, coalesce(truth = cwe, false) FROM b),
        c AS (SELECT kind, count(*) FILTER (hit) AS tp, count(*) FILTER (cwe IS NOT NULL AND NOT hit) AS fp, count(*) FILTER (truth IS NOT NULL AND NOT hit) AS fn FROM e GROUP BY 1) SELECT *, round({_share('5 * tp', '5 * tp + 4 * fn + fp')}, 6) AS f_beta FROM c""",
    "keyword_asymmetry": """WITH k AS (SELECT unnest(['the', 'und', 'que', '$$$', 'token']) AS word), r AS (SELECT word, avg(contains(coalesce(text, ''), word)::INT) FILTER (doc_id % 2 = 0) AS v, avg(contains(coalesce(text, ''), word)::INT) FILTER (doc_id % 2 = 1) AS s FROM k, documents GROUP BY 1)
        SELECT word, round(v, 6) AS vuln, round(s, 6) AS safe, word = (SELECT word FROM r ORDER BY abs(round(v - s, 9)) DESC, word DESC LIMIT 1) AS largest FROM r""",
    "distinct_sets": "SELECT c_nationkey, count(DISTINCT o_custkey) AS customers, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "critic_metrics": f"""{J}, a AS (SELECT source, pair_id, g, CASE WHEN n_chars % 13 = 0 THEN 'UNPARSED' WHEN score < CAST(0.5 AS DOUBLE) THEN 'YES' ELSE 'NO' END AS c FROM j),
        s AS (SELECT source, count(*) AS n, count(*) FILTER (c <> 'UNPARSED') AS scored, count(*) FILTER (c = 'UNPARSED') AS unparsed, count(*) FILTER (c = 'YES') AS yes, count(*) FILTER (c = 'YES' AND NOT g OR c = 'NO' AND g) AS ok, count(*) FILTER (c <> 'UNPARSED' AND g) AS v FROM a GROUP BY 1),
        q AS (SELECT source, pair_id, max(c) FILTER (g) AS v, max(c) FILTER (NOT g) AS s FROM a WHERE c <> 'UNPARSED' GROUP BY 1, 2), p AS (SELECT source, count(*) AS pairs, count(*) FILTER (v <> s) AS d, count(*) FILTER (v = 'NO' AND s = 'YES') AS b FROM q WHERE v IS NOT NULL AND s IS NOT NULL GROUP BY 1),
        r AS (SELECT source, n, scored, unparsed, yes, coalesce(pairs, 0) AS pairs, {_share('ok', 'scored')} AS accuracy, {_share('s.v', 'scored')} AS always_no, {_share('d', 'pairs')} AS disagreement, {_share('b', 'pairs')} AS pair_correct, {_share('yes', 'scored')} AS yes_rate, {_share('unparsed', 'n')} AS unparsed_rate FROM s LEFT JOIN p USING (source))
        SELECT source, n, scored, unparsed, yes, pairs, round(accuracy, 6) AS accuracy, round(always_no, 6) AS always_no, round(disagreement, 6) AS disagreement, round(pair_correct, 6) AS pair_correct, round(yes_rate, 6) AS yes_rate, round(unparsed_rate, 6) AS unparsed_rate, round(accuracy - always_no, 6) AS margin,
        CASE WHEN pairs < 10 THEN 'UNMEASURED' WHEN disagreement > yes_rate THEN 'PASS' ELSE 'FAIL' END AS t3, round(accuracy - always_no, 4) >= CAST(0.15 AS DOUBLE) AND yes >= 5 AND round(unparsed_rate, 4) < CAST(0.20 AS DOUBLE) AS promising FROM r""",
    "precision_gate": f"""{J}, c AS (SELECT source, count(*) AS a, count(*) FILTER (n_chars % 9 > 0 AND p) AS n, count(*) FILTER (n_chars % 9 > 0 AND p AND g) AS tp, count(*) FILTER (n_chars % 9 = 0) AS unk FROM j GROUP BY 1), k AS (SELECT source, n, {_share('tp', 'n')} AS q, {_share('unk', 'a')} AS unk FROM c),
        h AS (SELECT source, n, round(q, 6) AS prec, round(q - 1.96 * sqrt(q * (1 - q) / nullif(n, 0)), 6) AS lo, round(q + 1.96 * sqrt(q * (1 - q) / nullif(n, 0)), 6) AS hi, round(unk, 6) AS unknown_rate FROM k)
        SELECT *, CASE WHEN lo > 0.55 THEN 'GO' WHEN hi < 0.55 THEN 'KILL' WHEN prec > 0.55 THEN 'WEAK' ELSE 'INCONCLUSIVE' END AS verdict,
        CASE WHEN n < 20 THEN 'INCONCLUSIVE' WHEN prec >= 0.60 AND lo >= 0.80 THEN 'TRUST_ENGINE' WHEN prec >= 0.60 THEN 'ENGINE_AS_SIGNAL' WHEN prec < 0.60 OR unknown_rate >= 0.916 THEN 'NO_BETTER' ELSE 'INCONCLUSIVE' END AS use FROM h""",
    "arm_metrics": f"""WITH r AS (SELECT o_totalprice % 10 < 3 AS t, o_custkey % 2 = 0 AS c, o_totalprice % 10 < 5 AS s1, o_custkey % 3 = 0 AS s2 FROM orders), e AS (SELECT 'S1' AS arm, t, c, s1 AS f FROM r UNION ALL SELECT 'S2', t, c, s2 FROM r UNION ALL SELECT 'C1', t, c, s1 OR s2 FROM r UNION ALL SELECT 'C2', t, c, s1 AND s2 FROM r)
        SELECT arm, round(avg(f::INT), 6) AS flag_rate, round({_share('count(*) FILTER (f AND t AND c)', 'count(*) FILTER (t AND c)')}, 6) AS recall_cross, round({_share('count(*) FILTER (f AND t AND NOT c)', 'count(*) FILTER (t AND NOT c)')}, 6) AS recall_single,
        count(*) FILTER (f AND NOT t) AS fp_files, round({_share('count(*) FILTER (f AND t)', 'count(*) FILTER (f)')}, 6) AS prec FROM e GROUP BY 1""",
    "engine_union": """WITH e AS (SELECT DISTINCT o_custkey, 'e' || k AS engine FROM orders, (VALUES (2), (3), (5), (7)) v(k) WHERE o_orderkey % k = 0), c AS (SELECT o_custkey, count(*) AS k, min(engine) AS engine FROM e GROUP BY 1)
        SELECT CASE WHEN k = 1 THEN engine ELSE 'several' END AS engine, count(*) AS n FROM c GROUP BY 1""",
    "failure_cause": """SELECT CASE WHEN l_quantity < 5 THEN 'not_parsed' WHEN l_discount < CAST(0.02 AS DOUBLE) THEN 'no_source' WHEN l_returnflag = 'A' THEN 'sanitized' WHEN l_tax > CAST(0.06 AS DOUBLE) THEN 'wrong_line' ELSE 'unknown' END AS cause, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""",
    "envelope": f"""WITH a AS ({_auc("score", "source", 9)}), f AS (SELECT source, CAST(t AS DOUBLE) AS recall, greatest(CAST(0 AS DOUBLE), CAST(t AS DOUBLE) - (2 * auc - 1)) AS f FROM a, (VALUES (0.90), (0.75), (0.50), (0.30), (0.20), (0.10)) v(t) WHERE auc IS NOT NULL)
        SELECT source, recall, round(f, 4) AS fpr_min, round(CASE WHEN recall + f > 0 THEN recall / (recall + f) ELSE 1 END, 4) AS precision_max FROM f""",
    "argmax_agreement": f"{J} SELECT lang, round(avg(((score - CAST(0.5 AS DOUBLE) >= 0) = CASE WHEN n_chars % 8 = 0 THEN NOT p ELSE p END)::INT), 6) AS agreement FROM j GROUP BY 1",
    "joint_cells": f"""{J}, k AS (SELECT b AS bin, c AS cue FROM (VALUES ('short'), ('middle'), ('long'), ('huge')) x(b), (VALUES (true), (false)) y(c)), r AS (SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 1000 THEN 'middle' ELSE 'long' END AS bin, n_chars % 3 = 0 AS cue, g = p AS hit FROM j)
        SELECT k.bin, k.cue, count(hit) AS n, round(avg(hit::INT), 6) AS accuracy FROM k LEFT JOIN r ON r.bin = k.bin AND r.cue = k.cue GROUP BY 1, 2""",
    "overlap_report": f"""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1998), c AS (SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS shared, (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b)
        SELECT *, round({_share('100 * shared', 'a')}, 4) AS of_a, round({_share('100 * shared', 'b')}, 4) AS of_b FROM c""",
    "counterbalance": PAIRS.format("score") + """, e AS (SELECT (vuln + CAST(0.1 AS DOUBLE) > safe)::INT AS a, (vuln > safe + CAST(0.1 AS DOUBLE))::INT AS b, (vuln = safe)::INT AS t FROM s)
        SELECT count(*) AS n, round(avg(a), 6) AS first, round(avg(b), 6) AS second, round(avg(t), 6) AS ties, round((avg(a) + avg(b)) / 2, 6) AS mean, round(avg(a) - avg(b), 6) AS gap FROM e""",
    "arm_matrix": f"""{J}, e AS (SELECT lang, g, p, n_chars % 4 = 0 AS h FROM j), x AS (SELECT 'model' AS arm, lang, g, p FROM e UNION ALL SELECT 'graph', lang, g, h FROM e UNION ALL SELECT 'either', lang, g, p OR h FROM e UNION ALL SELECT 'both', lang, g, p AND h FROM e
        UNION ALL SELECT 'all_vuln', lang, g, true FROM e UNION ALL SELECT 'all_safe', lang, g, false FROM e), c AS (SELECT arm, coalesce(lang, 'all') AS lang, {COUNTS.format(g='g', p='p')} FROM x GROUP BY GROUPING SETS ((arm), (arm, x.lang))) SELECT *, {RATE} FROM c""",
    "suppression_count": f"{J} SELECT g AS gold, count(*) FILTER (p) AS positives, count(*) FILTER (p AND n_chars % 3 = 0) AS vetoed FROM j GROUP BY 1",
    "budget_total": "SELECT conv_id, turn, round(sum(round(length(text) * CASE WHEN role = 'assistant' THEN 15 ELSE 3 END / CAST(1000 AS DOUBLE), 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 4) AS spent FROM conversations",
    "alias_hit": """WITH a AS (SELECT * FROM (VALUES ('en', ['the', 'this']), ('de', ['und', 'der']), ('fr', ['que', 'les']), ('es', ['los', 'una'])) v(lang, names))
        SELECT d.lang, count(*) FILTER (len(list_filter(names, lambda x: contains(lower(coalesce(text, '')), x))) > 0) AS hits, count(*) AS n FROM documents d JOIN a ON a.lang = d.lang GROUP BY 1""",
    "convention_sensitivity": f"""WITH {SCORED}, r AS (SELECT lang, {_share("count(*) FILTER (gold = 'vuln' AND score > CAST(0.7 AS DOUBLE))", "count(*) FILTER (gold = 'vuln')")} AS s, {_share("count(*) FILTER (gold = 'vuln' AND score >= CAST(0.45 AS DOUBLE))", "count(*) FILTER (gold = 'vuln')")} AS v FROM scored GROUP BY 1)
        SELECT lang, round(v - s, 6) AS gap, round(v - s, 6) > 0.1 AS sensitive FROM r""",
    "fingerprint_persist": """WITH b AS (SELECT l_suppkey AS project, l_partkey % 25 AS cwe, l_returnflag AS sink FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_linestatus) FILTER (l_linestatus IN ('F', 'O')) = 2), c AS (SELECT project, count(*) AS n FROM b GROUP BY 1)
        SELECT s_suppkey AS project, coalesce(n, 0) AS persisting, n IS NULL AS clean FROM supplier LEFT JOIN c ON project = s_suppkey""",
    "token_difference": f"""WITH w AS (SELECT doc_id, list_distinct({TOKENS}) AS w FROM documents) SELECT a.doc_id // 2 AS pair, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) AS only_a, len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS only_b
        FROM w a JOIN w b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1""",
    "context_subset": """WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), k AS (SELECT DISTINCT source, line FROM l),
        c AS (SELECT doc_id, source, CASE WHEN pos % 2 = 0 THEN line ELSE line || '!' END AS line FROM l) SELECT doc_id, count(*) AS lines, count(k.line) AS known FROM c LEFT JOIN k ON k.source = c.source AND k.line = c.line GROUP BY 1""",
    "provenance": f"""{LINES}, a AS (SELECT l_orderkey, l_linenumber, line FROM r WHERE l_returnflag = 'R'), g AS (SELECT a.l_orderkey, a.l_linenumber, min(abs(a.line - b.line)) AS gap FROM a LEFT JOIN r b ON b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'A' GROUP BY 1, 2)
        SELECT CASE WHEN gap IS NULL THEN 'graph_only' WHEN gap <= 30 THEN 'overlap' ELSE 'ambiguous' END AS kind, count(*) AS n FROM g GROUP BY 1""",
    "ensemble_vote": f"""WITH {SCORED}, r AS (SELECT gold = 'vuln' AS g, score AS a, CASE WHEN n_chars % 6 > 0 THEN (n_chars % 100) / CAST(100 AS DOUBLE) END AS b FROM scored), e AS (SELECT 'or' AS rule, g, a >= CAST(0.6 AS DOUBLE) OR coalesce(b >= CAST(0.6 AS DOUBLE), false) AS p FROM r
        UNION ALL SELECT 'calibrated', g, CASE WHEN b IS NULL THEN a >= CAST(0.6 AS DOUBLE) ELSE round(a * CAST(0.7 AS DOUBLE) + b * CAST(0.3 AS DOUBLE), 9) >= CAST(0.55 AS DOUBLE) END FROM r), c AS (SELECT rule, {COUNTS.format(g='g', p='p')} FROM e GROUP BY 1) SELECT *, {RATE} FROM c""",
}
