"""Results worked out by hand for judging: pairs, intervals, combined rules, envelopes, policies, names and paths."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from graniteloom.functions import draws
from graniteloom.operators import diffs, evaluation, feeds, findings, grading, rules


def test_combined_rules(spark):
    """All twelve cases by the words of the rules."""
    cases = list(itertools.product((True, False), ("vuln", "safe", "unknown"), (True, False)))
    rows = spark.createDataFrame(cases, "answer boolean, graph string, strong boolean")
    got = rows.select("answer", "graph", "strong", *(c.alias(n) for n, c in evaluation.combined(F.col("answer"), F.col("graph"), F.col("strong")).items())).collect()
    for r in got:
        veto, found = r["graph"] == "safe" and r["strong"], r["graph"] == "vuln"
        want = (r["answer"], True if found else False if veto else r["answer"], r["answer"] or found, False if veto else r["answer"], False if veto else r["answer"] or found)
        assert tuple(r)[3:] == want


def test_interval_takes_the_1951st_of_2000(spark):
    values = spark.range(2000).select(F.col("id").cast("double").alias("v"))
    assert tuple(evaluation.interval(values, "v").first()) == (50.0, 1950.0)
    assert tuple(evaluation.interval(values.where("v < 40"), "v").first()) == (1.0, 39.0)


def test_resampling_keeps_units_whole(spark):
    """A weight is the unit's, whatever the number of verdicts; its mean is one."""
    rows = spark.createDataFrame([(i // 2, i % 2 == 0, i % 3 == 0, True) for i in range(400)], "pair long, gold boolean, a boolean, b boolean")
    both = evaluation.bootstrap_counts(rows, "pair", 50, ("a", "b")).collect()
    alone = {r["rep"]: r["a"] for r in evaluation.bootstrap_counts(rows, "pair", 50, ("a",)).collect()}
    assert len(both) == 50 and all(alone[r["rep"]] == r["a"] and sum(r["a"]) == sum(r["b"]) and r["b"]["fn"] == 0 for r in both)
    assert sum(sum(r["a"]) for r in both) / 50 == pytest.approx(400, rel=0.05)


def test_envelope(spark):
    """AUC 0.8 allows 0.6: at recall 0.9 a rate of 0.3 and precision 0.75; at 0.5 none and 1."""
    bound = grading.envelope(F.col("a"), F.col("t"))
    got = spark.createDataFrame([(0.8, 0.9), (0.8, 0.5), (0.5, 0.1), (0.9, 0.0)], "a double, t double").select(F.round(bound["fpr"], 4), F.round(bound["precision"], 4)).collect()
    assert [tuple(r) for r in got] == [(0.3, 0.75), (0.0, 1.0), (0.1, 0.5), (0.0, 1.0)]


POLICY = [
    ("TRUST_ENGINE", False, 0.1, "vuln", None, (True, "engine", "DONE", 0.1, False)),
    ("TRUST_ENGINE", True, 0.1, None, "vuln", (True, "llm", "PARTIAL", 0.1, False)),
    ("TRUST_ENGINE", False, None, "safe", "vuln", (True, "graph", "DONE", None, False)),
    ("TRUST_ENGINE", None, 0.9, "safe", "unknown", (False, "llm", "DONE", 0.9, False)),
    ("ENGINE_AS_SIGNAL", False, 0.4, "vuln", None, (True, "llm+engine", "DONE", 0.65, False)),
    ("ENGINE_AS_SIGNAL", True, 0.4, "safe", None, (False, "llm+engine", "DONE", 0.4, False)),
    ("ENGINE_AS_SIGNAL", True, 0.4, None, "vuln", (True, "graph", "PARTIAL", 0.4, False)),
    ("ENGINE_AS_SIGNAL", True, None, "vuln", None, (True, "llm", "DONE", None, True)),
    ("ENGINE_AS_SIGNAL", False, None, None, None, (False, "llm", "DONE", None, True)),
    ("NO_BETTER", False, 0.9, "vuln", None, (False, "llm", "DONE", 0.9, False)),
    ("INCONCLUSIVE", False, 0.9, None, "vuln", (True, "graph", "DONE", 0.9, False)),
]


def test_policies(spark):
    rows = spark.createDataFrame([(i, *p[:5]) for i, p in enumerate(POLICY)], "i int, name string, detected boolean, score double, engine string, graph string")
    made = findings.policy(F.col("name"), F.col("detected"), F.col("score"), F.col("engine"), F.col("graph"), F.lit(0.25), F.lit(0.6))
    assert [tuple(r["r"]) for r in rows.select("i", made.alias("r")).orderBy("i").collect()] == [p[5] for p in POLICY]
    untuned = findings.policy(F.lit("ENGINE_AS_SIGNAL"), F.lit(True), F.lit(0.9), F.lit("vuln"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(0.6))
    assert tuple(spark.range(1).select(untuned.alias("r")).first()["r"]) == (True, "llm", "DONE", 0.9, True)


def test_languages_and_paths(spark):
    """A dash parts no tokens, so a key of two letters beside it is none; places of a half go to the even one."""
    table = {"py": "python", "python": "python", "java": "java", "c": "c", "javascript": "js"}
    names = ["x-py-y", "x/py(y)", "GitHub Actions", "java spring", "cpython", "JavaScript-ES6", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(feeds.language_of(F.col("n"), table)).collect()
    assert [r[0] for r in got] == [None, "python", None, "java", "python", "js", None]
    steps = spark.range(1).select(diffs.evenly(F.sequence(F.lit(0), F.lit(11))), diffs.evenly(F.sequence(F.lit(0), F.lit(9))), diffs.evenly(F.sequence(F.lit(0), F.lit(5)), 3)).first()
    assert steps[0] == [0, 1, 2, 4, 5, 6, 7, 9, 10, 11] and steps[1] == list(range(10)) and steps[2] == [0, 2, 5]


def test_points_of_cases(spark):
    """A hit by line, by class, by a class accepted for it; further lines; missed, safe and silent cases."""
    cases = [(1, True, 79), (2, True, 79), (3, True, 79), (4, True, 79), (5, False, 79), (6, False, 79), (7, True, 79), (8, True, None)]
    findings = [(1, 10, 5), (1, 11, 5), (1, 11, 6), (2, 50, 79), (3, 50, 80), (4, 50, 5), (4, 51, 5), (5, 1, 79), (5, 1, 80), (5, 2, 1), (1, None, 79), (8, 3, None)]
    frames = (
        spark.createDataFrame(cases, "case long, vulnerable boolean, cls long"), spark.createDataFrame(findings, "case long, line long, cls long"),
        spark.createDataFrame([(1, 10), (4, 10), (9, 1)], "case long, line long"), spark.createDataFrame([(79, 80), (80, 79)], "cls long, ok long"),
    )
    got = {r["case"]: tuple(r)[1:] for r in grading.case_points(*frames).collect()}
    assert got == {1: (1, 1, 0, 0, 4), 2: (1, 0, 0, 0, 5), 3: (1, 0, 0, 0, 5), 4: (0, 2, 0, 1, -2), 5: (0, 2, 0, 0, -2), 6: (0, 0, 1, 0, 2), 7: (0, 0, 0, 1, 0), 8: (1, 0, 0, 0, 5)}


def test_summary_of_groups(spark):
    groups = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "project string, expected int")
    found = spark.createDataFrame([("p", True), ("p", False), ("q", False)], "project string, found boolean")
    alerts = spark.createDataFrame([("p", 1, True), ("p", 1, False), ("p", 9, True), ("q", 2, False), ("r", None, False)], "project string, cwe int, matched boolean")
    row = grading.group_summary(groups, found, alerts, "project", "cwe").first().asDict()
    assert {k: row[k] for k in ("groups", "tp", "fn", "target_fp", "unrelated", "active", "fp")} == {"groups": 3, "tp": 1, "fn": 2, "target_fp": 2, "unrelated": 2, "active": 5, "fp": 4}
    assert [row[k] for k in ("group_recall", "precision", "recall", "target_precision", "f1", "target_f1")] == pytest.approx([1 / 3, 1 / 5, 1 / 3, 1 / 3, 0.25, 1 / 3])


def test_critic_and_gate(spark):
    rows = [("a", i, label, answer) for i in range(12) for label, answer in (("vuln", "NO"), ("safe", "YES" if i < 8 else "NO"))] + [("a", 90, "vuln", "UNPARSED"), ("a", 90, "safe", None), ("b", 1, "vuln", "YES")]
    got = {r["source"]: r.asDict() for r in grading.critic_report(spark.createDataFrame(rows, "source string, pair long, label string, answer string"), "source", "pair", "label", "answer").collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["scored"], a["unparsed"], a["yes"], a["pairs"], a["t3"], a["promising"]) == (26, 24, 2, 8, 12, "PASS", True)
    assert [a[k] for k in ("accuracy", "always_no", "margin", "disagreement", "yes_rate")] == pytest.approx([20 / 24, 0.5, 20 / 24 - 0.5, 8 / 12, 8 / 24])
    assert (b["pairs"], b["t3"], b["promising"], b["accuracy"]) == (0, "UNMEASURED", False, 0.0)
    cases = [(19, 0.9, 0.9, 0.0, "INCONCLUSIVE"), (20, 0.9, 0.8, 0.0, "TRUST_ENGINE"), (20, 0.6, 0.79, 0.99, "ENGINE_AS_SIGNAL"), (20, 0.59, 0.9, 0.0, "NO_BETTER")]
    gates = spark.createDataFrame(cases, "n long, p double, lo double, u double, want string")
    assert gates.where(grading.engine_gate(F.col("n"), F.col("p"), F.col("lo"), F.col("u")) == F.col("want")).count() == 4


STAGES = findings.Patterns(
    primitives=[("hash", ["md5"], ["bcrypt"], ["(?i)password"]), ("secret", ["key='[a-z]{6,}'"], ["getenv"], [])],
    sources={"py": ["input"], "go": ["Param"]},
    sinks={"cmd": {"py": ["system"]}, "sql": {"py": ["execute"], "go": ["Query"]}},
    cleaners={"cmd": ["quote"], "sql": ["[?]"]},
    needs={"sql": ["SELECT"]},
    bound=("sql", ["SELECT"], ["[+]"]),
)


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("py", "md5(Password)", ("vuln", "hash", False)), ("py", "md5(x)", ("unknown", "hash", False)), ("py", "md5 bcrypt password", ("unknown", "?", False)), ("py", "key='abcdef'", ("vuln", "secret", False)), ("py", "key='abcdef' getenv", ("unknown", "?", False)),
        ("py", "SELECT ? system input", ("safe", "sql", True)), ("py", "SELECT ? + system input", ("vuln", "cmd", False)), ("py", "system quote input", ("safe", "cmd", True)), ("py", "system", ("unknown", "cmd", False)), ("py", "execute input", ("unknown", "?", False)),
        ("go", "Query SELECT Param", ("vuln", "sql", False)), ("go", "system Param", ("unknown", "?", False)), ("cobol", "md5 password", ("unknown", "?", False)), (None, "md5 password", ("unknown", "?", False)),
    ],
)
def test_stages_of_a_verdict(spark, language, text, want):
    row = spark.range(1).select(findings.staged_verdict(F.lit(text), F.lit(language).cast("string"), STAGES).alias("v")).first()
    assert tuple(row["v"]) == want


def test_identity_of_generated_rules(spark):
    """The digest of sink|CWE-78|^a\\.b$|arg:1 was worked out apart."""
    exact = r"^a\.b$"
    rows = [
        (1, "sink", "CWE-78", "full", exact, "arg:1", "a.b", False, True, "HIGH", None), (2, "sink", "CWE-78", "name", exact, "arg:1", "a.b", False, True, "high", None), (3, "source", None, "internal_parameter", exact, "return", "a.b", True, True, "high", "own"),
        (4, "sink", "CWE-78", "full", exact, "arg:0", "a.b", False, True, "high", None), (5, "other", "CWE-78", "full", exact, "call", "a.b", False, True, "high", ""), (6, "sink", "CWE-78", "full", "a.b", "receiver", "a.b", False, True, "high", None), (7, "sink", "CWE-78", "full", exact, "call", None, False, True, "high", None),
    ]
    table = spark.createDataFrame(rows, "id long, role string, cwe string, match string, pattern string, endpoint string, full_name string, internal boolean, resolved boolean, confidence string, rule_id string")
    got = {r["id"]: (r["rule_id"], r["enforce"]) for r in rules.identified(table).collect()}
    digest = hashlib.sha256(f"sink|CWE-78|{exact}|arg:1".encode()).hexdigest()[:16]
    assert got[1] == (f"rule.{digest}", True) == (got[2][0], True) and not got[2][1] and got[3] == ("own", True) and 4 not in got
    assert [got[i][1] for i in (5, 6, 7)] == [False] * 3 and got[5][0].startswith("rule.")
    names = ["java.lang.String.<init>:void(int[],char)", "a b-c", "x$y_1", "é"]
    quoted = spark.createDataFrame([(n,) for n in names], "n string").select(rules.exact_pattern(F.col("n"))).collect()
    assert [r[0] for r in quoted] == ["^" + re.escape(n) + "$" for n in names]


def test_lines_of_words(spark):
    lines = ["@@ -1,2 +5,3 @@", " ctx", "+uses Pickle.Loads(x)", "-pickle.loads(y)", "+none", "@@ -9,1 +20,2 @@", "+READOBJECT", "+x"]
    changed = diffs.numbered(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "key string, pos int, line string"), ["key"], "pos", "line")
    got = diffs.keyword_lines(changed, ["key"], {"deser": ["pickle.loads", "readobject"], "xxe": ["sax"], "none": []}).collect()
    assert [tuple(r) for r in got] == [("d", "deser", [6, 20], False), ("d", "xxe", [5], True), ("d", "none", [5], True)]


REVIEWS = [
    (("FALSE", "HIGH", 15, 10, None, "dead code", True), ("FALSE", None, True)),
    (("FALSE", "high", 17, 10, None, "dead code", True), ("UNCERTAIN", "FALSE", False)),
    (("FALSE", "high", 34, 10, 40, "dead code", True), ("FALSE", None, True)),
    (("FALSE", "high", 15, 10, None, " ", True), ("UNCERTAIN", "FALSE", False)),
    (("FALSE", "low", 15, 10, None, "dead code", True), ("UNCERTAIN", "FALSE", False)),
    (("FALSE", "high", None, 10, None, "dead code", True), ("UNCERTAIN", "FALSE", False)),
    (("FALSE", "high", 0, 3, None, "before the first line", True), ("UNCERTAIN", "FALSE", False)),
    (("FALSE", "high", 15, 10, None, "dead code", False), ("UNJUDGED", None, False)),
    (("TRUE", "low", None, 10, None, None, True), ("TRUE", None, False)),
    ((None, None, None, 10, None, None, True), ("UNJUDGED", None, False)),
]


def test_reviews(spark):
    rows = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(REVIEWS)], "i int, v string, c string, basis int, line int, source_line int, reason string, ok boolean")
    made = findings.reviewed(F.col("v"), F.col("c"), F.col("basis"), [F.col("line"), F.col("source_line")], F.col("reason"), F.col("ok"))
    assert [tuple(r["m"]) for r in rows.select("i", made.alias("m")).orderBy("i").collect()] == [w for _, w in REVIEWS]


def test_calls_of_own_packages(spark):
    """A package's own name is not inside of it; one name that is not resolved keeps its call."""
    calls = [(1, "a.b.C"), (1, "a.b.c.D"), (2, "a.b.C"), (2, "<unresolved>"), (3, "a.b"), (4, "a.bc.D"), (5, "a.b.C"), (5, "x.Y"), (6, ""), (7, None), (8, "D"), (9, "x.z.W")]
    packages = spark.createDataFrame([("a.b",), ("x.z",)], "package string")
    kept = rules.without_local(spark.createDataFrame(calls, "call int, name string"), "call", "name", packages, "package")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([c for c in calls if c[0] not in (1, 9)], key=str)


def test_draws_are_the_hash_of_the_unit(spark):
    """Multiplicities by the hash as it is defined, one by one, for units of all lengths and none."""
    units = ["7", "12345", None, "ü" * 20, "x" * 52, "y" * 200, ""]
    cdf = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    seen = 0
    for reps, w in draws.multiplicities(units, 120):
        for rep, row in zip(reps, w, strict=True):
            seen += 1
            for unit, m in zip(units, row, strict=True):
                u = int(hashlib.md5((f"42:{rep}" + ("" if unit is None else f":{unit}")).encode()).hexdigest()[:8], 16) / 2**32
                assert m == sum(u >= c for c in cdf)
    assert seen == 120


def test_resampled_auc_with_ties_over_tasks(spark):
    """Equal scores in several tasks and batches count a half; the unit's draw is shared by both scores."""
    data = [(i // 2, i % 3 == 0, float(i * 7 % 4), float(-(i % 90))) for i in range(600)]
    rows = spark.createDataFrame(data, "pair long, gold boolean, a double, b double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r["rep"], r["side"]): r["auc"] for r in evaluation.bootstrap_aucs(rows, "pair", "gold", ("a", "b"), 12).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    weights = {int(r): w for reps, some in draws.multiplicities([str(i) for i in range(300)], 12) for r, w in zip(reps, some, strict=True)}
    for (rep, side), auc in got.items():
        w, at = weights[rep].tolist(), 2 if side == "a" else 3
        pos, neg = ([(d[at], w[d[0]]) for d in data if d[1] is g] for g in (True, False))
        won = sum(wp * wn * ((x > y) + (x == y) / 2) for x, wp in pos for y, wn in neg)
        assert auc == won / (sum(p[1] for p in pos) * sum(n[1] for n in neg))
    assert len(got) == 24
