import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from graniteloom import functions as N
from graniteloom.functions import linediff, shingles, tables
from graniteloom.operators import diffs


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_answers_are_read(spark):
    text = "<think>label: safe</think>**Label:** vulnerable\n CWE: see cwe-79 (x)\nSeverity: high"
    assert tuple(one(spark, text, N.answer(F.col("t")))[0]) == ("vuln", "CWE-79", "HIGH")
    assert one(spark, "no idea", N.answer(F.col("t")))[0]["label"] == "parse_fail"
    assert one(spark, "x\n```py\na = 1\n```\ny", N.fenced(F.col("t")))[0] == "a = 1\n"
    items = one(spark, 'so: [{"line": 3, "cwe": "CWE-1"}] done', N.json_items(F.col("t"), "struct<line:int,cwe:string>"))[0]
    assert [tuple(i) for i in items] == [(3, "CWE-1")] and one(spark, "none", N.json_items(F.col("t"), "struct<line:int>"))[0] is None


def test_dates_and_numbers(spark):
    assert one(spark, "published 2021-03-04T00:00", N.year(F.col("t")))[0] == 2021
    assert str(one(spark, "2021-03-04T00:00", N.day(F.col("t")))[0]) == "2021-03-04" and one(spark, "n/a", N.day(F.col("t")))[0] is None
    row = spark.range(1).select(N.log_gap(F.lit(-1.0), F.lit(None).cast("double")), N.extended(F.lit(3.0), 0, 1, 1, 3), N.set_similarity(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).first()
    assert tuple(row) == (29.0, 7.0, 1 / 3)


def test_differences_of_lines(spark):
    rows = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), ("same", "same"), (None, "n")], "a string, b string")
    got = rows.select(N.changed_lines("a", "b").alias("lines"), F.round(N.sequence_ratio("a", "b"), 4).alias("ratio")).collect()
    assert [r["lines"] for r in got] == [[2, 4], [], [1]] and [r["ratio"] for r in got] == [0.6667, 1.0, 0.0]
    assert one(spark, "a\n\n b\nc\nd", N.line_shingles(F.col("t")))[0] == ["a\nb\nc", "b\nc\nd"]


def lcs_table(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(row[-1], rows[-1][j + 1]))
        rows.append(row)
    return rows[-1][-1]


def test_matches_are_longest(monkeypatch):
    """Both ways, against the whole table: few and many equal lines, empty sides, equal sides."""
    r = random.Random(7)
    for pairs in (linediff.PAIRS, 0):
        monkeypatch.setattr(linediff, "PAIRS", pairs)
        for _ in range(300):
            letters = "abcdefghijkl"[: r.choice([1, 2, 4, 12])]
            a, b = ([r.choice(letters) for _ in range(r.randrange(24))] for _ in range(2))
            got = linediff.matched(a, b)
            assert len(got) == lcs_table(a, b) == linediff.lcs_length(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
            steps, built = linediff.steps_between(a, b), []
            for tag, i1, i2, j1, j2 in steps:
                assert (tag == "equal") == (a[i1:i2] == b[j1:j2]) and (i1 < i2, j1 < j2) == {"equal": (True, True), "replace": (True, True), "delete": (True, False), "insert": (False, True)}[tag]
                built += a[i1:i2] if tag == "equal" else b[j1:j2]
            assert built == b and [s[1] for s in steps] == [0, *(s[2] for s in steps)][:-1] if steps else a == b == []


def test_long_texts_are_quick():
    a = [f"line {i}" for i in range(100_000)]
    b = [x + "!" if i % 50 == 0 else x for i, x in enumerate(a) if i % 97]
    began = time.time()
    assert len(linediff.matched(a, b)) == sum(i % 97 > 0 and i % 50 > 0 for i in range(100_000)) and time.time() - began < 5
    a, b = ["x", "y", "z"] * 3000, ["y", "x", "w"] * 3000
    began = time.time()
    assert len(linediff.matched(a, b)) == linediff.lcs_length(a, b) and time.time() - began < 20


def test_steps_as_columns(spark):
    rows = spark.createDataFrame([("a\nb\nc\nd", "a\nx\nc\nd\ne"), (None, "n"), ("same", "same")], "a string, b string")
    lines = {s: F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(s, "\n")) for s in ("a", "b")}
    got = rows.withColumn("s", N.line_steps("a", "b")).select(N.diff_counts(F.col("s")).alias("c"), N.changed_places(F.col("s"), "a").alias("p"), N.hunk_text(lines["a"], lines["b"], F.col("s")).alias("h")).collect()
    assert [tuple(r["c"]) for r in got] == [(2, 1, 3, 1), (1, 0, 1, 0), (0, 0, 0, None)]
    assert [r["p"] for r in got] == [[2], [], []] and [r["h"] for r in got] == ["- b\n+ x\n+ e", "+ n", "(none)"]


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -3,4 +3,4 @@
 keep
-old
+new
 tail
-gone
+more
\\ No newline at end of file
diff --git a/y.py b/z.py
--- a/y.py
+++ b/z.py
@@ -10 +10,2 @@ def f():
-one
+two
+three
@@ -20,0 +22 @@
+late
diff --git broken
@@ -1 +1 @@
-lost
"""


def test_diffs_of_several_files(spark):
    """The table function and the window form agree; files, ends and marks are no lines."""
    rows = spark.createDataFrame([(k, i, x) for k in ("d", "e") for i, x in enumerate((DIFF if k == "d" else "no diff\n-x").split("\n")[:-1])], "key string, pos int, line string")
    want = [("x.py", 1, " ", 3, 3, "keep"), ("x.py", 1, "-", 4, None, "old"), ("x.py", 1, "+", None, 4, "new"), ("x.py", 1, " ", 5, 5, "tail"), ("x.py", 1, "-", 6, None, "gone"), ("x.py", 1, "+", None, 6, "more")]
    want += [("y.py", 2, "-", 10, None, "one"), ("y.py", 2, "+", None, 10, "two"), ("y.py", 2, "+", None, 11, "three"), ("y.py", 3, "+", None, 22, "late")]
    columns = ("file", "hunk", "side", "old_no", "new_no", "body")
    tables.register(spark)
    rows.createOrReplaceTempView("diff_lines")
    by_sql = spark.sql("SELECT * FROM parse_diff(TABLE(diff_lines) PARTITION BY key ORDER BY pos)")
    assert [tuple(r[c] for c in columns) for r in by_sql.orderBy("hunk", F.expr("coalesce(new_no, old_no)"), F.expr("side = '+'")).collect()] == want
    assert {(r["hunk_start"], r["hunk_stop"]) for r in by_sql.collect()} == {(3, 6), (10, 10), (20, 20)} and {r["post_path"] for r in by_sql.collect()} == {"x.py", "z.py"}
    windows = diffs.numbered(rows, ["key"], "pos", "line")
    assert [tuple(r[c] for c in columns) for r in windows.orderBy("hunk", F.expr("coalesce(new_no, old_no)"), F.expr("side = '+'")).collect()] == want
    texts = spark.createDataFrame([("k", "ab\ncd\nef", 7), ("l", "", 8), ("m", "x" * 20, 8)], "key string, text string, most int")
    found = tables.LineWindows(texts.asTable().partitionBy("key")).orderBy("key", "window").collect()
    assert [tuple(r)[1:] for r in found if r["key"] == "k"] == [(0, 0, 6, 0), (1, 5, 8, 1)] and [tuple(r)[2:4] for r in found if r["key"] == "m"] == [(0, 8), (6, 14), (12, 20)]


def test_line_counts_are_those_of_the_steps(spark):
    from graniteloom import functions as N

    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "a", "a"), (3, None, "p\nq"), (4, "", None), (5, "a\nb", "")], "id int, a string, b string")
    found = rows.select(N.line_counts("a", "b").alias("one"), N.diff_counts(N.line_steps("a", "b")).alias("two"))
    assert all(r["one"] == r["two"] for r in found.collect()) and found.schema["one"].dataType.simpleString() == found.schema["two"].dataType.simpleString()


def test_texts_are_single_spaced():
    """As by regular expression, for many texts at once; a text without tokens is one space."""
    r = random.Random(4)
    for _ in range(200):
        texts = ["".join(r.choice(" \t\n\rab\u00e9\x0b") for _ in range(r.randrange(9))) + " " for _ in range(r.randrange(1, 7))]
        raw = [t.encode() for t in texts]
        out, ends = shingles.single_spaced(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(x) for x in raw]))
        assert [bytes(out[a:b]).decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [re.sub(r"[ \t\r\n]+", " ", t).strip(" ") + " " for t in texts]
