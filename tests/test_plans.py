import re

import pytest

from graniteloom import plans
from graniteloom.operators import diffs
from tests.comparing import same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(name, spark, sf_dir):
    same(plans.queries()[name](spark, sf_dir), plans.oracle_sql()[name], sf_dir)


def test_overlap_windows(spark, sf_dir):
    """A window ends behind its last line feed from its half on; the next begins in its last 150 characters, at the first line
    there if one begins before the last character."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["windows"], r["chars"], r["last"]) for r in plans.queries()["overlap_windows"](spark, sf_dir).collect()}
    want = {}
    for i, t in texts.items():
        start, spans = 0, []
        while start < len(t):
            stop = min(len(t), start + 600)
            feeds = [k + 1 for k in range(start + 300, stop) if t[k] == "\n"] if stop < len(t) else []
            stop = feeds[-1] if feeds else stop
            spans.append((start, stop))
            if stop == len(t):
                break
            feeds = [k + 1 for k in range(stop - 150, stop - 1) if t[k] == "\n"]
            start = feeds[0] if feeds else stop - 150
        if spans:
            want[i] = (len(spans), sum(b - a for a, b in spans), spans[-1][1])
    assert got == want and diffs.windows_of("", 10) == [] and diffs.windows_of("ab\ncd\nef", 7) == [(0, 6), (5, 8)]


def test_line_diff(spark, sf_dir):
    """Lines that differ are those beyond a longest common subsequence, whose length is worked out by its table."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000").collect()}
    got = {r["doc_id"]: r for r in plans.queries()["line_diff"](spark, sf_dir).collect()}
    for i, t in texts.items():
        a = re.split("[.\n,]", t)
        b = [x.upper() if k % 5 == 0 else x for k, x in enumerate(a) if k % 7]
        a, b = "\n".join(a).splitlines(), "\n".join(b).splitlines()
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(rows[-1][j] + 1 if x == y else max(row[-1], rows[-1][j + 1]))
            rows.append(row)
        common = rows[-1][-1]
        assert (got[i]["deleted"], got[i]["added"], got[i]["changed"]) == (len(a) - common, len(b) - common, len(a) + len(b) - 2 * common)


def test_every_query_without_sql_is_known():
    assert set(plans.queries()) - set(plans.oracle_sql()) <= {"overlap_windows", "line_diff"}


def test_var_length_path_takes_flows_from_every_order(spark, tmp_path):
    """A customer whose only order has a key divisible by 3 has its flow like any other."""
    spark.createDataFrame([(50, "A"), (351, "B")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, 50)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in plans.queries()["var_length_path"](spark, str(tmp_path)).collect()}
    assert got == {(50, 50, 0, "A"), (50, 351, 1, "B"), (50, 3, 1, None)}
