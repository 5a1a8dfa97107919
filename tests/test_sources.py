from pyspark.sql import types as T

from graniteloom.operators import rules
from graniteloom.operators.retrieval import flat_index, with_payload
from graniteloom.sources import readers, writers


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "meta": {"label": "vuln"}}\nnot json\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl")).collect()
    assert [r["prompt"] for r in got] == ["p", None] and got[1]["_corrupt_record"] == "not json"
    assert readers.json_lines(spark, str(tmp_path / "none"), optional=True).count() == 0


def test_feed_as_list_or_envelope(spark, tmp_path):
    item = T.StructType([T.StructField("id", T.StringType())])
    for name, text in (("a", '[{"id": "x"}]'), ("b", '{"vulnerabilities": [{"id": "x"}]}'), ("c", '{"data": [{"id": "x"}]}')):
        (tmp_path / name).write_text(text)
        assert [r["id"] for r in readers.feed(spark, str(tmp_path / name), item).collect()] == ["x"]


def test_rule_tables(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("sink\txss\tCWE-79\tname\tprintln\t\targ:1\tr1\nsource\t-\t-\tname\tgetParameter\n")
    a, b = readers.rule_table(spark, str(tmp_path / "r.tsv")).collect()
    assert (a["arg_pattern"], a["endpoint"], a["rule_id"], b["endpoint"], b["rule_id"]) == (None, "arg:1", "r1", "return", None)
    (tmp_path / "p.tsv").write_text("f.*\t1,return;2,0\n")
    assert [tuple(m) for m in readers.propagation_table(spark, str(tmp_path / "p.tsv")).first()["moves"]] == [(1, -1), (2, 0)]
    (tmp_path / "r5.tsv").write_text("sink\txss\tCWE-79\tname\n\nsink\txss\tCWE-79\tname\tok\n")
    assert [r["pattern"] for r in readers.rule_table(spark, str(tmp_path / "r5.tsv")).collect()] == ["ok"]
    (tmp_path / "p2.tsv").write_text("f\t1,return;x,2;3;4,5,6\ng\tbad\nh\n")
    assert [(r["pattern"], [tuple(m) for m in r["moves"]]) for r in readers.propagation_table(spark, str(tmp_path / "p2.tsv")).collect()] == [("f", [(1, -1)])]
    # Patterns are judged by the engine that runs them: Python's named groups are none of its, letters by class are.
    (tmp_path / "s.tsv").write_text("sql\txss, sqli\tprepare(d|Statement)\nweb\t*\t \\p{L}+ \nweb\t*\t(?P<n>a)b\nweb\t*\t(?<n>a)b\nweb\t,\ta\nweb\t*\t \nold\t*\ntab\tx\ta\tb\n")
    got = [tuple(r) for r in readers.sanitizer_table(spark, str(tmp_path / "s.tsv")).collect()]
    assert got == [("sql", ["xss", "sqli"], "prepare(d|Statement)"), ("web", ["*"], "\\p{L}+"), ("web", ["*"], "(?<n>a)b"), ("tab", ["x"], "a\tb")]
    codes = spark.createDataFrame([(1, "PreparedStatement prepareStatement", "sqli"), (2, "nothing", "xss"), (3, "prepared", "rce")], "id long, code string, category string")
    hits = rules.sanitizing(codes, readers.sanitizer_table(spark, str(tmp_path / "s.tsv")).drop("category"), "code", "category")
    assert sorted((r["id"], r["pattern"]) for r in hits.collect()) == [(1, "\\p{L}+"), (1, "prepare(d|Statement)"), (2, "\\p{L}+"), (3, "\\p{L}+")]


def test_source_tree_and_upsert(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/vendor/b.py").write_text("y = 1")
    assert [r["content"] for r in readers.source_tree(spark, str(tmp_path / "src"), "*.py").collect()] == ["x = 1"]
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, writers.insert_if_absent(known, new, ["k"]).collect())) == [("a", 1), ("b", 2)]


def test_csv_cells_of_several_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("code", T.StringType())])
    (tmp_path / "a.csv").write_text('id,code\n1,"if (a) {\n  say(""x"");\n}"\n2,plain\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "a.csv"), schema).collect()] == [(1, 'if (a) {\n  say("x");\n}'), (2, "plain")]
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, code string")
    writers.csv_report(rows, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in readers.csv_table(spark, str(tmp_path / "out"), schema).collect()) == [(1, 'a "b", c'), (2, None)]


def test_reports_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1), ("val", 2)], "split string, n int")
    writers.json_splits(rows, str(tmp_path / "s"))
    assert sorted((r["split"], r["n"]) for r in spark.read.json(str(tmp_path / "s")).collect()) == [("train", 1), ("val", 2)]
    writers.json_report(spark.createDataFrame([(0.5, None)], "f1 double, auc double"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"f1":0.5,"auc":null}'


def test_rule_files_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("sink", "xss", "a", None), ("source", None, "b", "arg:1")], "role string, cwe string, pattern string, endpoint string")
    assert [r["value"] for r in writers.rule_lines(rules, ["role", "cwe", "pattern"], ["endpoint"]).collect()] == ["sink\txss\ta", "source\t\tb\targ:1"]
    sanitizers = spark.createDataFrame([("web", "esc.*", ["xss", "sqli"]), ("web", "(", ["*"]), ("sql", "q", [])], "category string, pattern string, applies_to array<string>")
    writers.sanitizer_lines(sanitizers).write.text(str(tmp_path / "z"))
    assert sorted(tuple(r) for r in readers.sanitizer_table(spark, str(tmp_path / "z")).collect()) == [("sql", ["*"], "q"), ("web", ["xss", "sqli"], "esc.*")]
    moves = spark.createDataFrame([("f", [(1, -1), (2, 0)])], "pattern string, moves array<struct<from:int,to:int>>")
    assert writers.propagation_lines(moves).first()["value"] == "f\t1,return;2,0"


def test_vector_points_are_verified(spark, tmp_path):
    vectors = spark.createDataFrame([("b", [0.0, 2.0]), ("a", [3.0, 0.0])], "name string, vector array<double>")
    points = writers.vector_points(vectors, ["name"], str(tmp_path / "v"))
    assert {r["name"]: r["id"] for r in points.collect()} == {"a": 0, "b": 1}
    assert writers.verified(points, 2, points).first()["holds"] and not writers.verified(points, 3, points).first()["holds"]
    index = flat_index(points)
    assert sorted(tuple(r["vector"]) for r in index.collect()) == [(0.0, 1.0), (1.0, 0.0)]
    moved = with_payload(index, spark.createDataFrame([(0, "x")], "id long, tag string"))
    assert {r["id"]: r["tag"] for r in moved.collect()} == {0: "x", 1: None}


def test_a_log_goes_on(spark, tmp_path):
    rows = spark.range(10)
    assert writers.append_new(rows.where("id < 6"), str(tmp_path / "log"), ["id"]) == 6
    assert writers.append_new(rows, str(tmp_path / "log"), ["id"]) == 4
    assert writers.append_new(rows, str(tmp_path / "log"), ["id"]) == 0 and spark.read.parquet(str(tmp_path / "log")).count() == 10


def test_program_graph_and_lists(spark, tmp_path):
    spark.createDataFrame([(1, 2, "flow")], "a long, b long, kind string").write.parquet(str(tmp_path / "g/edges"))
    tables = readers.program_graph(spark, str(tmp_path / "g"))
    assert tables["edges"].count() == 1 and tables["calls"].count() == 0 and "code" in tables["calls"].columns
    files = spark.createDataFrame([("a.yml", "- name: one\n  line: 3\n  file: x\n- name: two\n  line: 4")], "path string, content string")
    assert [tuple(r)[1:] for r in readers.scanned_lines(files).orderBy("name", "key").collect()] == [("one", "file", "x"), ("one", "line", "3"), ("two", "line", "4")]
    cache = spark.createDataFrame([("java:f", "sink"), ("f", "source"), ("g", "none")], "key string, value string")
    wanted = spark.createDataFrame([("java", "f"), ("py", "f"), ("py", "h")], "frontend string, k string")
    assert {(r["frontend"], r["k"]): r["role"] for r in readers.cached(cache, wanted, "frontend", "k", "role").collect()} == {("java", "f"): "sink", ("py", "f"): "source", ("py", "h"): None}
    (tmp_path / "t").mkdir()
    for name in ("a.py", "b.min.js", "c.js"):
        (tmp_path / "t" / name).write_text("x")
    assert readers.source_tree(spark, str(tmp_path / "t"), suffixes=(".py", ".js"), without=(".min.js",)).count() == 2
