import time

from pyspark.sql import functions as F

from graniteloom.streaming import events as S
from graniteloom.streaming import keyed
from tests.comparing import plain


def test_stream_equals_batch_and_goes_on(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.limit(600).repartition(2).write.parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/in"
    seen = lambda: S.drained(S.first_seen(S.event_stream(spark, path), "event_id", late="1000 days"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert seen().count() == 600
    batch.limit(700).write.mode("append").parquet(path)
    assert seen().count() == batch.limit(700).unionByName(batch.limit(600)).select("event_id").distinct().count()


def test_windowed_counts(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    got = S.drained(S.window_counts(S.event_stream(spark, f"{tmp_path}/in"), "event_type", late="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    want = S.window_counts(batch, "event_type")
    # Windows that the watermark has not passed are still open.
    assert set(plain(got.select("start", "event_type", "n").toPandas())) <= set(plain(want.select("start", "event_type", "n").toPandas())) and got.count() > 0


def test_late_rows_and_sessions(spark, tmp_path):
    """A row beyond the watermark is left out of its window; sessions end after their gap."""
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-09 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-20 00:00:00")]
    for i, row in enumerate(rows):
        spark.createDataFrame([(i, row[1], row[0], "t", 1.0)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    counts = S.drained(S.window_counts(S.event_stream(spark, f"{tmp_path}/in"), "event_type", late="1 day"), f"{tmp_path}/w", f"{tmp_path}/cw")
    assert {str(r["start"])[:10]: r["n"] for r in counts.collect()} == {"2024-01-01": 2, "2024-01-03": 1, "2024-01-09": 1}
    found = S.drained(S.sessions(S.event_stream(spark, f"{tmp_path}/in"), "user_id", late="1 day"), f"{tmp_path}/s", f"{tmp_path}/cs")
    assert sorted((r["user_id"], str(r["start"])[:10], r["n"]) for r in found.collect()) == [(1, "2024-01-01", 2), (1, "2024-01-03", 1), (2, "2024-01-09", 1)]


def test_batches_are_merged(spark, tmp_path):
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 3)], [(1, "d", 2), (3, "e", 1)])):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = S.upserted(S.event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ckpt", ["k"], "at")
        assert {r["k"]: r["v"] for r in got.collect()} == [{1: "a", 2: "b"}, {1: "c", 2: "b"}, {1: "c", 2: "b", 3: "e"}][i]


def test_first_texts_of_buckets(spark, tmp_path):
    """Equal and nearly equal texts over batches and a restart; a text may come again when its time is over."""
    keyed.with_rocksdb(spark)
    long = [f"w{i}" for i in range(400)]
    near, far = " ".join([*long[:-1], "x"]), " ".join([*long[:300], *"abcdefgh"])
    batches = [
        [(1, "b", "g1", " ".join(long), "2024-01-01 00:00:00"), (2, "b", "g1", "OTHER  text", "2024-01-01 00:00:01")],
        [(3, "b", "g2", near, "2024-01-02 00:00:00"), (4, "b", "g1", near, "2024-01-02 00:00:00"), (5, "c", "g2", near, "2024-01-02 00:00:00"), (6, "b", "g2", far, "2024-01-02 00:00:00"), (7, "b", "g3", "other text ", "2024-01-02 00:00:00"), (8, None, None, None, "2024-01-02 00:00:00")],
        [(9, None, None, "", "2024-01-03 00:00:00"), (10, "z", "g", "q", "2024-03-01 00:00:00")],
        [(11, "z", "g", "r", "2024-03-02 00:00:00")],
        [(12, "b", "g9", "other text", "2024-03-03 00:00:00"), (13, "b", "g9", "Other text", "2024-03-03 00:00:01"), (14, "b", "g2", near, "2024-03-03 00:00:00")],
    ]
    got = {}
    for rows in batches:
        spark.createDataFrame(rows, "id long, bucket string, grp string, text string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed.first_texts(S.event_stream(spark, f"{tmp_path}/in"), "id", "text", ["bucket"], "grp", live="10 days", late="1 hour")
        got = {r["id"]: r["verdict"] for r in S.drained(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").collect()}
    assert got == {1: "kept", 2: "kept", 3: "near", 4: "kept", 5: "kept", 6: "kept", 7: "same", 8: "kept", 9: "same", 10: "kept", 11: "kept", 12: "kept", 13: "same", 14: "kept"}
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/ckpt")
    assert state.count() == 4, "entries beyond their time are gone"


def test_jaccard_above():
    a = set(range(100))
    assert keyed.jaccard_above(a, set(range(98)), 0.95) and not keyed.jaccard_above(a, set(range(95)), 0.95) and not keyed.jaccard_above(set(), set(), 0.5)
