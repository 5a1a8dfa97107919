import json

import pytest
from pyspark.sql import functions as F

from graniteloom.sources import paging
from graniteloom.streaming.events import drained


def pages(folder, items, a_page, told=None):
    """Page files as a service would give them."""
    folder.mkdir(exist_ok=True)
    for start in range(0, max(len(items), 1), a_page):
        page = {"startIndex": start, "resultsPerPage": a_page, "totalResults": len(items) if told is None else told, "vulnerabilities": items[start : start + a_page]}
        (folder / f"start_index={start}").write_text(json.dumps(page))


@pytest.fixture
def feed(spark):
    spark.dataSource.register(paging.PagedFeed)
    return lambda base, **options: spark.read.format("paged_feed").options(base=f"file://{base}", **options).load()


def test_one_partition_a_page(feed, tmp_path):
    items = [{"id": f"v{i}", "text": "é\n"} for i in range(23)]
    pages(tmp_path / "f", items, 5)
    rows = feed(tmp_path / "f")
    assert rows.rdd.getNumPartitions() == 5
    assert [(r["index"], json.loads(r["item"])) for r in rows.orderBy("index").collect()] == list(enumerate(items))
    assert feed(tmp_path / "none").count() == 0
    pages(tmp_path / "empty", [], 5)
    assert feed(tmp_path / "empty").count() == 0
    pages(tmp_path / "short", items[:7], 5, told=12)
    with pytest.raises(Exception, match="items where"):
        feed(tmp_path / "short").collect()


def test_stream_goes_on_where_it_stopped(spark, feed, tmp_path):
    """The offset is a start index: a stop, new pages, and a page that has grown lose nothing and repeat nothing."""
    items = [{"id": i} for i in range(30)]
    base = tmp_path / "f"

    def run(**options):
        stream = spark.readStream.format("paged_feed").options(base=f"file://{base}", **options).load()
        return sorted(r["index"] for r in drained(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").collect())

    feed(base)
    pages(base, items[:13], 5)
    assert run() == list(range(13))
    assert run() == list(range(13))
    pages(base, items[:27], 5)
    assert run() == list(range(27))
    pages(base, items, 5)
    assert run() == list(range(30))


def test_pages_written_by_spark_read_back(spark, feed, tmp_path):
    rows = spark.range(47).select(F.col("id").alias("n"), F.concat(F.lit("t"), "id").alias("t"))
    paging.write_pages(rows, F.struct("n", "t"), ["n"], f"file://{tmp_path}/w", 10)
    got = feed(f"{tmp_path}/w")
    assert got.rdd.getNumPartitions() == 5 and [json.loads(r["item"]) for r in got.orderBy("index").collect()] == [{"n": i, "t": f"t{i}"} for i in range(47)]
