"""Plans of scans and joins that must hold at any size."""

from pathlib import Path

import pytest

from veldra.operators import feeds
from veldra.plans import feeds as feed_queries
from veldra.runtime import broadcast_checked, materialize, read_table, shared_dir

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_used(spark):
    text = plan(feed_queries.regex_filter(spark, DATA))
    assert "ReadSchema: struct<rec_id:bigint,amenity:string>" in text


def test_filters_reach_the_scan(spark):
    df = read_table(spark, DATA, "osm_places").filter("city is not null and amenity = 'fast_food'").select("rec_id")
    pushed = plan(df).split("PushedFilters: ")[1]
    assert all(f in pushed for f in ("IsNotNull(city)", "EqualTo(amenity,fast_food)"))


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = feeds.dedupe(read_table(spark, DATA, "news_items").select("title", "url", "fetched_at", "item_id"), ["title", "url"], ["fetched_at", "item_id"])
    assert plan(df).count("WindowGroupLimit") == 2


def test_broadcast_needs_a_checked_size(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        assert "BroadcastHashJoin" in plan(big.join(broadcast_checked(df, 100), "k"))
        assert "BroadcastHashJoin" not in plan(big.join(broadcast_checked(df, 99), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_materialized_rows_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(10).withColumnRenamed("id", "k"), "x")
    assert all(f.startswith(shared_dir(spark)) for f in df.inputFiles()) and df.count() == 10


def test_only_probed_lists_are_read(spark, tmp_path):
    """A search in a stored inverted file filters the scan by list, and trains nothing."""
    from veldra.operators import indexes

    rows = read_table(spark, DATA, "embeddings").selectExpr("vec_id AS id", "embedding")
    index = indexes.build("ivf", rows, str(tmp_path / "i"), 64, lists=32, probes=1)
    text = plan(index.search(rows.filter("id = 5").withColumnRenamed("id", "query_id"), 1))
    assert "PushedFilters: [" in text and any("cid" in part.split("]")[0] for part in text.split("PushedFilters: [")[1:])


@pytest.mark.parametrize("strategy", ["recursive", "fixed", "semantic"])
def test_chunks_need_no_shuffle(spark, strategy):
    from veldra.operators import chunking

    text = plan(chunking.chunk(read_table(spark, DATA, "documents"), strategy))
    assert "Exchange" not in text and text.count("MapInArrow") <= 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
