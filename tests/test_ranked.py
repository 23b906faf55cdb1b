"""Orders over whole tables do not depend on which exchanges a plan happens to share."""

import pytest
from pyspark.sql import functions as F

from quireworks.operators import catalog, upkeep
from quireworks.streaming import flows


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_ranks_are_places(spark, reuse):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_totalprice")
    got = catalog.ranked(orders.repartition(16), F.desc("o_totalprice"), F.asc("o_orderkey"))
    wanted = [r.o_orderkey for r in sorted(orders.collect(), key=lambda r: (-r.o_totalprice, r.o_orderkey))]
    assert [r.o_orderkey for r in got.orderBy("rank").collect()] == wanted
    assert got.select("rank").distinct().count() == len(wanted) and got.where("rank <= 1000").count() == 1000
    assert catalog.ranked(orders.limit(0), F.asc("o_orderkey")).count() == 0


def test_new_rows_get_ids_of_their_own(spark, reuse):
    library = spark.createDataFrame([(7, "u0", "t", "PDF", 1, 5, 5, False)], "id long, uri string, title string, format string, size_bytes long, last_opened_at long, created_at long, is_starred boolean")
    updates = spark.range(5000).select(F.col("id").alias("update_no"), F.format_string("n%05d", (F.col("id") * 7919) % 5000).alias("uri"), F.lit("t").alias("title"), F.lit("PDF").alias("format"), F.lit(2).cast("long").alias("size_bytes"), F.lit(9).cast("long").alias("opened_at"))
    got = upkeep.upsert_by_uri(library, updates.repartition(16)).orderBy("uri").collect()
    assert [(r.id, r.uri) for r in got] == [(8 + i, f"n{i:05d}") for i in range(5000)] + [(7, "u0")]


def test_gate_over_ranges(spark, reuse):
    rows = [(i * 10, i, ("enabled", "reading", "battery")[i % 3], (i * i) % 5 < 3) for i in range(2000)]
    got = flows.combine_latest_gate(spark.createDataFrame(rows, "ts long, event_id long, signal string, on boolean").repartition(16)).orderBy("ts").collect()
    now, wanted, before = {}, [], None
    for ts, _, signal, on in rows:
        now[signal] = on
        is_open = now.get("enabled", False) and not now.get("reading", False) and not now.get("battery", False)
        if is_open != before:
            wanted.append((ts, is_open))
        before = is_open
    assert [(r.ts, r.open) for r in got] == wanted
