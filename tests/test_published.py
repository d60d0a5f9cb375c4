"""Published tables: readers see whole states, a load that breaks changes nothing; segments are ranked once a day and state."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import catalog as C
from ledgerlens.plans import reports as R
from ledgerlens.plans import segments as SG
from ledgerlens.sources import published as P
from ledgerlens.sources import sinks
from ledgerlens.sources.star import load_star
from tests.conftest import SF_SMALL


def _numbers(spark, n, broken=False):
    df = spark.range(n).repartition(4)
    return df.withColumn("x", F.when(F.col("id") == n - 1, F.raise_error(F.lit("broken row"))).otherwise(F.col("id"))) if broken else df.withColumn("x", F.col("id"))


def _folders(tmp_dir, table):
    return sorted(os.listdir(os.path.join(tmp_dir, table)))


def test_a_write_that_breaks_leaves_the_table(spark, tmp_dir):
    sinks.sink_full_replace(_numbers(spark, 10), "p_broken", tmp_dir)
    reader = P.read_published(spark, "p_broken")
    with pytest.raises(Exception, match="broken row"):
        sinks.sink_full_replace(_numbers(spark, 1000, broken=True), "p_broken", tmp_dir)
    assert spark.table("p_broken").count() == 10
    sinks.sink_full_replace(_numbers(spark, 3), "p_broken", tmp_dir)
    assert spark.table("p_broken").count() == 3 and reader.count() == 10      # who reads goes on with what it had
    spark.sql("DROP VIEW p_broken")


def test_rows_that_did_not_arrive_are_not_staged(spark, tmp_dir):
    with pytest.raises(P.IncompleteWrite):
        P.stage(_numbers(spark, 10), tmp_dir, "p_short", rows=11)
    assert P.stage(_numbers(spark, 10), tmp_dir, "p_short", rows=10)


def test_other_columns_and_partitions(spark, tmp_dir):
    odd = spark.createDataFrame([(1, "a'b", 2.0), (2, None, 3.0)], "`we``ird col` long, part string, v double")
    sinks.sink_full_replace(odd, "p_odd", tmp_dir + "/it's here", ["part"])
    assert sorted(spark.table("p_odd").collect(), key=str) == sorted(odd.collect(), key=str)
    plan = spark.table("p_odd").filter("part = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    empty = spark.createDataFrame([], "a int, b date")
    sinks.sink_full_replace(empty, "p_odd", tmp_dir)
    assert spark.table("p_odd").columns == ["a", "b"] and spark.table("p_odd").count() == 0
    spark.sql("DROP VIEW p_odd")
    assert P.read_published(spark, "p_odd") is None and P.folders_of(spark, "p_odd") is None


def test_folders_no_longer_shown_can_be_removed(spark, tmp_dir):
    for n in (1, 2, 3):
        sinks.sink_full_replace(_numbers(spark, n), "p_old", tmp_dir)
    assert len(_folders(tmp_dir, "p_old")) == 3
    assert P.remove_unused(spark, tmp_dir, ["p_old", "p_never"]) == []           # too young
    assert len(P.remove_unused(spark, tmp_dir, ["p_old"], older_than_hours=-1)) == 2
    assert spark.table("p_old").count() == 3 and len(_folders(tmp_dir, "p_old")) == 1
    spark.sql("DROP VIEW p_old")


def _day_rows(spark, days):
    return spark.createDataFrame([(d, dt.date(2024, 1, 1) + dt.timedelta(days=d)) for d in days], "order_id long, order_date date")


def test_incremental_loads_are_put_together(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_FOLDERS", 3)
    for last in range(1, 7):
        sinks.load_all({"fact_orders": _day_rows(spark, range(last))}, tmp_dir, "incremental", "p_inc_")
        assert sorted(r.order_id for r in spark.table("p_inc_fact_orders").collect()) == list(range(last))
        assert len(P.folders_of(spark, "p_inc_fact_orders")) <= 3
    spark.sql("DROP VIEW p_inc_fact_orders")


def test_a_star_is_loaded_whole_or_not_at_all(spark, tmp_dir):
    star = {"dim_customers": _numbers(spark, 5), "fact_orders": _day_rows(spark, range(4))}
    sinks.load_all(star, tmp_dir, prefix="p_star_")
    later = _day_rows(spark, range(9)).withColumn("order_id", F.when(F.col("order_id") == 8, F.raise_error(F.lit("broken row"))).otherwise(F.col("order_id")))
    for mode in ("full", "incremental"):
        with pytest.raises(Exception, match="broken row"):
            sinks.load_all({"dim_customers": _numbers(spark, 50), "fact_orders": later}, tmp_dir, mode, "p_star_")
        assert spark.table("p_star_dim_customers").count() == 5 and spark.table("p_star_fact_orders").count() == 4
    for n in star:
        spark.sql(f"DROP VIEW p_star_{n}")


def test_segments_are_ranked_once(spark, tmp_dir, monkeypatch):
    fact, day = load_star(spark, SF_SMALL).fact_slim, C.MID[1]
    ranked = []
    real = SG.segment_customers
    monkeypatch.setattr(SG, "segment_customers", lambda *a, **k: ranked.append(1) or real(*a, **k))
    store = SG.SegmentStore(spark, tmp_dir, "p_seg_")
    first = R.kpis(fact, *C.MID, segments=store.filter(fact, day, "Champion, Loyal")).collect()
    again = R.kpis(fact, *C.MID, segments=store.filter(fact, day, ["Loyal", "Champion"])).collect()
    assert first == again == R.kpis(fact, *C.MID, segments=["Champion", "Loyal"]).collect() and len(ranked) == 2    # the last asked for it anew
    ranked.clear()
    more = fact.union(fact.limit(1))       # a load moves the mark
    assert store.customers(more, day).count() == store.customers(more, day).count() and len(ranked) == 1
    assert store.filter(fact, day, " , ") is None and store.filter(fact, day, None) is None
    store.forget(day)
    store.customers(more, day)
    assert len(ranked) == 2
    store.forget(day)
