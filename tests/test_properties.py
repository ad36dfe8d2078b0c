
from pyspark.sql import functions as F

import __spark_entry__ as E
from fareshift.functions.classify import outside_corridor
from fareshift.plans import catalog

SF = "/root/testdata/sf0.001"


def test_asof_keeps_every_transaction(spark):
    chk = E.queries()["match_count_check"](spark, SF)
    assert chk.where(F.col("diff") != 0).count() == 0
    assert E.queries()["asof_backward"](spark, SF).count() == E.queries()["ridership_used"](spark, SF).count()


def test_used_plus_unused_is_all(spark):
    r = E.queries()["used_unused_counts"](spark, SF).first()
    assert r.counts_agree and r.n_used + r.n_unused == r.n_all


def test_scaled_never_below_matched(spark):
    sc = E.queries()["scale_to_control"](spark, SF)
    bad = sc.where((F.col("final_901") < F.col("ridership_901")) | (F.col("final_902") < F.col("ridership_902")))
    assert sc.count() > 0 and bad.count() == 0


def test_local_routes_sum_to_outside_corridor(spark):
    total = E.queries()["local_by_day"](spark, SF).agg(F.sum("ridership")).first()[0]
    m = catalog._matched(spark, SF)
    assert total == m.where(outside_corridor("latitude", catalog.NORTH, catalog.SOUTH)).count()


def test_roll_ends_only_fills_unmatched(spark):
    a = E.queries()["asof_backward"](spark, SF).select("txn_id", F.col("avl_history_id").alias("a"))
    b = E.queries()["asof_roll_ends"](spark, SF).select("txn_id", F.col("avl_history_id").alias("b"))
    j = a.join(b, "txn_id")
    assert j.where(F.col("a").isNotNull() & (F.col("a") != F.col("b"))).count() == 0
