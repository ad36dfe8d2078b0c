import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st

from fareshift.operators.asof import asof_both, asof_join
from fareshift.operators.matching import match_positions
from conftest import rows

T = dt.datetime


def _frames(spark, pos, txn):
    p = spark.createDataFrame(pos, "vehicle_id string, pos_time timestamp_ntz, avl_history_id long, latitude double")
    t = spark.createDataFrame(txn, "txn_id long, vehicle_id string, txn_time timestamp_ntz")
    return t, p


def test_backward_and_roll_ends(spark):
    d = lambda h, m: T(2019, 12, 3, h, m)
    t, p = _frames(spark, [("1", d(10, 0), 1, 1.0), ("1", d(10, 5), 2, 2.0)],
                   [(1, "1", d(9, 59)), (2, "1", d(10, 0)), (3, "1", d(10, 3)), (4, "1", d(11, 0))])
    kw = dict(by=["vehicle_id"], left_time="txn_time", right_time="pos_time", right_cols=["avl_history_id"],
              tie="avl_history_id", last_time="maxtime")
    got = rows(asof_join(t, p, **kw), "txn_id", "pos_time", "maxtime")
    assert got == [(1, None, d(10, 5)), (2, d(10, 0), d(10, 5)), (3, d(10, 0), d(10, 5)), (4, d(10, 5), d(10, 5))]
    rolled = rows(asof_join(t, p, roll_ends=True, **kw), "txn_id", "pos_time")
    assert rolled[0] == (1, d(10, 0))


def test_forward_tolerance_exact(spark):
    base = T(2019, 12, 3, 10, 0, 0)
    t, p = _frames(spark, [("1", base, 1, 1.0)],
                   [(1, "1", T(2019, 12, 3, 9, 57, 59)), (2, "1", T(2019, 12, 3, 9, 58, 0)), (3, "1", base),
                    (4, "1", T(2019, 12, 3, 10, 1))])
    got = rows(asof_join(t, p, by=["vehicle_id"], left_time="txn_time", right_time="pos_time",
                         right_cols=["avl_history_id"], direction="forward", tolerance=120, how="inner"),
               "txn_id", "pos_time")
    assert got == [(2, base), (3, base)]


def test_ties_last_and_all(spark):
    d = T(2019, 12, 3, 10, 0)
    t, p = _frames(spark, [("1", d, 5, 5.0), ("1", d, 7, 7.0), ("1", d, 6, 6.0)], [(1, "1", T(2019, 12, 3, 10, 1))])
    kw = dict(by=["vehicle_id"], left_time="txn_time", right_time="pos_time", right_cols=["avl_history_id"],
              tie="avl_history_id")
    assert rows(asof_join(t, p, **kw), "txn_id", "avl_history_id") == [(1, 7)]
    # a rolled match stays one row, one at exactly the left time is expanded
    assert rows(asof_join(t, p, ties="all", **kw), "txn_id", "avl_history_id") == [(1, 7)]
    at = spark.createDataFrame([(1, "1", d)], t.schema)
    assert rows(asof_join(at, p, ties="all", **kw), "txn_id", "avl_history_id") == [(1, 5), (1, 6), (1, 7)]


def test_null_vehicle_kept_unmatched(spark):
    d = T(2019, 12, 3, 10, 0)
    t, p = _frames(spark, [("1", d, 1, 1.0)], [(1, None, T(2019, 12, 3, 10, 1)), (2, "1", T(2019, 12, 3, 10, 1))])
    got = rows(match_positions(t, p, position_cols=("avl_history_id", "latitude")), "txn_id", "avl_history_id")
    assert got == [(1, None), (2, 1)]


def test_match_across_buckets_and_service_day(spark):
    # position at 02:59 belongs to the previous service day; the 03:01 fare must not see it.
    t, p = _frames(spark, [("1", T(2019, 12, 3, 2, 59), 1, 1.0), ("1", T(2019, 12, 3, 5, 0), 2, 2.0)],
                   [(1, "1", T(2019, 12, 3, 3, 1)), (2, "1", T(2019, 12, 3, 9, 0)), (3, "1", T(2019, 12, 3, 2, 59, 30))])
    got = rows(match_positions(t, p, position_cols=("avl_history_id",)), "txn_id", "avl_history_id")
    assert got == [(1, None), (2, 2), (3, 1)]


def _brute(pos, txn, direction, tol):
    out = []
    for tid, v, tt in txn:
        cands = [(pt, aid) for (pv, pt, aid, _) in pos if pv == v and v is not None]
        if direction == "backward":
            c = [x for x in cands if x[0] <= tt]
            best = max(c) if c else None
        else:
            c = [x for x in cands if x[0] >= tt]
            best = min(c, key=lambda x: (x[0], -x[1])) if c else None
        if best is not None and tol is not None and abs((best[0] - tt).total_seconds()) > tol:
            best = None
        out.append((tid, best[1] if best else None))
    return sorted(out, key=lambda t: (t[0],))


@settings(max_examples=12, deadline=None)
@given(seed=st.integers(0, 10_000), direction=st.sampled_from(["backward", "forward"]),
       unit=st.sampled_from(["second", "minute", "hour"]), tol=st.sampled_from([None, 30, 600]))
def test_asof_matches_brute_force(spark, seed, direction, unit, tol):
    rnd = random.Random(seed)
    base = T(2020, 1, 1, 0, 0)
    pos = [(rnd.choice(["a", "b", None]), base + dt.timedelta(seconds=rnd.randrange(0, 7200)), i, float(i))
           for i in range(40)]
    txn = [(i, rnd.choice(["a", "b", "c", None]), base + dt.timedelta(seconds=rnd.randrange(-100, 7300)))
           for i in range(60)]
    t, p = _frames(spark, pos, txn)
    got = rows(asof_join(t, p, by=["vehicle_id"], left_time="txn_time", right_time="pos_time",
                         right_cols=["avl_history_id"], tie="avl_history_id", direction=direction,
                         tolerance=tol, bucket_unit=unit), "txn_id", "avl_history_id")
    assert got == _brute(pos, txn, direction, tol)
    assert len(got) == len(txn)


def test_bad_arguments(spark):
    t, p = _frames(spark, [], [])
    with pytest.raises(ValueError):
        asof_join(t, p, by=["vehicle_id"], left_time="txn_time", right_time="pos_time", direction="sideways")


def test_null_tie_ranks_lowest(spark):
    d = T(2019, 12, 3, 10, 0)
    p = spark.createDataFrame([("1", d, None, 1.0), ("1", d, 4, 2.0)],
                              "vehicle_id string, pos_time timestamp_ntz, avl_history_id long, latitude double")
    t = spark.createDataFrame([(1, "1", T(2019, 12, 3, 10, 1)), (2, "1", T(2019, 12, 3, 9, 0))],
                              "txn_id long, vehicle_id string, txn_time timestamp_ntz")
    kw = dict(by=["vehicle_id"], left_time="txn_time", right_time="pos_time", right_cols=["latitude"],
              tie="avl_history_id")
    assert rows(asof_join(t, p, **kw), "txn_id", "latitude") == [(1, 2.0), (2, None)]
    assert rows(asof_join(t, p, roll_ends=True, **kw), "txn_id", "latitude") == [(1, 2.0), (2, 2.0)]
    fwd = asof_join(t, p, direction="forward", **kw)
    assert rows(fwd, "txn_id", "latitude") == [(1, None), (2, 2.0)]


def test_match_without_service_day_warns(spark):
    import warnings
    d = T(2019, 12, 3, 10, 0)
    t, p = _frames(spark, [("1", d, 1, 1.0)], [(1, "1", T(2019, 12, 3, 10, 1))])
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        m = match_positions(t, p, by=("vehicle_id",), position_cols=("avl_history_id",))
    assert any("service_day" in str(x.message) for x in w)
    assert rows(m, "txn_id", "avl_history_id") == [(1, 1)]


def test_forward_is_as_fast_as_backward(spark):
    """20,000 rows a side in one bucket, and 20,000 one-second buckets of one key."""
    import time

    from pyspark.sql import functions as F

    base = F.lit("2024-01-01 05:00:00").cast("timestamp_ntz")
    for micros, unit in ((1_000, "minute"), (1_000_000, "second")):
        at = base + F.make_dt_interval(secs=(F.col("id") * micros / F.lit(1e6)).cast("decimal(18,6)"))
        left = spark.range(20_000).select(F.lit("a").alias("k"), at.alias("t"))
        right = spark.range(20_000).select(F.lit("a").alias("k"), at.alias("p"), F.col("id").alias("v"))
        took = {}
        for direction in ("backward", "forward", "backward", "forward"):
            t0 = time.perf_counter()
            out = asof_join(left, right, by=["k"], left_time="t", right_time="p", right_cols=["v"], tie="v",
                            direction=direction, bucket_unit=unit)
            assert out.where("t = p").count() == 20_000
            took[direction] = time.perf_counter() - t0
        assert took["forward"] < 3 * took["backward"] + 1


def _random_sides(spark, seed):
    """Few times and keys, so ties, null keys and null times all occur; a real key equals a stand-in for null."""
    rnd = random.Random(seed)
    base = T(2020, 1, 1, 0, 0)
    at = lambda: base + dt.timedelta(seconds=rnd.randrange(0, 600, 7))
    pos = [(rnd.choice(["a", "", None]), rnd.choice([at(), at(), at(), None]), i, float(i)) for i in range(60)]
    txn = [(i, rnd.choice(["a", "", "c", None]), rnd.choice([at(), at(), at(), None])) for i in range(60)]
    return pos, txn, *_frames(spark, pos, txn)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("unit", ["second", "minute"])
def test_both_directions_equal_two_joins(spark, seed, unit):
    pos, txn, t, p = _random_sides(spark, seed)
    kw = dict(by=["vehicle_id"], left_time="txn_time", right_time="pos_time", right_cols=["avl_history_id"],
              tie="avl_history_id", bucket_unit=unit)
    both = asof_both(t, p, before=90, after=30, **kw)
    assert both.columns == [*t.columns, "prev_pos_time", "prev_avl_history_id", "next_pos_time", "next_avl_history_id"]
    real = [x for x in pos if x[1] is not None]
    known = [x for x in txn if x[2] is not None]
    null = [(x[0], None) for x in txn if x[2] is None]
    assert rows(both, "txn_id", "prev_avl_history_id") == sorted(_brute(real, known, "backward", 90) + null)
    assert rows(both, "txn_id", "next_avl_history_id") == sorted(_brute(real, known, "forward", 30) + null)
    assert rows(asof_join(t, p, direction="forward", **kw), "txn_id", "avl_history_id") == sorted(
        _brute(real, known, "forward", None) + null)
    for tid, latest in rows(asof_join(t, p, last_time="m", **kw), "txn_id", "m"):
        _, v, at = txn[tid]
        own = [x[1] for x in real if x[0] == v and v is not None]
        assert latest == (max(own) if own and at else None)


@pytest.mark.parametrize("seed", range(3))
def test_all_ties_and_rolled_ends_equal_brute_force(spark, seed):
    pos, txn, t, p = _random_sides(spark, seed)
    out = asof_join(t, p, by=["vehicle_id"], left_time="txn_time", right_time="pos_time", right_cols=["avl_history_id"],
                    tie="avl_history_id", ties="all", roll_ends=True)
    want = []
    for tid, v, at in txn:
        own = [(x[1], x[2]) for x in pos if x[0] == v and v is not None and x[1] is not None] if at else []
        met, before = [x for x in own if x[0] == at], [x for x in own if at and x[0] < at]
        if met:
            want += [(tid, k) for _, k in met]
        elif before:
            want.append((tid, max(before)[1]))
        else:
            want.append((tid, min(own, key=lambda x: (x[0], -x[1]))[1] if own else None))
    assert rows(out, "txn_id", "avl_history_id") == sorted(want)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _shuffles(plan, kind):
    return sum(1 for x in plan.splitlines() if kind in x and "ReusedExchange" not in x)


def test_each_side_is_scanned_and_shuffled_once(spark):
    from fareshift.plans import catalog
    sf = "/root/testdata/sf0.001"
    for name in ("asof_backward", "asof_comparison", "asof_roll_ends"):
        plan = _final_plan(catalog.QUERIES[name](spark, sf))
        assert plan.count("FileScan") == 2 and _shuffles(plan, "REPARTITION_BY_COL") == 1, name
    for name in ("asof_ties_all", "asof_ties_rolled"):  # its positions are a join of two tables
        plan = _final_plan(catalog.QUERIES[name](spark, sf))
        assert plan.count("FileScan") == 3 and _shuffles(plan, "REPARTITION_BY_COL") == 1, name


def test_stored_positions_are_not_shuffled(spark, tmp_path):
    from fareshift.operators.matching import with_service_day
    from fareshift.sources.sinks import write_bucketed
    _, _, t, p = _random_sides(spark, 5)
    t, p = with_service_day(t, "txn_time"), with_service_day(p, "pos_time")
    by = ["vehicle_id", "service_day"]
    kw = dict(by=by, left_time="txn_time", right_time="pos_time", right_cols=["avl_history_id"], tie="avl_history_id",
              last_time="maxtime")
    for mode, part in (("overwrite", p.where("avl_history_id < 30")), ("append", p.where("avl_history_id >= 30"))):
        write_bucketed(part, "stored_positions", by, "pos_time", buckets=4, mode=mode, path=str(tmp_path / "stored"))
    try:
        stored = asof_join(t, spark.table("stored_positions"), stored=4, **kw)
        assert rows(stored) == rows(asof_join(t, p, **kw))
        plan = _final_plan(stored)
        # the transactions' exchange, and those of the bucket summaries
        assert _shuffles(plan, "REPARTITION_BY_NUM") == 1 and "REPARTITION_BY_COL" not in plan
        # from the positions' scans up to the window and the aggregate there is no exchange
        lines = plan.splitlines()
        depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
        scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x]
        assert len(scans) == 2
        for i in scans:
            above, at = [], depth[i]
            for j in range(i, -1, -1):
                if depth[j] < at:
                    above.append(lines[j])
                    at = depth[j]
                    if "Window" in lines[j] or "Aggregate" in lines[j]:
                        break
            assert any("Union" in x for x in above) and not any("Exchange" in x for x in above)
    finally:
        spark.sql("DROP TABLE IF EXISTS stored_positions")
