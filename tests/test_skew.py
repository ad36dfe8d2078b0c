"""A hot key: one vehicle-day holding most of the rows, against DuckDB's ASOF."""

import duckdb
import numpy as np
import pandas as pd

from fareshift.operators.asof import asof_join


def _data(n_pos=30_000, n_txn=20_000, seed=7):
    rng = np.random.default_rng(seed)
    base = np.datetime64("2024-01-05T03:00:00")
    # 90 % of rows on vehicle "hot", the rest on 50 others; times over one service day
    pv = np.where(rng.random(n_pos) < 0.9, "hot", rng.integers(0, 50, n_pos).astype(str))
    tv = np.where(rng.random(n_txn) < 0.9, "hot", rng.integers(0, 50, n_txn).astype(str))
    pt = base + rng.integers(0, 86_400_000_000, n_pos).astype("timedelta64[us]")
    tt = base + rng.integers(0, 86_400_000_000, n_txn).astype("timedelta64[us]")
    pos = pd.DataFrame({"vehicle_id": pv, "pos_time": pt, "avl_history_id": np.arange(n_pos, dtype="int64"),
                        "latitude": rng.random(n_pos) * 100})
    txn = pd.DataFrame({"txn_id": np.arange(n_txn, dtype="int64"), "vehicle_id": tv, "txn_time": tt})
    return pos, txn


def test_hot_key_matches_duckdb(spark):
    pos, txn = _data()
    p = spark.createDataFrame(pos, "vehicle_id string, pos_time timestamp_ntz, avl_history_id long, latitude double")
    t = spark.createDataFrame(txn, "txn_id long, vehicle_id string, txn_time timestamp_ntz")
    got = asof_join(t, p, by=["vehicle_id"], left_time="txn_time", right_time="pos_time",
                    right_cols=["avl_history_id"], tie="avl_history_id").select("txn_id", "avl_history_id")
    got = dict((r.txn_id, r.avl_history_id) for r in got.collect())
    con = duckdb.connect()
    con.register("pos", pos)
    con.register("txn", txn)
    exp = dict(con.execute("""
        SELECT t.txn_id, p.avl_history_id FROM txn t ASOF LEFT JOIN pos p
        ON t.vehicle_id = p.vehicle_id AND t.txn_time >= p.pos_time""").fetchall())
    assert len(got) == len(txn)
    assert got == exp
