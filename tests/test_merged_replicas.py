"""Rounded touch statistics at ties: those of SQL, however the rows are dealt over partitions."""

import datetime
import json

ROWS = {
    (17, '{"k": 62}'): [(0, 19.43, 19723, "signup"), (2, 6.71, 19726, "click"), (4, 10.99, 19730, "error"), (6, 69.57, 19740, "view"), (1, 11.04, 19726, "error")],
    (114, '{"k": 38}'): [(10, 7.87, 19724, "view"), (12, 25.84, 19731, "click"), (14, 48.62, 19745, "purchase"), (16, 0.21, 19749, "signup"), (11, 0.19, 19751, "view")],
    (5, '{"k": 1}'): [(20, None, 19724, "view"), (22, 2.5, 19725, "click"), (21, None, 19726, "view")],
}


def test_merged_replicas_at_ties(spark, tmp_path):
    import duckdb

    from wordmill import plans

    start = datetime.datetime(1970, 1, 1, 9)
    rows = [(i, start + datetime.timedelta(days=d), user, kind, value, word) for (user, word), taps in ROWS.items() for i, value, d, kind in taps]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows.sort()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "one" / "events.parquet"))
    spark.createDataFrame(rows[::-1], schema).repartition(7).write.parquet(str(tmp_path / "many" / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/one/events.parquet/*.parquet'")
    want = db.execute(f"SELECT * FROM ({plans.ORACLE_SQL['merged_replicas']}) ORDER BY user_id").fetchall()
    for way in ("one", "many"):
        got = plans.QUERIES["merged_replicas"](spark, str(tmp_path / way)).orderBy("user_id").collect()
        assert json.dumps([list(r) for r in got]) == json.dumps([list(r) for r in want])
