"""Words learned from a stream: over batches as the plain fold does it, with nulls as in SQL, and without a call of Python for each key."""

import datetime

from wordmill.streaming import ingest


def _write(spark, at, name, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    start = datetime.datetime(2024, 1, 1, 12)
    made = [(i, None if day is None else start + datetime.timedelta(days=day), user, kind, 1.0, word) for i, (user, word, day, kind) in enumerate(rows)]
    spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{at}/{name}")


def test_learned_over_batches_as_folded(spark, tmp_path):
    batches = [[(1, "a", d, "view") for d in (1, 1, 2)] + [(2, "b", d, "click") for d in range(7)], [(1, "a", 2, "purchase"), (1, "a", 9, "view")] + [(2, "b", d, "view") for d in range(5, 12)] + [(3, "c", 0, "view")]]
    for rows in batches:
        _write(spark, tmp_path, "in", rows)
    stream = ingest.read_files(spark, f"{tmp_path}/in", ingest.EVENTS, most_files=1).selectExpr("user_id", "props AS word", "date_diff(ts, DATE'1970-01-01') AS day", "event_type = 'purchase' AS explicit")
    ingest.run(ingest.learn(stream), f"{tmp_path}/log", ingest.batch_writer(f"{tmp_path}/out"), "update").awaitTermination()
    assert len({r["batch"] for r in spark.read.parquet(f"{tmp_path}/out").select("batch").collect()}) == 2
    want = {}
    for rows in batches:
        for user, word, day, kind in rows:
            want[user, word] = ingest.fold_word(want.get((user, word)), [day], kind == "purchase")
    got = ingest.latest(spark, f"{tmp_path}/out", ["user_id", "word"]).collect()
    assert {(r["user_id"], r["word"]): (r["n"], r["n_days"], r["explicit"]) for r in got} == {k: (n, days, seen) for k, (n, days, _, seen) in want.items()}


def test_nulls_as_in_sql_and_no_python(spark, tmp_path):
    import duckdb

    from wordmill import plans

    _write(spark, tmp_path, "events.parquet", [(1, "a", None, "view"), (1, "a", 3, None), (2, "b", None, None), (None, None, 1, "purchase"), (None, None, 2, None)])
    out = plans.QUERIES["streamed_learning"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, db.execute(plans.ORACLE_SQL["streamed_learning"]).fetchall()))
    stream = ingest.read_files(spark, f"{tmp_path}/events.parquet", ingest.EVENTS).selectExpr("user_id", "props AS word", "1 AS day", "true AS explicit")
    assert "Pandas" not in ingest.learn(stream)._jdf.queryExecution().logical().toString()
