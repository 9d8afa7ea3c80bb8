import datetime as dt

from folioflow import streaming

SCHEMA = "user_id long, ts timestamp, value double, text string"


def test_totals_sessions_and_first_texts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    batches = [[(1, at(0), 1.0, "a"), (2, at(5), 2.0, "b"), (1, at(10), None, "a")], [(1, at(20), 4.0, "b"), (1, at(120), 8.0, "c")], [(3, at(600), 1.0, "d")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {}
    for name, make, mode in (("totals", streaming.running_totals, "update"), ("sessions", streaming.session_counts, "append"), ("texts", streaming.first_seen, "append")):
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = make(events).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got[name] = spark.table(name).collect()
    last = {}
    for r in got["totals"]:
        last[r["user_id"]] = max(last.get(r["user_id"], (0, 0.0)), (r["n"], r["total"]))
    assert last == {1: (4, 13.0), 2: (1, 2.0), 3: (1, 1.0)}
    assert sorted((r["user_id"], r["n"]) for r in got["sessions"]) == [(1, 1), (1, 3), (2, 1)]
    assert sorted(r["text"] for r in got["texts"]) == ["a", "b", "c", "d"]
