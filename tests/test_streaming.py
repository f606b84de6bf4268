from datetime import datetime, timedelta

from sedgemill.streaming import capture

T0 = datetime(2025, 1, 1)


def test_session_deltas(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "session string, ts timestamp, text string"
    texts = ["a" * 100, "a" * 100, "a" * 60, "a" * 200 + "b" * 300]
    for k, text in enumerate(texts):
        spark.createDataFrame([("s", T0 + timedelta(minutes=k), text), ("t", T0 + timedelta(minutes=k), "x" * 10)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = capture.drain(capture.session_deltas(stream, threshold=25, band=100), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    rows = sorted((r["session"], r["seq"], r["delta"], r["tokens"], r["reason"]) for r in spark.read.schema(capture.DELTA).parquet(str(tmp_path / "out")).collect())
    assert rows == [("s", 0, "a" * 100, 25, "threshold"), ("s", 1, "a" * 100 + "b" * 300, 100, "threshold"), ("s", 2, "", 125, "band")]


def test_stream_equals_batch(spark, tmp_path):
    d, schema = "/root/testdata/sf0.001", None
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    # one file in order of time, then one far later row that closes all windows
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    end = events.agg({"ts": "max"}).first()[0] + timedelta(days=30)
    spark.createDataFrame([(-1, end, -1, "end", 0.0)], events.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, f in (("hourly", capture.hourly), ("sessions", capture.user_sessions)):
        q = capture.drain(f(stream, late="20 days") if name == "hourly" else f(stream, late="20 days"), str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        got = spark.read.parquet(str(tmp_path / name)).drop("total")
        want = f(events).drop("total")
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in want.collect()} and got.count() > 0.5 * want.count()


def test_duplicates(spark, tmp_path):
    schema = "id string, ts timestamp, text string"
    rows = [("a", T0, "x"), ("a", T0, "xyz"), ("b", T0, "q")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = capture.drain(capture.distinct_entries(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert {r["id"]: r["text"] for r in capture.longest_entries(spark.createDataFrame(rows, schema)).collect()} == {"a": "xyz", "b": "q"}
