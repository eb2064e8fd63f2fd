from pyspark.sql import functions as F

from loomtrail.streaming import agent_stream as ST


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def stream(spark, data_dir, tmp_path, name):
    import os

    d = tmp_path / name
    d.mkdir()
    os.symlink(f"{data_dir}/{name}.parquet", d / "part.parquet")
    schema = spark.read.parquet(f"{data_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(str(d))


def test_closed_windows_equal_batch(spark, data_dir, tmp_path):
    s = run(spark, ST.windowed(stream(spark, data_dir, tmp_path, "events"), "ts", "1 hour", "1 day", by=["event_type"], value="value"), "daily")
    batch = ST.windowed(spark.read.parquet(f"{data_dir}/events.parquet"), "ts", "1 hour", "1 day", by=["event_type"], value="value")
    got = {(r["begin"], r["event_type"]): (r["events"], round(r["value"], 6)) for r in s.collect()}
    want = {(r["begin"], r["event_type"]): (r["events"], round(r["value"], 6)) for r in batch.collect()}
    assert got and got.items() <= want.items()
    assert len(want) - len(got) <= 5  # the last day's windows are still open


def test_sessions_on_stream(spark, data_dir, tmp_path):
    s = run(spark, ST.session_windows(stream(spark, data_dir, tmp_path, "events"), "ts", "1 hour", "2 hours", "user_id"), "sess")
    assert s.count() > 0


def test_run_states(spark, tmp_path):
    d = tmp_path / "ev"
    rows = [("r", "turn_started", None, None), ("r", "tool_finished", "u1", True), ("r", "turn_started", None, None), ("r", "tool_finished", "u1", False), ("s", "tool_finished", "u2", None)]
    df = spark.createDataFrame(rows, "run_id string, type string, uri string, ok boolean")
    df.coalesce(1).write.parquet(str(d))
    s = run(spark, ST.run_states(spark.readStream.schema(df.schema).parquet(str(d)), most_turns=1), "states", "update")
    assert {r["run_id"]: (r["turns"], r["images"], r["calls"], r["failures"], r["over_limit"]) for r in s.collect()} == {"r": (2, 1, 2, 1, True), "s": (0, 1, 1, 1, False)}


def test_normalise_events(spark):
    rows = [("r", 1, "tool_execution_start", "crop", None, None), ("r", 2, "tool_execution_end", "crop", False, '{"ok": 1}'), ("r", 3, "tool_execution_end", "crop", False, "text"), ("r", 4, "tool_execution_end", "crop", True, '{"error": {"code": "X"}}'), ("r", 5, "message", None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, seq int, kind string, tool string, is_error boolean, details string")
    assert [(r["type"], r["ok"], r["error"]) for r in ST.normalise_events(df).orderBy("seq").collect()] == [("tool_started", None, None), ("tool_finished", True, None), ("tool_finished", False, "UNSTRUCTURED_RESULT"), ("tool_finished", False, "X"), ("message", None, None)]


def test_append_traces(spark, data_dir, tmp_path):
    q = ST.append_traces(stream(spark, data_dir, tmp_path, "events").select("event_id", F.left("props", F.lit(5)).alias("props")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == spark.read.parquet(f"{data_dir}/events.parquet").count()


def test_traces_are_scrubbed_and_reads_cached(spark, tmp_path):
    from loomtrail.streaming import agent_stream as E

    src = tmp_path / "in"
    rows = [("page", "k", "v1", 0.0, "data:abc"), ("page", "k", "v2", 50.0, "x" * 900), ("page", "k", None, 300.0, None), ("page", "n", None, 5.0, None)]
    spark.createDataFrame(rows, "namespace string, cache_key string, value string, at double, note string").coalesce(1).write.json(str(src))
    read = lambda: spark.readStream.schema("namespace string, cache_key string, value string, at double, note string").json(str(src))
    E.append_traces(read(), str(tmp_path / "t"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert {len(r["note"]) for r in spark.read.json(str(tmp_path / "t")).where("note is not null").collect()} == {500, len("<data-uri:8 chars>")}
    q = E.cached_reads(read().drop("note"), ttl=100.0).writeStream.format("json").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["cache_key"], r["hit"], r["value"], r["updated_at"]) for r in spark.read.schema(E.CACHED).json(str(tmp_path / "o")).collect() if r["value"])
    assert got == [("k", False, "v1", 0.0), ("k", True, "v1", 0.0)]
