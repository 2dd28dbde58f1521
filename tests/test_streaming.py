from tessera.streaming.requests import calls_by_window, first_requests

ROWS = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:01:00"), (1, "b", "2024-01-01 00:02:00"), (2, "a", "2024-01-01 00:12:00")]


def _stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "run_id long, key string, ts string").selectExpr("run_id", "key", "cast(ts as timestamp) as ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _run(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_first_requests(spark, tmp_path):
    _run(first_requests(_stream(spark, tmp_path)), tmp_path, "firsts", "append")
    assert sorted((r.run_id, r.key) for r in spark.table("firsts").collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_calls_by_window(spark, tmp_path):
    _run(calls_by_window(_stream(spark, tmp_path)), tmp_path, "calls", "complete")
    assert sorted((r.window_start.minute, r.key, r.n_requests, r.n_runs) for r in spark.table("calls").collect()) == [(0, "a", 2, 1), (0, "b", 1, 1), (10, "a", 1, 1)]
