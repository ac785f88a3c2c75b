from linkledger.streaming.snapshots import snapshot_stream, windowed_events


def test_snapshots(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = snapshot_stream(source, str(tmp_path / "out"), str(tmp_path / "check"), every=None)
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/snapshots")).collect()
    assert len(rows) == 1 and rows[0]["interface_count"] == events.count() and rows[0]["status"] == "ok"
    assert windowed_events(events).agg({"n": "sum"}).first()[0] == events.count()


def test_failed_snapshot(spark, sf_dir, tmp_path):
    """A batch whose rows can't be written leaves a failed row with the reason, and a repeat puts an ok one in its place."""
    import pytest

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/interfaces").write_text("a file in the place of the folder")
    start = lambda: snapshot_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), every=None)
    with pytest.raises(Exception):
        start().awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out/snapshots")).first()
    assert row["status"] == "failed" and row["error"]
    (tmp_path / "out/interfaces").unlink()
    start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/snapshots")).collect()
    assert [(r["status"], r["interface_count"]) for r in rows] == [("ok", events.count())]


def test_late_rows(spark, tmp_path):
    """On a stream a window is emitted once the watermark has passed it, and rows that come a batch later are dropped."""
    import datetime

    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate(([(at(1), "x", 1.0), (at(1, 30), "x", 2.0)], [(at(5), "x", 4.0)], [(at(5, 1), "x", 0.5)], [(at(1, 10), "x", 100.0), (at(4, 55), "x", 8.0)], [(at(9), "x", 16.0)], [(at(9, 1), "x", 0.0)], [(at(9, 2), "x", 0.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = windowed_events(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = {r["start"].hour: (r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (2, 3.0), 4: (1, 8.0), 5: (2, 4.5)}
