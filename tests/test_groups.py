import datetime as dt

from keyloom.streaming import groups


def test_delivery_acks_and_expiry(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    schema = "ts timestamp, grp string, id long, kind string"
    parts = [
        [(at(0), "g", 1, "message"), (at(0), "g", 2, "message"), (at(0), "h", 1, "message"), (at(0), "g", 4, "message")],
        [(at(1), "g", 1, "ack"), (at(1), "g", 2, "message"), (at(1), "g", 3, "ack"), (at(1), "g", 4, "ack")],
        [(at(2), "g", 3, "message"), (at(500), "z", 9, "message")],
        [(at(501), "z", 10, "message")],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = groups.consume(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    events = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert events == {("g", 1, "c1", "delivered"), ("g", 2, "c2", "delivered"), ("h", 1, "c1", "delivered"), ("g", 4, "c1", "delivered"), ("g", 1, "c1", "acked"), ("g", 4, "c1", "acked"), ("z", 9, "c0", "delivered"), ("z", 10, "c1", "delivered"), ("g", 2, "c2", "expired"), ("h", 1, "c1", "expired")}
    assert rows == len(events)
