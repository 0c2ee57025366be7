from pyspark.sql import functions as F

from flowloom.operators import flows
from flowloom.streaming import sessions


def _stream(spark, tmp_path, rows, schema):
    src = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    return spark.readStream.schema(schema).parquet(str(src)).withColumn("event_time", F.timestamp_seconds("ts"))


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return q


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"h{i % 2}", "d", 1000.0 + ts, 10.0, 2 if i % 5 else 16) for i, ts in enumerate([0, 1, 2, 5, 9, 14, 30, 31, 50, 62, 70, 71, 95, 140, 141, 170, 171, 200, 230, 231])] + [(99, "end", "end", 9999.0, 1.0, 0)]
    schema = "seq long, src string, dst string, ts double, packet_len double, tcp_flags int"
    _run(sessions.assemble_flows(_stream(spark, tmp_path, rows, schema), 15.0, 60.0), "live_flows")
    got = sorted((r.src, r.dst, r.start_time, r.last_time, r.packet_count) for r in spark.sql("select * from live_flows where src <> 'end'").collect())
    df = spark.createDataFrame(rows, schema)
    cut = flows.cut_active(flows.cut_idle(df, ["src", "dst"], 15.0), ["src", "dst"], 60.0)
    want = sorted((r.src, r.dst, r.start_time, r.last_time, r.packet_count) for r in flows.assemble(cut, ["src", "dst"], ["session", "chunk"]).filter("src <> 'end'").collect())
    assert got == want


def test_rollup_and_suppression(spark, tmp_path):
    rows = [("d", "e", float(t), 5.0) for t in (600, 700, 899, 900, 1250, 99999)]
    s = _stream(spark, tmp_path, rows, "detector string, entity string, ts double, packet_len double")
    _run(sessions.windowed_rollup(s, "60 seconds", "10 seconds", ["entity"]), "rolled")
    assert sorted(r.packets for r in spark.sql("select * from rolled").collect()) == [1, 1, 1, 1, 1]
    _run(sessions.suppress_hits(s, 300.0), "kept_hits")
    assert sorted(r.ts for r in spark.sql("select * from kept_hits").collect()) == [600.0, 900.0, 1250.0, 99999.0]


def test_alert_sink(spark, tmp_path):
    s = _stream(spark, tmp_path, [(1, 0.0), (1, 1.0), (2, 2.0)], "alert_id long, ts double")
    q = sessions.append_alerts(s, str(tmp_path / "log"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    # a later batch brings an id again
    spark.createDataFrame([(2, 9.0), (3, 9.5)], "alert_id long, ts double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = sessions.append_alerts(spark.readStream.schema("alert_id long, ts double").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.alert_id, r.ts) for r in spark.read.parquet(str(tmp_path / "log")).collect())[1:] == [(2, 2.0), (3, 9.5)]
    assert sessions.rates([])["p50_ms"] is None
