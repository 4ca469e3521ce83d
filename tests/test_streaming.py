import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import usage as batch
from emberline.streaming import usage as stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_daily_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('p', id % 3) AS provider", "timestamp_seconds(1704067200 + id * 1800) AS ts", "id AS tokens")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.daily(read).writeStream.format("memory").queryName("daily_use").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("daily_use").collect()}
    want = {tuple(r) for r in batch.daily(rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))).collect()}
    last = max(d for _, d, *_ in want)
    assert {r for r in want if r[1] < last} <= got <= want


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def requests(n, draw):
    """(provider, request_id, seconds, rpm) that come up to 40 seconds late, in files of some."""
    rows = []
    for i in range(n):
        provider, rpm = draw.choice([("slow", 6), ("fast", 90), ("free", None)])
        rows.append((provider, i, 1_700_000_000.0 + draw.choice([i * 2.0, i * 2.0, i // 20 * 40.0, max(0, i * 2.0 - draw.uniform(0, 40))]), rpm))
    return rows


def run(spark, read, folder, name):
    query = stream.token_bucket(read, late="1 minute", slice_seconds=10).writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-checkpoint")).trigger(availableNow=True).outputMode("append").start()
    try:
        query.awaitTermination(240)
    finally:
        query.stop()


def test_bucket_stream_equals_batch(spark, rocks, tmp_path):
    """Rows come late and in many small batches, and the stream is stopped and started again between; the same as all of them at once."""
    rows = requests(300, random.Random(8))
    kind = "provider string, request_id long, s double, rpm int"
    frame = lambda part: spark.createDataFrame(part, kind).selectExpr("provider", "request_id", "timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS ts", "rpm")
    schema = frame(rows).schema
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = [rows[k : k + 60] for k in range(0, 300, 60)]
    # one request far ahead closes all slices, and is itself left waiting
    parts.append([("slow", 999, 1_700_000_000 + 100_000.0, 6), ("fast", 998, 1_700_000_000 + 100_000.0, 90)])
    for k, part in enumerate(parts):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (2, 5):
            run(spark, read, tmp_path, "out")
    got = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    caps = spark.createDataFrame([("slow", 6), ("fast", 90), ("free", None)], "provider string, rpm int")
    flat = frame(rows).drop("rpm").withColumn("at", F.unix_micros("ts") / 1e6)
    want = {r.request_id: r for r in batch.token_bucket(flat, caps).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert (got[i].provider, got[i].at) == (w.provider, w.at) and got[i].admitted_at == pytest.approx(w.admitted_at, abs=1e-5), i
    assert sum(w.waited > 0 for w in want.values()) > 30
    assert any(a[2] > b[2] for a, b in zip(rows, rows[1:], strict=False))


def test_bucket_stream_without_time(spark, rocks, tmp_path):
    rows = spark.createDataFrame([("p", 1, None, 5), (None, 2, None, None)], "provider string, request_id long, ts timestamp, rpm int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(spark, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), tmp_path, "out")
    assert sorted((r.request_id, r.admitted_at, r.waited) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, None, None), (2, None, None)]
