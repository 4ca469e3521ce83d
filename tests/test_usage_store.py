from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.sources.usage_store import UsageStore

REQUEST = "provider string, day string, input_tokens long, output_tokens long"


def totals(store):
    return {(r.provider, r.day): (r.requests, r.input_tokens, r.output_tokens, r.tokens) for r in store.totals().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return UsageStore(spark, str(tmp_path / "use"))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST)


def test_a_missing_store_is_no_use(spark, store):
    assert totals(store) == {} and store.broken().count() == 0
    caps = spark.createDataFrame([("a", 5, None), ("b", None, 100)], "provider string, rpd int, tpd int")
    assert {tuple(r) for r in store.today(caps, "2026-01-01").collect()} == {("a", 5, None, 0, 0, 5), ("b", None, 100, 0, 0, None)}


def test_a_batch_that_comes_again_adds_nothing(spark, store):
    one, two = batch(spark, ("a", "d1", 10, 1), ("a", "d1", 5, None), ("b", "d1", 7, 7)), batch(spark, ("a", "d1", 1, 1), ("a", "d2", 2, 2))
    send = store.sink()
    send(one, 0)
    send(two, 1)
    want = {("a", "d1"): (3, 16, 2, 18), ("b", "d1"): (1, 7, 7, 14), ("a", "d2"): (1, 2, 2, 4)}
    assert totals(store) == want
    send(one, 0)
    send(two, 1)
    assert totals(store) == want
    store.sink("others")(two, 1)  # another source's batch 1 is another batch
    assert totals(store)["a", "d2"] == (2, 4, 4, 8)
    caps = spark.createDataFrame([("a", 3, 10), ("c", 1, 1)], "provider string, rpd int, tpd int")
    assert {tuple(r) for r in store.today(caps, "d1").collect()} == {("a", 3, 10, 4, 20, 0), ("c", 1, 1, 0, 0, 1)}


def test_compacting_changes_nothing_and_old_batches_stay_counted_once(spark, store):
    rows = [batch(spark, ("a", f"d{i % 2}", i, 1)) for i in range(5)]
    for i, r in enumerate(rows):
        store.record(r, i)
    want = totals(store)
    store.compact(2)
    assert totals(store) == want
    store.record(rows[1], 1)  # comes again after it was folded in
    assert totals(store) == want
    store.compact(4)
    store.compact(4)
    assert totals(store) == want


def test_broken_rows_count_as_zero(spark, store):
    for i in range(3):
        store.record(batch(spark, ("a", "d", 10, 1)), i)
    files = sorted(Path(store.path).rglob("id=1/part-*.json"))
    files[0].write_text(files[0].read_text()[:20])
    for crc in Path(store.path).rglob("*.crc"):
        crc.unlink()
    assert totals(store) == {("a", "d"): (2, 20, 2, 22)}
    assert [(r.kind, r.id) for r in store.broken().collect()] == [("batch", 1)]
    store.record(batch(spark, ("a", "d", 10, 1)), 1)
    assert totals(store) == {("a", "d"): (3, 30, 3, 33)} and store.broken().count() == 0


def test_a_stream_that_fails_and_starts_again_counts_once(spark, tmp_path, store):
    rows = spark.range(40).selectExpr("concat('p', id % 2) AS provider", "concat('d', id % 3) AS day", "id AS input_tokens", "1L AS output_tokens")
    for part in range(4):
        rows.where(F.col("input_tokens") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sent = []

    def failing(batch_rows, number):
        store.sink()(batch_rows, number)
        sent.append(number)
        if number == 1 and sent.count(1) == 1:
            raise RuntimeError("lost after it was written")

    def run(sink):
        read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = read.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost after"):
        run(failing)
    run(failing)
    assert sent.count(1) == 2
    want = {(r.provider, r.day): (r.n, r.i, r.n, r.i + r.n) for r in rows.groupBy("provider", "day").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i")).collect()}
    assert totals(store) == want
