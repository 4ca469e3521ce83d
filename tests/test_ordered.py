"""Digests over texts in their order, of which no task holds all."""

import hashlib

from pyspark.sql import functions as F

from emberline.functions import provider
from emberline.sources import ordered


def test_digest_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_RANGE", 4000)
    rows = spark.range(2000, numPartitions=5).select(F.format_string("k%05d", (F.col("id") * 7919) % 2000).alias("k"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("t"))
    texts = [r.t or "" for r in rows.orderBy("k").collect()]
    got = ordered.ordered_digest(rows, ["k"], "t")
    assert got.first().digest == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("rangepartitioning")[-1]
    assert ordered.ordered_digest(rows.limit(0), ["k"], "t").first().digest == hashlib.sha256(b"").hexdigest()


def test_combined_hash_gathers_no_prompts(spark):
    told = [("b", "2"), ("a", "1"), ("a", "1"), (None, "3"), ("c", None), ("a", "0")]
    rows = spark.createDataFrame(told, "name string, content_hash string")
    got = provider.combined_hash(rows)
    assert got.first()[0] == hashlib.sha256(b"a:0|a:1|a:1|b:2").hexdigest()[:12]
    assert "collect_list" not in got._jdf.queryExecution().analyzed().toString()
    assert provider.combined_hash(rows.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()[:12]
