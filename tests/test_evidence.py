"""Lines out of long logs, against the same of logs that are one text each."""

import random

from pyspark.sql import functions as F

from emberline.operators import evidence, patches


def logs():
    draw = random.Random(3)
    return {f"log{k}": [draw.choice(["user 7 x", "  user 7\t", "other", "it's", "", "y" * 200 + " user 7"]) for _ in range(n)] for k, n in enumerate([1, 2, 19, 200, 201, 650])}


def frames(spark):
    held = logs()
    lines = spark.createDataFrame([(k, i + 1, line) for k, ls in held.items() for i, line in enumerate(ls)], "log_id string, n int, line string").repartition(5)
    return lines, spark.createDataFrame([(k, "\n".join(ls)) for k, ls in held.items()], "log_id string, log string")


def test_ranges(spark):
    lines, whole = frames(spark)
    pairs = [(1, 1), (1, 3), (5, 900), (199, 200), (200, 401), (201, 400), (9, 2), (0, 5), (-3, 2), (10**6, 10**6), (1, 10**6), (400, 650)]
    wanted = whole.select("log_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("first"), F.lit(b).alias("last")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("log_id", "r.*")
    got = {(r.log_id, r.ord): r.text for r in evidence.ranges(lines, wanted).collect()}
    want = {(r.log_id, r.ord): r.text for r in wanted.join(whole, "log_id").select("log_id", "ord", patches.log_range(F.col("log"), F.col("first"), F.col("last")).alias("text")).collect()}
    assert got == want and len(got) == len(pairs) * 6
    assert evidence.ranges(lines, wanted.withColumn("log_id", F.lit("gone"))).where("ord = 0").first().text.startswith("[lines 1-1 of 1]")


def test_searches(spark):
    lines, whole = frames(spark)
    needles = ["user 7", "it's", "nothing 'of' \"this\"", ""]
    got = {(r.log_id, r.ord): r.text for r in evidence.search_texts(lines, needles).collect()}
    for i, needle in enumerate(needles):
        want = {r.log_id: r.text for r in whole.select("log_id", patches.search_report(F.col("log"), F.lit(needle)).alias("text")).collect()}
        assert {k: t for (k, o), t in got.items() if o == i + 1} == want
