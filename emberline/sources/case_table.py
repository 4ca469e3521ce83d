"""Stored cases, parted by a hash of their id, and decisions that are merged into them.

A merge reads and writes only the parts that a decision changes; the files of all others stay as they are. What is written is first staged
beside the table, so that a part is never read while it is replaced, and a merge that is made again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.workspace import new_path

PART = "case_part"
#: case_id, and what a decision says; null leaves a field as it is. adjudicators and agreeing count those who were asked and who agree.
DECISION = "case_id string, failure_class string, subcategory string, related_to_diff boolean, adjudicators int, agreeing int, human boolean, verified_date date, note string"


def store(cases: DataFrame, path: str, parts: int = 64) -> None:
    """Write cases in `parts` parts by a hash of case_id."""
    part = (F.crc32(F.col("case_id").cast("binary")) % parts).cast("int")
    # Spark deals large parts to several tasks and small ones together to one, so that a task's rows don't grow with the table.
    cases.withColumn(PART, part).hint("rebalance", PART).write.partitionBy(PART).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decided(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """cases as load_cases() has them with what decisions say, and changed: whether a row is another now.

    Classes are replaced where told; counts of adjudicators come together. A person's word sets verified_by_human and the date. A note is added after those there are, once. All
    who were asked agreeing, or a person's word, adds the tag smoke, once. A decision on no case does nothing.
    """
    d = decisions.select(F.col("case_id").alias("d_id"), F.struct(*[c for c in decisions.columns if c != "case_id"]).alias("d"))
    t, p, v = F.col("ground_truth"), F.col("provenance"), F.col("d")
    truth = t
    for c in ("failure_class", "subcategory", "related_to_diff"):
        truth = truth.withField(c, F.coalesce(v[c], t[c]))
    notes = F.coalesce(p["notes"], F.lit(""))
    note = F.trim(F.coalesce(v["note"], F.lit("")))
    added = F.when((note == "") | F.contains(notes, note), p["notes"]).otherwise(F.trim(F.concat(notes, F.lit(" "), note)))
    counts = v["adjudicators"].isNotNull()
    human = F.coalesce(v["human"], F.lit(False))
    origin = (
        p.withField("independent_adjudications", F.when(counts, v["adjudicators"]).otherwise(p["independent_adjudications"]))
        .withField("adjudicators_agreeing", F.when(counts, v["agreeing"]).otherwise(p["adjudicators_agreeing"]))
        .withField("verified_by_human", F.when(human, True).otherwise(p["verified_by_human"]))
        .withField("verified_date", F.when(human, F.coalesce(v["verified_date"], p["verified_date"])).otherwise(p["verified_date"]))
        .withField("notes", added)
    )
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    smoke = human | F.coalesce(counts & (v["adjudicators"] == v["agreeing"]), F.lit(False))
    new_tags = F.when(smoke & ~F.array_contains(tags, "smoke"), F.array_append(tags, "smoke")).otherwise(F.col("tags"))
    told = F.col("d_id").isNotNull()
    joined = cases.join(d, F.col("case_id") == F.col("d_id"), "left")
    rows = joined.select("*", F.when(told, truth).otherwise(t).alias("n_truth"), F.when(told, origin).otherwise(p).alias("n_origin"), F.when(told, new_tags).otherwise(F.col("tags")).alias("n_tags"))
    changed = ~(F.col("n_truth").eqNullSafe(t) & F.col("n_origin").eqNullSafe(p) & F.col("n_tags").eqNullSafe(F.col("tags")))
    replaced = {"ground_truth": "n_truth", "provenance": "n_origin", "tags": "n_tags"}
    return rows.select(*[F.col(replaced[c]).cast(cases.schema[c].dataType).alias(c) if c in replaced else F.col(c) for c in cases.columns], changed.alias("changed"))


def merge(spark: SparkSession, path: str, decisions: DataFrame, parts: int = 64) -> dict[str, int]:
    """Merge decisions into the cases stored at path: rows changed, parts rewritten, and decisions on no case.

    ValueError if two decisions are on one case. parts is the number that store() was given. The driver sees numbers of parts only.
    """
    twice = decisions.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two decisions on case {twice[0].case_id}")
    part = (F.crc32(F.col("case_id").cast("binary")) % parts).cast("int")
    touched = [r[0] for r in decisions.where("case_id IS NOT NULL").select(part).distinct().collect()]
    cases = stored(spark, path).where(F.col(PART).isin(touched))
    staging = new_path(spark, "case-merge")
    decided(cases, decisions).write.partitionBy(PART).parquet(staging)
    staged = spark.read.schema(cases.withColumn("changed", F.lit(True)).schema).parquet(staging)
    changes = {r[PART]: r["n"] for r in staged.where("changed").groupBy(PART).agg(F.count("*").alias("n")).collect()}
    unmatched = decisions.join(staged.select("case_id"), "case_id", "left_anti").count()
    if changes:
        rows = staged.where(F.col(PART).isin(list(changes))).drop("changed").select(*stored(spark, path).columns)
        rows.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return {"changed": sum(changes.values()), "parts": len(changes), "unmatched": unmatched}
