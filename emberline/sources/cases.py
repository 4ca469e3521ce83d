"""Readers and writers: case folders, attempts, controls, manifests, scorecards, run archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.text import normalize_line_breaks, sanitized_name

CASE = """schema_version INT, case_id STRING, title STRING,
  inputs STRUCT<provider STRING, repo STRING, run_id BIGINT, run_attempt INT, head_sha STRING, pr_number BIGINT, failed_job_name STRING, failed_step_name STRING, log_files ARRAY<STRING>, diff_file STRING, workflow_file STRING, passing_run_log STRING>,
  ground_truth STRUCT<failure_class STRING, subcategory STRING, related_to_diff BOOLEAN, culprit_files ARRAY<STRING>, failing_tests ARRAY<STRING>, fix_commit_sha STRING, fix_summary STRING>,
  provenance STRUCT<source STRING, labeling_method STRING, verified_by_human BOOLEAN, verified_date DATE, original_url STRING, snapshot_date DATE, notes STRING, independent_adjudications INT, adjudicators_agreeing INT>,
  verification STRUCT<method STRING, docker_image STRING, setup_commands ARRAY<STRING>, test_command STRING, no_new_breaks_command STRING, timeout_seconds INT>,
  tags ARRAY<STRING>"""
ATTEMPT = "case_id STRING, attempted BOOLEAN, level STRING, skip_reason STRING, detail STRING, evidence STRING, localized BOOLEAN, needed_repair BOOLEAN, edit_notes STRING"
LEVELS = ["nothing", "applies", "lints", "failing_test_passes", "nothing_else_broke"]


def load_cases(spark: SparkSession, path: str, subset: str | None = None) -> DataFrame:
    """Cases of all case.json files below path, with folder, in the order of case_id; subset None or 'smoke', else ValueError.

    An id that several folders have is an error in a data set: ValueError, too.
    """
    if subset not in (None, "smoke"):
        raise ValueError(f"no such subset: {subset}")
    rows = spark.read.schema(CASE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "case.json").json(path)
    rows = rows.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/case\\.json$", ""))
    again = repeated_ids(rows).limit(1).collect()
    if again:
        raise ValueError(f"duplicate case id {again[0].case_id}")
    return (rows if subset is None else rows.where(F.array_contains("tags", "smoke"))).orderBy("case_id")


def repeated_ids(cases: DataFrame) -> DataFrame:
    """(case_id, n) of ids that more than one folder has: an error in a data set."""
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def misplaced(cases: DataFrame) -> DataFrame:
    """Cases whose folder isn't named like them."""
    return cases.where(F.element_at(F.split("folder", "/"), -1) != F.col("case_id")).select("case_id", "folder")


def referenced_files(inputs: Column | None = None) -> Column:
    """All files that a case names: its logs, then diff, workflow and passing log where told."""
    i = F.col("inputs") if inputs is None else inputs
    return F.array_compact(F.concat(F.coalesce(i["log_files"], F.array().cast("array<string>")), F.array(i["diff_file"], i["workflow_file"], i["passing_run_log"])))


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its folder: absolute, or with more steps up than down at some point."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    low = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")), lambda a: a["low"])
    return F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z]:") | (low < 0)


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text): whole files below path as UTF-8 with line feeds only; bytes that are none are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path"), normalize_line_breaks(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def missing_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, file) that a case names and files(path) doesn't have."""
    named = cases.select("case_id", F.explode(referenced_files()).alias("file"), "folder").withColumn("path", F.concat("folder", F.lit("/"), "file"))
    return named.join(files.select("path"), "path", "left_anti").select("case_id", "file")


def case_logs(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, log): a case's log files one after the other in the order told, a line feed between."""
    named = cases.select("case_id", "folder", F.posexplode("inputs.log_files").alias("pos", "file")).withColumn("path", F.concat("folder", F.lit("/"), "file"))
    parts = named.join(files, "path").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    return parts.select("case_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("log"))


def case_diffs(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, diff): null where a case names none."""
    named = cases.select("case_id", F.concat("folder", F.lit("/"), "inputs.diff_file").alias("path"))
    return named.join(files, "path", "left").select("case_id", F.col("text").alias("diff"))


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Attempts of all JSON files below path that have some; level as 0 to 4, null and unknown ones as 0."""
    rows = spark.read.schema(f"attempts ARRAY<STRUCT<{ATTEMPT.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN')}>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    a = rows.select(F.explode("attempts").alias("a")).select("a.*")
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower("level"))
    no = F.lit(False)
    return a.withColumn("level", F.coalesce(F.when(level > 0, (level - 1).cast("int")), F.when(F.col("level").rlike("^[0-4]$"), F.col("level").cast("int")), F.lit(0))).withColumns({c: F.coalesce(c, no) for c in ("attempted", "localized", "needed_repair")})


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """Control rows of all JSON files below path that have both cases and n_usable."""
    case = "STRUCT<case_id: STRING, usable: BOOLEAN, reference_level: STRING, corrupted_level: STRING, reason: STRING, detail: STRING>"
    rows = spark.read.schema(f"n_usable INT, cases ARRAY<{case}>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.where("cases IS NOT NULL AND n_usable IS NOT NULL").select(F.explode("cases").alias("c")).select("c.*")


def unmeasurable(controls: DataFrame) -> DataFrame:
    return controls.where(~F.coalesce("usable", F.lit(False))).select("case_id").distinct()


def read_scorecards(spark: SparkSession, path: str) -> DataFrame:
    """(git_sha, model, prompt_hash, dataset_hash, subset, case rows): a row for each case of each scorecard below path."""
    case = "STRUCT<case_id: STRING, truth_class: STRING, predicted_class: STRING, correct: BOOLEAN, subcategory_correct: BOOLEAN, related_to_diff_correct: BOOLEAN, localization_rank: INT, latency_ms: DOUBLE, error: STRING>"
    rows = spark.read.schema(f"git_sha STRING, model STRING, prompt_hash STRING, dataset_hash STRING, subset STRING, per_case ARRAY<{case}>").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.where("per_case IS NOT NULL").withColumn("c", F.explode("per_case")).select("git_sha", "model", "prompt_hash", "dataset_hash", "subset", "c.*")


def write_scorecards(cards: DataFrame, path: str) -> None:
    """Cards as Parquet by model and prompt, with the file name that a single card would have."""
    cards.withColumn("file_name", sanitized_name(F.col("git_sha"), F.col("model"), F.col("prompt_hash"))).write.mode("append").partitionBy("model", "prompt_hash").parquet(path)


MANIFEST = "schema_version INT, dataset_hash STRING, case_count BIGINT, cases ARRAY<STRUCT<case_id: STRING, failure_class: STRING, source: STRING, tags: ARRAY<STRING>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The row of a manifest file; ValueError if it is none."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    if rows.where("dataset_hash IS NULL OR case_count IS NULL OR cases IS NULL").count() or rows.isEmpty():
        raise ValueError(f"{path} is no manifest")
    return rows


def write_manifest(text: DataFrame, path: str) -> None:
    """manifest_text(), or manifest_lines() in their order, as one file in a new folder. A line ends each row, so one task writes row after row."""
    if "ord" in text.columns:
        text.repartition(1).sortWithinPartitions("ord", "case_id").select("value").write.text(path)
    else:
        text.select(F.regexp_replace("value", "\\n$", "")).coalesce(1).write.text(path)


def archive_logs(archives: DataFrame) -> DataFrame:
    """(path, entry, text): text files in zip archives(path, content); an archive that can't be read has one row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, n, z.read(n).decode("utf-8", "replace"), None) for n in sorted(z.namelist()) if n.endswith(".txt")]
                except zipfile.BadZipFile as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "entry", "text", "error"])

    return archives.select("path", "content").mapInPandas(run, "path string, entry string, text string, error string")
