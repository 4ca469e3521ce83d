"""Curation of cases: caps, selection without repeats, adjudication, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from emberline import registry
from emberline.functions.text import strip
from emberline.operators.classify import signal
from emberline.sources.cases import referenced_files
from emberline.sources.ordered import ordered_digest
from emberline.sources.workspace import new_path

PREFERENCE = ["failure", "timed_out", "cancelled"]


def failed_job(jobs: DataFrame) -> DataFrame:
    """The job of each run that counts as failed: failure before timed_out before cancelled, then the first; runs without any go."""
    places = F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), F.col("conclusion"))
    some = jobs.withColumn("preference", places).where("preference > 0")
    fields = F.struct(*[F.col(c) for c in jobs.columns if c != "run_id"])
    return some.groupBy("run_id").agg(F.min_by(fields, F.struct("preference", "ordinal")).alias("job")).select("run_id", "job.*")


def capped(rows: DataFrame, group: str, cap: int, ordinal: str = "ordinal", limit: int | None = None) -> DataFrame:
    """The first rows of each group in the order of ordinal, at most cap; then the first limit of all of them."""
    order = Window.partitionBy(group).orderBy(ordinal)
    kept = rows.withColumn("place_in_group", F.row_number().over(order)).where(F.col("place_in_group") <= cap).drop("place_in_group")
    return kept if limit is None else kept.orderBy(ordinal).limit(limit)


def select_new(catalogue: DataFrame, existing: DataFrame, cap: int, limit: int | None = None) -> DataFrame:
    """New rows of catalogue(tag, repo, bug, ordinal): neither their tag nor their bug exists, one for each bug, and at most cap
    for each repository, what exists counted in; then the first limit.

    existing(tag, repo, bug). Rows with a null bug go: they name no test. A bug belongs to its repository, so taking the first
    row of each bug and then capping repositories gives what a loop over the catalogue would.
    """
    fresh = catalogue.where("bug IS NOT NULL").join(existing.select("tag").distinct(), "tag", "left_anti").join(existing.select("repo", "bug").distinct(), ["repo", "bug"], "left_anti")
    first = fresh.groupBy("repo", "bug").agg(F.min_by("tag", "ordinal").alias("tag"), F.min("ordinal").alias("ordinal"))
    had = existing.groupBy("repo").agg(F.count("*").alias("had"))
    order = Window.partitionBy("repo").orderBy("ordinal")
    kept = first.withColumn("k", F.row_number().over(order)).join(had, "repo", "left").where(F.col("k") + F.coalesce("had", F.lit(0)) <= cap).select("tag", "repo", "bug", "ordinal")
    return kept if limit is None else kept.orderBy("ordinal").limit(limit)


def shared_culprits(a: Column, b: Column) -> Column:
    """a's paths in a's order that b has as well, white space around them aside."""
    other = F.transform(b, strip)
    return F.filter(a, lambda p: F.array_contains(other, strip(p)))


def tri_state(told: Column) -> Column:
    return F.when(told == "true", True).when(told == "false", False)


def reconcile(annotations: DataFrame, evidence: DataFrame | None = None, root: str = "") -> DataFrame:
    """(slug, agreed, failure_class, subcategory, related_to_diff, culprit_files, confidence, review) of two annotators, a and b.

    annotations: slug, annotator, failure_class, subcategory, related (true, false or unknown), confidence, culprit_files. They
    agree if class, subcategory and relation are equal and evidence(slug), where given, has the slug; the lesser confidence counts. The rest is
    for review, which says why, and where below root the evidence of a slug should be; empty where they agree.
    """
    fields = ["failure_class", "subcategory", "related", "confidence", "culprit_files"]
    side = lambda who: annotations.where(F.col("annotator") == who).select("slug", F.struct(*fields).alias(who))
    both = side("a").join(side("b"), "slug", "full")
    if evidence is None:
        both = both.withColumn("stored", F.lit(True))
    else:
        both = both.join(evidence.select("slug", F.lit(True).alias("stored")).distinct(), "slug", "left").na.fill(False, ["stored"])
    key = lambda who: F.concat_ws("/", *[F.col(f"{who}.{f}") for f in fields[:3]])
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    equal = F.col("a.failure_class").eqNullSafe(F.col("b.failure_class")) & F.col("a.subcategory").eqNullSafe(F.col("b.subcategory")) & F.col("a.related").eqNullSafe(F.col("b.related"))
    review = (
        F.when(~whole, F.concat("slug", F.lit(": one annotation is missing")))
        .when(~equal, F.concat("slug", F.lit(": A said "), key("a"), F.lit(", B said "), key("b")))
        .when(~F.col("stored"), F.concat("slug", F.lit(": evidence missing from " + (root.rstrip("/") + "/" if root else "")), "slug"))
        .otherwise("")
    )
    agreed = review == ""
    only = lambda c: F.when(agreed, c)
    return both.select("slug", agreed.alias("agreed"), only(F.col("a.failure_class")).alias("failure_class"), only(F.col("a.subcategory")).alias("subcategory"), only(tri_state(F.col("a.related"))).alias("related_to_diff"), only(shared_culprits(F.col("a.culprit_files"), F.col("b.culprit_files"))).alias("culprit_files"), only(F.least("a.confidence", "b.confidence")).alias("confidence"), review.alias("review"))


def existing_cases(cases: DataFrame) -> DataFrame:
    """(tag, repo, bug) of the cases that a data set has: what select_new() leaves out and counts. Cases without a repository go.

    tag is what stands after the last colon of the image, null without one.
    """
    image, repo = F.coalesce(F.col("verification.docker_image"), F.lit("")), F.coalesce(F.col("inputs.repo"), F.lit(""))
    tests = F.array_sort(F.filter(F.coalesce(F.col("ground_truth.failing_tests"), F.array().cast("array<string>")), lambda t: t != ""))
    tag = F.when(F.contains(image, F.lit(":")), F.substring_index(image, ":", -1))
    return cases.where(repo != "").select(tag.alias("tag"), repo.alias("repo"), F.struct(repo.alias("repo"), tests.alias("tests")).alias("bug"))


def repo_counts(existing: DataFrame) -> DataFrame:
    return existing.groupBy("repo").agg(F.count("*").alias("n"))


def good_entries(catalogue: DataFrame, wanted: dict = registry.QUALITY) -> DataFrame:
    """Entries of a catalogue whose fields, nested ones by dots, have all the values wanted."""
    for field, value in wanted.items():
        catalogue = catalogue.where(F.col(field) == F.lit(value))
    return catalogue


def candidates(runs: DataFrame) -> DataFrame:
    """What is kept of runs(repo, run_id, run_attempt, head_sha, workflow_name, html_url, conclusion, rerun_passed, job struct<name,
    steps array<struct<name, conclusion>>>): the failed job, its first failed step, and the signal."""
    names = F.transform(F.filter("job.steps", lambda x: x["conclusion"] == "failure"), lambda x: x["name"])
    told = signal(F.col("conclusion"), F.col("run_attempt"), F.col("rerun_passed"), names)
    return runs.select("repo", "run_id", "run_attempt", "head_sha", "workflow_name", F.col("job.name").alias("failed_job"), F.get(names, F.lit(0)).alias("failed_step"), "html_url", told.alias("signal"))


def case_ids(agreed: DataFrame, prefix: str = "gm", first: int = 1) -> DataFrame:
    """agreed with case_id: numbers in the order of slug, from `first` on.

    Slugs are sorted in ranges over all tasks; a range's rows are numbered in its task, after the counts of the ranges before. So no
    task sees all slugs. The sorted rows are written once, below spark.checkpoint.dir, so that both uses see the same ranges.
    """
    spark, path = agreed.sparkSession, new_path(agreed.sparkSession, "case-ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    agreed.repartitionByRange(n, "slug").sortWithinPartitions("slug").withColumn("case_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    # Spark numbers rows by partition, in the upper bits, and place.
    part, place = F.shiftright("case_place", 33), F.col("case_place").bitwiseAND(2**33 - 1)
    before = Window.orderBy("case_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("case_part")).agg(F.count("*").alias("n"))  # a row for each task of the sort
    sizes = sizes.select("case_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("case_before"))
    numbered = placed.withColumn("case_part", part).join(F.broadcast(sizes), "case_part")
    return numbered.withColumn("case_id", F.format_string(f"{prefix}-%04d", F.col("case_before") + place + first)).drop("case_part", "case_place", "case_before")


def trusted(provenance: Column) -> Column:
    n, agree = F.coalesce(provenance["independent_adjudications"], F.lit(0)), F.coalesce(provenance["adjudicators_agreeing"], F.lit(0))
    return F.coalesce(provenance["verified_by_human"], F.lit(False)) | ((n >= 2) & (agree == n))


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the columns, each with its length before it, so that no two rows of values run together."""
    parts = [F.concat(F.coalesce(F.octet_length(c.cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def in_key_order(column: Column, kind: DataType) -> Column:
    """A struct with its fields, and theirs, in the order of their names."""
    if isinstance(kind, StructType):
        fields = [in_key_order(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: in_key_order(x, kind.elementType))
    return column


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a JSON object: keys in order, no white space, nulls told, ASCII only."""
    kind = df.select(*columns).schema
    fields = [in_key_order(F.col(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
    json = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    lower = json
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # escapes in lower case, unless their back slash is itself escaped
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    json = F.when(json.rlike(r"\\u00(0[BEF]|1[A-F])"), lower).otherwise(json)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.floor((code - 0x10000) / 0x400) + 0xD800, (code - 0x10000) % 0x400 + 0xDC00
        return F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    signs = F.array_distinct(F.split(F.regexp_replace(json, r"[\x00-\x7E]+", ""), ""))
    plain = F.aggregate(signs, json, lambda text, c: F.when(c == "", text).otherwise(F.replace(text, c, escaped(c))))
    return F.when(json.rlike(r"[^\x00-\x7E]"), plain).otherwise(json)


def case_blocks(cases: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(case_id, block) of load_cases(): what each case adds to the data set's digest: its canonical JSON, then each file that it
    names by name and digest, in the order of names, each ended by a NUL. Without files(path, text) only the JSON."""
    names = ["schema_version", "case_id", "title", "inputs", "ground_truth", "provenance", "verification", "tags"]
    none = F.array().cast("array<string>")
    or_ = lambda c, field, value: c.withField(field, F.coalesce(c[field], value))
    inputs = or_(or_(F.col("inputs"), "provider", F.lit("github_actions")), "run_attempt", F.lit(1))
    truth = or_(or_(F.col("ground_truth"), "culprit_files", none), "failing_tests", none)
    origin = F.col("provenance")
    for field, value in (("verified_by_human", F.lit(False)), ("notes", F.lit("")), ("independent_adjudications", F.lit(0)), ("adjudicators_agreeing", F.lit(0))):
        origin = or_(origin, field, value)
    bare = F.from_json(F.lit("{}"), cases.schema["verification"].dataType)
    check = or_(or_(or_(F.coalesce("verification", bare), "method", F.lit("none")), "setup_commands", none), "timeout_seconds", F.lit(600))
    whole = cases.withColumns({"schema_version": F.coalesce("schema_version", F.lit(1)), "inputs": inputs, "ground_truth": truth, "provenance": origin, "verification": check, "tags": F.coalesce("tags", none)})
    blocks = whole.select("case_id", F.concat(canonical_json(whole, names), F.lit("\0")).alias("block"))
    if files is None:
        return blocks
    named = cases.select("case_id", F.explode(referenced_files()).alias("file"), "folder").withColumn("path", F.concat("folder", F.lit("/"), "file"))
    told = named.join(files.select("path", F.sha2("text", 256).alias("digest")), "path").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("file", "digest"))).alias("told"))
    text = F.array_join(F.transform("told", lambda f: F.concat(f["file"], f["digest"], F.lit("\0"))), "")
    return blocks.join(told, "case_id", "left").select("case_id", F.concat("block", F.coalesce(text, F.lit(""))).alias("block"))


def content_hash(blocks: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: dataset_hash, 12 hex digits of the SHA-256 of blocks(key, block) one after the other in the order of key.

    The digest is a fold over all blocks, so one task reads them in order, a megabyte at a time; bucketed_hash() has no such task.
    All that is before, making the blocks and sorting them, is spread over tasks, and no task holds more than a range of them.
    """
    return ordered_digest(blocks, [key], "block").select(F.left("digest", F.lit(12)).alias("dataset_hash"))


def manifest(cases: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: schema_version, dataset_hash, case_count, cases array<struct<case_id, failure_class, source, tags>> by case_id."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    entry = F.struct("case_id", F.col("ground_truth.failure_class").alias("failure_class"), F.col("provenance.source").alias("source"), tags.alias("tags"))
    listed = cases.agg(F.count("*").alias("case_count"), F.array_sort(F.collect_list(entry)).alias("cases"))
    digest = content_hash(case_blocks(cases, files))
    return digest.crossJoin(F.broadcast(listed)).select(F.lit(1).alias("schema_version"), "dataset_hash", "case_count", "cases")


def manifest_lines(cases: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(ord, case_id, value): the manifest's text by lines, in the order of ord, then case_id: a head, as many lines as a case
    has for each of them in one row, and a foot. Nothing holds all cases: they can be sorted and written one after the other."""
    told = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    listed = F.when(F.size(tags) == 0, "[]").otherwise(F.concat(F.lit("[\n        "), F.array_join(F.transform(tags, told), ",\n        "), F.lit("\n      ]")))
    fields = [F.concat(F.lit(f'      "{name}": '), told(F.col(c))) for name, c in (("case_id", "case_id"), ("failure_class", "ground_truth.failure_class"), ("source", "provenance.source"))]
    entry = F.concat(F.lit("    {\n"), F.concat_ws(",\n", *fields, F.concat(F.lit('      "tags": '), listed)), F.lit("\n    }"))
    # One row: how many cases there are, and which is the last, after which no comma stands.
    counts = cases.agg(F.count("*").alias("case_count"), F.max("case_id").alias("last"))
    head = content_hash(case_blocks(cases, files)).crossJoin(F.broadcast(counts))
    texts = [F.lit('{\n  "schema_version": 1'), F.concat(F.lit('  "dataset_hash": '), told(F.col("dataset_hash"))), F.concat(F.lit('  "case_count": '), F.col("case_count").cast("string"))]
    begin = F.concat(F.concat_ws(",\n", *texts), F.lit(',\n  "cases": ['), F.when(F.col("case_count") == 0, "]\n}").otherwise(""))
    first = head.select(F.lit(0).alias("ord"), F.lit("").alias("case_id"), begin.alias("value"))
    end = counts.where("case_count > 0").select(F.lit(2).alias("ord"), F.lit("").alias("case_id"), F.lit("  ]\n}").alias("value"))
    each = cases.join(F.broadcast(counts), F.lit(True)).select(F.lit(1).alias("ord"), "case_id", F.concat(entry, F.when(F.col("case_id") == F.col("last"), "").otherwise(",")).alias("value"))
    return first.unionByName(each).unionByName(end)


def manifest_text(row: DataFrame) -> DataFrame:
    """(value): a manifest as its file has it: two spaces a level, line feeds, one at the end."""
    told = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    listed = lambda items, pad: F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit(f"[\n{pad}  "), F.array_join(items, f",\n{pad}  "), F.lit(f"\n{pad}]")))

    def entry(c: Column) -> Column:
        fields = [F.concat(F.lit(f'      "{f}": '), told(c[f])) for f in ("case_id", "failure_class", "source")]
        tags = F.concat(F.lit('      "tags": '), listed(F.transform(c["tags"], told), "      "))
        return F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields, tags), F.lit("\n    }"))

    head = [F.concat(F.lit('  "schema_version": '), F.col("schema_version").cast("string")), F.concat(F.lit('  "dataset_hash": '), told(F.col("dataset_hash"))), F.concat(F.lit('  "case_count": '), F.col("case_count").cast("string"))]
    cases = F.concat(F.lit('  "cases": '), listed(F.transform("cases", entry), "  "))
    return row.select(F.concat(F.lit("{\n"), F.concat_ws(",\n", *head, cases), F.lit("\n}\n")).alias("value"))


def bucketed_hash(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: dataset_hash, 12 hex digits, the same in whatever order rows come; repeated rows count as often as they are there.

    Each row's key and digest are hashed; the hashes' eight numbers of 32 bits are summed over all rows, and the sums are hashed. Sums come
    together from all tasks, so nothing is gathered or sorted.
    """
    each = rows.select(F.sha2(F.concat_ws("\0", F.col(key).cast("string"), F.col(digest)), 256).alias("h"))
    lanes = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(f"s{i}") for i in range(8)]
    sums = F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(8)])
    return each.agg(*lanes).select(F.left(F.sha2(sums, 256), F.lit(12)).alias("dataset_hash"))
