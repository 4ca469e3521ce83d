"""Column builders over what hosting APIs, containers, archives and prompt files give. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import bound, strip
from emberline.sources.ordered import ordered_digest

STEP = "struct<number:int,name:string,conclusion:string>"
JOB_PAYLOAD = f"struct<id:bigint,name:string,conclusion:string,steps:array<{STEP}>>"


def conclusion(raw: Column) -> Column:
    """One of the seven conclusions; others and null are null."""
    return F.when(raw.isin(registry.CONCLUSIONS), raw)


def job(payload: Column) -> Column:
    """struct(job_id, name, conclusion, steps) of a job's JSON."""
    p = F.from_json(payload, JOB_PAYLOAD)
    steps = F.transform(F.coalesce(p["steps"], F.array().cast(f"array<{STEP}>")), lambda s: F.struct(s["number"].alias("number"), s["name"].alias("name"), conclusion(s["conclusion"]).alias("conclusion")))
    return F.struct(p["id"].alias("job_id"), p["name"].alias("name"), conclusion(p["conclusion"]).alias("conclusion"), steps.alias("steps"))


def workflow_name(name: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(path, F.lit("")), F.lit(""))


def failed_steps(steps: Column) -> Column:
    return F.filter(steps, lambda s: s["conclusion"] == "failure")


def pull_of_commit(pulls: DataFrame) -> DataFrame:
    """(sha, number): of each commit's pulls(sha, ordinal, number, state) the first open one, else the first."""
    return pulls.groupBy("sha").agg(F.min_by("number", F.struct((F.col("state") != "open").alias("closed"), "ordinal")).alias("number"))


def archive_name(job_name: Column) -> Column:
    """A job's name as archives spell it."""
    return F.translate(job_name, "/:", "  ")


def best_match(candidates: Column, target: Column, least: int = 80) -> Column:
    """The candidate that equals target, else the longest of at least `least` characters that target begins with; null if none."""
    cut = F.filter(candidates, lambda c: (F.length(c) >= least) & F.startswith(target, c))
    longest = F.array_max(F.transform(cut, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    return F.when(F.array_contains(candidates, target), target).otherwise(longest)


def layout(line: Column) -> Column:
    """struct(root, project) of a line of key=value words."""
    words = F.filter(F.split(strip(line), r"\s+"), lambda w: F.contains(w, F.lit("=")) & ~F.startswith(w, F.lit("log=")))
    value = lambda ws, key: F.coalesce(F.regexp_replace(F.element_at(F.concat(F.array(F.lit(f"{key}=")), F.filter(ws, lambda w: F.startswith(w, F.lit(f"{key}=")))), -1), f"^{key}=", ""), F.lit(""))
    return bound(words, lambda ws: F.struct(value(ws, "root").alias("root"), value(ws, "project").alias("project")))


def normalized_diff_paths(diff: Column, root: Column, project: Column) -> Column:
    """A diff of two folders of a container with a/ and b/ paths in its header lines; all other lines stay as they are."""
    side = lambda name: F.concat(root, F.lit(f"/{name}/"), project, F.lit("/"))

    def rest(line: Column, folder: Column) -> Column:
        return F.split(line, F.concat(F.lit("\\Q"), folder, F.lit("\\E")), 2)[1]

    def rewrite(line: Column, bare: Column, failed: Column, passed: Column) -> Column:
        name = F.regexp_extract(rest(bare, failed), r"^\s*(\S+)", 1)
        return (
            F.when(F.startswith(bare, F.lit("--- ")) & F.contains(bare, failed), F.concat(F.lit("--- a/"), F.substring_index(rest(bare, failed), "\t", 1)))
            .when(F.startswith(bare, F.lit("+++ ")) & F.contains(bare, passed), F.concat(F.lit("+++ b/"), F.substring_index(rest(bare, passed), "\t", 1)))
            .when(F.startswith(bare, F.lit("diff ")) & F.contains(bare, failed), F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name))
            .otherwise(line)
        )

    known = (F.coalesce(root, F.lit("")) != "") & (F.coalesce(project, F.lit("")) != "")
    rewritten = lambda f: F.transform(F.split(diff, "\n"), lambda line: bound(F.regexp_replace(line, r"\r\z", ""), lambda bare: rewrite(line, bare, f["failed"], f["passed"])))
    folders = F.struct(side("failed").alias("failed"), side("passed").alias("passed"))
    return F.when(known, F.array_join(bound(folders, rewritten), "\n")).otherwise(diff)


def apply_result(returncode: Column, output: Column, marker: str) -> Column:
    """struct(applied, needed_repair, build_passed, apply_output): the last line with the marker says whether a patch went in.

    After the marker stands 0 if it applied, 2 if it did after repair. apply_output is what was printed right before it.
    """
    lines = F.split(output, r"\r\n|\n|\r")
    at = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit(marker)), i)), lambda i: i.isNotNull()))
    code = strip(F.substring(F.get(lines, at), len(marker) + 1, 1 << 20))
    applied = F.coalesce(code.isin("0", "2"), F.lit(False))
    first = F.greatest(at - registry.APPLY_OUTPUT_LINES, F.lit(0))
    before = F.when(at > 0, strip(F.array_join(F.slice(lines, first + 1, at - first), "\n"))).otherwise("")
    return F.struct(applied.alias("applied"), F.coalesce(code == "2", F.lit(False)).alias("needed_repair"), (applied & (returncode == 0)).alias("build_passed"), F.coalesce(before, F.lit("")).alias("apply_output"))


def verification(result: Column, output: Column) -> Column:
    """struct(level, detail, evidence) of an apply_result: nothing 0, applies 1, nothing else broke 4."""
    n = F.lit(registry.OUTPUT_TAIL_CHARS)
    suffix = F.when(result["needed_repair"], " after repairing its hunk headers").otherwise("")
    row = lambda level, detail, evidence: F.struct(F.lit(level).alias("level"), detail.alias("detail"), evidence.alias("evidence"))
    return (
        F.when(~result["applied"], row(0, F.lit("patch does not apply"), F.right(result["apply_output"], n)))
        .when(~result["build_passed"], row(1, F.concat(F.lit("patch applies"), suffix, F.lit(" but the build still fails")), F.right(output, n)))
        .otherwise(row(4, F.concat(F.lit("the original job passes with the patch applied"), suffix), F.right(output, n)))
    )


def content_hash(text: Column) -> Column:
    """12 hex digits of a prompt's text, whatever its line ends and outer white space."""
    return F.left(F.sha2(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))), 256), F.lit(12))


def combined_hash(prompts: DataFrame) -> DataFrame:
    """One row: combined_hash of prompts(name, content_hash), in the order of name. Rows with a null name or hash are none.

    Pairs stand one after the other with a bar between: each but the first has one before it, so they can be digested range by range.
    """
    known = prompts.where("name IS NOT NULL AND content_hash IS NOT NULL").select("name", "content_hash")
    first = known.agg(F.min(F.struct("name", "content_hash")).alias("first"))  # of equal pairs any may be the first, so they are counted
    counted = known.groupBy("name", "content_hash").agg(F.count("*").alias("n"))
    pair = F.concat("name", F.lit(":"), "content_hash")
    again = F.repeat(F.concat(F.lit("|"), pair), (F.col("n") - 1).cast("int"))
    lead = F.when(F.struct("name", "content_hash") == F.col("first"), "").otherwise("|")
    told = counted.join(F.broadcast(first), F.lit(True)).select("name", "content_hash", F.concat(lead, pair, again).alias("pair"))
    return ordered_digest(told, ["name", "content_hash"], "pair").select(F.left("digest", F.lit(12)).alias("combined_hash"))


def prompt(raw: Column) -> Column:
    """struct(meta map, body, content_hash) of a prompt file with a front matter block; null without one, an id or a body."""
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    entry = lambda x: F.struct(F.regexp_extract(x, "^([a-z_]+):", 1).alias("k"), F.regexp_replace(strip(F.regexp_replace(x, r"^[a-z_]+:", "")), "^[\"']+|[\"']+$", "").alias("v"))
    # of a repeated key the last counts
    last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))

    def parts(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.regexp_extract(text, pattern, 1), "\n"), strip), lambda x: x.rlike(r"^[a-z_]+:"))
        meta = bound(F.transform(lines, entry), lambda entries: F.map_from_entries(last(entries)))
        return F.struct(meta.alias("meta"), strip(F.regexp_extract(text, pattern, 2)).alias("body"))

    told = lambda p: F.when(F.map_contains_key(p["meta"], "id") & (p["body"] != ""), F.struct(p["meta"].alias("meta"), p["body"].alias("body"), content_hash(p["body"]).alias("content_hash")))
    return bound(F.replace(raw, F.lit("\r\n"), F.lit("\n")), lambda text: F.when(text.rlike(pattern), bound(parts(text), told)))


#: Parts of a template: an escaped brace, a placeholder, text, and a brace that stands alone.
_PARTS = r"\{\{|\}\}|\{[A-Za-z_][A-Za-z_0-9]*\}|[^{}]+|[{}]"


def placeholders(body: Column) -> Column:
    """The different names that a template wants values for, in the order in which they first stand in it."""
    names = F.filter(F.regexp_extract_all(body, F.lit(_PARTS), F.lit(0)), lambda p: F.startswith(p, F.lit("{")) & (F.length(p) > 2))
    return F.array_distinct(F.transform(names, lambda p: F.regexp_replace(p, "[{}]", "")))


def template_error(body: Column, names: list[str]) -> Column:
    """What keeps a template from being rendered with values of these names; null if nothing does."""
    parts = F.regexp_extract_all(body, F.lit(_PARTS), F.lit(0))
    missing = F.filter(placeholders(body), lambda n: ~n.isin(names)) if names else placeholders(body)
    alone = F.exists(parts, lambda p: p.isin("{", "}"))
    return F.when(alone, "a brace stands alone").when(F.size(missing) > 0, F.concat(F.lit("the template needs a value for "), F.array_join(missing, ", ")))


def rendered_prompt(body: Column, values: dict[str, Column]) -> Column:
    """A template with its {placeholders} replaced, in one pass: braces in values are text, and doubled ones in the template are single.

    A placeholder without a value, or a brace that stands alone, fails the job with its name; template_error() tells beforehand. A null value, where it is used, makes the
    text null; values that no placeholder wants are let be.
    """
    parts = F.regexp_extract_all(body, F.lit(_PARTS), F.lit(0))

    def filled(p: Column) -> Column:
        out = F.when(p == "{{", "{").when(p == "}}", "}")
        for name, value in values.items():
            out = out.when(p == "{" + name + "}", value)
        return out.otherwise(p)

    lost = F.lit(False)  # array_join would leave nulls out
    for name, value in values.items():
        lost = lost | (F.array_contains(parts, "{" + name + "}") & value.isNull())
    error = template_error(body, list(values))
    text = F.array_join(F.transform(parts, filled), "")
    return F.when(error.isNotNull(), F.raise_error(error)).when(~lost, text)


def without_sensitive(attributes: Column) -> Column:
    """A map without keys that may hold secrets."""
    markers = F.array(*[F.lit(m) for m in registry.SENSITIVE_KEYS])
    return F.map_filter(attributes, lambda k, v: ~F.exists(markers, lambda m: F.contains(F.lower(k), m)))


def error_message(body: Column) -> Column:
    """The message of a JSON error payload, else the beginning of the body."""
    return F.coalesce(F.get_json_object(body, "$.message"), F.left(body, F.lit(registry.PREVIEW_CHARS)))


def retry_delay(status: Column, retry_after: Column, longest: float = 30.0) -> Column:
    """Seconds until a refused request is worth another try; null if the response is final or doesn't say when."""
    seconds = retry_after.try_cast("double")
    told = F.when(seconds.isNotNull(), F.least(F.greatest(seconds, F.lit(0.0)), F.lit(longest)))
    return F.when(status.isin(500, 502, 503, 504), F.lit(1.0)).when(status.isin(403, 429), told)


def updated(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """cases(case_id, tags, notes, verified_by_human) after decisions(case_id, smoke, note): a tag and a note are added, once."""
    d = decisions.select("case_id", F.col("smoke").alias("d_smoke"), F.col("note").alias("d_note"))
    joined = cases.join(d, "case_id", "left")
    tags = F.when(F.col("d_smoke"), F.array_union("tags", F.array(F.lit("smoke")))).otherwise(F.col("tags"))
    notes = F.when(F.col("d_note").isNull(), F.col("notes")).otherwise(F.concat_ws("\n", F.nullif("notes", F.lit("")), "d_note"))
    return joined.withColumns({"tags": tags, "notes": notes, "verified_by_human": F.coalesce("verified_by_human", F.lit(False)) | F.col("d_note").isNotNull()}).drop("d_smoke", "d_note")


def latest_manifest_differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two manifests of the same columns hold different rows."""
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
