"""Column builders over log text, paths, URLs, tags and JSON. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import registry


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once a row. Else each mention of a column is computed anew, within lambdas for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_bom(raw: Column) -> Column:
    return F.regexp_replace(raw, "^﻿", "")


def normalize_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_timestamps(text: Column) -> Column:
    """Drops ISO timestamps with the space after them at the start of lines; lines end with a line feed only."""
    return F.regexp_replace(text, r"(?md)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z ", "")


def strip_ansi(text: Column) -> Column:
    """Drops terminal control sequences: CSI ones, and OSC ones up to BEL or ST."""
    return F.regexp_replace(text, "\u001b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\u0007\u001b]*(?:\u0007|\u001b\\\\))", "")


def clean_log(raw: Column) -> Column:
    return strip_ansi(strip_timestamps(normalize_line_breaks(strip_bom(raw))))


def split_lines(log: Column) -> Column:
    """Lines between line feeds; one trailing empty line is dropped, and an empty log has none."""
    return bound(log, lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")))


def line_groups(line: Column) -> Column:
    """Ordinals of the pattern groups that a line matches, in order of priority."""
    hits = [F.when(line.rlike("(?U)(?:" + "|".join(patterns) + ")"), F.lit(i)) for i, (_, patterns) in enumerate(registry.PATTERN_GROUPS)]
    return F.array_compact(F.array(*hits))


def first_rule(log: Column, fallback: tuple[str, str] = registry.FALLBACK) -> Column:
    """struct(failure_class, subcategory, matched) of the first rule found in the whole log, lines starting after line feeds."""
    rule = lambda c, s, m: F.struct(F.lit(c).alias("failure_class"), F.lit(s).alias("subcategory"), F.lit(m).alias("matched"))
    out = None
    for failure_class, subcategory, pattern in registry.RULES:
        hit = log.rlike(f"(?Umd){pattern}")
        out = F.when(hit, rule(failure_class, subcategory, True)) if out is None else out.when(hit, rule(failure_class, subcategory, True))
    return out.otherwise(rule(*fallback, False))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(strip(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def parse_run_url(url: Column) -> Column:
    """struct(repo, run_id, attempt) of an Actions run URL, white space around it aside; null if it is none.

    run_id is a decimal of up to 38 digits. attempt is null where it isn't told.
    """
    pattern = r"(?U)^https://github\.com/([^/\s]+/[^/\s]+)/actions/runs/([0-9]+)(?:/attempts/([0-9]+))?(?:/job/[0-9]+)?/?(?:[?#]\S*)?\z"
    bare = strip(url)
    attempt = F.nullif(F.regexp_extract(bare, pattern, 3), F.lit(""))
    told = F.struct(F.regexp_extract(bare, pattern, 1).alias("repo"), F.regexp_extract(bare, pattern, 2).try_cast("decimal(38,0)").alias("run_id"), attempt.try_cast("long").alias("attempt"))
    return F.when(bare.rlike(pattern), told)


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*", "")


def extract_json(text: Column) -> Column:
    """The JSON object of an answer: the body of the first fenced block, else the text; of that all, if it begins with a brace,
    else from the first brace to the last, else all. White space around it goes."""
    fence = r"(?s)```(?:json)?(?U:\s*)(.*?)```"
    body = strip(F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text))
    braced = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.startswith(body, F.lit("{")), body).otherwise(F.coalesce(F.nullif(braced, F.lit("")), body))


def parse_tag(tag: Column) -> Column:
    """struct(slug, job_id) of `slug-123`; null otherwise."""
    pattern = r"^(.+)-(\d{1,18})$"
    return F.when(tag.rlike(pattern), F.struct(F.regexp_extract(tag, pattern, 1).alias("slug"), F.regexp_extract(tag, pattern, 2).cast("long").alias("job_id")))


def repo_name_from_slug(slug: Column) -> Column:
    """What stands after the first hyphen, else all."""
    rest = F.regexp_extract(slug, r"(?s)^[^-]*-(.+)", 1)
    return F.when(rest != "", rest).otherwise(slug)


def parse_failing_tests(text: Column) -> Column:
    """Non-empty trimmed names between # signs."""
    return F.filter(F.transform(F.split(text, "#"), strip), lambda t: t != "")


def bug_key(repo: Column, tests: Column) -> Column:
    """A repository and its sorted failing tests: not distinct, not trimmed."""
    return F.struct(repo.alias("repo"), F.array_sort(F.filter(F.split(tests, "#"), lambda t: t != "")).alias("tests"))


def is_setup_step(name: Column) -> Column:
    lowered = F.lower(name)
    out = F.contains(lowered, F.lit(registry.SETUP_MARKERS[0]))
    for marker in registry.SETUP_MARKERS[1:]:
        out = out | F.contains(lowered, F.lit(marker))
    return out


def stated_retry_seconds(body: Column) -> Column:
    """Seconds that an error payload asks to wait; null if it doesn't."""
    return F.regexp_extract(body, r'"retryDelay"\s*:\s*"?([0-9.]+)s?"?', 1).try_cast("double")


def server_wait_seconds(header: Column, body: Column) -> Column:
    """Seconds that a server asks to wait, by its Retry-After header, else by the payload; at most 75, null if it doesn't say or is negative."""
    told = F.regexp_replace(strip(header), "s$", "").try_cast("double")
    seconds = F.when(header.isNotNull(), told).otherwise(stated_retry_seconds(body))
    return F.when(seconds >= 0, F.least(seconds, F.lit(registry.MAX_WAIT_SECONDS)))


def truncated(text: Column, limit: int, marker: str) -> Column:
    """text, or its first limit characters and a line with the marker."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("\n" + marker))).otherwise(text)


def prompt_diff(diff: Column) -> Column:
    """A diff as a prompt shows it: at most 8,000 characters; it says so if there is none."""
    return F.when(F.coalesce(diff, F.lit("")) == "", F.lit(registry.NO_DIFF)).otherwise(truncated(diff, registry.MAX_DIFF_CHARS, "...[diff truncated]"))


def prompt_files(contents: Column) -> Column:
    """Files of a map as a prompt shows them: each under its path, at most 12,000 characters; it says so if there are none."""
    block = lambda e: F.concat(F.lit("--- "), e["key"], F.lit(" ---\n"), truncated(e["value"], registry.MAX_FILE_CHARS, "...[truncated]"))
    return F.when(F.coalesce(F.size(contents), F.lit(0)) <= 0, F.lit(registry.NO_FILES)).otherwise(F.array_join(F.transform(F.map_entries(contents), block), "\n\n"))


def quote_evidence(evidence: Column, limit: int = 3, chars: int = 300) -> Column:
    """The first lines of evidence as a block quote that they can't leave: one line each, without back ticks, cut."""
    none = F.lit(f"> {registry.NO_EVIDENCE}")

    def quoted(e: Column) -> Column:
        safe = F.left(strip(F.translate(e, "\r\n`", "  '")), F.lit(chars))
        return F.when(safe != "", F.concat(F.lit("> "), safe)).otherwise(none)

    return F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, none).otherwise(F.array_join(F.transform(F.slice(evidence, 1, limit), quoted), "\n"))


def sanitized_name(git_sha: Column, model: Column, prompt_hash: Column) -> Column:
    """A scorecard's file name."""
    return F.concat(F.concat_ws("-", git_sha, F.regexp_replace(model, r"[/\\:]", "-"), prompt_hash), F.lit(".json"))


def allowed_repos(setting: Column) -> Column:
    return F.filter(F.transform(F.split(setting, ","), lambda r: F.lower(strip(r))), lambda r: r != "")


def may_write(repo: Column, setting: Column) -> Column:
    """Exact membership; an empty list refuses all."""
    return F.array_contains(allowed_repos(setting), F.lower(strip(repo)))
