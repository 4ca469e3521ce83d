"""Patch and diff text: what is touched, how much, policy checks, evidence reads, header repair. Per-row array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.provider import layout, normalized_diff_paths
from emberline.functions.text import bound, parse_tag, strip, truncated

#: All line ends that Python's splitlines knows.
ANY_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def all_lines(text: Column) -> Column:
    """Lines by any line end, without the empty one after a last end; none of an empty text."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return bound(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(bound(F.split(t, ANY_LINE_END), cut)))


def touched_paths(patch: Column) -> Column:
    """Paths after `+++ `, first met first: without what follows a tab, without b/, and without /dev/null."""
    return _paths(all_lines(patch))


def _paths(lines: Column) -> Column:
    heads = F.filter(lines, lambda line: F.startswith(line, F.lit("+++ ")))
    paths = F.transform(heads, lambda line: F.regexp_replace(F.substring_index(strip(F.substring(line, 5, 1 << 20)), "\t", 1), "^b/", ""))
    return F.array_distinct(F.filter(paths, lambda p: p != "/dev/null"))


def changed_line_count(patch: Column) -> Column:
    return _changed(all_lines(patch))


def _changed(lines: Column) -> Column:
    changed = lambda x: (F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))) | (F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---")))
    return F.size(F.filter(lines, changed))


def find_secret(text: Column) -> Column:
    """The first pattern of the list that is found; null if none."""
    out = F.lit(None).cast("string")
    for pattern in reversed(registry.SECRET_PATTERNS):
        out = F.when(text.rlike(pattern), F.lit(pattern)).otherwise(out)
    return out


def check_patch(patch: Column, failure_class: Column) -> Column:
    """Why a patch is refused, the first of: empty, too many files, too many lines, a secret, a workflow edit; null if it isn't."""

    def refusal(p: Column) -> Column:
        workflow = F.exists(p["paths"], lambda x: F.startswith(x, F.lit(".github/workflows/")))
        return (
            F.when(strip(patch) == "", "empty")
            .when(F.size(p["paths"]) > registry.MAX_PATCH_FILES, "too_many_files")
            .when(p["changed"] > registry.MAX_PATCH_LINES, "too_many_lines")
            .when(find_secret(patch).isNotNull(), "secret")
            .when(workflow & (failure_class != "pipeline_config"), "workflow_edit")
        )

    told = lambda lines: F.struct(_paths(lines).alias("paths"), _changed(lines).alias("changed"))
    return bound(bound(all_lines(patch), told), refusal)


def normalize_patch(patch: Column) -> Column:
    """Line feeds only, and one at the end; a patch of white space only stays as it is."""
    ended = lambda flat: F.when(F.endswith(flat, F.lit("\n")), flat).otherwise(F.concat(flat, F.lit("\n")))
    return bound(patch, lambda p: F.when(strip(p) == "", p).otherwise(bound(F.regexp_replace(p, r"\r\n?", "\n"), ended)))


_HEADER = r"diff --git a/(\S+) b/(\S+)$"


def diff_paths(diff: Column) -> Column:
    """New paths of `diff --git` headers, first met first; none of a null diff."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(diff, F.lit("")), F.lit(f"(?Umd)^{_HEADER}"), F.lit(2)))


def listed_files(diff: Column) -> Column:
    """diff_paths() as text, a line each; it says so if there are none."""
    return bound(diff_paths(diff), lambda paths: F.when(F.size(paths) > 0, F.array_join(paths, "\n")).otherwise(f"{registry.NOT_FOUND}: this case carries no diff"))


def diff_section(diff: Column, path: Column, limit: int = registry.MAX_SECTION_CHARS) -> Column:
    """The part of a diff from a file's header to the next one, cut with a marker; a text that says so if there is none."""
    parts = F.filter(F.split(diff, f"(?Umd)(?=^{_HEADER})"), lambda p: F.regexp_extract(p, f"(?Umd)\\A{_HEADER}", 2) == path)
    own = bound(F.get(parts, F.lit(0)), lambda part: truncated(part, limit, "...[hunk truncated]"))
    missing = F.concat(F.lit(f"{registry.NOT_FOUND}: "), path, F.lit(" is not in the diff"))
    return F.when(F.coalesce(diff, F.lit("")) == "", f"{registry.NOT_FOUND}: this case carries no diff").otherwise(F.coalesce(own, missing))


def log_range(log: Column, start: Column, end: Column, cap: int = registry.MAX_RANGE_LINES) -> Column:
    """Lines start to end, 1-based and inclusive, at most cap of them, under a header; it says so if the cap cut some off."""
    lines = F.split(log, "\n")
    total = F.size(lines)
    capped = F.least(end, start + (cap - 1))
    last = F.least(capped, total)
    head = F.concat(F.lit("[lines "), start.cast("string"), F.lit("-"), last.cast("string"), F.lit(" of "), total.cast("string"), F.when(capped < end, " (truncated)").otherwise(""), F.lit("]\n"))
    outside = F.concat(F.lit(f"{registry.NOT_FOUND}: the log has lines 1 to "), total.cast("string"))
    inside = (start >= 1) & (start <= total)
    body = F.when(inside, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(last - start + 1, F.lit(0))), "\n"))
    return F.when(inside, F.concat(head, body)).otherwise(outside)


def quoted(text: Column) -> Column:
    """text between quotes as reports write it: single ones, double ones if it has single ones only; line ends as escapes."""
    flat = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, told in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        flat = F.replace(flat, F.lit(raw), F.lit(told))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), flat, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(flat, F.lit("'"), F.lit("\\'")), F.lit("'")))


def search_report(log: Column, needle: Column, limit: int = 20) -> Column:
    """search_log() as text: `number: line` for each hit shown, then how many more there are; it says so if there are none."""
    found = search_log(log, needle, limit)
    shown = F.array_join(F.transform(found["hits"], lambda h: F.concat(h["n"].cast("string"), F.lit(": "), h["line"])), "\n")
    more = F.when(found["more"] > 0, F.concat(F.lit("\n..."), found["more"].cast("string"), F.lit(" more matches"))).otherwise("")
    return F.when(F.size(found["hits"]) > 0, F.concat(shown, more)).otherwise(F.concat(F.lit(f"{registry.NOT_FOUND}: no line contains "), quoted(needle)))


def search_log(log: Column, needle: Column, limit: int = 20, chars: int = 160) -> Column:
    """struct(hits array<struct<n, line>>, more): lines with a literal text, the first ones trimmed and cut, and how many more."""
    found = F.filter(F.transform(F.split(log, "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.left(strip(x), F.lit(chars)).alias("line"), F.contains(x, needle).alias("hit"))), lambda x: x["hit"])
    hits = F.transform(F.slice(found, 1, limit), lambda x: F.struct(x["n"], x["line"]))
    return F.struct(hits.alias("hits"), F.greatest(F.size(found) - limit, F.lit(0)).alias("more"))


def corrupted(patch: Column, sentinel: str = "control_line_that_does_not_exist") -> Column:
    """A patch whose first context or removed line can't be found any more: the sentinel stands for what it said.

    Lines end with a line feed, the last one too.
    """
    eligible = lambda x: (F.startswith(x, F.lit(" ")) | F.startswith(x, F.lit("-"))) & ~F.startswith(x, F.lit("--- ")) & ~F.startswith(x, F.lit("-- "))
    # the first line's place is looked for once a patch, not once a line
    place = lambda lines: F.array_position(F.transform(lines, eligible), True)
    told = lambda lines, first: F.transform(lines, lambda x, i: F.when(i + 1 == first, F.concat(F.left(x, F.lit(1)), F.lit(sentinel))).otherwise(x))
    return F.concat(F.array_join(bound(all_lines(patch), lambda lines: bound(place(lines), lambda first: told(lines, first))), "\n"), F.lit("\n"))


def resolve_path(path: Column, known: Column) -> Column:
    """The known path that is meant; null if none or several could be.

    A known path itself is meant. Of others, separators are slashes and one ./, then one a/, then one b/ in front goes; what is
    left is a known path, or the end of one after a slash.
    """
    slashes = lambda c: F.translate(c, "\\", "/")
    wanted = F.regexp_replace(slashes(path), r"^(\./)?(a/)?(b/)?", "")
    meant = F.filter(known, lambda k: F.endswith(F.concat(F.lit("/"), slashes(k)), F.concat(F.lit("/"), wanted)))
    return F.when(F.array_contains(known, path), path).when(F.size(meant) == 1, F.get(meant, F.lit(0)))


def sections(text: Column, marker: str = r"=====CI_(\w+)=====") -> Column:
    """map<name, text> of a text cut by marker lines; names in lower case, texts with their line ends. Of a repeated name the last
    counts; what stands before the first goes. A marker line may have white space around the marker."""
    line = rf"[ \t\r]*{marker}[ \t\r]*(?:\n|\z)"
    parts = F.filter(F.split(text, rf"(?md)(?=^{line})"), lambda p: p.rlike(rf"\A{line}"))
    entry = lambda p: F.struct(F.lower(F.regexp_extract(p, rf"\A{line}", 1)).alias("k"), F.regexp_replace(p, rf"\A{line}", "").alias("v"))
    last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return bound(F.transform(parts, entry), lambda entries: F.map_from_entries(last(entries)))


def artifact(tag: Column, output: Column) -> Column:
    """struct(slug, job_id, failing_log, fix_diff, culprit_files, error) of an image's tag and what its extraction printed.

    error says why it is no case: no log of the failing build, or a checkout that is the build's cache. It comes with nulls.
    """
    part = lambda found, name: F.coalesce(F.try_element_at(found, F.lit(name)), F.lit(""))

    def read(p: Column) -> Column:
        log, where = p["log"], p["layout"]
        told = F.concat(F.lit(" ("), F.when(where == "", "layout not reported").otherwise(where), F.lit(")"))
        error = F.when(log.isin("", "no log"), F.concat(tag, F.lit(" has no original build log"), told)).when(F.contains(where, F.lit("project=cacher")), F.concat(tag, F.lit(" resolved to the build cache, not a checkout"), told))
        return bound(error, lambda e: case(p, e))

    def case(p: Column, error: Column) -> Column:
        files = F.filter(F.transform(all_lines(p["files"]), strip), lambda x: x != "")
        diff = bound(layout(p["layout"]), lambda place: normalized_diff_paths(p["diff"], place["root"], place["project"]))
        only = lambda c: F.when(error.isNull(), c)
        return bound(parse_tag(tag), lambda name: F.struct(name["slug"].alias("slug"), name["job_id"].alias("job_id"), only(p["log"]).alias("failing_log"), only(diff).alias("fix_diff"), only(files).alias("culprit_files"), error.alias("error")))

    parts = lambda found: F.struct(strip(part(found, "log")).alias("log"), strip(part(found, "layout")).alias("layout"), part(found, "files").alias("files"), strip(part(found, "diff")).alias("diff"))
    return bound(sections(output), lambda found: bound(parts(found), read))
