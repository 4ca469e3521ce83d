"""Run archives: zip files with a log for each job at the top and a folder of step logs for each job.

An archive's directory is read first, as a table with a row for each member: where it lies, how long it is, and what job and
step it belongs to. Matching of names is a join over that table, and only members that were asked for are then inflated, each
from its own bytes. Archives are written the same way round: rows of members, gathered by archive.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.provider import archive_name

#: Names that are shorter were not cut by the writer of an archive, so they must be equal.
CUT_NAME = 80
#: Archives whose members a task has as Python objects at a time.
SLICE = 64
_LOCAL_HEADER = struct.Struct("<4s5H3I2H")
INDEX = "path string, ord int, entry string, place long, packed_bytes long, text_bytes long, method int, crc long, error string"


def pack(members: DataFrame) -> DataFrame:
    """(path, content): a zip archive for each path of members(path, ord, entry, text), its members in the order of ord, then entry.

    An archive is one value, so its members must fit in a task. A null text is an empty member.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, text in frame.sort_values(["ord", "entry"])[["entry", "text"]].itertuples(index=False):
                # a fixed date, so that equal members make equal archives
                z.writestr(zipfile.ZipInfo(entry), text or "", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    return members.select("path", "ord", "entry", "text").groupBy("path").applyInPandas(run, "path string, content binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few archives at a time: a batch may have ten thousand, and Python objects made of all of them would lie beside it."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)
        del batch
        # Workers live on after their tasks; what Arrow keeps for later is memory that others want.
        pa.default_memory_pool().release_unused()


def index(archives: DataFrame) -> DataFrame:
    """A row for each member of archives(path, content), from their directories alone: ord, entry, place and size of its bytes, and

    folder (before the first slash, null at the top), job (what stands after the number in a log at the top), step (the number
    of a log in a folder). Folders themselves have rows, too. An archive that can't be read, or is null, has one row, with an error.
    """

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _slices(batches):
            rows = []
            for path, content in zip(*(few.column(c).to_pylist() for c in range(2)), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content if content is not None else b"")) as z:
                        rows += [(path, i, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, None) for i, m in enumerate(z.infolist())]
                except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = archives.select("path", "content").mapInArrow(run, INDEX)
    entry = F.col("entry")
    inside = F.contains(entry, F.lit("/"))
    job = F.when(~inside & entry.rlike(r"^\d+_[^\n]+\.txt\z"), F.regexp_extract(entry, r"^\d+_([^\n]+)\.txt\z", 1))
    step = F.when(inside & F.endswith(entry, F.lit(".txt")), F.nullif(F.regexp_extract(entry, r"(?s)^[^/]*/(\d{1,9})_", 1), F.lit("")).cast("int"))
    return rows.select("*", F.when(inside, F.substring_index(entry, "/", 1)).alias("folder"), job.alias("job"), step.alias("step"))


def matched(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted(path, job, ...) with name: the one of names(path, name) that is the job's, null if none is.

    An equal name wins; else the longest of those that were cut, which the job's name begins with. Equal names are found by an
    equi-join, cut ones by a join on their first CUT_NAME characters, so no name meets all others of its archive.
    """
    target = archive_name(F.col("job"))
    head = F.when(F.length(target) >= CUT_NAME, F.left(target, F.lit(CUT_NAME)))
    keyed = wanted.withColumns({"target": target, "head": head})
    names = names.where("name IS NOT NULL AND name <> ''").select(F.col("path").alias("p"), "name").distinct()
    exact = keyed.join(names, (F.col("path") == F.col("p")) & (F.col("target") == F.col("name")), "left").drop("p")
    cut = names.where(F.length("name") >= CUT_NAME).select("p", F.col("name").alias("long"), F.left("name", F.lit(CUT_NAME)).alias("h"))
    jobs = keyed.select("path", "job", "target", "head").distinct()
    longest = jobs.join(cut, (F.col("path") == F.col("p")) & (F.col("head") == F.col("h")) & F.startswith("target", "long"))
    longest = longest.groupBy("path", "job").agg(F.max_by("long", F.length("long")).alias("cut_name"))
    same = (exact["path"] == longest["path"]) & exact["job"].eqNullSafe(longest["job"])
    both = exact.join(longest, same, "left").select(*[exact[c] for c in wanted.columns], F.coalesce(exact["name"], longest["cut_name"]).alias("name"))
    return both


def job_entries(listed: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs(path, job) with the member of index() that holds the job's log; nulls where none does. Of equal names the last counts."""
    top = listed.where("job IS NOT NULL").groupBy("path", "job").agg(F.max_by(F.struct("entry", "place", "packed_bytes", "text_bytes", "method", "crc"), "ord").alias("member"))
    top = top.select("path", F.col("job").alias("name"), "member")
    found = matched(jobs.select("path", "job"), top.select("path", "name"))
    return found.join(top, ["path", "name"], "left").select("path", "job", "member.*")


def step_entries(listed: DataFrame, steps: DataFrame) -> DataFrame:
    """steps(path, job, step) with the member that holds that step's log: of the job's folder, the first with the number."""
    folders = listed.where("folder IS NOT NULL")
    logs = folders.where("step IS NOT NULL").groupBy("path", "folder", "step").agg(F.min_by(F.struct("entry", "place", "packed_bytes", "text_bytes", "method", "crc"), "ord").alias("member"))
    found = matched(steps.select("path", "job", "step"), folders.select("path", F.col("folder").alias("name")))
    logs = logs.withColumnRenamed("folder", "name")
    return found.join(logs, ["path", "name", "step"], "left").select("path", "job", "step", "member.*")


def member_bytes(content: bytes, place: int, packed_bytes: int, text_bytes: int, method: int, crc: int) -> bytes:
    """A member of an archive, inflated from its own bytes; ValueError if they aren't what the directory says."""
    head = _LOCAL_HEADER.unpack_from(content, place)
    if head[0] != b"PK\x03\x04" or head[2] & 1:
        raise ValueError("no member begins there" if head[0] != b"PK\x03\x04" else "the member is encrypted")
    begin = place + _LOCAL_HEADER.size + head[9] + head[10]
    packed = content[begin : begin + packed_bytes]
    if method == zipfile.ZIP_STORED:
        text = packed
    elif method == zipfile.ZIP_DEFLATED:
        try:
            text = zlib.decompressobj(-zlib.MAX_WBITS).decompress(packed)
        except zlib.error as e:
            raise ValueError(str(e)) from e
    else:
        raise ValueError(f"compression method {method} is unknown")
    if len(text) != text_bytes or zlib.crc32(text) != crc:
        raise ValueError("the member's length or checksum differs from the directory")
    return text


def opened(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (of job_entries() or step_entries()) with text, and error where a member can't be read; no member, no text.

    Bytes that are no UTF-8 are replaced. The members that are wanted of an archive go to it as one array, so its content is
    read once; no other member is inflated.
    """
    where = ["entry", "place", "packed_bytes", "text_bytes", "method", "crc"]
    kinds = "array<struct<" + ",".join(f"{c}:{dict(entries.dtypes)[c]}" for c in where) + ">>"
    wanted = entries.where("entry IS NOT NULL").groupBy("path").agg(F.collect_set(F.struct(*where)).cast(kinds).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _slices(batches):
            rows = []
            for path, content, members in zip(*(few.column(c).to_pylist() for c in range(3)), strict=True):
                for m in members:
                    try:
                        rows.append((path, m["place"], member_bytes(content, *(int(m[c]) for c in where[1:])).decode("utf-8", "replace"), None))
                    except (ValueError, struct.error) as e:
                        rows.append((path, m["place"], None, str(e)))
            kinds = {"path": pa.string(), "place": pa.int64(), "text": pa.string(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    held = archives.select("path", "content").join(wanted, "path").select("path", "content", "members")
    texts = held.mapInArrow(run, "path string, place long, text string, error string")
    return entries.drop(*where[2:]).join(texts, ["path", "place"], "left").drop("place")


def job_logs(archives: DataFrame, jobs: DataFrame) -> DataFrame:
    """(path, job, entry, text, error) for each row of jobs(path, job): the job's log, null where its archive has none."""
    return opened(archives, job_entries(index(archives), jobs))


def step_logs(archives: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, job, step, entry, text, error) for each row of steps(path, job, step): the step's log, null where there is none."""
    return opened(archives, step_entries(index(archives), steps))

