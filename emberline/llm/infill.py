"""Fill-in-the-middle: a text's pieces in another order, so that a model learns to write what stands between two others.

A text becomes an array of code points. Neighbours of different class, as the unit has them, are boundaries; two boundaries, chosen
by numbers from a hash of doc_id, cut it into prefix, middle and suffix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_slices

#: Texts whose pieces are sent on together, in bytes.
SLICE_BYTES = 1 << 20
#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("character", "word", "line")
_WHITE = np.zeros(0x3001, bool)
_WHITE[[c for c in range(0x3001) if chr(c).isspace()]] = True


def check_markers(markers: tuple[str, str, str]) -> None:
    """ValueError unless a text without the markers can always be told from them: none is empty, holds another, or ends as one begins."""
    for i, a in enumerate(markers):
        for k, b in enumerate(markers):
            if not a or (i != k and a in b) or any(a[n:] == b[: len(a) - n] for n in range(1, len(a))):
                raise ValueError(f"markers {markers} can be mistaken for each other")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; where two neighbours have the same, no boundary lies between them.

    character: every code point is a unit. word: a run of white space goes with the run before it. line: a line feed ends a unit.
    """
    if unit == "character":
        return np.arange(len(points)) & 1
    if unit == "line":
        ends = points == 0x0A
    else:
        white = _WHITE[np.minimum(points, 0x3000)] & (points <= 0x3000)
        ends = white & ~np.append(white[1:], True)
    return np.concatenate([[0], np.cumsum(ends[:-1])]) if len(points) else np.zeros(0, np.int64)


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of a text begin and, last, its end: n + 1 places of n units."""
    kind = classes(points, unit)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def numbers(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of 8 hex digits of the sha256 of seed:doc_id; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(raw: bytes, draw: tuple[int, int, int, int], unit: str, keep_percent: int, spm_percent: int, marks: tuple[bytes, ...]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of a text in UTF-8."""
    points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    at = boundaries(points, unit)
    n = len(at) - 1
    if not n or any(m in raw for m in marks) or draw[2] % 100 >= keep_percent:
        return n, "plain", None, None, raw
    low, high = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    a, b = int(at[low]), int(at[high])
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le").encode() for x, y in ((0, a), (a, b), (b, len(points))))
    p, s, m = marks
    if draw[3] % 100 < spm_percent:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, *, unit: str = "character", seed: int = 1, keep_percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs(doc_id, text).

    n counts the text's units. form is psm (prefix, suffix, middle), spm (suffix first) or plain: the text as it is, for empty texts, those that hold
    a marker, and all but keep_percent of a hundred. The prefix ends after as many units as the smaller of two numbers drawn from 0 to n, the middle
    after the larger; either may be empty. prefix_chars and middle_chars are code points, null for plain texts.

    A null text is an empty one. Repeated rows are done alike; rows of one doc_id draw the same numbers, and a null doc_id draws as an empty one. Other columns are
    left out. Nothing is shuffled; a task holds the texts of an Arrow batch and the code points of one text.
    """
    check_markers(markers)
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    marks = tuple(m.encode() for m in markers)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", SLICE_BYTES):
            raw, ids = data.tobytes(), rows.column(0).to_pylist()
            out = [(i, *rearranged(raw[a:b], numbers(i, seed), unit, keep_percent, spm_percent, marks)) for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f.name == "output" else f.type).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of: what stands between its markers, in the order of the text."""
    cut = F.split(output, "|".join(re.escape(m) for m in markers))

    def joined(piece: Column) -> Column:  # in a lambda, so that a row is cut once
        return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).otherwise(F.concat(piece[2], piece[3], piece[1]))

    return F.when(form == "plain", output).otherwise(F.transform(F.array(cut), joined)[0])


def digests(docs: DataFrame, **options) -> DataFrame:
    """fill_in_middle() with the sha256 of the output and of the text restored from it, in their place."""
    markers = options.get("markers", MARKERS)
    done = fill_in_middle(docs, **options)
    text = restored(F.col("output"), F.col("form"), markers)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
