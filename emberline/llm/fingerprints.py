"""Document fingerprints by randomised edit embedding: a walk over a text's characters, with steps that all texts share, maps
edit distance to Hamming distance; sampled bits of the walk are the fingerprint, bands of them find candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import shuffle_partitions, written
from emberline.llm.graph import link_sketched, small
from emberline.llm.shingles import mix

NULL_ID = -(2**63)
SAMPLES = 128
LEVELS = 40
PERIOD = 8192
SLICE_CHARS = 4 << 20
#: Below so many texts still walking, one text after the other is faster than all abreast.
FEW = 40
#: Of 64 sketched bits up to a reach, a pair alike by 0.8 differs in 8 where its edits lie worst, and in over 18 once in 8,000
#: times; an unlike pair in 30.
SKETCH_APART = 18
#: Of 128 bits, such a pair differs in 16, and in over 32 less than once in 20,000 times; an unlike pair in 60.
WIDE_APART = 32
#: Bands that are met first, so that groups of copies are connected before the others are.
FIRST_BANDS = 2
#: Fingerprints whose keys are made at once.
KEYED_ROWS = 2000


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """(sampled steps, steps each stands for): all of the first 128, then 128 of every doubling, at random in even strides."""
    steps, weights = [np.arange(SAMPLES)], [np.ones(SAMPLES, np.int64)]
    for level in range(LEVELS - 1):
        stride = 1 << level
        offset = (mix(np.arange(level * SAMPLES, (level + 1) * SAMPLES, dtype=np.uint64) + np.uint64(99991)) % np.uint64(stride)).astype(np.int64)
        steps.append(stride * (SAMPLES + np.arange(SAMPLES)) + offset)
        weights.append(np.full(SAMPLES, stride))
    return np.concatenate(steps), np.concatenate(weights)


STEPS, WEIGHTS = _steps()
_TOTALS = np.append(0, np.cumsum(WEIGHTS))
_FIRST_BITS = np.array([((1 << n) - 1) << (64 - n) for n in range(65)], np.uint64)
_FIXED = mix(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(7)).view(np.uint8)[::8].reshape(PERIOD, 256).copy() & 3
_FIXED[:, 0] = 0  # class 0 ends a text: no step goes past it
_ROWS = [r.tobytes() for r in _FIXED]
_CLASSES = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(5)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)


def classes(text: str) -> np.ndarray:
    """One of 255 classes for each code point; the first 65,536 by table, others by the same rule."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = _CLASSES[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = (mix(codes[high].astype(np.uint64) + np.uint64(5)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out


def embed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(steps until each text was walked through, sampled bits of each walk; bits from there on are 0).

    At step j a text's walk stands at a character and goes on to the next, or not, by a bit that is random in j and the
    character; a second such bit is what a sample keeps. Whole texts are walked: about two steps a character.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    chars = classes("".join(texts))
    ends = np.cumsum(lengths)
    buffer = np.insert(chars, ends, 0)
    at = ends - lengths + np.arange(len(texts))
    longest = int(lengths.max(initial=0))
    width = int(np.searchsorted(STEPS, 3 * longest + 4 * 64 + 64)) + 1
    bits = np.zeros((len(texts), width), np.uint8)
    walked = np.zeros(len(texts), np.int64)
    lanes = np.flatnonzero(lengths)
    at = at[lanes]
    step, k = 0, 0
    while len(lanes) > FEW:
        begun = at.copy()
        for j in range(step, step + 64):
            v = _FIXED[j % PERIOD][buffer[at]]
            if STEPS[k] == j:
                bits[lanes, k] = v >> 1
                k += 1
            at += v & 1
        over = buffer[at] == 0
        for i in np.flatnonzero(over):
            p, j = int(begun[i]), step
            while buffer[p]:
                p += _ROWS[j % PERIOD][buffer[p]] & 1
                j += 1
            walked[lanes[i]] = j
        lanes, at, step = lanes[~over], at[~over], step + 64
    if len(lanes):
        raw = buffer.tobytes()
        wanted = STEPS[: width + 1].tolist()
        for lane, p in zip(lanes.tolist(), at.tolist(), strict=True):
            j, i, out = step, k, bits[lane]
            c = raw[p]
            while c:
                v = _ROWS[j % PERIOD][c]
                if wanted[i] == j:
                    out[i] = v >> 1
                    i += 1
                if v & 1:
                    p += 1
                    c = raw[p]
                j += 1
            walked[lane] = j
    return walked, bits


def likeness(walked_a: np.ndarray, bits_a: np.ndarray, walked_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Share of the longer walk in which both are at equal characters, 0 to 1, for rows of walks.

    Bits of unequal characters agree half the time, so a differing bit stands for two such samples; where one walk is over,
    all differ. Two empty texts are alike.
    """
    width = bits_a.shape[1]
    steps, weights = STEPS[:width][None, :], WEIGHTS[:width][None, :]
    long, short = np.maximum(walked_a, walked_b)[:, None], np.minimum(walked_a, walked_b)[:, None]
    differs = np.where(steps < short, 2.0 * (bits_a != bits_b), 1.0) * weights
    within = steps < long
    total = (within * weights).sum(1)
    return np.clip(1 - (differs * within).sum(1) / np.maximum(total, 1), 0, 1)


def to_text(walked: int, bits: np.ndarray) -> str:
    """Walk length in hex, a dash, the samples within it in hex."""
    n = int(np.searchsorted(STEPS, walked))
    return f"{walked:x}-{np.packbits(bits[:n]).tobytes().hex()}"


def from_texts(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [f.split("-") for f in fingerprints]
    walked = np.array([int(p[0], 16) for p in parts], np.int64)
    width = 4 * max((len(p[1]) for p in parts), default=0) or 8
    raw = np.frombuffer(b"".join(bytes.fromhex(p[1]).ljust(width // 8, b"\0") for p in parts), np.uint8).reshape(len(parts), width // 8)
    return walked, np.unpackbits(raw, axis=1)


def fingerprint_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns as they are, and fingerprint, of every row's whole text; null counts as empty."""
    rest = [c for c in df.columns if c not in (text, "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            for part in _parts(texts):
                walked, bits = embed(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(rest)], pa.array([to_text(int(w), b) for w, b in zip(walked, bits, strict=True)], pa.string())], [*rest, "fingerprint"])

    out = df.select(*[F.col(f"`{c}`") for c in rest], F.col(text))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return out.mapInArrow(run, f"{schema}, fingerprint string")


def _parts(texts: list[str]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SLICE_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def compare_edited(docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text (rounded down, in code points) replaced by as many of the first of the next
    document, in descending order of doc_id, after the last the first; rows of one doc_id stand by their texts. A null
    text is empty, a null doc_id the smallest. A single document is its own next.

    Whole texts are shuffled once, into ranges of doc_id; in a range, rows meet their next one by one. Only the first and last
    row of each range go to a second, small step.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.repartitionByRange(n, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(ids: list[int], texts: list[str], following: list[str]) -> list[pa.Array]:
        edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following, strict=True)]
        count = len(texts)
        unique = [*texts, *[f for i, f in enumerate(following) if i + 1 >= count or f is not texts[i + 1]]]
        place = {id(t): i for i, t in enumerate(unique)}
        walked, bits = embed([*unique, *edited])
        own, new = np.arange(count), len(unique) + np.arange(count)
        after = np.array([place[id(f)] for f in following], np.int64)
        fingerprint = lambda at: [to_text(int(walked[i]), bits[i]) for i in at]
        near = lambda at: likeness(walked[own], bits[own], walked[at], bits[at])
        columns = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], fingerprint(own), fingerprint(new), near(new), near(after)]
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: tuple[int, str] | None = None
        head = None
        extra = [pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(texts):
                own_ids, own = ids[part], texts[part]
                if head is None:
                    head = own[0]
                if held is not None:
                    own_ids, own = [held[0], *own_ids], [held[1], *own]
                held = own_ids[-1], own[-1]
                if len(own) > 1:
                    done = compared(own_ids[:-1], own[:-1], own[1:])
                    yield pa.RecordBatch.from_arrays([*done, *(pa.nulls(len(own) - 1, k) for k in extra)], [*names, "part", "head", "last"])
        if held is not None:
            blank = [pa.nulls(1, k) for k in kinds[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), *blank, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([head]), pa.array([held[1]])], [*names, "part", "head", "last"])

    found = written(ranges.mapInArrow(run, f"{ddl}, part int, head string, last string"), "fingerprints")
    # One row for each range: its first and last text, and its place.
    edges = found.where("part IS NOT NULL").select("doc_id", "part", "head", "last")
    order = Window.orderBy("part")
    follows = edges.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    heads = edges.select(F.col("part").alias("next_part"), "head")
    edge_rows = edges.select("doc_id", "part", "last").join(follows, "part").join(heads, "next_part").select("doc_id", "last", "head")

    def run_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, last, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays(compared([doc_id], [last], [head]), names)

    out = found.where("part IS NULL").select(*names).unionByName(edge_rows.mapInArrow(run_edges, ddl))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


@dataclass(frozen=True)
class WalkLikeness:
    """likeness() of whole fingerprints of at least `least`."""

    least: float

    def alike(self, xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        walked, bits = from_texts([p.decode() for p in (*xs, *ys)])
        n = len(xs)
        return likeness(walked[:n], bits[:n], walked[n:], bits[n:]) >= self.least

    def among(self, payloads: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        """Of numbers x and ys of payloads, which of ys are alike to x. Payloads are read once; samples meet 64 at a time, as all of a word weigh the same."""
        parts = [p.split(b"-") for p in payloads]
        walked = np.array([int(p[0], 16) for p in parts], np.int64)
        width = max((len(p[1]) for p in parts), default=0) // 16 + 1
        words = np.frombuffer(b"".join(bytes.fromhex(p[1].decode()).ljust(8 * width, b"\0") for p in parts), ">u8").reshape(len(parts), width).astype(np.uint64)
        samples = np.searchsorted(STEPS, walked)
        total = _TOTALS[samples]
        masks = _FIRST_BITS[np.clip(samples[:, None] - 64 * np.arange(width), 0, 64)]
        weights = WEIGHTS[::64][:width]

        def alike(x: int, ys: np.ndarray) -> np.ndarray:
            both = np.bitwise_count((words[ys] ^ words[x]) & masks[ys] & masks[x]).astype(np.int64) @ weights
            differs = 2 * both + np.abs(total[ys] - total[x])
            return np.clip(1 - differs / np.maximum(np.maximum(total[ys], total[x]), 1), 0, 1) >= self.least

        return alike


def reaches(least: float, longest: int) -> np.ndarray:
    """Numbers of leading steps that walks are banded over, from 0 to beyond longest, each 1 / least of the one before or more.

    A walk is banded over the last reach within it and the one before. Of two walks alike by least, the shorter has at least
    that share of the longer's steps, so they have a reach in common.
    """
    out = [0, 1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] / least)))
    return np.array(out, np.int64)


def band_choice(classes_: int, least: float, missed: float) -> tuple[int, int]:
    """(bands, bits) for so many different fingerprints, so that a pair alike by least shares no band at most so often.

    Bits are few while buckets are small: unlike walks that share a key only meet by sketches, inside a task. Beyond a million
    fingerprints bits grow with the logarithm of the table, so that buckets don't. A pair alike by least differs in (1 - least) / 2 of
    the bits of the whole walk, and in 1 / least times that if all edits are within the reach.
    """
    bits = max(14, math.ceil(math.log2(max(classes_, 1))) - 6)
    hit = (1 - min(0.5, (1 - least) / 2 / least)) ** bits
    return max(1, math.ceil(math.log(missed) / math.log1p(-hit))), bits


def band_keys(walked: np.ndarray, sampled: np.ndarray, grid: np.ndarray, first: int, bands: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of bands first, first + 1 and so on of each walk, bands of them at each of two reaches; the sketch for each key).

    A key is of bits drawn with replacement from all steps up to the reach, each step by the sample that stands for it, so
    edits count by their share of the walk whether they are spread or in one passage. A sketch is 64 further bits drawn so.
    """
    at = np.searchsorted(grid, walked, side="right") - 1
    keys, sketches = np.empty((len(walked), 2, bands), np.uint64), np.empty((len(walked), 2, bands), np.int64)
    bands_ = np.arange(first, first + bands, dtype=np.uint64)
    for row in range(2):
        for i in np.unique(at - row).tolist():
            own = np.flatnonzero(at - row == i)
            chosen, powers = _drawn(int(grid[i]), first, bands, bits)
            picked = (sampled[own[:, None], chosen.ravel()[None, :]].reshape(len(own), bands, bits) * powers).sum(2, dtype=np.uint64)
            keys[own, row] = mix(picked + np.uint64(i * 1_000_003) + bands_)
            sketches[own, row] = np.packbits(sampled[own[:, None], _drawn(int(grid[i]), -1, 1, 64)[0]], axis=1).view(np.int64)
    return keys.reshape(len(walked), -1).view(np.int64), sketches.reshape(len(walked), -1)


def wide_sketches(walked: np.ndarray, sampled: np.ndarray, grid: np.ndarray, bands: int) -> np.ndarray:
    """64 further bits of each walk up to each of its two reaches, one for each of the keys that band_keys() gives."""
    at = np.searchsorted(grid, walked, side="right") - 1
    out = np.empty((len(walked), 2, bands), np.int64)
    for row in range(2):
        for i in np.unique(at - row).tolist():
            own = np.flatnonzero(at - row == i)
            out[own, row] = np.packbits(sampled[own[:, None], _drawn(int(grid[i]), -2, 1, 64)[0]], axis=1).view(np.int64)
    return out.reshape(len(walked), -1)


@lru_cache(maxsize=512)
def _drawn(reach: int, first: int, bands: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bands x bits places of samples, a factor for each bit)"""
    seed = np.arange(first * bits, (first + bands) * bits).astype(np.uint64) + mix(np.array([reach + 31], np.uint64))
    steps = (mix(seed) % np.uint64(max(reach, 1))).astype(np.int64).reshape(bands, bits)
    level = np.where(steps < SAMPLES, 0, np.frexp(steps // SAMPLES)[1])  # 0: the first 128 steps, then one doubling after the other
    stride = np.left_shift(1, np.maximum(level - 1, 0))
    places = level * SAMPLES + np.where(level == 0, steps, steps // stride - SAMPLES)
    places = np.where(STEPS[places] < reach, places, np.maximum(places - 1, 0))  # its sample may stand beyond the reach
    return places, mix(np.arange(1, bits + 1, dtype=np.uint64))


def near_by_edits(prints: DataFrame, *, least: float = 0.8, missed: float = 0.01, bands: int | None = None, bits: int | None = None, bands_at_once: int = 14) -> DataFrame:
    """prints(fingerprint, doc_id, ...) with component_id: the smallest doc_id reachable by likeness of least or more.

    Equal fingerprints are one class. A class is found by band keys over the leading steps of its walk: see reaches() and
    band_keys(). By default bands and bits follow from the number of classes, so that a pair alike by just least shares no band
    at most `missed` of the time where the edits lie worst, and less elsewhere: bands can miss a pair. Candidates whose sketches are
    near are paired by link_sketched() and verified on whole fingerprints. A null doc_id has no component; an empty text is alike to empty
    ones only.

    Keys are made and met some bands at a time, each time from the fingerprints: first 2, then bands_at_once
    at a time, whatever the table's size. So what a shuffle holds on disk does not grow with the number of bands, and payloads are
    shuffled as often for a small table as for a large one.
    """
    classes_ = written(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "print-classes")
    count = classes_.count()
    chosen = band_choice(count, least, missed)
    bands, bits = bands or chosen[0], bits or chosen[1]

    def keyed(first: int, count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, KEYED_ROWS):
                    part = batch.slice(start, KEYED_ROWS)
                    walked, sampled = from_texts(part.column(0).to_pylist())
                    some = np.flatnonzero(walked)
                    if not len(some):
                        continue
                    walked, sampled, grid = walked[some], sampled[some], reaches(least, int(walked.max()))
                    keys, sketches = band_keys(walked, sampled, grid, first, count, bits)
                    wide = wide_sketches(walked, sampled, grid, count)
                    v, label = (np.repeat(part.column(c).to_numpy()[some], 2 * count) for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), v, sketches.ravel(), wide.ravel(), label)], ["key", "v", "sketch", "wide", "label"])

        def frame(labels: DataFrame | None) -> DataFrame:
            rows = classes_.select("fingerprint", "class_id", F.col("class_id").alias("label"))
            if labels is not None:
                rows = classes_.join(small(labels.withColumnRenamed("v", "class_id")), "class_id", "left").select("fingerprint", "class_id", F.coalesce("label", "class_id").alias("label"))
            return rows.mapInArrow(run, "key long, v long, sketch long, wide long, label long")

        return frame

    few = min(FIRST_BANDS, bands)
    frames = [keyed(0, few), *(keyed(first, min(bands_at_once, bands - first)) for first in range(few, bands, bands_at_once))]
    payloads = classes_.select(F.col("class_id").alias("v"), F.encode("fingerprint", "UTF-8").alias("payload"))
    labels = link_sketched(frames, payloads, WalkLikeness(least), WIDE_APART)
    named = classes_
    if labels is not None:
        named = classes_.join(small(labels.select(F.col("v").alias("class_id"), "label")), "class_id", "left").withColumn("class_id", F.coalesce("label", "class_id"))
    out = prints.join(named.select("fingerprint", F.col("class_id").alias("component_id")), "fingerprint", "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
