"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates,
and confirmation on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import Scratch, fresh, text_slices, written
from emberline.llm.graph import Nearness, link_buckets, small
from emberline.llm.shingles import mix, shingle_sets

SLICE_BYTES = 2 << 20
#: Of 64 sketched bits, a pair alike by 0.8 differs in 6.4 on average, and in over 18 once in 500,000 times; an unlike pair in 32.
SKETCH_APART = 18
#: Bands that are met first, so that groups of copies are connected before the others are.
FIRST_BANDS = 2


@dataclass(frozen=True)
class Bands:
    """bands of rows hashes each. At likeness 0.8 two sets meet in none of 32 bands of 5 once in 300,000 times."""

    bands: int = 32
    rows: int = 5

    @property
    def bins(self) -> int:
        return self.bands * self.rows


class Signer:
    """Signatures of shingle sets. A set's hashes are dealt to bins by their top bits, and the least of a bin stands for it.

    An empty bin takes the value of the first full one in a random row of bins that is its own but the same for all sets, so
    that two sets agree in it as often as they are alike.
    """

    def __init__(self, bands: Bands):
        self.bands = bands
        k = bands.bins
        self.edges = np.array([-(-(i << 64) // k) for i in range(k)], np.uint64)
        tries = np.arange(k, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(1, 64 * k // 8, dtype=np.uint64)[None, :]
        self.rows = (mix(tries) % np.uint64(k)).astype(np.int32)
        self.salt = mix(np.arange(1, bands.bands + 1, dtype=np.uint64))
        self.sampled = np.arange(64) * k // 64
        self.bit_salt = mix(np.arange(1000, 1064, dtype=np.uint64))

    def sketch(self, values: np.ndarray) -> int:
        """One bit of each of 64 bins; bits of unequal values agree half the time."""
        return int(np.packbits(mix(values[self.sampled] ^ self.bit_salt) >> np.uint64(63) != 0).view(np.int64)[0])

    def keys(self, values: np.ndarray) -> np.ndarray:
        """The band keys of a signature."""
        keys = self.salt.copy()
        for column in values.reshape(self.bands.bands, self.bands.rows).T:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each bin, of a sorted, non-empty set."""
        place = np.searchsorted(hashes, self.edges)
        end = np.append(place[1:], len(hashes))
        full = end > place
        values = hashes[np.minimum(place, len(hashes) - 1)]
        empty = np.flatnonzero(~full)
        for width in (32, self.rows.shape[1]):
            if len(empty):
                found = full[self.rows[empty, :width]]
                first = found.argmax(axis=1)
                hit = found[np.arange(len(empty)), first]
                values[empty[hit]] = values[self.rows[empty[hit], first[hit]]]
                empty = empty[~hit]
        if len(empty):  # no full bin in a long row: the first full one of all, by position after the row's start
            filled = np.flatnonzero(full)
            values[empty] = values[filled[np.searchsorted(filled, self.rows[empty, 0]) % len(filled)]]
        return values


def signatures(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """doc_id, n_shingles, set_hash (binary, null for an empty set), sketch, keys (array of band keys, empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands)
        for rows, data, offsets in text_slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(data, offsets, words)
            values = [sign(s) if len(s) else None for s in sets]
            keys = [sign.keys(x).view(np.int64) for x in values if x is not None]
            ends = np.cumsum([bands.bands if len(s) else 0 for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if x is None else sign.sketch(x) for x in values], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                ],
                ["doc_id", "n_shingles", "set_hash", "sketch", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sketch long, keys array<long>")


def members(docs: DataFrame, words: int) -> DataFrame:
    """v (doc_id), payload (the whole sorted set as 64-bit numbers) of every row of docs with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(data, offsets, words)
            some = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some, pa.int64())), pa.array([sets[i].tobytes() for i in some], pa.binary())], ["v", "payload"])

    return docs.select("doc_id", "text").mapInArrow(run, "v long, payload binary")


@dataclass(frozen=True)
class SetLikeness:
    """100 * intersection >= percent * union, on whole sets, which stay as they came: 8 bytes a shingle."""

    percent: int

    def alike(self, xs: list[bytes], ys: list[bytes]) -> list[bool]:
        out = []
        for x, y in zip(xs, ys, strict=True):
            both = np.frombuffer(x + y, np.uint64).copy()
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(common * 100 >= (len(both) - common) * self.percent)
        return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: Bands = Bands()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Documents are linked if their shingle sets have 100 * intersection >= percent * union; component_id is the smallest
    doc_id reachable, and kept marks the rows that have it. Documents with equal sets form one class, and the class goes on
    as its smallest doc_id. Classes that share a band key are candidates; link_buckets() pairs them, stars first, and every pair
    whose sketches are near is confirmed on full sets.

    A null or wordless text has an empty set and is linked with nothing. A row without doc_id is linked with nothing, has no
    component_id and is kept. Repeated rows give repeated results.
    """
    scratch = Scratch()
    signed = scratch.written(signatures(docs, words, bands), "signatures")
    sized = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    classes = sized.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    repeated = scratch.written(classes.where("class_rows > 1").select("set_hash", "class_id"), "classes")
    assigned = signed.join(small(repeated), "set_hash", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    results = written(assigned.select("doc_id", "n_shingles", "class_id"), "assigned")

    nearness = Nearness(apart=SKETCH_APART, percent=percent)
    leads = assigned.where("doc_id = class_id").select("keys", F.col("doc_id").alias("v"), F.col("n_shingles").alias("n"), "sketch")
    keyed = lambda first, count: leads.select(F.explode(F.slice("keys", first + 1, count)).alias("key"), "v", "n", "sketch")
    few = min(FIRST_BANDS, bands.bands)
    rounds = [[keyed(first, count)] for first, count in ((0, few), (few, bands.bands - few)) if count]
    # Only documents that share a key with another one need their sets.
    shared = keyed(0, bands.bands).groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("key")
    sharing = scratch.written(keyed(0, bands.bands).join(shared.hint("shuffle_hash"), "key").select(F.col("v").alias("doc_id")).distinct(), "members")
    chosen = docs.select("doc_id", "text").join(small(sharing), "doc_id", "left_semi")
    labels = link_buckets(rounds, scratch.written(members(chosen, words), "sets"), SetLikeness(percent), nearness)
    scratch.clear()
    out = results
    if labels is not None:
        out = out.join(small(labels.select(F.col("v").alias("class_id"), "label")), "class_id", "left").withColumn("class_id", F.coalesce("label", "class_id"))
    return out.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id; all columns as they are.

    Where that id has several rows, the one whose text has the smallest hash stays. Rows without doc_id stay.
    """
    found = near_duplicates(docs, words=words, percent=percent)
    gone = written(found.where("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(small(repeated), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rank = fresh(docs, "near_rank")
    first = again.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return kept.join(small(repeated), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(first)
