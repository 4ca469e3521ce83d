"""Importance resampling towards a target: documents are drawn in proportion to how much more likely their words are in a target
corpus than in their own.

Every text is read once. Its features, runs of words, become buckets of a hash, which a task writes one after the other as
packed uint16 to a stream file in the shared folder, with the offsets of its documents; each block of a stream is sorted and run-length
encoded for its counts, which Spark adds up. When the gains of all buckets are known, the streams are read again, not the
texts: gains are gathered by bucket and summed between offsets.

A block of a stream, as the manifest places it:

    zstandard frame of the buckets, uint16[n_features]
    zstandard frame of: doc_id int64[n] | has an id uint8[n] | words uint64[n] | offsets uint64[n + 1]
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import Scratch, open_input, open_output, remove, shuffle_partitions, text_slices, work_path

#: Texts whose words are hashed together, in bytes.
SLICE_BYTES = 1 << 20
#: Features of a block, unless one document has more.
BLOCK_FEATURES = 1 << 22
#: Words whose hashes a worker remembers at most.
MAX_WORDS = 500_000

#: A-Z lower-cased; what is neither a digit, a letter nor beyond ASCII becomes a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _zeros_after() -> list[np.ndarray]:
    """How the crc32 of any bytes changes by 1, 2, 4, ... zero bytes after them, without its first and last inversion: of each,
    a table [4, 256] by the bytes of the value so far."""
    one = np.zeros((4, 256), np.uint32)
    base = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    # A byte b on the state s gives base[(s ^ b) & 255] ^ (s >> 8); of a zero byte, that is linear in s.
    for k in range(4):
        s = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one[k] = base[s & 255] ^ (s >> np.uint32(8))
    tables = [one]
    while len(tables) < 31:
        last = tables[-1]
        tables.append(np.stack([_through(last, last[k]) for k in range(4)]))
    return tables


def _through(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> np.uint32(8)) & 255] ^ table[2][(state >> np.uint32(16)) & 255] ^ table[3][state >> np.uint32(24)]


_ZEROS: list[np.ndarray] = []


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings one after the other, from the crc32 of each and the length of the second."""
    if not _ZEROS:
        _ZEROS.extend(_zeros_after())
    state = first.copy()
    length, bit = second_bytes.copy(), 0
    while length.any():
        odd = np.flatnonzero(length & 1)
        state[odd] = _through(_ZEROS[bit], state[odd])
        length >>= 1
        bit += 1
    return state ^ second


class Hasher:
    """Buckets of the features of texts. Hashes of words are remembered; beyond MAX_WORDS all are forgotten, which changes no result."""

    def __init__(self, buckets: int, longest: int):
        if not 1 <= buckets <= 1 << 16:
            raise ValueError("buckets must fit in 16 bits")
        self.buckets, self.longest = buckets, longest
        self.place: dict[bytes, int] = {}
        self.crc, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.space = np.uint32(zlib.crc32(b" "))

    def words(self, raw: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(the words of texts end to end, how many each text has)."""
        folded = raw.translate(_FOLD)
        words: list[bytes] = []
        counts = np.zeros(len(offsets) - 1, np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            found = folded[a:b].split()
            counts[i] = len(found)
            words += found
        return words, counts

    def __call__(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of the texts' features, each text's in a row; how many words; how many features each text has)."""
        words, counts = self.words(raw, offsets)
        if len(self.place) > MAX_WORDS or self.size.sum() > 20 * MAX_WORDS:
            self.place.clear()
            self.crc, self.size = self.crc[:0], self.size[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
            self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        text = np.repeat(np.arange(len(counts)), counts)
        last = np.cumsum(counts)[text] - 1  # of each word, the last one of its text
        crc, here = self.crc[at], np.arange(len(at))
        runs, owners = [crc], [text]
        for n in range(1, self.longest):
            begin = here[: max(0, len(here) - n)]
            begin = begin[begin + n <= last[begin]]
            if n == 1:
                ahead = crc[begin]
            else:  # the run of n words that begins there
                ahead = runs[-1][np.searchsorted(kept, begin)]
            ahead = joined_crc(ahead, np.full(len(begin), self.space), np.ones(len(begin), np.int64))
            runs.append(joined_crc(ahead, crc[begin + n], self.size[at[begin + n]]))
            owners.append(text[begin])
            kept = begin
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        features = (np.concatenate(runs)[order] % np.uint32(self.buckets)).astype("<u2")
        return features, counts, np.bincount(owner, minlength=len(counts))


_BLOCK = "path string, place long, feature_bytes long, index_bytes long, n_docs long, n_features long, buckets array<int>, counts array<long>"


def write_streams(docs: DataFrame, root: str, *, buckets: int, longest: int) -> DataFrame:
    """The bucket streams of docs(doc_id, text) below root; a row for each block: where it is, and the counts of its buckets.

    Each task writes one file, named by its attempt; the rows, once written by Spark, say which files count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{root}/stream-{task.partitionId():05d}-{task.taskAttemptId()}"
        hasher, packer = Hasher(buckets, longest), zstandard.ZstdCompressor(level=1)
        stream, place = None, 0
        parts: list[tuple] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal stream, place, held
            ids, words, features, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            held = 0
            ordered = np.sort(features)
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
            data = packer.compress(features.tobytes())
            known = np.array([i is not None for i in ids], np.uint8)
            numbers = np.array([i if i is not None else 0 for i in ids], "<i8")
            index = packer.compress(numbers.tobytes() + known.tobytes() + words.astype("<u8").tobytes() + np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
            if stream is None:
                stream = open_output(path)
            stream.write(data + index)
            row = {"path": [path], "place": [place], "feature_bytes": [len(data)], "index_bytes": [len(index)], "n_docs": [len(ids)], "n_features": [len(features)], "buckets": [ordered[first].astype(np.int32)], "counts": [np.diff(np.append(first, len(ordered)))]}
            place += len(data) + len(index)
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for rows, data, offsets in text_slices(batches, "text", SLICE_BYTES):
            features, words, counts = hasher(data.tobytes(), offsets)
            parts.append((np.array(rows.column(0).to_pylist(), object), words, features, counts))
            held += len(features)
            if held >= BLOCK_FEATURES:
                yield block()
        if parts:
            yield block()
        if stream is not None:
            stream.close()

    kinds = [("path", pa.string()), *[(n, pa.int64()) for n in ("place", "feature_bytes", "index_bytes", "n_docs", "n_features")], ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
    schema = pa.schema(kinds)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def bucket_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, n): the blocks' counts, added up."""
    pairs = blocks.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def count_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """bucket_counts() on the driver: one number for each bucket, however many rows there are."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 * ln(p / q)): how much likelier it is in the target than in the own corpus, both counts with one added."""
    n = len(own)
    top, bottom = float(own.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t + 1) * top) / (float(s + 1) * bottom))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weigh_streams(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, row_mix) of every document in the streams: weight is the floored mean of its features' gains.

    row_mix is a number that spreads rows, from the block's file and place and the row's place in it.
    """
    n = shuffle_partitions(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as stream:
                    stream.seek(row["place"])
                    data, index = stream.read(row["feature_bytes"]), stream.read(row["index_bytes"])
                docs = row["n_docs"]
                index = unpacker.decompress(index)
                ids, known = np.frombuffer(index, "<i8", docs), np.frombuffer(index, np.uint8, docs, 8 * docs) > 0
                words, offsets = np.frombuffer(index, "<u8", docs, 9 * docs), np.frombuffer(index, "<u8", docs + 1, 17 * docs).astype(np.int64)
                features = np.frombuffer(unpacker.decompress(data), "<u2") if row["n_features"] else np.zeros(0, "<u2")
                if len(features) != row["n_features"] or offsets[-1] != len(features):
                    raise ValueError(f"{row['path']} at {row['place']} holds another number of features than its manifest says")
                counts = np.diff(offsets)
                some = np.flatnonzero(counts)
                weight = np.zeros(docs, np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(gains[features], offsets[some]) // counts[some]
                begin = int.from_bytes(hashlib.sha256(f"{row['path']}:{row['place']}".encode()).digest()[:8], "little")
                mix = ((np.arange(docs, dtype=np.uint64) + np.uint64(begin)) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
                columns = [pa.array(ids, mask=~known), *(pa.array(c) for c in (words.astype(np.int64), counts, weight, mix))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "row_mix"])

    slim = blocks.select("path", "place", "feature_bytes", "index_bytes", "n_docs", "n_features")
    return slim.repartition(n, "path", "place").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, row_mix long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of the sha256 of seed:doc_id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(able: DataFrame, scratch: Scratch) -> DataFrame:
    """able(doc_id, n_features, weight, score, row_mix) with rank: 1, 2, 3... from the highest score. Ties go to the smaller doc_id,
    null ids last, then to fewer features.

    Rows are sorted in ranges over all tasks; those of one range are numbered in their task, and ranges are set off by the counts of
    those before. row_mix, a number of each row, parts what else is equal, so no task gets a whole group of repeated rows.
    """
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row_mix"))
    placed = able.repartitionByRange(shuffle_partitions(able.sparkSession), *order).sortWithinPartitions(*order)
    # Spark numbers rows by partition, in the upper bits, and place.
    placed = scratch.written(placed.withColumn("row_place", F.monotonically_increasing_id()), "resampling-ranked")
    part, place = F.shiftright("row_place", 33), F.col("row_place").bitwiseAND(2**33 - 1)
    sizes = placed.groupBy(part.alias("row_part")).agg(F.count("*").alias("n"))
    # A row for each task of the sort.
    before = Window.orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("row_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_before"))
    return placed.withColumn("row_part", part).join(F.broadcast(sizes), "row_part").select("doc_id", "n_features", "weight", "score", (F.col("row_before") + place + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text); rank is null for rows that are not drawn.

    Words are runs of digits, ASCII letters in lower case and all characters beyond ASCII; features are all runs of 1 to longest
    words, repeats counted, and a feature's bucket is its crc32 modulo buckets. A bucket's gain compares its share of all features of
    target(text) with that of docs; weight is the floored mean of the gains of a document's features, 0 without any; score adds
    noise from seed and doc_id, so that the highest scores are a draw without replacement by the weights. Of the rows with at least min_words words,
    percent of a hundred are drawn, rounded down: ranks 1, 2, 3... by score, ties to the smaller doc_id.

    A null text has no words. Repeated rows are rows of their own and get ranks one after the other; a null doc_id counts as an empty id and comes
    last among ties. An empty table gives no rows, an empty target gains by docs alone. Other columns are left out.

    Texts are read once and never shuffled. What reaches the driver is a count for each bucket. The streams go when the weights are written.
    """
    spark, scratch = docs.sparkSession, Scratch()
    root = work_path(spark, "resampling-streams")
    blocks = scratch.written(write_streams(docs, f"{root}/docs", buckets=buckets, longest=longest), "resampling-blocks")
    target_blocks = scratch.written(write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), f"{root}/target", buckets=buckets, longest=longest), "resampling-target")
    gains = bucket_gains(*(count_array(bucket_counts(b), buckets) for b in (blocks, target_blocks)))
    weighed = weigh_streams(blocks, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    weighed = scratch.written(weighed, "resampling-weights")
    scratch.clear(weighed)
    remove(root)
    able = weighed.where(F.col("n_words") >= min_words)
    n_drawn = percent * able.count() // 100
    placed = ranked(able, scratch)
    rest = weighed.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank"))).unionByName(rest)
