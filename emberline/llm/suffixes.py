"""Exact removal of repeated byte strings by suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier. Which strings can be equal is found by anchors:
the least hash of the 32-byte grams in a string is the same gram, at the same place, in every equal string. Runs of strings
with one anchor are compared whole first; only those that have an anchor in common with another run, but are not equal to
it as a whole, are suffix-sorted: multikey quicksort to a shallow depth, then a blind trie for each group that is still
together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import shuffle_partitions, text_slices, written
from emberline.llm.graph import small
from emberline.llm.shingles import mix, prefix_hash, prime_hash, span_hash

NULL_ID = -(2**63)
GRAM = 32
SLICE_BYTES = 1 << 20
#: Rows of one doc_id with different texts are told apart above this bit of a position.
NTH_SHIFT = 40
_LOW = (1 << NTH_SHIFT) - 1
#: Groups of one refined anchor above so many members are dealt out by whole strings instead.
GROUP_ROWS = 20_000
SHALLOW = 32


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i : i + width] for every i that has so many."""
    m, have = v, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts end to end: (text, first start, starts less one, anchor's distance from it, anchor's hash, hash of the whole run).

    A run is the longest row of starts whose strings of `length` bytes have one anchor; the whole run's bytes reach to the end
    of its last string. Every start of a string belongs to one run.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    h = prefix_hash(data)
    starts = np.arange(n - GRAM + 1)
    grams = span_hash(h, starts, starts + GRAM)
    shift = np.uint64(max(n, 2).bit_length())
    order = (grams >> shift << shift) | starts.astype(np.uint64)
    anchor = (sliding_minimum(order, length - GRAM + 1) & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    owner = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    valid = np.arange(len(anchor)) + length <= offsets[owner + 1]
    where = np.flatnonzero(valid)
    if not len(where):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(where), bool)
    new[1:] = (anchor[where[1:]] != anchor[where[:-1]]) | (where[1:] != where[:-1] + 1)
    first = where[new]
    last = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)]
    at = anchor[first]
    whole = mix(prime_hash(data, first, last + length) + (last - first).astype(np.uint64))
    return owner[first], first, last - first, at - first, grams[at], whole


def segments(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int, slice_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, its first byte's place in it, bytes, offsets): a text longer than a slice comes in pieces.

    Pieces overlap by length - 1 bytes, so every string starts in exactly one.
    """
    if len(offsets) == 2 and offsets[1] > 2 * slice_bytes:
        for base in range(0, int(offsets[1]), slice_bytes):
            piece = data[base : base + slice_bytes + length - 1]
            if base == 0 or len(piece) >= length:
                yield np.zeros(1, np.int64), np.array([base]), piece, np.array([0, len(piece)])
    else:
        yield np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), data, offsets


_RUN_SCHEMA = "key long, whole long, doc long, at long, shape int"
_RUN_NAMES = ["key", "whole", "doc", "at", "shape"]


def runs(docs: DataFrame, length: int, slice_bytes: int) -> DataFrame:
    """Runs of docs(doc, nth, text): key, whole, doc, at, shape. shape is 128 * (starts less one) + anchor's distance.

    Of equal runs in one slice, all but the earliest have a null key: their strings start earlier in it, whatever else there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", slice_bytes):
            docs_ = rows.column(0).to_numpy(zero_copy_only=False)
            base = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << NTH_SHIFT
            for row, place, part, ends in segments(rows, data, offsets, length, slice_bytes):
                text, first, span, distance, key, whole = anchor_runs(part, ends, length)
                if not len(first):
                    continue
                doc = docs_[row[text]]
                at = base[row[text]] + place[text] + first - ends[text]
                both = key ^ mix(whole)
                order = np.argsort(both, kind="stable")
                same = both[order[1:]] == both[order[:-1]]
                later = np.zeros(len(first), bool)
                if same.any():
                    # only the rows that have an equal one: sort them by content, then by place
                    some = np.zeros(len(first), bool)
                    some[order[1:][same]] = some[order[:-1][same]] = True
                    i = np.flatnonzero(some)
                    i = i[np.lexsort((at[i], doc[i], whole[i], key[i]))]
                    equal = (key[i[1:]] == key[i[:-1]]) & (whole[i[1:]] == whole[i[:-1]])
                    lead = np.maximum.accumulate(np.where(np.append(True, ~equal), np.arange(len(i)), 0))
                    later[i] = (doc[i] != doc[i[lead]]) | (at[i] != at[i[lead]])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), mask=later), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(at), pa.array((span * 128 + distance).astype(np.int32))], _RUN_NAMES)

    return docs.select("doc", "nth", "text").mapInArrow(run, _RUN_SCHEMA)


def settle(sorted_runs: DataFrame) -> DataFrame:
    """Of runs dealt out by key and sorted by key, whole, doc, at: those that are settled (later = true: an equal run is
    earlier) and those whose key has other runs as well (later = false), which need a closer look. Runs alone are dropped.

    Runs without a key were settled in their slice; they come first. What is held is one batch and one run.
    """
    names = ["doc", "at", "shape", "later"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first of the last row of equal runs, and whether its key had other runs before
        for batch in batches:
            local = batch.column(0).null_count
            if local:
                part = batch.slice(0, local)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(np.ones(local, bool))], names)
                batch = batch.slice(local)
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.append(np.array([x], c.dtype), c) for x, c in zip(held, columns, strict=False)]
            key, whole, doc, at, shape = columns
            same_key = np.append(held is not None and held[5], key[1:] == key[:-1])
            same = np.append(False, same_key[1:] & (whole[1:] == whole[:-1]))
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            later = np.flatnonzero(same & ((doc != doc[lead]) | (at != at[lead])))
            leads = np.flatnonzero(~same)
            # a lead has company if the one before or the one after has its key; the last one waits for what comes
            look = leads[:-1][same_key[leads[:-1]] | same_key[leads[1:]]]
            last = leads[-1]
            held = (key[last], whole[last], doc[last], at[last], shape[last], bool(same_key[last]))
            picked = np.concatenate([later, look])
            yield pa.RecordBatch.from_arrays([pa.array(doc[picked]), pa.array(at[picked]), pa.array(shape[picked]), pa.array(np.arange(len(picked)) < len(later))], names)
        if held is not None and held[5]:
            yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int64()), pa.array([held[4]], pa.int32()), pa.array([False])], names)

    return sorted_runs.mapInArrow(run, "doc long, at long, shape int, later boolean")


def contexts(docs: DataFrame, length: int, slice_bytes: int) -> DataFrame:
    """The bytes of the runs in docs(doc, nth, text, wanted array<struct<at, shape>>): key, doc, at, distance, bytes.

    A run is cut in two: strings that reach at least half of what is not anchor to its left, and the others. Either half has
    more than the anchor in common, and its key is the hash of that: fewer runs meet that have nothing else in common.
    """
    rest = length - GRAM
    half = (rest + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", slice_bytes):
            wanted = pc.list_flatten(rows.column(3))
            counts = pc.list_value_length(rows.column(3)).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(rows.num_rows), counts)
            at = wanted.field("at").to_numpy(zero_copy_only=False)
            shape = wanted.field("shape").to_numpy(zero_copy_only=False).astype(np.int64)
            first = offsets[owner] + (at & _LOW)
            doc = rows.column(0).to_numpy(zero_copy_only=False)[owner]
            for base in range(0, max(len(data), 1), 2 * slice_bytes):  # a long text alone may fill many slices
                i = np.flatnonzero((first >= base) & (first < base + 2 * slice_bytes))
                if len(i):
                    yield from halves(data[base : base + 2 * slice_bytes + 2 * length], first[i] - base, shape[i], doc[i], at[i])

    def halves(data: np.ndarray, first: np.ndarray, shape: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        span, distance = shape >> 7, shape & 127
        anchor = first + distance
        h = prefix_hash(data)
        # starts up to `anchor - half` have the left half in common, those after it the right one
        left_last = np.minimum(first + span, anchor - half)
        right_first = np.maximum(first, anchor - half + 1)
        for lo, hi, begin, end, side in ((first, left_last, anchor - half, anchor + GRAM, 1), (right_first, first + span, anchor, anchor + length - half + 1, 2)):
            i = np.flatnonzero(hi >= lo)
            if not len(i):
                continue
            key = mix(span_hash(h, begin[i], end[i]) + np.uint64(side))
            sizes = hi[i] + length - lo[i]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            picked = data[np.arange(ends[-1]) + np.repeat(lo[i] - ends[:-1], sizes)]
            raw = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(picked)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[i]), pa.array(at[i] + lo[i] - first[i]), raw], ["key", "doc", "at", "bytes"])

    return docs.select("doc", "nth", "text", "wanted").mapInArrow(run, "key long, doc long, at long, bytes binary")


class BlindTrie:
    """Strings that begin alike, told apart by their first differing byte only; a leaf keeps equal strings together.

    Going down compares one byte a node and looks at no other; one comparison with the leaf found says where a string
    branches off, and a second way down puts it there.
    """

    def __init__(self):
        self.root = None

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        """Length of the common prefix of two strings of one length."""
        x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return len(a) - (x.bit_length() + 7) // 8

    def insert(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = [text, [item]]
            return
        node = self.root
        while len(node) == 3:  # [depth, children, None]
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(item)
            return
        depth = self.common(node[0], text)
        parent, label, node = None, None, self.root
        while len(node) == 3 and node[0] < depth:
            parent, label = node, text[node[0]]
            node = node[1][label]
        if len(node) == 3 and node[0] == depth:
            node[1][text[depth]] = [text, [item]]
            return
        other = node
        while len(other) == 3:
            other = next(iter(other[1].values()))
        branch = [depth, {other[0][depth]: node, text[depth]: [text, [item]]}, None]
        if parent is None:
            self.root = branch
        else:
            parent[1][label] = branch

    def groups(self) -> Iterator[list[int]]:
        """Items with equal strings, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                yield node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def equal_strings(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Rows of starts whose strings of `length` bytes are equal, within each group: groups of two rows at least.

    Multikey quicksort by eight bytes at a time down to the shallow depth, of those still together only; blind tries below.
    """
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray((len(data) + 1,), ">u8", buffer=padded, strides=(1,))
    active, rank = np.arange(len(starts)), group
    for depth in range(0, min(SHALLOW, length - 7), 8):
        word = words[starts[active] + depth].astype(np.uint64)
        order = np.lexsort((word, rank))
        active, rank, word = active[order], rank[order], word[order]
        new = np.append(True, (rank[1:] != rank[:-1]) | (word[1:] != word[:-1])) if len(active) else np.zeros(0, bool)
        rank = np.cumsum(new)
        together = np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)
        active, rank = active[together], rank[together]
    if not len(active):
        return
    bounds = np.append(np.flatnonzero(np.append(True, rank[1:] != rank[:-1])), len(active))
    raw = data.tobytes()
    at = starts[active].tolist()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        texts = [raw[s + SHALLOW : s + length] for s in at[lo:hi]]
        if texts.count(texts[0]) == hi - lo:
            yield active[lo:hi]
            continue
        trie = BlindTrie()
        for i, text in enumerate(texts):
            trie.insert(text, i)
        for found in trie.groups():
            if len(found) > 1:
                yield active[lo:hi][found]


def repeated_starts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to): bytes covered by strings that, within their group, start earlier as well."""
    counts = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(counts)])[:-1][owner]
    starts = offsets[owner] + within
    place = at[owner] + within
    whose = doc[owner]
    later = np.zeros(len(starts), bool)
    for same in equal_strings(data, starts, group[owner], length):
        d, p = whose[same], place[same]
        least = d.min()
        lead = p[d == least].min()
        later[same] = (d != least) | (p != lead)
    hit = np.flatnonzero(later)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    return whose[first], place[first], place[last] + length


def sort_groups(dealt: DataFrame, length: int) -> DataFrame:
    """doc, start, end of what repeats within groups of key; dealt is sorted by key, and a group's contexts fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            parts = [x for x in (held, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy()
            cut = len(key) if batch is None else int(np.searchsorted(np.cumsum(np.append(False, key[1:] != key[:-1])), np.count_nonzero(key[1:] != key[:-1])))
            held = None if batch is None else rows.slice(cut)
            rows, key = rows.slice(0, cut), key[:cut]
            group = np.cumsum(np.append(False, key[1:] != key[:-1])) if cut else np.zeros(0, np.int64)
            many = np.bincount(group)[group] > 1 if cut else np.zeros(0, bool)
            rows, group = rows.filter(pa.array(many)), group[many]
            sizes = pc.binary_length(rows.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            # whole groups at a time, as many as some MB hold
            ends = np.cumsum(sizes)
            start = 0
            while start < len(group):
                stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right"))
                stop = max(stop, start + 1)
                stop = int(np.searchsorted(group, group[stop - 1], side="right"))
                part = rows.slice(start, stop - start)
                data = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)
                offsets = np.concatenate([[0], np.cumsum(sizes[start:stop])])
                doc, lo, hi = repeated_starts(data, offsets, group[start:stop], part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), length)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi)], ["doc", "start", "end"])
                start = stop

    return dealt.select("key", "doc", "at", "bytes").mapInArrow(run, "doc long, start long, end long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def by_strings(crowded: DataFrame, length: int) -> DataFrame:
    """doc, at, key: a row for each string of the runs in crowded, dealt out by a hash of the whole string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = len(raw) - length + 1
                keys = span_hash(prefix_hash(np.frombuffer(raw, np.uint8)), np.arange(n), np.arange(n) + length)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([doc] * n, pa.int64()), pa.array(at + np.arange(n)), pa.array([raw[i : i + length] for i in range(n)], pa.binary())], ["key", "doc", "at", "bytes"])

    return crowded.select("key", "doc", "at", "bytes").mapInArrow(run, "key long, doc long, at long, bytes binary")


def numbered(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with doc (null: smallest), digest (SHA-256 of the whole text, null: empty) and nth.

    nth is 0; where rows of one doc_id have different texts, it numbers the texts in the order of their digests.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    facts = rows.select("doc", "digest")
    unlike = facts.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc")
    nth = facts.join(small(written(unlike, "unlike")), "doc", "left_semi").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("digest")) - 1)
    nth = written(nth, "nth")
    if nth.isEmpty():
        return rows.withColumn("nth", F.lit(0))
    return rows.join(small(nth), ["doc", "digest"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def repeated_spans(rows: DataFrame, length: int = 100, slice_bytes: int = SLICE_BYTES, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc, nth, spans) of the texts with repeated bytes, and (digest, lead_doc, lead_nth) of texts that occur more than once.

    rows is numbered()'s. spans is the sorted array of {start, end} in bytes, neither touching the next. A text that occurs
    again as a whole repeats altogether, if it has `length` bytes at all, and takes no part in anything else: only its
    earliest row does.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    facts = rows.select("doc", "nth", "digest")
    firsts = facts.groupBy("digest").agg(F.min(F.struct("doc", "nth")).alias("lead"), F.count("*").alias("copies")).where("copies > 1")
    firsts = written(firsts.select("digest", F.col("lead.doc").alias("lead_doc"), F.col("lead.nth").alias("lead_nth")), "firsts")
    own = rows.join(small(firsts), "digest", "left").where("lead_doc IS NULL OR (doc = lead_doc AND nth = lead_nth)").select("doc", "nth", "text")

    found = runs(own, length, slice_bytes)
    dealt = found.repartition(n, F.coalesce("key", F.col("doc"))).sortWithinPartitions("key", "whole", "doc", "at")
    settled = written(settle(dealt), "settled")
    later = settled.where("later")
    spans = later.select("doc", F.col("at").alias("start"), (F.col("at") + F.shiftright("shape", 7) + length).alias("end"))

    look = settled.where("NOT later").select("doc", F.shiftright("at", NTH_SHIFT).cast("int").alias("nth"), "at", "shape")
    wanted = look.groupBy("doc", "nth").agg(F.collect_list(F.struct("at", "shape")).alias("wanted"))
    pieces = written(contexts(own.join(wanted, ["doc", "nth"]), length, slice_bytes), "contexts")
    sizes = pieces.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    sizes = written(sizes, "sizes")
    groups = pieces.join(sizes, "key")
    calm = groups.where(F.col("members") <= group_rows).repartition(n, "key").sortWithinPartitions("key")
    spans = spans.union(sort_groups(calm, length))
    if not sizes.where(F.col("members") > group_rows).isEmpty():
        strings = by_strings(groups.where(F.col("members") > group_rows), length)
        # equal strings now have one key: all rows but the earliest repeat, whatever the size of the group
        firsts_ = strings.groupBy("bytes").agg(F.min(F.struct("doc", "at")).alias("lead"), F.count("*").alias("k")).where("k > 1")
        again = strings.join(firsts_, "bytes").where((F.col("doc") != F.col("lead.doc")) | (F.col("at") != F.col("lead.at")))
        spans = spans.union(again.select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("end")))
    return merged(spans), firsts


def merged(spans: DataFrame) -> DataFrame:
    """doc, nth, spans: the union of spans(doc, start, end) of each text as a sorted array of maximal {start, end}."""
    at = spans.select("doc", F.shiftright("start", NTH_SHIFT).cast("int").alias("nth"), F.col("start").bitwiseAND(_LOW).alias("start"), F.col("end").bitwiseAND(_LOW).alias("end"))
    order = Window.partitionBy("doc", "nth").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    islands = at.withColumn("reach", reach).withColumn("island", island).groupBy("doc", "nth", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("doc", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def removed(docs: DataFrame, length: int = 100, slice_bytes: int = SLICE_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_bytes, spans (array of {start, end} that go), kept (binary, the rest).

    A null text is empty; rows of one doc_id and text are one document; different texts of one doc_id come in the order of
    their digests; a null doc_id is the smallest.
    """
    rows = numbered(docs)
    spans, firsts = repeated_spans(rows, length, slice_bytes, group_rows)
    spans = written(spans, "spans")
    out = rows.withColumn("raw", F.encode("text", "UTF-8")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = out.join(small(firsts), "digest", "left")
    out = out.join(spans, ["doc", "nth"], "left")
    copy = F.col("lead_doc").isNotNull() & ((F.col("doc") != F.col("lead_doc")) | (F.col("nth") != F.col("lead_nth")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = out.withColumn("spans", F.when(copy, F.when(F.col("n_bytes") >= length, whole).otherwise(nothing)).otherwise(F.coalesce("spans", nothing)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans_:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*parts, raw[at:]]) if spans_ else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in batch.column(1).to_pylist()], pa.int64()), batch.column(2), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return out.select("doc_id", "raw", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of removed()."""
    out = removed(docs, length)
    return out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
