"""Joins by size, and connected components as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import Scratch, shuffle_partitions, written

#: Rows of ids and numbers up to which a side is broadcast: a few MB.
SMALL_ROWS = 200_000
PAIRS_AT_ONCE = 500
#: Pairs within buckets that are compared in blocks at once, without further stars.
FEW_PAIRS = 5_000_000
PAIRS_IN_BLOCK = 16
#: Buckets of so few rows are compared all at once, one distance of rows after the other; of larger ones, so many rows are held and so many pairs compared in a task.
FEW_ROWS = 256
HELD_ROWS = 200_000
IN_TASK = 20_000_000
#: Of the first 64 of 128 sketched bits, how many may be unequal where blocks meet: a pair that differs in one bit of eight has more less than once in a million times.
COARSE = 24
#: Edges up to which components are found in one task, with some 300 bytes for each.
ONE_TASK = 300_000


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most max_rows rows; beyond that Spark shuffles both sides.

    For narrow rows that are cheap to count: a written table or an aggregate.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def components(edges: DataFrame, count: int | None = None) -> DataFrame:
    """(v, label) for every vertex of edges(a, b): label is the smallest vertex reachable.

    Up to ONE_TASK edges (count, if it is known), one task joins them. Beyond that, in each round a vertex takes its smallest
    neighbour's, then that one's smallest neighbour's name; edges go on between the names only, without those within one, so
    they become few within about log n rounds even in a chain of n. Each round is written to the shared folder; hot vertices
    meet map-side minima and joins that Spark may split.
    """
    scratch = Scratch()
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    if (edges.count() if count is None else count) <= ONE_TASK:
        return scratch.written(live.repartition(1).mapInArrow(joined_in_order, "v long, label long"), "labels")
    live = scratch.written(live.distinct(), "edges")
    labels = None
    while labels is None or not live.isEmpty():
        both = live.union(live.select("b", "a"))
        low = scratch.written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), "low")
        step = scratch.written(low.join(low.select(F.col("v").alias("m"), F.col("m").alias("label")), "m").select("v", "label"), "step")
        if labels is None:
            labels = step
        else:
            on = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
            labels = scratch.written(labels.join(on, "label", "left").select("v", F.coalesce("next", "label").alias("label")), "labels")
        named = lambda c: step.select(F.col("v").alias(c), F.col("label").alias(f"{c}l"))  # noqa: B023, E731
        over = live.join(named("a"), "a").join(named("b"), "b").where("al <> bl")
        live = scratch.written(over.select(F.least("al", "bl").alias("a"), F.greatest("al", "bl").alias("b")).distinct(), "edges")
        scratch.clear(live, labels)
    scratch.clear(labels)
    return labels


def joined_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, label) of edges(a, b)"""
    above: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := above.setdefault(v, v)) != v:
            above[v] = v = above[up]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(v) for v in above], pa.int64())], ["v", "label"])


@dataclass(frozen=True)
class Nearness:
    """What two members of a bucket must have in common before their payloads are looked at.

    sketch is a number of 64 bits, of which a pair to be found has few unequal ones; apart is how many it may have. percent:
    sizes further apart than that can't be alike.
    """

    apart: int
    percent: int | None = None

    def column(self, x: str, y: str):
        near = F.bit_count(F.col(f"{x}sketch").bitwiseXOR(F.col(f"{y}sketch"))) <= self.apart
        if self.percent is not None:
            near &= F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * self.percent
        return near

    def rows(self, n: np.ndarray, sketch: np.ndarray, n_other: int, sketch_other: np.uint64) -> np.ndarray:
        near = np.bitwise_count(sketch ^ sketch_other) <= self.apart
        if self.percent is not None:
            near &= np.minimum(n, n_other) * 100 >= np.maximum(n, n_other) * self.percent
        return near


def link_buckets(rounds: list[list[DataFrame]], members: DataFrame, likeness, nearness: Nearness, *, star_rounds: int = 2, block_rows: int = 2000, block_bytes: int = 32 << 20, sketches_first: bool = False) -> DataFrame | None:
    """(v, label) of the components of all alike members of common buckets; None without any link.

    rounds: frames of key, v, n (a size), sketch; v with one key are a bucket. Rounds are taken one after the other, and members
    that earlier ones connected are not compared again; so a first round of few keys spares the others the groups of copies.
    The frames of a round are shuffled one after the other, so that the disk holds one of them at a time.
    members: v, payload (binary). likeness is a picklable object whose alike(xs, ys) says of lists of payloads which pairs are
    alike; it is asked for pairs that are near only.

    A bucket's smallest member is compared with the others: a star, not all pairs. In a bucket whose members are not all
    connected then, another member, by a hash, is the centre of the next star, as long as that finds links, star_rounds times at
    most. What is left apart is compared with the whole bucket in blocks inside tasks, of at most block_rows and about block_bytes
    (n counts as 8 bytes) on either side: by sizes and sketches first, near pairs by payload unless they are connected by then;
    only links leave. So no bucket is cut and no near pair is lost. A hot key is counted before it is shuffled, and its rows meet
    the bucket's centre by a join that Spark may split.
    """
    scratch = Scratch()
    left, right = (members.select(F.col("v").alias(x), F.col("payload").alias(f"p{x}")) for x in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                found = likeness.alike(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        found = once.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(compare, "a long, b long")
        return scratch.written(found.distinct(), "links")

    def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("v"))
        return rows.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))

    apart = lambda rows: scratch.written(divided(rows), "apart")

    labels = None
    for frames in rounds:
        known, parts = labels if labels is None else small(labels), []
        for keyed in frames:
            rows = labelled(keyed, known)
            shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("v", "n", "sketch", "label")).alias("centre"), F.min("label").alias("low"), F.max("label").alias("high"))
            shared = shared.where("low <> high").select("key", "members", "centre")
            near = (F.col("label") != F.col("centre.label")) & nearness.column("", "centre.")
            met = rows.join(shared.hint("shuffle_hash"), "key").withColumn("near", near).where("members > 2 OR near")
            parts.append(scratch.written(met.select("key", "v", "n", "sketch", "members", F.when(F.col("near"), F.col("centre.v")).alias("centre")), "buckets"))
        buckets = reduce(DataFrame.unionByName, parts)
        new = links(buckets.where("centre IS NOT NULL").select(F.col("centre").alias("a"), F.col("v").alias("b")))
        found = new.count()
        labels = joined(labels, new, found)
        several = buckets.where("members > 2").select("key", "v", "n", "sketch")
        open_rows = apart(labelled(several, labels))
        # members times those that are apart, of all buckets
        work = open_rows.agg(F.sum(F.col("size") - F.col("connected"))).first()[0] or 0
        for turn in range(star_rounds):
            if not found or work <= FEW_PAIRS:
                break
            centre = open_rows.where("label <> main").groupBy("key").agg(F.min_by(F.struct("v", "n", "sketch", "label"), F.xxhash64("v", F.lit(turn))).alias("centre"))
            stars = open_rows.join(centre, "key").where("label <> centre.label").where(nearness.column("", "centre."))
            new = links(stars.select(F.col("centre.v").alias("a"), F.col("v").alias("b")))
            found = new.count()
            labels = joined(labels, new, found)
            open_rows = apart(labelled(several, labels))
            work = open_rows.agg(F.sum(F.col("size") - F.col("connected"))).first()[0] or 0
        if work:
            new = scratch.written(block_links(open_rows, members, likeness, nearness, block_rows, block_bytes, sketches_first).distinct(), "links")
            labels = joined(labels, new, new.count())
        scratch.clear()
    return labels


def divided(rows: DataFrame) -> DataFrame:
    """Those of buckets whose members have several labels, with the label that most of a bucket has, and how many."""
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    most = by_label.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("size"), (8 * F.sum("n")).alias("bytes")).where("kinds > 1")
    return rows.join(most.select("key", F.col("most.label").alias("main"), F.col("most.k").alias("connected"), "size", "bytes"), "key")


def joined(labels: DataFrame | None, new: DataFrame, count: int) -> DataFrame | None:
    """labels after count further links."""
    if not count:
        return labels
    if labels is None:
        return components(new, count)
    known = labels.count()
    if known + count <= ONE_TASK:
        return components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).union(new), known + count)
    return relabelled(labels, new)


def link_sketched(frames, members: DataFrame, likeness, apart: int, *, block_rows: int = 2000, block_bytes: int = 32 << 20) -> DataFrame | None:
    """(v, label) of the components of all alike members of common buckets; None without any link.

    For buckets that meet by accident for the most part: each key is shuffled once, with a label and 128 sketched bits of its member,
    and only members that differ in at most `apart` of them from one of another label in their bucket go on.
    frames: functions that take the labels found so far (None at first) and return key, v, sketch, wide, label; taken one after the other.
    members and likeness are as in link_buckets(), and so is what happens to members that go on: they meet in blocks inside tasks and are
    verified by payload, unless they are connected by then. No bucket is cut and no near pair is lost.
    """
    scratch, labels = Scratch(), None
    slots = shuffle_partitions(members.sparkSession)
    for frame in frames:
        dealt = frame(labels).select("key", "v", "sketch", "wide", "label").repartition(slots, "key").sortWithinPartitions("key")
        near = scratch.written(dealt.mapInArrow(partnered(apart), "key long, v long, n long, sketch long, label long"), "near")
        rows = scratch.written(divided(near), "apart")
        if not rows.isEmpty():
            whole = not rows.where(F.col("size") > 2 * block_rows).isEmpty()  # may hold rows that were not compared
            new = scratch.written(block_links(rows, members, likeness, Nearness(apart=COARSE), block_rows, block_bytes, whole).distinct(), "links")
            labels = joined(labels, new, new.count())
        scratch.clear()
    return labels


def partnered(apart: int, held_rows: int = HELD_ROWS, in_task: int = IN_TASK):
    """What mapInArrow takes, to keep of rows(key, v, sketch, wide, label) sorted by key those that are near to one of another label in their bucket.

    Pairs of rows are compared, by sketches, in buckets of at most held_rows rows and about in_task pairs of different labels; the rows of larger ones all stay.
    """

    def near_rows(key: np.ndarray, label: np.ndarray, sketch: np.ndarray, wide: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(key), bool)
        distance = lambda x, y: np.bitwise_count(sketch[x] ^ sketch[y]).astype(np.int16) + np.bitwise_count(wide[x] ^ wide[y])
        starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(key)))
        last = np.repeat(starts + sizes, sizes)
        x = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW_ROWS), sizes))
        step = 1
        while len(x := x[x + step < last[x]]):
            pairs = x[(label[x] != label[x + step]) & (distance(x, x + step) <= apart)]
            stays[pairs] = stays[pairs + step] = True
            step += 1
        for b in np.flatnonzero(sizes > FEW_ROWS).tolist():
            own = np.arange(starts[b], starts[b] + sizes[b])
            names, group, counts = np.unique(label[own], return_inverse=True, return_counts=True)
            probes = own[group != counts.argmax()]
            if len(probes) * len(own) > in_task:
                stays[own] = True
                continue
            for p in probes.tolist():
                met = own[(label[own] != label[p]) & (distance(own, p) <= apart)]
                if len(met):
                    stays[met] = stays[p] = True
        return stays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [part.column("key"), part.column("v"), pa.array(np.zeros(part.num_rows, np.int64)), part.column("sketch"), part.column("label")]
            yield from pa.table(columns, ["key", "v", "n", "sketch", "label"]).to_batches()

        def compared(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key, label, sketch, wide = (part.column(c).to_numpy() for c in ("key", "label", "sketch", "wide"))
            stays = near_rows(key, label, sketch.view(np.uint64), wide.view(np.uint64))
            if stays.any():
                yield from out(part.filter(pa.array(stays)))

        held: list[pa.RecordBatch] = []
        large = None  # the key of a bucket whose rows all stay
        for batch in batches:
            key = batch.column(0).to_numpy()
            if large is not None:
                n = int(np.searchsorted(key, large, side="right"))
                yield from out(pa.Table.from_batches([batch.slice(0, n)]))
                batch, key = batch.slice(n), key[n:]
            if not len(key):
                continue
            large = None
            open_at = int(np.searchsorted(key, key[-1]))
            if open_at or (held and held[-1].column(0)[0].as_py() != key[0]):
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, open_at)]))
                held = []
            held.append(batch.slice(open_at))
            if sum(h.num_rows for h in held) > held_rows:
                yield from out(pa.Table.from_batches(held))
                held, large = [], int(key[-1])
        if held:
            yield from compared(pa.Table.from_batches(held))

    return run


def block_links(rows: DataFrame, members: DataFrame, likeness, nearness: Nearness, block_rows: int, block_bytes: int, sketches_first: bool) -> DataFrame:
    """Links (a, b) between different labels in rows(key, v, n, sketch, label, main, connected, size, bytes), but for those of main.

    Near pairs are verified by payloads; a pair that earlier links of the block connect is not compared. With sketches_first, members meet
    by sizes and sketches before, without payloads: one that is near to none of another label in its block goes, as nearly all do where
    buckets meet by accident. The same links are found either way.
    """
    blocks = lambda c: F.ceil(F.greatest(c / block_rows, F.col("bytes") * c / F.col("size") / block_bytes)).cast("int")
    rows = rows.withColumn("base_blocks", blocks(F.col("size"))).withColumn("probe_blocks", blocks(F.col("size") - F.col("connected")))
    spread = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = rows.withColumn("i", spread("base_blocks")).withColumn("j", each("probe_blocks")).withColumn("probe", F.lit(False))
    probes = rows.where("label <> main").withColumn("j", spread("probe_blocks")).withColumn("i", each("base_blocks")).withColumn("probe", F.lit(True))
    slots = shuffle_partitions(rows.sparkSession)
    slim = ["key", "i", "j", "probe", "v", "n", "label", "sketch"]
    both = base.unionByName(probes).select(*slim)
    dealt = lambda frame: frame.repartition(slots, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def with_partner(part: pa.Table) -> Iterator[pa.RecordBatch]:
        probe = part.column("probe").to_numpy()
        n, label, sketch = (part.column(c).to_numpy() for c in ("n", "label", "sketch"))
        sketch = sketch.view(np.uint64)
        bases, stays = np.flatnonzero(~probe), np.zeros(len(probe), bool)
        of_n, of_sketch, of_label = n[bases], sketch[bases], label[bases]
        for x in np.flatnonzero(probe).tolist():
            near = nearness.rows(of_n, of_sketch, n[x], sketch[x]) & (of_label != label[x])
            if near.any():
                stays[x] = True
                stays[bases[near]] = True
        if stays.any():
            yield from part.filter(pa.array(stays)).to_batches()

    def block(part: pa.Table) -> Iterator[pa.RecordBatch]:
        probe = part.column("probe").to_numpy()
        v, n, label, sketch = (part.column(c).to_numpy() for c in ("v", "n", "label", "sketch"))
        sketch = sketch.view(np.uint64)
        payload = part.column("payload")
        if hasattr(likeness, "among"):
            alike_to, many = likeness.among(payload.to_pylist()), 4
        else:
            many = 1
            alike_to = lambda x, ys: likeness.alike([payload[x].as_py()] * len(ys), [payload[y].as_py() for y in ys])
        bases = np.flatnonzero(~probe)
        of_n, of_sketch = n[bases], sketch[bases]
        names, group = np.unique(label, return_inverse=True)
        above = list(range(len(names)))

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        found: tuple[list[int], list[int]] = ([], [])
        for x in np.flatnonzero(probe).tolist():
            near, at_once = bases[nearness.rows(of_n, of_sketch, n[x], sketch[x])].tolist(), PAIRS_IN_BLOCK
            while near:
                # a link may connect what comes after it
                own = root(group[x])
                near = [y for y in near if root(group[y]) != own]
                some, near = near[:at_once], near[at_once:]
                if some:
                    at_once *= many
                    for y, alike in zip(some, alike_to(x, some), strict=True):
                        if alike:
                            found[0].append(int(v[x]))
                            found[1].append(int(v[y]))
                            above[root(group[y])] = root(group[x])
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    def by_block(handle):
        """What mapInArrow takes, to give handle the rows of one block after the other."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            now = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                group = np.stack([batch.column(c).to_numpy() for c in range(3)])
                cuts = np.append(0, np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist()
                for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                    which = tuple(group[:, lo].tolist())
                    if which != now and held:
                        yield from handle(pa.Table.from_batches(held))
                        held = []
                    now = which
                    held.append(batch.slice(lo, hi - lo))
            if held:
                yield from handle(pa.Table.from_batches(held))

        return run

    kept = dealt(both).mapInArrow(by_block(with_partner), both.schema) if sketches_first else both
    return dealt(kept.join(members, "v").select(*slim, "payload")).mapInArrow(by_block(block), "a long, b long")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: only the components that these touch are joined."""

    def named(side: str) -> DataFrame:
        return labels.select(F.col("v").alias(side), F.col("label").alias(f"{side}l"))

    over = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("al", "a").alias("a"), F.coalesce("bl", "b").alias("b"))
    merged = components(over).select(F.col("v").alias("old"), F.col("label").alias("new"))
    known = labels.select("v", F.col("label").alias("old")).union(merged.select(F.col("old").alias("v"), "old")).distinct()
    return written(known.join(small(merged), "old", "left").select("v", F.coalesce("new", "old").alias("label")), "labels")
