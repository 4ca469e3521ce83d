"""Mixing sources to target weights by Pfair scheduling: blocks of documents get release times and deadlines from their
source's weight, and the earliest deadline goes first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import fresh, open_output, shuffle_partitions, work_path

NO_SOURCE = "\u0000null"
SHARED = "\u0000shared"
#: Sources and lanes that the driver plans.
MAX_SOURCES = 20_000
#: Blocks whose plan the driver holds and broadcasts; that of a larger table is the same, but goes to a file in slices.
MAX_BLOCKS = 4_000_000
#: Blocks in a slice of such a file.
SLICE = 500_000
#: Blocks of a source in one row of the table of places.
CHUNK = 4096
#: What sums of doubles may be off at a whole turn.
NEAR = 1e-9


@dataclass(frozen=True)
class Plan:
    """slots[s][k] is the turn of source s's block k; every turn from 0 on is one block's. starts has the first turn of each round: one begins
    when a source has gone out at its share to its end."""

    slots: dict[str, np.ndarray]
    starts: np.ndarray

    def rounds(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, slots, side="right") - 1


def _windows(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(release and deadline of every block, source after source; when each source ends), as turns.

    In the ideal, all sources that last are sent at once, at shares in proportion to their weights; v is what each has been sent by then
    a unit of weight, the same for all that last. So source s ends at v = blocks / weight, and the turn that belongs to a v runs
    in straight lines between these ends. Block k is released when the ideal has sent k blocks of its source, rounded down, and due when it has sent k + 1, rounded up.
    """
    ends = blocks / weights
    order = np.argsort(ends, kind="stable")
    v = np.concatenate([[0.0], ends[order]])
    gone = np.concatenate([[0], np.cumsum(blocks[order])])
    # summed from the last one, so that the weight that is left is not a difference of large numbers
    lasting = np.append(np.cumsum(weights[order][::-1])[::-1], 0.0)
    turn = gone + v * lasting
    source = np.repeat(np.arange(len(blocks)), blocks)
    k = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    near = NEAR + 1e-12 * len(source)
    release = np.floor(np.interp(k / weights[source], v, turn) + near).astype(np.int64)
    due = np.ceil(np.interp((k + 1) / weights[source], v, turn) - near).astype(np.int64)
    return release, due, turn[1:]


def _earliest_deadline_first(release: np.ndarray, due: np.ndarray) -> np.ndarray:
    """The turn of each block: of those released, the one that is due first is sent, then the next. No turn is left free."""
    slots = np.empty(len(release), np.int64)
    coming = np.argsort(release, kind="stable")
    begins, dues, coming = release[coming].tolist(), due[coming].tolist(), coming.tolist()
    ready: list[tuple[int, int]] = []
    at, n = 0, len(coming)
    for t in range(n):
        while at < n and (begins[at] <= t or not ready):
            heapq.heappush(ready, (dues[at], coming[at]))
            at += 1
        slots[heapq.heappop(ready)[1]] = t
    return slots


def plan(blocks: dict[str, int], weights: dict[str, float]) -> Plan:
    """The turns of all blocks. Sources keep their weights to each other to the end, whichever have ended: every source is less than one block
    from what the ideal has sent of it, after any number of turns.

    That holds as the blocks whose windows lie within some turns are at most as many as the turns, for the ideal sends them there; so all are
    sent within their windows when the earliest deadline goes first. Sources without weight go out after that, in proportion to their blocks.
    """
    slots: dict[str, np.ndarray] = {}
    starts: list[int] = []
    done = 0
    names = sorted(s for s, n in blocks.items() if n)
    for group, weight in (([s for s in names if weights.get(s, 0) > 0], weights), ([s for s in names if not weights.get(s, 0) > 0], blocks)):
        if not group:
            continue
        n, w = np.array([blocks[s] for s in group], np.int64), np.array([weight[s] for s in group], float)
        release, due, ends = _windows(n, w / w.sum())
        turns = _earliest_deadline_first(release, due) + done
        slots |= dict(zip(group, np.split(turns, np.cumsum(n)[:-1]), strict=True))
        starts += [done, *(done + np.unique(np.ceil(ends - NEAR - 1e-12 * len(turns)).astype(np.int64))[:-1]).tolist()]
        done += len(turns)
    return Plan(slots, np.array(sorted(set(starts)), np.int64))


def plan_slices(blocks: dict[str, int], weights: dict[str, float], size: int) -> Iterator[pa.Table]:
    """The plan() of all blocks as rows of mix_lane, mix_block, slot, turn, about `size` rows a time: only these, and some numbers a source, are held."""
    names = sorted(s for s, n in blocks.items() if n)
    done, first_round = 0, 0
    for group, weight in (([s for s in names if weights.get(s, 0) > 0], weights), ([s for s in names if not weights.get(s, 0) > 0], blocks)):
        if not group:
            continue
        n, w = np.array([blocks[s] for s in group], np.int64), np.array([weight[s] for s in group], float)
        w = w / w.sum()
        order = np.argsort(n / w, kind="stable")
        v = np.concatenate([[0.0], (n / w)[order]])
        turn = np.concatenate([[0], np.cumsum(n[order])]) + v * np.append(np.cumsum(w[order][::-1])[::-1], 0.0)
        total = int(n.sum())
        near = NEAR + 1e-12 * total
        starts = np.append(0, np.unique(np.ceil(turn[1:] - near).astype(np.int64))[:-1])
        lanes = pa.array(group, pa.string())

        def coming() -> Iterator[tuple[int, int, int, int]]:
            """(release, due, source, block) in the order of plan()'s, slice by slice of the ideal."""
            since, held = np.zeros(len(n), np.int64), np.zeros((4, 0), np.int64)  # noqa: B023
            for end in range(size, total + size, size):  # noqa: B023
                until = n if end >= total else np.minimum(n, np.ceil(np.interp(end, turn, v) * w).astype(np.int64))  # noqa: B023
                until = np.maximum(until, since)
                source = np.repeat(np.arange(len(n)), until - since)  # noqa: B023
                k = np.arange(len(source)) - np.repeat(np.cumsum(until - since) - until, until - since)
                release = np.floor(np.interp(k / w[source], v, turn) + near).astype(np.int64)  # noqa: B023
                due = np.ceil(np.interp((k + 1) / w[source], v, turn) - near).astype(np.int64)  # noqa: B023
                rows = np.concatenate([held, np.stack([release, due, source, k])], axis=1)
                rows = rows[:, np.lexsort((rows[3], rows[2], rows[0]))]
                # later slices may hold blocks of the last release
                cut = rows.shape[1] if end >= total else int(np.searchsorted(rows[0], end - 1))  # noqa: B023
                held, since = rows[:, cut:], until
                yield from zip(*rows[:, :cut].tolist(), strict=True)

        rows, ready, out = coming(), [], []
        following = next(rows, None)
        for t in range(total):
            while following is not None and (following[0] <= t or not ready):
                heapq.heappush(ready, following[1:])
                following = next(rows, None)
            out.append(heapq.heappop(ready)[1:])
            if len(out) == size or t + 1 == total:
                source, k = np.array(out, np.int64).T
                slot = np.arange(t + 1 - len(out), t + 1)
                turns = np.searchsorted(starts, slot, side="right") - 1 + first_round
                yield pa.table([lanes.take(pa.array(source)), pa.array(k), pa.array(slot + done), pa.array(turns, pa.int32())], ["mix_lane", "mix_block", "slot", "turn"])
                out = []
        done, first_round = done + total, first_round + len(starts)


def written_plan(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """plan_slices() as a table in the shared folder."""
    path = work_path(spark, "mix-plan")
    schema = pa.schema([("mix_lane", pa.string()), ("mix_block", pa.int64()), ("slot", pa.int64()), ("turn", pa.int32())])
    with open_output(f"{path}/plan.parquet") as sink, pq.ParquetWriter(sink, schema) as writer:
        for part in plan_slices(blocks, weights, SLICE):
            writer.write_table(part)
    return spark.read.parquet(path)


def lanes_of(counts: DataFrame, max_sources: int) -> tuple[list, set[str] | None]:
    """Of counts(mix_source, n, weight): (rows of lane, n, weight; the sources with a lane of their own, or None if all have).

    With over max_sources sources, the half of that with most rows have lanes of their own, and the others share as many lanes,
    by hash. So the driver sees max_sources rows at most.
    """
    rows = counts.limit(max_sources + 1).collect()
    if len(rows) <= max_sources:
        return [(r[0], r[1], r[2]) for r in rows], None
    top = [(r[0], r[1], r[2]) for r in counts.orderBy(F.desc("n"), "mix_source").limit(max_sources // 2).collect()]
    own = {r[0] for r in top}
    tail = counts.join(F.broadcast(_names(counts, own)), "mix_source", "left_anti")
    shared = tail.groupBy(_shared_lane(max_sources).alias("lane")).agg(F.sum("n"), F.sum("weight")).collect()
    return top + [(r[0], r[1], r[2]) for r in shared], own


def _names(df: DataFrame, names: set[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(s,) for s in sorted(names)], "mix_source string")


def _shared_lane(max_sources: int):
    return F.concat(F.lit(SHARED), F.pmod(F.xxhash64("mix_source"), F.lit(max(1, max_sources // 2))).cast("string"))


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = 8, seed: int = 17, max_sources: int = MAX_SOURCES) -> DataFrame:
    """docs with mix_round, mix_block, mix_slot and mix_place: every row once, in the order of mix_place mixed to weights.

    weights: target share of each value of source; by default the number of its rows to the power. A source without weight
    goes out after all others; when a source ends, the others keep their weights to each other; a null source is a source.
    Within a source, rows stand in the order of a hash of doc_id, then in the order of their columns; block_rows in a row make
    a block, and mix_slot is the block's turn. mix_place is mix_slot * block_rows + the row's place in its block; a source's
    last block may be short, which leaves places free. The four columns come last; where docs has such a name, the new column
    has an underscore more.

    Only counts by source reach the driver, which plans the turn of every block; the plan of over MAX_BLOCKS blocks is
    the same one, written slice by slice to the shared folder and joined from there. Beyond max_sources sources, small ones share lanes that are planned as one source with the weight of
    all of them; within a lane, the row that is due first at its source's weight goes first. A source's rows are ranked in as
    many ranges of the hash as its size asks for, so no task has a whole large source.
    """
    spark = docs.sparkSession
    added = [fresh(docs, name) for name in ("mix_round", "mix_block", "mix_slot", "mix_place")]
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("mix_source"), F.xxhash64(F.lit(seed), "doc_id").alias("mix_key"))
    counts = docs.groupBy(source.alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        given = spark.createDataFrame(list(weights.items()), "mix_source string, weight double")
        counts = counts.join(given, "mix_source", "left").na.fill(0.0, ["weight"])
    lanes, own = lanes_of(counts, max_sources)
    rows_of, target = {r[0]: r[1] for r in lanes}, {r[0]: r[2] for r in lanes if r[2] > 0}
    total = sum(rows_of.values())
    blocks = {s: -(-n // block_rows) for s, n in rows_of.items()}
    held = sum(blocks.values()) <= MAX_BLOCKS
    planned = plan(blocks if held else {}, target)
    slots = planned.slots
    turns = {s: planned.rounds(x) for s, x in slots.items()}
    # About MAX_BLOCKS numbers at most.
    rows = [(s, c // CHUNK, slots[s][c : c + CHUNK], turns[s][c : c + CHUNK]) for s in slots for c in range(0, len(slots[s]), CHUNK)]
    kinds = {"mix_lane": pa.string(), "mix_chunk": pa.int64(), "slots": pa.list_(pa.int64()), "turns": pa.list_(pa.int32())}
    table = F.broadcast(spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))))

    each = max(1, total // (4 * shuffle_partitions(spark)))
    if own is None:
        ranked = ranked_by_hash(keyed, {s: -(-n // each) for s, n in rows_of.items()})
    else:
        names = F.broadcast(_names(docs, own))
        ranked = ranked_by_hash(keyed.join(names, "mix_source", "left_semi"), {s: -(-rows_of[s] // each) for s in own})
        tail = keyed.join(names, "mix_source", "left_anti").join(counts.select("mix_source", "weight"), "mix_source")
        of_source = Window.partitionBy("mix_source").orderBy("mix_key", "row")
        tail = tail.withColumn("mix_due", F.row_number().over(of_source) / F.greatest("weight", F.lit(1e-12)))
        of_lane = Window.partitionBy("mix_lane").orderBy("mix_due", "mix_source", "mix_key", "row")
        tail = tail.withColumn("mix_lane", _shared_lane(max_sources)).withColumn("mix_rank", F.row_number().over(of_lane) - 1)
        ranked = ranked.unionByName(tail.select("row", "mix_lane", "mix_rank"))

    placed = ranked.withColumn("mix_block", F.floor(F.col("mix_rank") / F.lit(block_rows)))
    placed = placed.withColumn("mix_chunk", F.floor(F.col("mix_block") / F.lit(CHUNK))).join(table, ["mix_lane", "mix_chunk"])
    if not held:
        placed = ranked.withColumn("mix_block", F.floor(F.col("mix_rank") / F.lit(block_rows))).join(written_plan(spark, blocks, target), ["mix_lane", "mix_block"])
        columns = (F.col("turn"), F.col("mix_block"), F.col("slot"), F.col("slot") * block_rows + F.col("mix_rank") % block_rows)
        return placed.select("row.*", *[c.alias(name) for c, name in zip(columns, added, strict=True)])
    at = (F.col("mix_block") % CHUNK).cast("int")
    slot = F.get("slots", at)
    place = slot * block_rows + F.col("mix_rank") % block_rows
    columns = (F.get("turns", at), F.col("mix_block"), slot, place)
    return placed.select("row.*", *[c.alias(name) for c, name in zip(columns, added, strict=True)])


def ranked_by_hash(keyed: DataFrame, ranges: dict[str, int]) -> DataFrame:
    """row, mix_lane, mix_rank of keyed(row, mix_source, mix_key): a source is a lane; ranges of the hash are ranked alone."""
    spark = keyed.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(ranges.items()), "mix_source string, ranges long"))
    keyed = keyed.join(known, "mix_source").withColumn("mix_range", F.floor((F.col("mix_key") / F.lit(2.0**64) + 0.5) * F.col("ranges")))
    sizes = keyed.groupBy("mix_source", "mix_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("mix_source", "mix_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    within = Window.partitionBy("mix_source", "mix_range").orderBy("mix_key", "row")
    ranked = keyed.withColumn("mix_rank", F.row_number().over(within)).join(sizes, ["mix_source", "mix_range"])
    return ranked.select("row", F.col("mix_source").alias("mix_lane"), (F.col("mix_rank") + F.col("mix_before") - 1).alias("mix_rank"))


def in_order(mixed: DataFrame) -> DataFrame:
    """What mix() returned, sorted by mix_place over all its partitions, without the four columns that it added."""
    n = shuffle_partitions(mixed.sparkSession)
    place = F.col(f"`{mixed.columns[-1]}`")
    return mixed.repartitionByRange(n, place).sortWithinPartitions(place).drop(*mixed.columns[-4:])


def file_order(docs: DataFrame, name: str = "file_place") -> DataFrame:
    """docs with the place of each row in the files that it is read from, which in_order() wrote one after the other.

    The place is the last column; its name is a new one. Files are named part-NNNNN by Spark's writers. A table that isn't read
    from such files has no such order: its rows get their doc_id.
    """
    name = fresh(docs, name)
    try:
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
        placed = docs.select("*", (F.when(number != "", number.cast("long")) * F.lit(2**40) + F.col("_metadata.row_index")).alias(name))
        placed.schema  # resolves the names
    except AnalysisException:
        return docs.withColumn(name, F.col("doc_id"))
    return placed.withColumn(name, F.coalesce(name, "doc_id"))
