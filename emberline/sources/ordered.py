"""A digest over texts in their order: a fold that no two tasks can share, of which all but the fold itself is spread."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.workspace import new_path

_CHUNK = 1 << 20
#: Bytes of a range that are sorted in one task at most, bytes that are worth a task, and what a row takes beside its text.
_RANGE, _SMALL, _ROW = 1 << 26, 1 << 22, 64


def ordered_digest(rows: DataFrame, order: list[str], text: str) -> DataFrame:
    """One row: digest, the hex SHA-256 of the texts one after the other in the order of the columns `order`, then of text. Null texts are none.

    Texts are sorted in ranges over all tasks; each task writes its range to a file below spark.checkpoint.dir, and one task reads these files
    in order, a megabyte at a time. So no task holds more than its range. Files carry an id of their attempt; the rows that tasks return say
    which ones count.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "ordered")
    # written first, so that finding the ranges doesn't make the texts a second time
    rows.select(*order, F.col(text).alias("ordered_text")).write.parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows")
    # as many ranges as tasks where they are small, more where they would be large; the digest is the same
    size = kept.agg(F.sum(F.octet_length("ordered_text") + _ROW)).first()[0] or 0
    n = max(1, -(-size // _RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // _SMALL))

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        place = TaskContext.get().partitionId()
        name, out = f"{folder}/{place:06}-{uuid.uuid4().hex}.zst", None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            if not len(texts):
                continue
            if out is None:
                out = pa.CompressedOutputStream(store.open_output_stream(name, compression=None), "zstd")
            _, offsets, data = texts.buffers()
            ends = memoryview(offsets).cast("q")[texts.offset : texts.offset + len(texts) + 1]
            if data is not None:
                out.write(data[ends[0] : ends[-1]])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "name": [name]})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, digest = fs.FileSystem.from_uri(path)[0], hashlib.sha256()
        for batch in batches:
            for name in batch.column(1).to_pylist():
                with store.open_input_stream(name, compression=None) as raw, pa.CompressedInputStream(raw, "zstd") as stream:
                    while chunk := stream.read(_CHUNK):
                        digest.update(chunk)
        yield pa.RecordBatch.from_pydict({"digest": [digest.hexdigest()]})

    ranges = kept.repartitionByRange(n, *order).sortWithinPartitions(*order, "ordered_text").mapInArrow(spill, "place long, name string")
    # a row for each range
    folded = ranges.repartition(1).sortWithinPartitions("place").mapInArrow(fold, "digest string")
    return folded.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"))  # without texts, no task runs
