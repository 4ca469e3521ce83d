"""What several operators of this subpackage share: the shared folder, written tables, Arrow text buffers, dictionaries."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a local session gets a
    temporary one; on a cluster, executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="emberline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> None:
    """df as Parquet. When it is written, the shuffle files of the job go: what follows reads the table."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses none of it."""
    path = work_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(path: str) -> None:
    """A folder of the shared folder, with all that is in it, where it exists."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


class Scratch:
    """Tables that an operator writes on its way, so that it can remove them when nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(df.sparkSession, name)
        write_table(df, path)
        self.tables.append((df.sparkSession.read.schema(df.schema).parquet(path), path))
        return self.tables[-1][0]

    def clear(self, *keep: DataFrame | None) -> None:
        """Remove all tables but these."""
        for table_, path in self.tables:
            if not any(table_ is k for k in keep):
                remove(path)
        self.tables = [t for t in self.tables if any(t[0] is k for k in keep)]


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ and so on that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their UTF-8 bytes end to end, offsets with one more than rows), each of at most max_bytes or of one row.

    A null text counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        _, offsets_buffer, data_buffer = texts.buffers()
        offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1)
            part = offsets[start : end + 1]
            yield batch.slice(start, end - start), data[part[0] : part[-1]], part - part[0]
            start = end
        # Workers live on after their tasks; what Arrow keeps for later is memory that others want.
        del batch, texts, offsets_buffer, data_buffer, data, offsets, part
        pa.default_memory_pool().release_unused()


def learns(doc_id: str = "doc_id"):
    """Rows a model may learn from: crc32 of the id as text, mod 3, is not 1. A null id never counts."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def bounded_texts(labelled: DataFrame, labels: list, per_class: int, max_bytes_per_class: int, key: str = "doc_id") -> list:
    """At most per_class rows and about max_bytes_per_class bytes of whole texts of each of labels, the same ones at every run.

    labelled: key, text, label. Rows are taken in the order of a hash of key, so the sample is spread over the table. Which rows
    they are is found by keys and lengths alone; only the texts that are taken leave their tasks. Repeated rows are one.
    """
    place = ["sample_mix", "sample_key", "sample_text"]
    slim = labelled.where(F.col("label").isin(labels)).select(F.col("label").alias("sample_label"), F.xxhash64(F.col(key)).alias("sample_mix"), F.col(key).alias("sample_key"), F.xxhash64("text").alias("sample_text"), F.octet_length("text").alias("sample_bytes"))
    order = Window.partitionBy("sample_label").orderBy(*place)
    # Spark takes the first rows of a label within every partition before it shuffles them.
    first = slim.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= per_class)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("sample_before", F.coalesce(F.sum("sample_bytes").over(before), F.lit(0))).where(F.col("sample_before") < max_bytes_per_class)
    # At most per_class rows of numbers for each label.
    chosen = F.broadcast(first.select("sample_label", "sample_key", "sample_text").distinct())
    same = (F.col("label") == F.col("sample_label")) & (F.col(key) == F.col("sample_key")) & (F.xxhash64("text") == F.col("sample_text"))
    found = labelled.join(chosen, same, "left_semi").select(key, "text", "label").distinct().collect()
    return sorted(found, key=lambda r: (str(r["label"]), hashlib.sha256(str(r[key]).encode()).digest(), r["text"] or ""))


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A zstandard dictionary trained on samples; too few of them to train on make a dictionary of their plain content."""
    samples = [s for s in samples if s]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            pass
    content = b"".join(samples)[-size:]
    return zstandard.ZstdCompressionDict(content if len(content) >= 8 else b"no text to learn from", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_hash(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def open_output(uri: str):
    """A binary stream to a new file of the shared folder, from any executor."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # else a name on .zst would compress again


def open_input(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
