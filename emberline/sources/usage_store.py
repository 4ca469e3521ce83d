"""Daily use of providers, kept in files: every batch of requests is counted once, however often it is sent.

Below a store's path, each source of batches has files of JSON rows (provider, day, requests, input_tokens, output_tokens):

    source=S/kind=batch/id=N/    the sums of batch N
    source=S/kind=base/id=N/     the sums of all batches up to N

A batch that comes again replaces its own file. compact() writes a base; batches up to the newest base no longer count, so one of them
that comes again changes nothing. Each of these is one small file, which a job puts in place as its last step: a reader sees
it whole or not at all. Rows that can't be read, and files that don't exist, count as zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("requests", "input_tokens", "output_tokens")
_ROW = "provider STRING, day STRING, requests BIGINT, input_tokens BIGINT, output_tokens BIGINT"


@dataclass(frozen=True)
class UsageStore:
    """Counts of requests and tokens by provider and day, in files below path."""

    spark: SparkSession
    path: str

    def _rows(self) -> DataFrame:
        """All rows of all files, with source, kind and id; broken holds a line that is no such row."""
        try:
            lines = self.spark.read.schema("value STRING, source STRING, kind STRING, id BIGINT").text(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = self.spark.createDataFrame([], "value STRING, source STRING, kind STRING, id BIGINT")
        row = F.from_json("value", f"{_ROW}, broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
        return lines.where("value <> ''").select(row.alias("row"), "source", "kind", "id").select("row.*", "source", "kind", "id")

    def _counting(self) -> DataFrame:
        """The rows that count: of each source its newest base and the batches after it. Bases are told by folder names alone."""
        rows = self._rows()
        newest = rows.where("kind = 'base'").groupBy("source").agg(F.max("id").alias("base"))
        # As many rows as there are sources of batches, which have names in folders.
        rows = rows.join(F.broadcast(newest), "source", "left")
        return rows.where("(kind = 'base' AND id = base) OR (kind = 'batch' AND (base IS NULL OR id > base))")

    def totals(self) -> DataFrame:
        """(provider, day, requests, input_tokens, output_tokens, tokens): all that is recorded."""
        good = self._counting().where("broken IS NULL AND provider IS NOT NULL AND day IS NOT NULL")
        sums = good.groupBy("provider", "day").agg(*[F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(c) for c in COUNTS])
        return sums.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))

    def broken(self) -> DataFrame:
        """(source, kind, id, provider, broken): lines that count as zero because they are no rows, with what was read of a provider."""
        return self._counting().where("broken IS NOT NULL").select("source", "kind", "id", "provider", "broken")

    def _put(self, sums: DataFrame, source: str, kind: str, number: int) -> None:
        # Sums by provider and day: a small table, and one file of it.
        sums.select("provider", "day", *COUNTS).coalesce(1).write.mode("overwrite").json(f"{self.path}/source={source}/kind={kind}/id={number}")

    def record(self, requests: DataFrame, batch_id: int, source: str = "requests") -> None:
        """Count a batch requests(provider, day, input_tokens, output_tokens), one row a request; a batch that was counted is replaced."""
        sums = requests.groupBy("provider", "day").agg(F.count("*").alias("requests"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]])
        self._put(sums, source, "batch", batch_id)

    def sink(self, source: str = "requests") -> Callable[[DataFrame, int], None]:
        """What writeStream.foreachBatch takes. After a restart Spark sends the last batch again, with its number, if it isn't sure of it."""
        return lambda batch, batch_id: self.record(batch, batch_id, source)

    def compact(self, upto: int, source: str = "requests") -> None:
        """Fold a source's batches up to this number into one base. Nothing that was counted changes, and old files may be deleted."""
        rows = self._counting().where((F.col("source") == source) & (F.col("id") <= upto) & F.col("broken").isNull() & F.col("provider").isNotNull())
        sums = rows.groupBy("provider", "day").agg(*[F.sum(c).alias(c) for c in COUNTS])
        self._put(sums, source, "base", upto)

    def today(self, caps: DataFrame, day: str) -> DataFrame:
        """(provider, rpd, tpd, requests, tokens, remaining) of caps(provider, rpd, tpd) on a day; no record is no use.

        remaining is null where requests have no cap, else at least 0.
        """
        used = self.totals().where(F.col("day") == day).select("provider", "requests", "tokens")
        # A row for each provider on one day.
        joined = caps.join(used, "provider", "left").na.fill(0, ["requests", "tokens"])
        return joined.select("provider", "rpd", "tpd", "requests", "tokens", F.when(F.col("rpd").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("rpd") - F.col("requests"))).alias("remaining"))
