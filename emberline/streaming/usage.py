"""Daily use and token buckets over a stream. An addition: there is nothing to match; batch and stream give equal results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def daily(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """(provider, day, requests, tokens) of a stream usage(provider, ts, tokens): a row a day once the watermark has passed it."""
    days = usage.withWatermark("ts", late).groupBy("provider", F.window("ts", "1 day"))
    return days.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select("provider", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "requests", "tokens")


class Bucket(StatefulProcessor):
    """A provider's bucket of rpm tokens, refilled rpm / 60 a second.

    Requests wait in slices of event time, each a value of its own, until the watermark has passed the slice: then none can come before them any
    more, a timer goes off, and they are admitted in the order of at and request_id. Request n, from 0, is admitted at the latest of at
    and, for each m up to n, at of m and the time that n - m + 1 tokens take beyond a full bucket; so what has to be kept of all requests
    before is their number and the running maximum. Only a slice is ever held whole, besides a chunk of input.
    """

    def __init__(self, slice_seconds: int) -> None:
        self.slice_seconds = slice_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "at array<double>, id array<long>, rpm int")
        self.admitted = handle.getValueState("admitted", "base double, n long, most double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            place = np.floor(frame["at"] / self.slice_seconds).astype("int64")
            for number, part in frame.groupby(place):
                at, ids = part["at"].tolist(), part["request_id"].tolist()
                if self.waiting.containsKey((number,)):
                    before = self.waiting.getValue((number,))
                    at, ids = [*before[0], *at], [*before[1], *ids]
                else:
                    self.handle.registerTimer(int((number + 1) * self.slice_seconds * 1000))
                self.waiting.updateValue((number,), (at, ids, int(part["rpm"].iloc[0])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // (self.slice_seconds * 1000)
        for number in sorted(k[0] for k in list(self.waiting.keys())):
            if number >= passed:
                break
            at, ids, rpm = self.waiting.getValue((number,))
            self.waiting.removeKey((number,))
            frame = pd.DataFrame({"provider": key[0], "request_id": np.array(ids, "int64"), "at": np.array(at, "float64")}).sort_values(["at", "request_id"], ignore_index=True)
            base, n, most = self.admitted.get() if self.admitted.exists() else (frame["at"].iloc[0], 0, -np.inf)
            each, rank = 60.0 / rpm, n + np.arange(len(frame))
            early = np.maximum(np.maximum.accumulate(frame["at"].to_numpy() - base - rank * each), most)
            self.admitted.update((float(base), int(n + len(frame)), float(early[-1])))
            frame["admitted_at"] = np.maximum(frame["at"], base + early + (rank + 1 - rpm) * each)
            yield frame.assign(waited=frame["admitted_at"] - frame["at"])

    def close(self) -> None:
        pass


def token_bucket(requests: DataFrame, late: str = "1 minute", slice_seconds: int = 10) -> DataFrame:
    """A stream requests(provider, request_id, ts, rpm) with at (seconds), admitted_at and waited, as operators.usage.token_bucket() has them.

    A request has its row once the watermark, `late` behind the latest ts, has passed its slice of time; what comes later than that is
    dropped by Spark. Requests without rpm are admitted at once, those without ts have no time of admission. Needs the RocksDB state store.
    """
    rows = requests.select("provider", F.col("request_id").cast("long").alias("request_id"), "ts", F.col("rpm").cast("int").alias("rpm"), F.unix_micros("ts").cast("double").alias("at"))
    rows = rows.withColumn("at", F.col("at") / 1e6).withWatermark("ts", late)
    free = rows.where("rpm IS NULL OR ts IS NULL").select("provider", "request_id", "at", F.col("at").alias("admitted_at"), (F.col("at") - F.col("at")).alias("waited"))
    capped = rows.where("rpm IS NOT NULL AND ts IS NOT NULL").groupBy("provider")
    placed = capped.transformWithStateInPandas(Bucket(slice_seconds), "provider string, request_id long, at double, admitted_at double, waited double", "Append", "EventTime")
    return free.unionByName(placed)
