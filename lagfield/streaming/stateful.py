"""Structure functions over a stream whose frames come late, out of order and twice: event time, state with timers, hopping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "seq_id string, iy int, ix int, chunk int, lag int, s double, n long"
FRAMES = "t array<int>, re array<double>, im array<double>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LagProcessor(StatefulProcessor):
    """State of a wavevector: the frames that a frame yet to come may pair with, those of the last ``max(lags)`` frames before the watermark and all after it."""

    def __init__(self, lags: list[int], frame_ms: int, chunk: int | None, overlap: int):
        self.lags, self.frame_ms, self.chunk, self.step = lags, frame_ms, chunk, (chunk or 1) - overlap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getValueState("frames", FRAMES)

    def _held(self) -> dict[int, complex]:
        return {int(t): complex(a, b) for t, a, b in zip(*self.frames.get(), strict=True)} if self.frames.exists() else {}

    def _keep(self, held: dict[int, complex], watermark: int) -> None:
        """Frames out of reach of all that may still come go; a timer looks again when the newest will be."""
        first = watermark // self.frame_ms - 1 - max(self.lags)
        held = {t: v for t, v in held.items() if t >= first}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if held:
            order = sorted(held)
            self.frames.update((order, [held[t].real for t in order], [held[t].imag for t in order]))
            self.handle.registerTimer((order[-1] + max(self.lags) + 2) * self.frame_ms)
        else:
            self.frames.clear()

    def _chunks(self, early: int, late: int) -> range:
        """The chunks [i step, i step + chunk) that hold both frames of a pair."""
        return range(max(0, -(-(late - self.chunk + 1) // self.step)), early // self.step + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), self._held()
        new: dict[int, complex] = {}
        for pdf in rows:
            for t, a, b in zip(pdf["t"], pdf["re"], pdf["im"], strict=True):
                # A frame that is there already, or came too late to be told from one that was, does not count.
                if t not in held and t not in new and (t + 1) * self.frame_ms > watermark:
                    new[int(t)] = complex(a, b)
        both, sums = held | new, {}
        for lag in self.lags:
            pairs = {(t - lag, t) for t in new if t - lag in both} | {(t, t + lag) for t in new if t + lag in both}
            for early, late in sorted(pairs):
                d = abs(both[late] - both[early]) ** 2
                for c in (None, *(self._chunks(early, late) if self.chunk else ())):
                    s, n = sums.get((c, lag), (0.0, 0))
                    sums[c, lag] = s + d, n + 1
        self._keep(both, watermark)
        yield pd.DataFrame([(*key, c, lag, s, n) for (c, lag), (s, n) in sums.items()], columns=[f.split()[0] for f in OUT.split(", ")]).astype({"chunk": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._held(), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({f.split()[0]: pd.Series(dtype="object" if "string" in f else "float64") for f in OUT.split(", ")})

    def close(self) -> None:
        pass


def lagged_sums(spectrum: DataFrame, lags: list[int], frame_seconds: int, delay: str, chunk: int | None = None, overlap: int = 0) -> DataFrame:
    """Additive sums (s, n) of every micro-batch by wavevector and lag, and with ``chunk`` for each hopping chunk too (chunk null: the whole sequence).

    Frame t is at (t + 1) * ``frame_seconds`` of event time, after the first watermark, which is 0. Frames may come in any order within ``delay`` of the newest; later ones are dropped. A repeated frame counts once, the
    one that came first. The state is bounded by the delay and the largest lag, and goes when the watermark has passed it. Needs the RocksDB state store (``with_state_store``).
    """
    if not 0 <= overlap < (chunk or 1):
        raise ValueError("overlap must be smaller than the chunk")
    if not lags or min(lags) < 1:
        raise RuntimeError("lags must be positive")
    timed = spectrum.select("seq_id", "iy", "ix", "t", "re", "im", F.timestamp_seconds((F.col("t") + 1) * frame_seconds).alias("at")).withWatermark("at", delay)
    processor = LagProcessor(sorted(set(lags)), frame_seconds * 1000, chunk, overlap)
    return timed.groupBy("seq_id", "iy", "ix").transformWithStateInPandas(processor, OUT, "append", "eventTime")


def total(sums: DataFrame) -> DataFrame:
    """Structure functions of all sums so far: seq_id, iy, ix, chunk, lag, d, n_pairs."""
    out = sums.groupBy("seq_id", "iy", "ix", "chunk", "lag").agg(F.sum("s").alias("s"), F.sum("n").cast("int").alias("n_pairs"))
    return out.select("seq_id", "iy", "ix", "chunk", "lag", (F.col("s") / F.col("n_pairs")).alias("d"), "n_pairs")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now, to a table in ``folder``, and reads it. The state store is RocksDB while it runs."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
