"""Structure functions over a stream of spectra: the newest frames are the state, sums per lag come out as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "seq_id string, iy int, ix int, lag int, s double, n long"
STATE = "t array<int>, re array<double>, im array<double>"


def lagged_sums(spectrum: DataFrame, lags: list[int]) -> DataFrame:
    """Per micro-batch and wavevector the new pairs' sum of squared differences and their count.

    The state of a wavevector is its last max(lags) frames, so it is bounded. Frames come in order of t across batches; pairs with a
    missing frame are left out. Sum s and n by lag, then divide: the structure function so far.
    """
    keep = max(lags)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = {t: complex(a, b) for t, a, b in zip(*state.get, strict=True)} if state.exists else {}
        new = {}
        for pdf in parts:
            new |= {int(t): complex(a, b) for t, a, b in zip(pdf["t"], pdf["re"], pdf["im"], strict=True)}
        both, rows = old | new, []
        for lag in lags:
            d = [abs(both[t] - both[t - lag]) ** 2 for t in new if t - lag in both]
            d += [abs(both[t + lag] - both[t]) ** 2 for t in new if t + lag in old]
            if d:
                rows.append((*key, lag, float(np.sum(d)), len(d)))
        last = sorted(both)[-keep:]
        state.update(([int(t) for t in last], [both[t].real for t in last], [both[t].imag for t in last]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return spectrum.groupBy("seq_id", "iy", "ix").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def total(sums: DataFrame) -> DataFrame:
    """Structure function of all sums so far."""
    return sums.groupBy("seq_id", "iy", "ix", "lag").agg((F.sum("s") / F.sum("n")).alias("d"), F.sum("n").cast("int").alias("n_pairs"))
