"""Lag sequences: short integer lists made on the driver, and the one-column table that operators join."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def logspace_int(stop: int, num: int = 50, endpoint: bool = False) -> list[int]:
    """About logarithmic whole numbers from 1 on: steps are at least 1, the ratio adapts to what is left.

    Ends at ``stop`` with ``endpoint``; rounds half to even; distinct.
    """
    if num < 1:
        return []
    points = num if endpoint else num + 1
    ratio, value, out = float(stop) ** (1.0 / points), 1.0, [1.0]
    for i in range(1, num):
        if value * ratio - value >= 1.0:
            value *= ratio
        else:
            value += 1.0
            left = points - i - 1
            if left > 0:
                ratio = (stop / value) ** (1.0 / left)
        out.append(value)
    return sorted({min(round(x), int(stop)) for x in out})


def fibonacci(stop: int, endpoint: bool = False) -> list[int]:
    """1, 2, 3, 5, ... below ``stop`` (up to it with ``endpoint``); always begins with 1, 2."""
    out = [1, 2]
    while (following := out[-1] + out[-2]) < stop or (endpoint and following == stop):
        out.append(following)
    return out


def checked_lags(lags: Iterable[int], n_frames: int) -> list[int]:
    """Distinct ascending lags; a negative or too large one raises, 0 is left out with a warning."""
    found = sorted({int(x) for x in lags})
    if found and found[0] < 0:
        raise RuntimeError("lags must not be negative")
    if found and found[-1] > n_frames - 1:
        raise RuntimeError(f"lags must not exceed {n_frames - 1}, the number of frames less 1")
    if 0 in found:
        warnings.warn("lag 0 is left out", stacklevel=2)
        found.remove(0)
    return found


def lag_table(spark: SparkSession, lags: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lags], "lag int")
