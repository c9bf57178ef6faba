"""Wavevector grid, windows, masks and weights: generated tables and Column expressions over grid columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coefficients of the exact Blackman and the Blackman-Harris window.
BLACKMAN = (7938 / 18608, 9240 / 18608, 1430 / 18608)
BLACKMAN_HARRIS = (0.3635819, 0.4891775, 0.1365995, 0.0106411)


def next_power_of_2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _smooth(n: int, primes: tuple[int, ...]) -> int:
    for p in primes:
        while n % p == 0:
            n //= p
    return n


def next_fast_len(target: int, rule: str = "py", force_even: bool = False) -> int:
    """The least size of at least ``target`` whose factors an FFT handles well.

    ``py``: factors 2, 3, 5, 7 and one 11 at most; ``cpp``: and one 11 or 13 at most; ``cuda``: 2, 3, 5, 7.
    """
    rest = {"py": (1, 11), "cpp": (1, 11, 13), "cuda": (1,)}
    if rule not in rest:
        raise RuntimeError(f"unknown rule {rule}; there are {', '.join(rest)}")
    n = max(1, target)
    while _smooth(n, (2, 3, 5, 7)) not in rest[rule] or (force_even and n % 2):
        n += 1
    return n


def fast_len(n: Column, most: int) -> Column:
    """``next_fast_len`` (rule ``py``) of a column whose values are ``most`` at most: the first of all such sizes that is not smaller."""
    sizes = [1]
    while sizes[-1] < most:
        sizes.append(next_fast_len(sizes[-1] + 1))
    return F.array_min(F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= n))


def power_of_2(n: Column) -> Column:
    """``next_power_of_2`` of a column of ints."""
    return F.array_min(F.filter(F.array(*[F.lit(1 << e) for e in range(32)]), lambda p: p >= n))


@dataclass(frozen=True)
class Grid:
    """Sizes of the frames and of the padded transform; scale of the axes."""

    height: int
    width: int
    ny: int
    nx: int
    pixel_size: float = 1.0
    delta_t: float = 1.0

    @classmethod
    def of(cls, height: int, width: int, pixel_size: float = 1.0, delta_t: float = 1.0) -> Grid:
        return cls(height, width, next_fast_len(height), next_fast_len(width), pixel_size, delta_t)

    @property
    def nxh(self) -> int:
        return self.nx // 2 + 1

    def with_frame_rate(self, fps: float) -> Grid:
        return Grid(self.height, self.width, self.ny, self.nx, self.pixel_size, 1.0 / fps)

    def axes(self) -> tuple[list[float], list[float]]:
        """(ky by iy, kx by ix) in the scale of pixel_size."""
        wrap = lambda j, n: (j if j < (n + 1) // 2 else j - n) / n
        ky = [2 * math.pi * wrap((iy - self.ny // 2) % self.ny, self.ny) / self.pixel_size for iy in range(self.ny)]
        return ky, [2 * math.pi * wrap(ix, self.nx) / self.pixel_size for ix in range(self.nxh)]


def _frequency(j: Column, n: int) -> Column:
    return F.when(j < (n + 1) // 2, j).otherwise(j - n) / float(n) * (2 * math.pi)


def qgrid(spark: SparkSession, grid: Grid, full: bool = False) -> DataFrame:
    """iy, ix, ky, kx, k, mult: half plane with y shifted, or the full plane with both axes shifted. mult counts a pixel's mirror image."""
    ix = F.col("id") % (grid.nx if full else grid.nxh)
    iy = F.floor(F.col("id") / (grid.nx if full else grid.nxh))
    cells = spark.range(grid.ny * (grid.nx if full else grid.nxh)).select(iy.cast("int").alias("iy"), ix.cast("int").alias("ix"))
    jy = F.pmod(F.col("iy") - grid.ny // 2, F.lit(grid.ny))
    jx = F.pmod(F.col("ix") - grid.nx // 2, F.lit(grid.nx)) if full else F.col("ix")
    cells = cells.withColumns({"ky": _frequency(jy, grid.ny) / grid.pixel_size, "kx": _frequency(jx, grid.nx) / grid.pixel_size})
    once = (F.col("ix") == 0) | (F.lit(grid.nx % 2 == 0) & (F.col("ix") == grid.nxh - 1))
    return cells.withColumns({"k": F.sqrt(F.col("ky") * F.col("ky") + F.col("kx") * F.col("kx")), "mult": F.lit(1) if full else F.when(once, 1).otherwise(2)})


def _cosines(i: Column, n: int, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for m, c in enumerate(coefficients[1:], 1):
        total = total + (-1) ** m * c * F.cos(i * (2 * math.pi * m / n))
    return total


def blackman(height: int, width: int) -> Column:
    """Periodic exact Blackman window over columns y, x."""
    return _cosines(F.col("y"), height, BLACKMAN) * _cosines(F.col("x"), width, BLACKMAN)


def blackman_harris(height: int, width: int) -> Column:
    return _cosines(F.col("y"), height, BLACKMAN_HARRIS) * _cosines(F.col("x"), width, BLACKMAN_HARRIS)


def central_cross(grid: Grid, by_axes: bool = False) -> Column:
    """True away from the central cross of the half plane: by index, or where kx or ky is 0."""
    if by_axes:
        return (F.col("kx") != 0) & (F.col("ky") != 0)
    return (F.col("ix") != 0) & (F.col("iy") != grid.ny // 2)


def sector_weight(theta_0: float = 0.0, delta_theta: float = 90.0, rep: int = 2, kind: str = "uniform") -> Column:
    """Weight of wavevectors by their angle (degrees): ``rep`` sectors of opening ``delta_theta`` around theta_0, evenly placed.

    ``uniform`` adds 1 strictly inside a sector; ``gauss`` adds a normal density of standard deviation delta_theta / 2.
    """
    if kind not in ("uniform", "gauss"):
        raise RuntimeError("kind is uniform or gauss")
    theta, opening = F.atan2("ky", "kx"), math.radians(delta_theta)
    total = F.lit(0.0)
    for r in range(rep):
        at = math.radians(theta_0) + 2 * math.pi * r / rep
        off = F.pmod(theta - at + math.pi, F.lit(2 * math.pi)) - math.pi
        if kind == "uniform":
            total = total + F.when((off / opening) * (off / opening) < 0.25, 1.0).otherwise(0.0)
        else:
            sigma = opening / 2
            total = total + F.exp(-0.5 * (off / sigma) * (off / sigma)) / (sigma * math.sqrt(2 * math.pi))
    return total


def sphere_form_factor(radius: float = 1.0, contrast: float = 1.0, kind: str = "amplitude") -> Column:
    """Form factor of a sphere over column k; its limit at k = 0. ``intensity`` is 4 pi times the square."""
    if kind not in ("amplitude", "intensity"):
        raise RuntimeError("kind is amplitude or intensity")
    volume, x = 4 / 3 * math.pi * radius**3, F.col("k") * radius
    amplitude = contrast * volume * F.when(F.col("k") == 0, 1 / 3).otherwise((F.sin(x) - x * F.cos(x)) / (x * x * x))
    return amplitude if kind == "amplitude" else 4 * math.pi * amplitude * amplitude
