"""Intermediate scattering function from a radial average: f = 1 - (D - B) / A."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .noise import radial_noise


def intermediate_scattering(aa: DataFrame, aa_extra: DataFrame, noise: DataFrame | str = "polyfit", plateau: DataFrame | str = "var", **noise_args) -> DataFrame:
    """isf (seq_id, bin, k, tau, f, err).

    ``noise``: a mode, or a table (seq_id, bin, b, b_err); ``plateau``: var, power_spec (twice that), or a table (seq_id,
    bin, p, p_err). Null errors stand for the values themselves. A ring that a given table lacks or has twice, or an unknown plateau, raises ``RuntimeError``.
    """
    b = radial_noise(aa, aa_extra, noise, **noise_args) if isinstance(noise, str) else noise.select("seq_id", "bin", "b", "b_err")
    if isinstance(plateau, str):
        if plateau not in ("var", "power_spec"):
            raise RuntimeError("plateau is var, power_spec or a table")
        p = aa_extra.select("seq_id", "bin", (2 * F.col(plateau)).alias("p"), (2 * F.col(f"{plateau}_err")).alias("p_err"))
    else:
        p = plateau.select("seq_id", "bin", "p", "p_err")
    for given in [x for x, own in ((b, isinstance(noise, str)), (p, isinstance(plateau, str))) if not own]:
        rings = aa.select("seq_id", "bin").distinct().join(given, ["seq_id", "bin"], "left").groupBy("seq_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.count(given.columns[2]).alias("values"))
        if not rings.where("n <> 1 OR values <> 1").isEmpty():
            raise RuntimeError("a given table must have one row for each ring")
    rows = aa.join(b, ["seq_id", "bin"]).join(p, ["seq_id", "bin"])
    d, bb, pp = F.col("d"), F.col("b"), F.col("p")
    sb, sp, sd = F.coalesce("b_err", "b"), F.coalesce("p_err", "p"), F.coalesce("err", "d")
    a = pp - bb
    err = F.sqrt(F.pow((d - bb) / (a * a) * sp, 2.0) + F.pow((pp - d) / (a * a) * sb, 2.0) + F.pow(sd / a, 2.0))
    return rows.select("seq_id", "bin", "k", "tau", (1 - (d - bb) / a).alias("f"), err.alias("err"))
