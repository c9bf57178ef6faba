"""SQL twins of the operators: common table expressions that build on one another, from raster to radial average."""

from __future__ import annotations

import numpy as np

from ..functions.grid import Grid


def r(expr: str, name: str) -> str:
    """A column rounded to 6 places, without a negative zero."""
    return f"round({expr}, 6) + 0.0 AS {name}"


def cube(height: int = 8, width: int = 8) -> str:
    return f"""cells AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS m, l_suppkey % {height} AS y, l_partkey % {width} AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
frames AS (SELECT CAST(m - (SELECT min(m) FROM cells) AS INTEGER) AS t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v FROM cells)"""


def spectrum(g: Grid, frames: str = "frames") -> str:
    ax, ay = f"2 * pi() * jx * x / {g.nx}", f"2 * pi() * jy * y / {g.ny}"
    return f"""rows_x AS (SELECT t, y, jx, sum(v * cos({ax})) AS a, sum(-v * sin({ax})) AS b FROM {frames}, (SELECT range AS jx FROM range({g.nxh})) GROUP BY ALL),
spectrum AS (SELECT t, CAST((jy + {g.ny // 2}) % {g.ny} AS INTEGER) AS iy, CAST(jx AS INTEGER) AS ix,
  sum(a * cos({ay}) + b * sin({ay})) / sqrt({g.nx * g.ny}) AS re, sum(b * cos({ay}) - a * sin({ay})) / sqrt({g.nx * g.ny}) AS im
  FROM rows_x, (SELECT range AS jy FROM range({g.ny})) GROUP BY t, jy, jx)"""


def structure(lags: list[int], delta_t: float = 1.0) -> str:
    return f"""sf AS (SELECT CAST(lag AS INTEGER) AS lag, lag * {delta_t} AS tau, a.iy, a.ix, avg((b.re - a.re) * (b.re - a.re) + (b.im - a.im) * (b.im - a.im)) AS d, CAST(count(*) AS INTEGER) AS n_pairs
  FROM spectrum a CROSS JOIN (SELECT unnest({lags}) AS lag) JOIN spectrum b ON b.iy = a.iy AND b.ix = a.ix AND b.t = a.t + lag GROUP BY lag, a.iy, a.ix),
extra AS (SELECT iy, ix, avg(re * re + im * im) AS power_spec, var_pop(re) + var_pop(im) AS "var" FROM spectrum GROUP BY ALL)"""


def wave_grid(g: Grid) -> str:
    f = lambda j, n: f"(CASE WHEN {j} < {(n + 1) // 2} THEN {j} ELSE {j} - {n} END / CAST({n} AS DOUBLE) * (2 * pi()) / {g.pixel_size})"
    last = f" OR ix = {g.nxh - 1}" if g.nx % 2 == 0 else ""
    return f"""g0 AS (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix, {f(f'((a.range - {g.ny // 2} + {g.ny}) % {g.ny})', g.ny)} AS ky, {f('b.range', g.nx)} AS kx FROM range({g.ny}) a, range({g.nxh}) b),
qgrid AS (SELECT *, sqrt(ky * ky + kx * kx) AS k, CASE WHEN ix = 0{last} THEN 1 ELSE 2 END AS mult FROM g0)"""


def rings(edges: list[float], low: float, mask: str = "true", weight: str = "1.0") -> str:
    mids = [edges[0], *((a + b) / 2 for a, b in zip(edges, edges[1:], strict=False))]
    edge = f"CAST({edges} AS DOUBLE[])"
    return f"""pixels AS (SELECT iy, ix, k, mult * ({weight}) AS w, mult * ({weight}) * ({weight}) AS w2, CAST(len(list_filter({edge}, lambda e: e < k)) AS INTEGER) AS bin FROM qgrid WHERE ({mask})),
inside AS (SELECT * FROM pixels WHERE bin < {len(edges)} AND k >= {low!r} AND w > 0),
sliced AS (SELECT CAST(lag AS VARCHAR) AS what, tau, iy, ix, d AS v FROM sf UNION ALL SELECT 'power_spec', NULL, iy, ix, power_spec FROM extra UNION ALL SELECT 'var', NULL, iy, ix, "var" FROM extra),
means AS (SELECT what, any_value(tau) AS tau, bin, sum(w) AS sw, sum(w2) AS sw2, sum(w * k) / sum(w) AS k, sum(w * v) / sum(w) AS avg FROM sliced JOIN inside USING (iy, ix) GROUP BY what, bin),
spreads AS (SELECT s.what, i.bin, sum(i.w * (s.v - m.avg) * (s.v - m.avg)) AS s FROM sliced s JOIN inside i USING (iy, ix) JOIN means m ON m.what = s.what AND m.bin = i.bin GROUP BY s.what, i.bin),
rings AS (SELECT w.what, w.tau, CAST(b.bin AS INTEGER) AS bin, coalesce(m.k, b.mid) AS k, coalesce(m.avg, 'NaN'::DOUBLE) AS avg,
  CASE WHEN m.k IS NULL OR m.sw - m.sw2 / m.sw = 0 THEN 'NaN'::DOUBLE ELSE sqrt(s.s / (m.sw - m.sw2 / m.sw)) END AS err
  FROM (SELECT DISTINCT what, tau FROM sliced) w CROSS JOIN (SELECT unnest(range({len(edges)})) AS bin, unnest(CAST({mids} AS DOUBLE[])) AS mid) b
  LEFT JOIN means m ON m.what = w.what AND m.bin = b.bin LEFT JOIN spreads s ON s.what = w.what AND s.bin = b.bin),
aa AS (SELECT bin, k, tau, avg AS d, err FROM rings WHERE tau IS NOT NULL),
aa_extra AS (SELECT bin, any_value(k) AS k, max(CASE WHEN what = 'power_spec' THEN avg END) AS power_spec, max(CASE WHEN what = 'power_spec' THEN err END) AS power_spec_err,
  max(CASE WHEN what = 'var' THEN avg END) AS "var", max(CASE WHEN what = 'var' THEN err END) AS var_err FROM rings WHERE tau IS NULL GROUP BY bin)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def quadratic(rows: str, by: str, value: str, weight: str = "1.0", scaled: bool = False) -> str:
    """Constant term of a quadratic in tau by Cramer's rule, and its standard error."""
    s = [f"sum({weight} * {weight} * pow(u, {n}))" for n in range(5)]
    y = [f"sum({weight} * {weight} * {value} * pow(u, {n}))" for n in range(3)]
    by_comma = f"{by}, "
    return f"""centred AS (SELECT *, (tau - avg(tau) OVER (PARTITION BY {by})) / (max(tau) OVER (PARTITION BY {by}) - min(tau) OVER (PARTITION BY {by})) AS u,
  - avg(tau) OVER (PARTITION BY {by}) / (max(tau) OVER (PARTITION BY {by}) - min(tau) OVER (PARTITION BY {by})) AS z FROM {rows}),
sums AS (SELECT {by_comma}{', '.join(f'{e} AS s{n}' for n, e in enumerate(s))}, {', '.join(f'{e} AS y{n}' for n, e in enumerate(y))}, sum({weight} * {weight} * {value} * {value}) AS yy, count(*) AS n, any_value(z) AS z FROM centred GROUP BY {by}),
dets AS (SELECT *, s2*s4-s3*s3 AS c00, s2*s3-s1*s4 AS c01, s1*s3-s2*s2 AS c02, s0*s4-s2*s2 AS c11, s1*s2-s0*s3 AS c12, s0*s2-s1*s1 AS c22, s0*(s2*s4-s3*s3)+s1*(s2*s3-s1*s4)+s2*(s1*s3-s2*s2) AS det FROM sums),
coefs AS (SELECT *, (c00*y0+c01*y1+c02*y2)/det AS p0, (c01*y0+c11*y1+c12*y2)/det AS p1, (c02*y0+c12*y1+c22*y2)/det AS p2,
  (c00 + 2*z*c01 + z*z*(c11+2*c02) + 2*z*z*z*c12 + z*z*z*z*c22) / det AS spread FROM dets),
poly AS (SELECT {by_comma}p0 + p1*z + p2*z*z AS b, sqrt(spread{' * greatest(yy - p0*y0 - p1*y1 - p2*y2, 0.0) / (n - 3)' if scaled else ''}) AS b_err FROM coefs)"""


def spline_weights(taus: list[float], at: list[float], degree: int) -> str:
    """A table (tau, src, w): the log of a spline's value at ``tau`` is the sum of w times the logs of the curve at ``src``.

    Made apart from the operator: the spline is a polynomial and one-sided powers that begin at the knots, all fixed by the curve's points.
    """
    x, to = np.log(np.array(taus, float)), np.log(np.array(at, float))
    knots = x[(degree + 1) // 2 : -(degree + 1) // 2] if degree % 2 else ((x[1:] + x[:-1]) / 2)[degree // 2 : -(degree // 2)]
    terms = lambda v: np.column_stack([*(v**n for n in range(degree + 1)), *(np.maximum(v - c, 0) ** degree for c in knots)])
    w = terms(to) @ np.linalg.inv(terms(x))
    rows = ", ".join(f"({float(t)!r}::DOUBLE, {float(s)!r}::DOUBLE, {float(w[i, j])!r}::DOUBLE)" for i, t in enumerate(at) for j, s in enumerate(taus))
    return f"(SELECT * FROM (VALUES {rows}) AS v(tau, src, w))"
