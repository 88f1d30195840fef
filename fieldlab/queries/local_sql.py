"""SQL for ranked local regression, written out window by window.

Every window meets its points, so this only suits the short series of the small
test tables. The engine itself never forms these rows.
"""

from __future__ import annotations

from ..functions.tails import t_quantile

T_TABLE = ", ".join(f"({n}, {v!r})" for n, v in zip(
    range(3, 401), (float(v) for v in t_quantile(0.975, [n - 2.0 for n in range(3, 401)]))))


def ranked_local_regression_sql(points: str, alpha: float = 0.5) -> str:
    """Best window per file of ``points`` (file, x, y)."""
    rank = "floor(rank() OVER (PARTITION BY file ORDER BY {0}) + (count(*) OVER (PARTITION BY file, {0}) - 1) / 2.0)"
    ranks = " + ".join(rank.format(c) for c in ("skew", "serial", "width"))
    return f"""
    WITH p AS (SELECT file, x, y, row_number() OVER (PARTITION BY file ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY file) AS n
               FROM {points}),
    w AS (SELECT a.file, a.i, b.i AS j, b.i - a.i + 1 AS m FROM p a JOIN p b ON a.file = b.file
          WHERE b.i - a.i + 1 >= greatest(3, floor({alpha} * a.n))),
    fit AS (SELECT w.file, w.i, w.j, w.m, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx
            FROM w JOIN p ON p.file = w.file AND p.i BETWEEN w.i AND w.j GROUP BY ALL),
    e AS (SELECT f.*, p.x, p.i AS k, p.y - f.a - f.b * p.x AS e FROM fit f JOIN p ON p.file = f.file AND p.i BETWEEN f.i AND f.j),
    z AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY file, i, j ORDER BY k), 0) AS z FROM e),
    s AS (SELECT file, i, j, m, a, b, any_value(sxx) AS sxx, sum(e*e) AS rss, sum(e*e*e) AS e3, sum(e*z) AS ez, sum(z*z) AS zz,
                 sum(z) AS z1, sum(z*(x - mx)) AS zx FROM z GROUP BY ALL),
    q AS (SELECT s.*, abs((e3/m) / (rss/m)**1.5) AS skew, ez*ez / ((zz - z1*z1/m - zx*zx/sxx) * rss) AS serial,
                 2*t*sqrt(rss/(m - 2)/sxx) AS width FROM s JOIN (VALUES {T_TABLE}) AS tt(m, t) USING (m)),
    r AS (SELECT *, ({ranks}) / 3.0 / count(*) OVER (PARTITION BY file) AS score FROM q)
    SELECT file, arg_min(i, (score, i, j)) AS start_row, arg_min(j, (score, i, j)) AS stop_row,
           arg_min(a, (score, i, j)) AS intercept, arg_min(b, (score, i, j)) AS slope, min(score) AS score FROM r GROUP BY file"""
