"""SQL for the random-intercept fit: nested grids over the variance ratio."""

from __future__ import annotations


from .tail_sql import one_df_tail_ctes


def _fit_ctes(rows: str, levels: int, points: int) -> str:
    text = f"""
    WITH means AS (SELECT k, avg(x) AS cx, avg(y) AS cy FROM {rows} GROUP BY k),
    clusters AS (SELECT k, g, count(*) AS n, sum(x - cx) AS sx, sum(y - cy) AS sy, sum((x - cx)**2) AS xx,
                        sum((x - cx)*(y - cy)) AS xy, sum((y - cy)**2) AS yy FROM {rows} JOIN means USING (k) GROUP BY k, g),
    classes AS (SELECT k, n, count(*) AS m, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy,
                       sum(sx*sx) AS sxsx, sum(sx*sy) AS sxsy, sum(sy*sy) AS sysy FROM clusters GROUP BY k, n),
    grid_1 AS (SELECT k, CASE WHEN j = 0 THEN 0.0 ELSE pow(10.0, -6 + 7.0*j/{points}) END AS theta
               FROM means CROSS JOIN (SELECT unnest(range({points} + 1)) AS j))"""
    width = 7.0 / points
    for i in range(1, levels + 1):
        # The first grid finds the minimum; the finer ones the root of its derivative, which is not flat.
        measure = "(total - 2)*ln(q/(total - 2)) + ld + ln(det)" if i == 1 else (
            "abs((total - 2)*(dyy - 2*(base*db0 + slope*db1) + base*base*da00 + 2*base*slope*da01 + slope*slope*da11)/q"
            " + dld + (a11*da00 - 2*a01*da01 + a00*da11)/det)")
        text += f""",
    parts_{i} AS (SELECT k, theta, sum(m*n*(1 - c*n)) AS a00, sum(sx*(1 - c*n)) AS a01, sum(xx - c*sxsx) AS a11, sum(sy*(1 - c*n)) AS b0,
                         sum(xy - c*sxsy) AS b1, sum(yy - c*sysy) AS yy, sum(m*ln(1 + theta*n)) AS ld, sum(m*n) AS total,
                         -sum(m*n*n*d) AS da00, -sum(sx*n*d) AS da01, -sum(sxsx*d) AS da11, -sum(sy*n*d) AS db0, -sum(sxsy*d) AS db1,
                         -sum(sysy*d) AS dyy, sum(m*n/(1 + theta*n)) AS dld
                  FROM (SELECT *, theta/(1 + theta*n) AS c, 1/(1 + theta*n)**2 AS d FROM classes JOIN grid_{i} USING (k)) GROUP BY k, theta),
    fit_{i} AS (SELECT *, yy - (a11*b0*b0 - 2*a01*b0*b1 + a00*b1*b1)/det AS q, (a00*b1 - a01*b0)/det AS slope, (a11*b0 - a01*b1)/det AS base, a00/det AS unit
                FROM (SELECT *, a00*a11 - a01*a01 AS det FROM parts_{i})),
    best_{i} AS (SELECT k, arg_min(theta, crit) AS theta, arg_min(slope, crit) AS slope, arg_min(unit, crit) AS unit,
                        arg_min(q/(total - 2), crit) AS s2, max(total) AS total FROM
                 (SELECT *, {measure} AS crit FROM fit_{i}) GROUP BY k)"""
        if i < levels:
            text += f""",
    grid_{i + 1} AS (SELECT DISTINCT k, theta*pow(10.0, {width!r}*(j - {points // 2})/{points // 2}) AS theta
                     FROM best_{i} CROSS JOIN (SELECT unnest(range({points} + 1)) AS j))"""
            width = width / (points // 2)
    return text


def random_intercept_sql(rows: str, levels: int = 4, points: int = 400) -> str:
    """Best ratio and fit per key of ``rows`` (k, g, x, y), g being the cluster."""
    return _fit_ctes(rows, levels, points) + f"""
    SELECT k, theta, slope, s2, slope*slope/(s2*unit) AS f_value FROM best_{levels}"""


def random_intercept_test_sql(rows: str, levels: int = 4, points: int = 400) -> str:
    """The same with Satterthwaite degrees of freedom and p.

    The covariance of (tau, sigma) is twice the inverse of the second derivatives of
    the deviance; those along tau are differences over a thousandth of tau.
    """
    return _fit_ctes(rows, levels, points) + f""",
    near AS (SELECT k, w, pow(sqrt(theta)*(1 + w*0.001::DOUBLE), 2) AS theta FROM best_{levels} CROSS JOIN (VALUES (-1), (0), (1)) AS s(w)),
    near_sums AS (SELECT k, w, sum(m*n*(1 - c*n)) AS a00, sum(sx*(1 - c*n)) AS a01, sum(xx - c*sxsx) AS a11, sum(sy*(1 - c*n)) AS b0,
                         sum(xy - c*sxsy) AS b1, sum(yy - c*sysy) AS yy, sum(m*ln(1 + theta*n)) AS ld
                  FROM (SELECT *, theta/(1 + theta*n) AS c FROM classes JOIN near USING (k)) GROUP BY k, w),
    near_fits AS (SELECT k, w, yy - (a11*b0*b0 - 2*a01*b0*b1 + a00*b1*b1)/det AS q, a00/det AS u, ld + ln(det) AS l
                  FROM (SELECT *, a00*a11 - a01*a01 AS det FROM near_sums)),
    slopes AS (SELECT k, max(q) FILTER (w = 1) - max(q) FILTER (w = -1) AS dq, max(u) FILTER (w = 1) - max(u) FILTER (w = -1) AS du,
                      max(q) FILTER (w = 1) - 2*max(q) FILTER (w = 0) + max(q) FILTER (w = -1) AS ddq,
                      max(l) FILTER (w = 1) - 2*max(l) FILTER (w = 0) + max(l) FILTER (w = -1) AS ddl FROM near_fits GROUP BY k),
    bends AS (SELECT *, 4*(total - 2)/s2 AS hss, -dq/h/pow(s2, 1.5) AS hts, (ddl + ddq/s2)/(h*h) AS htt, s2*du/(2*h) AS gt, 2*sqrt(s2)*unit AS gs
              FROM (SELECT *, 0.001::DOUBLE*sqrt(theta) AS h FROM best_{levels} JOIN slopes USING (k)) WHERE theta > 0),
    tested AS (SELECT k, theta, slope, s2, slope*slope/(s2*unit) AS f, CAST(coalesce(den, total - 2) AS DOUBLE) AS den FROM best_{levels} LEFT JOIN
               (SELECT k, s2*s2*unit*unit*(htt*hss - hts*hts)/(gt*gt*hss - 2*gt*gs*hts + gs*gs*htt) AS den FROM bends) USING (k)),
    {one_df_tail_ctes('tested')}
    SELECT * FROM f_tails"""
