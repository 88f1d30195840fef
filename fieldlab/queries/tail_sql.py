"""SQL for tail probabilities: the quadrature sums written as joins with sequences of nodes."""

from __future__ import annotations

import math

from ..functions import normal


def horner(x: str, coefficients) -> str:
    text = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {float(c)!r})"
    return text


def normal_upper_sql(z: str) -> str:
    """Upper tail of the normal law at a column z."""
    a = f"abs({z})"
    far = f"({a} + 0.65)"
    for i in (4, 3, 2, 1):
        far = f"({a} + {i} / {far})"
    near = f"{horner(a, normal.UPPER_TOP)} / {horner(a, normal.UPPER_BOTTOM)}"
    tail = f"exp(-{a} * {a} / 2) * (CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE {(2 * math.pi) ** -0.5!r} / {far} END)"
    return f"(CASE WHEN {z} < 0 THEN 1 - {tail} ELSE {tail} END)"


def range_tail_ctes(rows: str) -> str:
    """Tables up to ``tails``: the rows of ``rows`` (with q, k, df; k up to 64) and p, the tail of the studentised range."""
    return f"""
    tail_rows AS MATERIALIZED (SELECT row_number() OVER () AS tail_row, * FROM {rows}),
    tail_steps AS (SELECT tail_row, q, k, df, low, step, unnest(range(CAST(ceil((10/sqrt(2*df) - low)/step) AS BIGINT) + 1)) AS i FROM
        (SELECT *, -0.5*ln(1 + q*q/(2*df)) - 10/sqrt(2*df) - 40/df AS low, least(0.5/sqrt(2*df), 0.12) AS step FROM tail_rows WHERE q > 0)),
    tail_scales AS (SELECT tail_row, k, q*exp(y) AS w, exp(df*(y - 0.5*(exp(2*y) - 1))) AS d FROM (SELECT *, low + i*step AS y FROM tail_steps)),
    tail_nodes AS (SELECT u, {normal_upper_sql('v')} AS below FROM (SELECT -9 + j*0.25::DOUBLE AS u, 9 - j*0.25::DOUBLE AS v FROM
        (SELECT unnest(range(193)) AS j))),
    tail_parts AS (SELECT tail_row, d, k*0.25*exp(-0.5*u*u)*{(2 * math.pi) ** -0.5!r}
            * (pow(below, k - 1) - pow(greatest(0, below - {normal_upper_sql('gap')}), k - 1)) AS part
        FROM (SELECT *, w - u AS gap FROM tail_scales CROSS JOIN tail_nodes)),
    tail_sums AS (SELECT tail_row, least(1.0, sum(d*part)*193/sum(d)) AS p FROM tail_parts GROUP BY tail_row),
    tails AS (SELECT tail_rows.*, CASE WHEN q <= 0 THEN 1.0 ELSE p END AS p FROM tail_rows LEFT JOIN tail_sums USING (tail_row))"""


def one_df_tail_ctes(rows: str) -> str:
    """Tables up to ``f_tails``: the rows of ``rows`` (with f and den) and p, the tail of F with 1 and den degrees of freedom.

    The tail is a Laplace integral over z; z = exp(s - exp(-s)) makes the sum over
    even steps of s exact to rounding. The same sum at f = 0 is the whole.
    """
    gap = "(CASE WHEN z/b < 1e-5 THEN z/b*(1 - z/b/2*(1 - z/b/3)) ELSE 1 - exp(-z/b) END)"
    return f"""
    f_rows AS MATERIALIZED (SELECT row_number() OVER () AS f_row, * FROM {rows}),
    f_nodes AS (SELECT exp(s - exp(-s)) AS z, exp(-exp(s - exp(-s)))*exp(s - exp(-s))*(1 + exp(-s)) AS weight
        FROM (SELECT -4.4 + j/32.0::DOUBLE AS s FROM (SELECT unnest(range(270)) AS j))),
    f_sums AS (SELECT f_row, sum(weight/sqrt(x + {gap})) / sum(weight/sqrt({gap})) * any_value(exp(-(b - 0.5)*ln(1 + x))) AS p
        FROM (SELECT f_row, f/den AS x, den/2 AS b FROM f_rows) CROSS JOIN f_nodes GROUP BY f_row),
    f_tails AS (SELECT f_rows.*, p FROM f_rows JOIN f_sums USING (f_row))"""


def signif_sql(c: str, digits: int = 2) -> str:
    power = f"pow(10.0, {digits - 1} - floor(log10(abs({c}))))"
    return f"(CASE WHEN {c} = 0 THEN 0.0 ELSE round({c} * {power}) / {power} END)"


def text_sql(c: str) -> str:
    """The text of a double of two significant digits below ten million."""
    return (f"(CASE WHEN abs({c}) >= 0.001 OR {c} = 0 THEN CAST({c} AS VARCHAR) "
            f"ELSE printf('%.1f', {c} / pow(10.0, floor(log10(abs({c}))))) || 'E' || CAST(floor(log10(abs({c}))) AS INTEGER) END)")
