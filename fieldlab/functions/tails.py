"""Tail probabilities in numpy, used on summary rows only.

Whole arrays are evaluated at once; no function here ever sees raw rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

# Lanczos approximation, g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012,
            9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x):
    """Logarithm of the gamma function for positive arguments."""
    z = np.asarray(x, dtype=float) - 1.0
    total = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def _beta_fraction(a, b, x, rounds=10_000_000):
    """Continued fraction of the incomplete beta function (modified Lentz), until it has converged."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, rounds + 1):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            return h
    raise ArithmeticError("the continued fraction of the beta function did not converge")


def log_gamma_ratio(a, b):
    """log_gamma(a + b) - log_gamma(a); for large a without their cancellation."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(b, dtype=float))
    s = a + b
    big = a > 200.0
    safe = np.where(big, a, 200.0)
    far = ((safe - 0.5) * np.log1p(b / safe) + b * np.log(safe + b) - b + (1 / (safe + b) - 1 / safe) / 12
           - (1 / (safe + b) ** 3 - 1 / safe ** 3) / 360)
    return np.where(big, far, log_gamma(s) - log_gamma(a))


def beta_inc(a, b, x, rest=None):
    """Regularised incomplete beta function; ``rest`` is 1 - x if known better."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    rest = 1.0 - x if rest is None else np.broadcast_to(np.clip(np.asarray(rest, dtype=float), 0.0, 1.0), x.shape)
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    y, z = np.where(flip, rest, x), np.where(flip, x, rest)
    inside = (y > 0.0)
    safe, other = np.where(inside, y, 0.5), np.where(inside, z, 0.5)
    # The smaller of both parts carries the digits; huge degrees of freedom need them.
    log_y = np.where(safe > 0.5, np.log1p(-np.minimum(other, 0.5)), np.log(safe))
    log_z = np.where(other > 0.5, np.log1p(-np.minimum(safe, 0.5)), np.log(np.where(other > 0, other, 1.0)))
    large, small = np.maximum(p, q), np.minimum(p, q)
    front = np.exp(log_gamma_ratio(large, small) - log_gamma(small) + p * log_y + q * log_z) / p
    part = np.where(inside, front * _beta_fraction(p, q, safe), 0.0)
    return np.where(flip, 1.0 - part, part)


def f_sf(f, df1, df2):
    """Upper tail of the F distribution."""
    f, df1, df2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    good = np.isfinite(f) & (f >= 0) & (df1 > 0) & (df2 > 0)
    ff, d1, d2 = np.where(good, f, 1.0), np.where(good, df1, 1.0), np.where(good, df2, 1.0)
    return np.where(good, beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * ff), d1 * ff / (d2 + d1 * ff)), np.nan)


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    return f_sf(np.asarray(t, dtype=float) ** 2, np.ones_like(np.asarray(df, dtype=float)), df)


def t_quantile(p, df):
    """Student quantile for p above one half: series start, then Newton steps."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    z = np.vectorize(NormalDist().inv_cdf, otypes=[float])(p)
    v = np.maximum(df, 1e-9)
    t = z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v)
    # Two closed forms start the heavy tails.
    t = np.where(df <= 1, np.tan(np.pi * (p - 0.5)), t)
    t = np.where(df == 2, (2 * p - 1) / np.sqrt(2 * p * (1 - p)), t)
    log_c = log_gamma((v + 1) / 2) - log_gamma(v / 2) - 0.5 * np.log(v * np.pi)
    for _ in range(8):
        pdf = np.exp(log_c - (v + 1) / 2 * np.log1p(t * t / v))
        step = (0.5 * t_sf2(t, v) - (1.0 - p)) / pdf
        t = t + step
        if np.all(np.abs(step) <= 1e-13 * np.abs(t)):
            break
    return t


@lru_cache(maxsize=32)
def t975_by_points(size):
    """97.5 % points of Student's t for a line through 3 .. size points.

    Beyond a thousand points the series is good to eleven digits.
    """
    out = np.full(size + 1, np.inf)
    near = min(size, 1000)
    out[3:near + 1] = t_quantile(0.975, np.arange(3, near + 1) - 2.0)
    z, v = NormalDist().inv_cdf(0.975), np.arange(near + 1, size + 1) - 2.0
    out[near + 1:] = (z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2)
                      + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3))
    return out


def normal_sf(z):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(z, dtype=float) / math.sqrt(2.0))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _panels(lo, hi, n):
    """Gauss-Legendre nodes and weights of n panels from lo to hi."""
    edges = np.linspace(lo, hi, n + 1)
    half = 0.5 * np.diff(edges)[:, None]
    return (half * _NODES + 0.5 * (edges[1:] + edges[:-1])[:, None]).ravel(), (half * _WEIGHTS).ravel()


def _range_sf(w, k):
    """P(range of k standard normals > w), for an array w; small values keep their digits."""
    # Integrate k * phi(u) * (Phi(u)^(k-1) - (Phi(u) - Phi(u - w))^(k-1)) over the largest value u.
    u, weights = _panels(-9.0, 39.0, 48)
    below = normal_sf(-u)
    gone = np.minimum(normal_sf(np.asarray(w, dtype=float)[..., None] - u) / below, 1.0 - 1e-16)
    part = below ** (k - 1) * -np.expm1((k - 1) * np.log1p(-gone))
    return np.sum(weights * k * np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi) * part, axis=-1)


def _log_chi_factor(x):
    """x log x - x - log_gamma(x), without its cancellation for large x."""
    if x < 100.0:
        return x * math.log(x) - x - math.lgamma(x)
    return 0.5 * math.log(x / (2 * math.pi)) - 1 / (12 * x) + 1 / (360 * x ** 3) - 1 / (1260 * x ** 5)


def tukey_sf(q, k, df):
    """Upper tail of the studentised range of k means with df degrees of freedom."""
    q = np.atleast_1d(np.asarray(q, dtype=float))
    k = np.broadcast_to(np.asarray(k, dtype=float), q.shape)
    df = np.broadcast_to(np.asarray(df, dtype=float), q.shape)
    out = np.empty(q.shape)
    for i in range(q.size):
        if not np.isfinite(q[i]) or not df[i] > 0:
            out[i] = np.nan
            continue
        if q[i] <= 0 or np.isinf(df[i]):
            out[i] = 1.0 if q[i] <= 0 else min(1.0, float(_range_sf(q[i], k[i])))
            continue
        # On the scale of log s, s = chi / sqrt(df), the integrand is about 1/sqrt(2 df) wide, wherever q puts its peak.
        spread = 1.0 / math.sqrt(2.0 * df[i])
        lo = -0.5 * math.log1p(q[i] ** 2 / (2.0 * df[i])) - 10.0 * spread - 40.0 / df[i]
        hi = 10.0 * spread
        # The range of many means passes from one to zero on a scale far below the width of the density.
        y, weights = _panels(lo, hi, (1 if k[i] <= 64 else 4) * math.ceil((hi - lo) / (2.0 * spread)))
        log_pdf = math.log(2.0) + _log_chi_factor(df[i] / 2.0) + df[i] * (y - 0.5 * np.expm1(2.0 * y))
        out[i] = min(1.0, float(np.sum(weights * np.exp(log_pdf) * _range_sf(q[i] * np.exp(y), k[i]))))
    return out


def tukey_point(alpha, k, df):
    """The studentised range that is passed with probability alpha; one value of k and df."""
    if not df > 0 or k < 2:
        return math.nan
    lo, hi = 0.0, 4.0
    while tukey_sf(hi, k, df)[0] > alpha:
        lo, hi = hi, 2.0 * hi
    while hi - lo > 1e-12 * hi:
        # Sixteen points at once narrow the bracket to a seventeenth.
        points = np.linspace(lo, hi, 18)
        above = int(np.sum(tukey_sf(points[1:-1], k, df) > alpha))
        lo, hi = points[above], points[above + 1]
    return 0.5 * (lo + hi)
