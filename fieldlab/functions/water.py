"""Seawater columns from published formulas, as plain Column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column

# One-atmosphere equation of state (Millero & Poisson 1981).
PURE_WATER = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
SALT_LINEAR = (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
SALT_THREE_HALVES = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
SALT_SQUARE = 4.8314e-4

# Practical salinity scale 1978.
PSS_A = (0.0080, -0.1692, 25.3851, 14.0941, -7.0261, 2.7081)
PSS_B = (0.0005, -0.0056, -0.0066, -0.0375, 0.0636, -0.0144)
PSS_C = (0.6766097, 2.00564e-2, 1.104259e-4, -6.9698e-7, 1.0031e-9)
PSS_D = (3.426e-2, 4.464e-4, 4.215e-1, -3.107e-3)
PSS_E = (2.070e-5, -6.370e-10, 3.989e-15)
PSS_K = 0.0162
STANDARD_CONDUCTIVITY = 42.9140  # mS/cm at S=35, 15 C (1968 scale), 0 dbar

# Tris buffer in synthetic seawater, total scale (Dickson).
TRIS_INVERSE_T = (11911.08, -18.2499, -0.039336)
TRIS_CONSTANT = (-366.27059, 0.53993607, 0.00016329)
TRIS_LOG_T = (64.52243, -0.084041)
TRIS_LINEAR_T = -0.11149858
GAS_CONSTANT = 8.314472
FARADAY = 96485.34
KELVIN = 273.15


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner evaluation, lowest order first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def temperature_1968(t: Column | str) -> Column:
    """1990 scale to the 1968 scale the equation of state was fitted on."""
    return (as_column(t) - 0.0002) / 0.99975


# Share of the conductivity at 25 degrees C by which a degree changes it (linear compensation of natural waters).
COMPENSATION = 0.0191


def density(salinity: Column | str, temperature: Column | str) -> Column:
    """Seawater density at the surface, kg per cubic metre."""
    s = as_column(salinity).cast("double")
    t = temperature_1968(temperature)
    return (polynomial(t, PURE_WATER) + polynomial(t, SALT_LINEAR) * s
            + polynomial(t, SALT_THREE_HALVES) * s * F.sqrt(s) + F.lit(SALT_SQUARE) * s * s)


def dry_weight(buoyant: Column | str, water_density: Column | str, body_density: Column | str) -> Column:
    """Weight in air of a body weighed under water (densities in one unit)."""
    return as_column(buoyant) / (1.0 - as_column(water_density) / as_column(body_density))


def practical_salinity(conductivity: Column | str, temperature: Column | str,
                       pressure: Column | float = 0.0) -> Column:
    """Practical salinity from mS/cm, degrees C (1990 scale) and dbar.

    Valid for salinity of 2 and above; deployments are filtered far above that.
    """
    c = as_column(conductivity).cast("double")
    t = as_column(temperature) * 1.00024
    p = pressure if isinstance(pressure, Column) else F.lit(float(pressure))
    ratio = c / F.lit(STANDARD_CONDUCTIVITY)
    d1, d2, d3, d4 = PSS_D
    e1, e2, e3 = PSS_E
    pressure_term = F.lit(1.0) + p * (e1 + e2 * p + e3 * p * p) / (
        1.0 + d1 * t + d2 * t * t + (d3 + d4 * t) * ratio)
    rt = ratio / (pressure_term * polynomial(t, PSS_C))
    root = F.sqrt(rt)
    dt = t - 15.0
    return polynomial(root, PSS_A) + dt / (1.0 + PSS_K * dt) * polynomial(root, PSS_B)


def specific_conductance(conductivity: Column | str, temperature: Column | str, per_degree: float = COMPENSATION) -> Column:
    """Conductivity as it would be at 25 degrees C, by linear compensation."""
    return as_column(conductivity) / (1.0 + per_degree * (as_column(temperature) - 25.0))


def conductivity_at(specific: Column | str, temperature: Column | str, per_degree: float = COMPENSATION) -> Column:
    """Conductivity at a temperature from the one at 25 degrees C; undoes ``specific_conductance``."""
    return as_column(specific) * (1.0 + per_degree * (as_column(temperature) - 25.0))


def tris_ph(salinity: Column | str, temperature: Column | str) -> Column:
    """pH of the tris buffer on the total scale."""
    s = as_column(salinity)
    k = as_column(temperature) + KELVIN
    return (polynomial(s, TRIS_INVERSE_T) / k + polynomial(s, TRIS_CONSTANT)
            + polynomial(s, TRIS_LOG_T) * F.log(k) + F.lit(TRIS_LINEAR_T) * k)


def total_ph(sample_mv: Column | str, tris_mv: Column | str, salinity: Column | str,
             temperature: Column | str) -> Column:
    """Sample pH from the electrode difference to the buffer."""
    k = as_column(temperature) + KELVIN
    volts = (as_column(tris_mv) - as_column(sample_mv)) / 1000.0
    return tris_ph(salinity, temperature) + volts / (k * (GAS_CONSTANT / FARADAY) * F.log(F.lit(10.0)))
