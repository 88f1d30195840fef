"""Normal quantile and tail as Columns, so ranks and tests never leave the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .water import polynomial

# Rational approximation AS 241 (Wichura 1988), lowest order first.
CENTRE_TOP = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427,
              13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
              33430.575583588128105, 2509.0809287301226727)
CENTRE_BOTTOM = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
                 21213.794301586595867, 39307.895800092710610, 28729.085735721942674,
                 5226.4952788528545610)
MIDDLE_TOP = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
              3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1,
              2.27238449892691845833e-2, 7.74545014278341407640e-4)
MIDDLE_BOTTOM = (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
                 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
                 1.05075007164441684324e-9)
TAIL_TOP = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
            2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
            2.71155556874348757815e-5, 2.01033439929228813265e-7)
TAIL_BOTTOM = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
               7.86869131745613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
               2.04426310338993978564e-15)


def normal_quantile(p: Column) -> Column:
    """z with P(Z <= z) = p for p strictly between 0 and 1."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * polynomial(r, CENTRE_TOP) / polynomial(r, CENTRE_BOTTOM)
    s = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    middle = polynomial(s - 1.6, MIDDLE_TOP) / polynomial(s - 1.6, MIDDLE_BOTTOM)
    tail = polynomial(s - 5.0, TAIL_TOP) / polynomial(s - 5.0, TAIL_BOTTOM)
    outer = F.when(s <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -outer).otherwise(outer)


# Rational approximation of the upper tail (Hart 1968, no. 5666), lowest order first.
UPPER_TOP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
             6.37396220353165, 0.700383064443688, 3.52624965998911e-2)
UPPER_BOTTOM = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
                86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2)


def normal_upper(z: Column) -> Column:
    """P(Z > z) to 1e-15; small tails keep eight digits."""
    a = F.abs(z)
    near = polynomial(a, UPPER_TOP) / polynomial(a, UPPER_BOTTOM)
    far = a + 0.65
    for i in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(i) / far
    tail = F.exp(-a * a / 2.0) * F.when(a < 7.07106781186547, near).otherwise(F.lit((2.0 * math.pi) ** -0.5) / far)
    return F.when(z < 0, 1.0 - tail).otherwise(tail)
