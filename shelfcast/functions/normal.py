"""Normal distribution as column expressions.

The argument is used many times in each expression: give a column, not a long expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's AS241 (PPND16) rational approximations, low power first.
PPF_CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
PPF_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
PPF_TAIL_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
PPF_TAIL_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
PPF_FAR_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
PPF_FAR_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
# Hart (1968) / West (2005) double precision normal integral, high power first.
CDF_NUM = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _poly(x: Column, low_first) -> Column:
    out = F.lit(low_first[-1])
    for c in reversed(low_first[:-1]):
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function; null outside (0, 1)."""
    p = p.cast("double")
    q = p - 0.5
    r_centre = F.lit(0.180625) - q * q
    centre = q * _poly(r_centre, PPF_CENTRE_NUM) / _poly(r_centre, PPF_CENTRE_DEN)
    tail_p = F.when(q < 0, p).otherwise(1.0 - p)
    r = F.sqrt(-F.ln(tail_p))
    tail = F.when(
        r <= 5.0, _poly(r - 1.6, PPF_TAIL_NUM) / _poly(r - 1.6, PPF_TAIL_DEN)
    ).otherwise(_poly(r - 5.0, PPF_FAR_NUM) / _poly(r - 5.0, PPF_FAR_DEN))
    signed = F.when(q < 0, -tail).otherwise(tail)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(signed))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    x = x.cast("double")
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _poly(a, CDF_NUM[::-1]) / _poly(a, CDF_DEN[::-1])
    far = bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)
