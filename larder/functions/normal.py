"""Normal distribution as column expressions.

Spark has no error function, so the two curves below are the published double-precision rational
approximations: the quantile after Wichura (AS 241, 1988) and the distribution function after Hart
as given by West (2005).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power first.
QUANTILE_MID = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
QUANTILE_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)
CDF_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def polynomial(x: Column, coefficients) -> Column:
    """Horner evaluation."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def ratio(x: Column, pair) -> Column:
    return polynomial(x, pair[0]) / polynomial(x, pair[1])


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    q = p - 0.5
    middle = q * ratio(F.lit(0.180625) - q * q, QUANTILE_MID)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5.0, ratio(r - 1.6, QUANTILE_TAIL)).otherwise(ratio(r - 5.0, QUANTILE_FAR))
    inside = (p > 0) & (p < 1)
    return F.when(inside & (F.abs(q) <= 0.425), middle).when(inside, F.signum(q) * tail)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    near = density * polynomial(a, CDF_NUMERATOR) / polynomial(a, CDF_DENOMINATOR)
    fraction = reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + 0.65)
    far = density / fraction / 2.506628274631
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, F.lit(1.0) - upper).otherwise(upper)
