"""Normal distribution: two-sided p-values and normals keyed by text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of erf and erfc to double precision on [0, 0.46875], to 4 and beyond
# (Cody 1969); numerators and denominators by falling powers.
ERF_LOW = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MID = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_HIGH = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)

# Fixed value: 97.5 % point of the standard normal.
Z_975 = 1.959963984540054


def _ratio(coefficients, x: Column) -> Column:
    def poly(c):
        out = F.lit(c[0])
        for v in c[1:]:
            out = out * x + F.lit(v)
        return out

    return poly(coefficients[0]) / poly(coefficients[1])


def erfc_column(x: Column) -> Column:
    """erfc for x >= 0 to double precision."""
    square = x * x
    inverse = F.try_divide(F.lit(1.0), square)
    high = F.try_divide(F.exp(-square), x) * (1.0 / math.sqrt(math.pi) - inverse * _ratio(ERFC_HIGH, inverse))
    return F.when(x <= 0.46875, 1.0 - x * _ratio(ERF_LOW, square)).when(x <= 4.0, F.exp(-square) * _ratio(ERFC_MID, x)).otherwise(F.when(x > 27.0, 0.0).otherwise(high) + 0.0 * x)


def erfc_sql(x: str) -> str:
    """The same as SQL text over a column name."""

    def poly(c, v):
        out = repr(float(c[0]))
        for k in c[1:]:
            out = f"({out}*{v} + {float(k)!r})"
        return f"{out}::DOUBLE" if len(c) == 1 else out

    def ratio(c, v):
        return f"(CAST({poly(c[0], v)} AS DOUBLE)/CAST({poly(c[1], v)} AS DOUBLE))"

    inverse = f"(1/nullif({x}*{x}, 0))"
    return (
        f"CASE WHEN {x} <= 0.46875 THEN 1 - {x}*{ratio(ERF_LOW, f'({x}*{x})')} WHEN {x} <= 4 THEN exp(-{x}*{x})*{ratio(ERFC_MID, x)} "
        f"WHEN {x} <= 27 THEN exp(-{x}*{x})/{x}*({1.0 / math.sqrt(math.pi)!r}::DOUBLE - {inverse}*{ratio(ERFC_HIGH, inverse)}) WHEN {x} IS NOT NULL THEN 0 END"
    )


def two_sided_p(z: Column) -> Column:
    """2 * Phi(-|z|) as a column expression."""
    return erfc_column(F.abs(z) / math.sqrt(2.0))


def normal_cdf(z: Column) -> Column:
    upper = erfc_column(F.abs(z) / math.sqrt(2.0)) / 2.0
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def _uniform(prefix: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(prefix), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")


def keyed_normal(*parts) -> Column:
    """A standard normal that depends on the key alone, never on partitioning.

    Box-Muller on two uniforms taken from md5 digests of the key.
    """
    key = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    u = (_uniform("u|", key) + 1.0) / float(2**48 + 1)
    v = _uniform("v|", key) / float(2**48)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)
