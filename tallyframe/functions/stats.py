"""Scalar statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is 0 or NULL."""
    return F.when((b != 0) & b.isNotNull(), a / b).otherwise(F.lit(default))


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function by its power series; beyond 8 sigma it is 0 or 1."""
    z = z.cast("double")
    # sum of z^(2k+1) / (1*3*...*(2k+1)); every term is the previous one times z^2 / (2k+1)
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)),
        F.struct(z.alias("t"), z.alias("s")),
        lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")),
        lambda a: a["s"],
    )
    inside = 0.5 + state * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t law with a whole number of degrees of freedom.

    Up to 60 degrees the finite trigonometric sum; above, Hill's expansion (1970) maps t to a normal
    deviate, with an error far below 1e-9 there.
    """
    t, df = F.abs(t.cast("double")), df.cast("double")
    angle = F.atan(t / F.sqrt(df))
    cos2 = df / (df + t * t)
    odd = df % 2 == 1
    # 1 + a1 c^2 + a1 a2 c^4 + ... with factors (2k - 1) / (2k) or, for odd degrees, (2k) / (2k + 1)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(30)),
        F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct(
            (a["x"] * cos2 * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("x"),
            (a["s"] + F.when(2 * k <= df - F.when(odd, 1).otherwise(0), a["x"]).otherwise(0.0)).alias("s"),
        ),
        lambda a: a["s"],
    )
    inside = F.when(odd, 2 / math.pi * (angle + F.when(df > 1, F.sin(angle) * F.cos(angle) * terms).otherwise(0.0))).otherwise(F.sin(angle) * terms)
    a = df - 0.5
    b = 48 * a * a
    y = a * F.log1p(t * t / df)
    z = (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y)
    return F.when(df <= 60, F.greatest(1 - inside, F.lit(0.0))).otherwise(2 * (1 - norm_cdf(z)))


# Coefficients of Wichura's algorithm AS 241 (1988) for the normal quantile.
_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coef, x: Column) -> Column:
    def poly(c):
        acc = F.lit(c[-1])
        for a in reversed(c[:-1]):
            acc = acc * x + F.lit(a)
        return acc

    return poly(coef[0]) / poly(coef[1])


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, _ratio(_NEAR, r - 1.6)).otherwise(_ratio(_FAR, r - 5.0))
    centre = q * _ratio(_CENTRE, F.lit(0.180625) - q * q)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -tail).otherwise(tail))


def entropy(p: Column, floor: float = 1e-15) -> Column:
    """-sum(p ln max(p, floor)) of an array of shares."""
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.ln(F.greatest(x, F.lit(floor))))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_moments(a: Column) -> Column:
    """struct(n, mean, m2) of a numeric array in one pass; m2 is the sum of squared deviations."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s, x):
        n, d = s["n"] + 1.0, x.cast("double") - s["mean"]
        mean = s["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + d * (x.cast("double") - mean)).alias("m2"))

    return F.aggregate(a, start, step)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_std(a: Column, ddof: int = 0) -> Column:
    """Standard deviation of an array; 0 where it has too few elements."""
    return F.aggregate(
        F.array(array_moments(a)), F.lit(0.0), lambda _, m: F.when(m["n"] > ddof, F.sqrt(m["m2"] / F.greatest(m["n"] - ddof, F.lit(1.0)))).otherwise(0.0)
    )


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def md5_int(c: Column, digits: int = 8) -> Column:
    """Integer from the leading hex digits of the MD5 of a value; the same in every engine."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def md5_unit(c: Column) -> Column:
    """Deterministic draw in [0, 1) from a value."""
    return md5_int(c) / F.lit(4294967296.0)
