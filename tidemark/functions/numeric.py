"""Scalar probability functions as Column expressions (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (West 2005, double precision).
HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
HART_LIMIT = 7.07106781186547
SQRT_TWO_PI = 2.506628274631


def num(x) -> Column:
    """A Column, or a Python number as a double literal."""
    return x if isinstance(x, Column) else F.lit(float(x))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding by floor, so two engines give the same double and never a negative zero."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, num(high)), num(low))


def finite(x: Column) -> Column:
    """True for a non-NULL number that is neither NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log odds of ``p`` clipped to [eps, 1-eps]; callers state their own eps."""
    c = clip(p, eps, 1 - eps)
    return F.log(c / (F.lit(1.0) - c))


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    c = clip(p, eps, 1 - eps)
    return -(y * F.log(c) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - c))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF to double precision; NULL stays NULL."""
    a = F.abs(z)
    e = F.exp(-a * a / F.lit(2.0))
    core = e * _horner(a, HART_NUMERATOR) / _horner(a, HART_DENOMINATOR)
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    upper = F.when(a < HART_LIMIT, core).when(a <= 37.0, e / tail / F.lit(SQRT_TWO_PI)).otherwise(F.lit(0.0))
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z > 0, F.lit(1.0) - upper).otherwise(upper)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / F.lit(2.0)) / F.lit(math.sqrt(2 * math.pi))


def interval_prob(mu: Column, sigma: Column, low: Column, high: Column) -> Column:
    """P(low <= X < high); a NULL bound is open. NULL for sigma <= 0 or low >= high."""
    left = F.coalesce(normal_cdf((low - mu) / sigma), F.lit(0.0))
    right = F.coalesce(normal_cdf((high - mu) / sigma), F.lit(1.0))
    ok = finite(mu) & finite(sigma) & (sigma > 0) & (low.isNull() | high.isNull() | (low < high))
    return F.when(ok, clip(right - left, 0.0, 1.0))


def with_product_interval_prob(df, mu: Column, sigma: Column, observed: Column, bias: Column, noise: Column, low: Column, high: Column, name: str = "prob"):
    """P(low <= max(remaining, observed + error) < high) for independent normals; no observation means no floor.

    The four z-scores are projected first and each CDF then reads one column: written as a single expression the
    generated method would exceed the JVM's limit and fall back to interpretation.
    """
    z = {"_z1": (high - mu) / sigma, "_z2": (high - (observed + bias)) / noise, "_z3": (low - mu) / sigma, "_z4": (low - (observed + bias)) / noise}
    flags = {"_fo": observed.isNull(), "_fl": low.isNull(), "_fh": high.isNull()}
    d = df.withColumns(z | flags)
    d = d.withColumns({f"_p{i}": normal_cdf(F.col(f"_z{i}")) for i in range(1, 5)})
    seen = lambda i: F.when(F.col("_fo"), F.lit(1.0)).otherwise(F.col(f"_p{i}"))
    top = F.when(F.col("_fh"), F.lit(1.0)).otherwise(F.col("_p1") * seen(2))
    bottom = F.when(F.col("_fl"), F.lit(0.0)).otherwise(F.col("_p3") * seen(4))
    out = d.withColumn(name, clip(top - bottom, 0.0, 1.0))
    return out.drop(*z, *flags, *[f"_p{i}" for i in range(1, 5)])


def diffusion_prob(spot: Column, strike: Column, sigma: Column, minutes: Column) -> Column:
    """P(final >= strike) under driftless log diffusion with per-minute ``sigma``."""
    z = F.log(spot / strike) / (sigma * F.sqrt(minutes))
    return clip(normal_cdf(z), 1e-6, 1 - 1e-6)


def average_z(z: Column, minutes: Column) -> Column:
    """Rescale a point-settlement z to a last-minute-average settlement; needs the window wholly ahead."""
    return F.when(minutes >= 1.0, z * F.sqrt(minutes / (minutes - F.lit(2.0) / F.lit(3.0))))


def blend_linear(model: Column, market: Column, weight) -> Column:
    """Weighted mean of probabilities; weight 0 or a missing model is exactly the market."""
    w = num(weight)
    return F.when((w == 0.0) | model.isNull(), market).otherwise(w * model + (F.lit(1.0) - w) * market)


def blend_logodds(model: Column, market: Column, weight) -> Column:
    """Weighted mean of log odds; weight 0 or a missing model is exactly the market."""
    w = num(weight)
    z = w * logit(model) + (F.lit(1.0) - w) * logit(market)
    return F.when((w == 0.0) | model.isNull(), market).otherwise(expit(z))


def anchored_logodds(model: Column, market: Column, weight, bound: float = 4.0) -> Column:
    """Market log odds plus a bounded share of the model's disagreement."""
    w = num(weight)
    m = logit(market)
    z = m + w * clip(logit(model) - m, -bound, bound)
    return F.when((w == 0.0) | model.isNull(), market).otherwise(expit(z))


def cyclic(position: Column, period: float) -> tuple[Column, Column]:
    """sin and cos of a position in a cycle (seconds of day, day of year)."""
    angle = F.lit(2 * math.pi) * position / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def guarded_probability(mean: Column, low: Column, high: Column, market: Column) -> Column:
    """Pull an ensemble mean toward the market by its own quantiles, never across the market."""
    up = F.greatest(market, F.least(mean, low))
    down = F.least(market, F.greatest(mean, high))
    return F.when(mean >= market, up).otherwise(down)
