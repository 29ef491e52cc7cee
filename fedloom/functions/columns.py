"""Column functions that several operators share; all stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c(x), 6) + F.lit(0.0)


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number above 0 and below 1 by the MD5 of the seed and the keys: the same whatever the partitions, on reruns, and in any SQL."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return c(a) / F.nullif(c(b), F.lit(0).cast("double"))


def present(value: Column | str, weight: Column | str) -> Column:
    """The weight where there is a value, so that absent values count nowhere."""
    return F.when(c(value).isNotNull(), c(weight))


def l2(x: Column | str) -> Column:
    """Aggregate: Euclidean norm."""
    return F.sqrt(F.sum(c(x) * c(x)))


def keep_count(n: Column, share: float) -> Column:
    """max(1, int(n share))."""
    return F.greatest(F.lit(1), F.floor(n * share)).cast("int")


def staleness_weight(weight: Column, staleness: Column, method: str = "decay", base: float = 0.99, most: int = 10, threshold: int = 5) -> Column:
    """Weight of an update that is some rounds old. Unknown methods leave it as it is."""
    if method == "decay":
        return weight * F.pow(F.lit(base), staleness)
    if method == "linear":
        return weight * F.greatest(F.lit(0.0), 1 - staleness / most)
    if method == "quadratic":
        return weight * F.greatest(F.lit(0.0), 1 - F.pow(staleness / most, F.lit(2.0)))
    if method == "threshold":
        return F.when(staleness <= threshold, weight).otherwise(weight * F.pow(F.lit(base), staleness - threshold))
    return weight


def client_mu(base_mu: float, method: str, staleness: Column, epochs: Column) -> Column:
    """Proximal strength of one client."""
    if method == "staleness":
        return base_mu * (1 + 0.1 * staleness)
    if method == "epochs":
        return base_mu * (1 + 0.05 * epochs)
    return F.lit(base_mu)
