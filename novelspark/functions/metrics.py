"""Distances as Column expressions, with numpy twins and bounds for blocks of vectors.

Every expression adds in array order, one element after the other, so results equal a
sequential loop bit for bit.  ``cosine`` is 1 - dot and expects unit vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def doubles(x: Column | str) -> Column:
    return F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where body uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: p * q))


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def poincare(a: Column, b: Column) -> Column:
    """Hyperbolic distance in the unit ball; NaN where a norm reaches 1."""
    na, nb = F.lit(1.0) - squared_norm(a), F.lit(1.0) - squared_norm(b)
    inside = (na > 0) & (nb > 0)
    return F.when(inside, 2 * F.asinh(l2(a, b) / F.sqrt(na * nb))).otherwise(F.lit(float("nan")))


def weighted_l2(weights: Sequence[float]) -> Metric:
    """L2 after each coordinate is scaled by its weight."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return lambda a, b: l2(F.zip_with(a, w, lambda p, q: p * q), F.zip_with(b, w, lambda p, q: p * q))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of arrays of numbers, which are 1 from 0.5 on."""
    return _total(F.zip_with(a, b, lambda p, q: F.when((p >= 0.5) != (q >= 0.5), 1.0).otherwise(0.0)))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)


def tanimoto(a: Column, b: Column) -> Column:
    """1 - |A and B| / |A or B| of arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.lit(1.0) - F.size(F.array_intersect(a, b)) / union)


def archimedean(p: Column, q: Column) -> Column:
    """d / (1 + d) of the gap of two numbers."""
    d = F.abs(p - q).cast("double")
    return d / (F.lit(1.0) + d)


def valuation(n: Column, r: int) -> Column:
    """How often r divides a number other than 0 (of up to 63 bits)."""
    powers = [r**k for k in range(1, 64) if r**k < 2**63]
    out = F.lit(0)
    for value in powers:
        out = out + F.when(F.pmod(n, F.lit(value)) == 0, 1).otherwise(0)
    return out


def padic(r: int) -> Metric:
    """r to the power of minus the valuation of the gap; 0 for equal numbers."""
    return lambda p, q: F.when(p == q, 0.0).otherwise(F.pow(F.lit(float(r)), -valuation(F.abs(p - q).cast("bigint"), r).cast("double")))


def residue_l2(moduli: Sequence[int], weights: Sequence[float] | None = None) -> Metric:
    """L2 of weighted differences of p mod r over r; a pseudometric."""
    weights = weights or [1.0] * len(moduli)

    def of(p: Column, q: Column) -> Column:
        out = F.lit(0.0)
        for r, w in zip(moduli, weights, strict=True):
            gap = F.pmod(p, F.lit(r)) / float(r) - F.pmod(q, F.lit(r)) / float(r)
            out = out + F.lit(float(w)) * gap * gap
        return F.sqrt(out)

    return of


def prime_weights(primes: Sequence[int]) -> list[float]:
    raw = [1.0 / np.log1p(r) for r in primes]
    return [float(w / sum(raw)) for w in raw]


def combined_arithmetic(primes: Sequence[int], share: float = 0.5) -> Metric:
    """share times the Archimedean distance, the rest p-adic ones weighted by 1 / log(1 + r)."""
    weights = prime_weights(primes)

    def of(p: Column, q: Column) -> Column:
        out = F.lit(float(share)) * archimedean(p, q)
        for r, w in zip(primes, weights, strict=True):
            out = out + F.lit((1.0 - share) * w) * padic(r)(p, q)
        return out

    return of


#: Names that a metric goes by (fixed values).
ALIASES = {
    "linf": linf, "L_inf": linf, "Linf": linf, "chebyshev": linf,
    "l1": l1, "L1": l1,
    "l2": l2, "L2": l2, "euclidean": l2,
    "cosine": cosine, "cos": cosine,
    "poincare": poincare, "poincare_ball": poincare, "hyperbolic": poincare,
}


def metric(name: str | Metric | None) -> Metric:
    """A metric by name; L-infinity by default; a function of two Columns is itself."""
    if name is None:
        return linf
    if callable(name):
        return name
    if name not in ALIASES:
        raise ValueError(f"unknown distance {name!r}")
    return ALIASES[name]


# ---- numpy twins: distances of each row of x to each row of y ------------------


def bounds(name: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of ``exact`` for every row of x with every row of y.

    L1 and L-infinity are exact.  Products of matrices lose digits where points are near one
    another and far from the origin; so points are taken from their mean first, and what
    rounding can do to a sum of d products of numbers of that size is added and taken off.
    """
    of = metric(name)
    rounding = 4.0 * (x.shape[1] + 8) * 2.0**-52
    if of is cosine:
        d = 1.0 - x @ y.T
        e = rounding * (1.0 + np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :])
        return d - e, d + e
    if of in (l2, poincare):
        middle = y.mean(0) if len(y) else 0.0
        a, b = x - middle, y - middle
        size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        square = size - 2 * a @ b.T
        low, high = np.sqrt(np.maximum(square - rounding * size, 0.0)), np.sqrt(np.maximum(square, 0.0) + rounding * size)
        if of is l2:
            return low * (1 - rounding), high * (1 + rounding)
        na, nb = 1 - (x * x).sum(1)[:, None], 1 - (y * y).sum(1)[None, :]
        wide = np.sqrt(np.maximum(na + rounding, 0.0) * np.maximum(nb + rounding, 0.0))
        narrow = np.sqrt(np.maximum(na - rounding, 0.0) * np.maximum(nb - rounding, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.where(wide > 0, 2 * np.arcsinh(low / wide), np.inf)
            far = np.where(narrow > 0, 2 * np.arcsinh(high / narrow), np.inf)
        return near * (1 - rounding), far * (1 + rounding)
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):  # axis by axis, in order
        gap = np.abs(x[:, k, None] - y[None, :, k])
        out = np.maximum(out, gap) if of is linf else out + gap
    return out, out


def exact(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x to the same rows of y, summed in order as the Columns are."""
    of = metric(name)
    if of is cosine:
        return 1.0 - np.cumsum(x * y, axis=1)[:, -1]
    if of is linf:
        return np.abs(x - y).max(1)
    if of is l1:
        return np.cumsum(np.abs(x - y), axis=1)[:, -1]
    root = np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1])
    if of is l2:
        return root
    scale = (1 - np.cumsum(x * x, 1)[:, -1]) * (1 - np.cumsum(y * y, 1)[:, -1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, 2 * np.arcsinh(root / np.sqrt(scale)), np.nan)


def within(name: str, x: np.ndarray, y: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
    """Whether ``exact`` is at most ``reach`` (a number, or one for each row of y)."""
    low, high = bounds(name, x, y)
    reach = np.broadcast_to(np.asarray(reach, float), (len(y),))[None, :]
    out = high <= reach
    i, j = np.nonzero((low <= reach) & ~out)  # too near to call
    if len(i):
        out[i, j] = exact(name, x[i], y[j]) <= reach[0, j]
    return out
