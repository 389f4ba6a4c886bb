"""Tail probabilities from published formulas (no SciPy)."""

from __future__ import annotations

import math

import numpy as np

# The largest samples of the exact laws. Past them, and for U where values tie, the limit laws decide; the
# work of an exact law is bounded by these sizes, whatever the table.
KS_EXACT, U_EXACT_SMALL, U_EXACT_LARGE, CVM_EXACT = 10_000, 8, 10_000, 20


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-square: the regularised incomplete gamma Q(dof / 2, x / 2)."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for P
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)  # continued fraction for Q
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def kolmogorov_sf(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def kolmogorov_p(d: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value: exact while neither sample has over KS_EXACT values."""
    return kolmogorov_exact(d, n, m) if max(n, m) <= KS_EXACT else kolmogorov_sf(d, n, m)


def kolmogorov_exact(d: float, n: int, m: int) -> float:
    """P(D >= d): one less the share of lattice paths from (0, 0) to (n, m) that never leave |i / n - j / m| < d.

    One row of the lattice is held at a time, scaled to its largest count.
    """
    limit = round(d * n * m)
    if limit <= 0:
        return 1.0
    row, scale = np.ones(min(m, (limit - 1) // n) + 1), 0.0  # the paths along i = 0
    low = 0
    for i in range(1, n + 1):
        first, last = max(0, -((limit - 1 - i * m) // n)), min(m, (i * m + limit - 1) // n)
        if first > last:
            return 1.0
        new = np.zeros(last - first + 1)
        held = row[first - low : last - low + 1] if first - low < len(row) else row[:0]
        new[: len(held)] = held
        row, low = np.cumsum(new), first
        top = row[-1]
        if top == 0:
            return 1.0
        row, scale = row / top, scale + math.log(top)
    if low + len(row) - 1 < m:
        return 1.0
    inside = scale + math.log(row[m - low]) - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1))
    return min(1.0, max(0.0, -math.expm1(min(0.0, inside))))


def mann_whitney_two_sided(u: float, n: int, m: int, tie_sum: float) -> float:
    """Exact without ties while the smaller sample has up to U_EXACT_SMALL values and the larger up to U_EXACT_LARGE."""
    exact = tie_sum == 0 and min(n, m) <= U_EXACT_SMALL and max(n, m) <= U_EXACT_LARGE
    return mann_whitney_exact(u, n, m) if exact else mann_whitney_p(u, n, m, tie_sum)


def mann_whitney_exact(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties: its counts are the coefficients of a Gaussian binomial, in whole numbers."""
    small, large = sorted((n, m))
    counts = np.zeros(small * large + 1, dtype=object)
    counts[0] = 1
    for i in range(1, small + 1):  # times (1 - q^(large + i)) over (1 - q^i)
        step = large + i
        if step < len(counts):
            counts[step:] = counts[step:] - counts[:-step]
        for r in range(min(i, len(counts))):
            counts[r::i] = np.add.accumulate(counts[r::i])
    upper = math.ceil(max(u, n * m - u) - 1e-9)
    return min(1.0, 2 * (int(counts[upper:].sum()) / math.comb(n + m, n)))


def cramer_von_mises_two_sided(t: float, n: int, m: int) -> float:
    """Exact while neither sample has over CVM_EXACT values."""
    return cramer_von_mises_exact(t, n, m) if max(n, m) <= CVM_EXACT else cramer_von_mises_p(t, n, m)


def cramer_von_mises_exact(t: float, n: int, m: int) -> float:
    """P(T >= t) over all orders of two samples without ties, each equally likely; t of tied samples is rounded down to
    the next value that untied ones can take up.

    T is n m / (n + m)^2 times the sum, over the points (i, j) of the order's lattice path, of (i / n - j / m)^2; that
    sum is counted in whole units of 1 / lcm(n, m)^2.
    """
    whole = math.lcm(n, m)
    a, b = whole // n, whole // m
    empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    above: list[tuple[np.ndarray, np.ndarray]] = [empty] * (m + 1)
    for i in range(n + 1):
        here = []
        for j in range(m + 1):
            if i == j == 0:
                here.append((np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)))
                continue
            left = here[j - 1] if j else empty
            sums, place = np.unique(np.concatenate([above[j][0], left[0]]), return_inverse=True)
            ways = np.zeros(len(sums), dtype=np.int64)
            np.add.at(ways, place, np.concatenate([above[j][1], left[1]]))
            here.append((sums + (a * i - b * j) ** 2, ways))
        above = here
    sums, ways = above[m]
    seen = math.floor(t * (n + m) ** 2 * whole * whole / (n * m) + 1e-6)
    return min(1.0, float(ways[sums >= seen].sum()) / math.comb(n + m, n))


def mann_whitney_p(u: float, n: int, m: int, tie_sum: float) -> float:
    """Two-sided, normal approximation with continuity and tie correction; tie_sum is the sum of t^3 - t."""
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - tie_sum / (total * (total - 1))))
    if sd == 0:
        return 1.0
    return min(1.0, 2 * normal_sf((max(u, n * m - u) - n * m / 2 - 0.5) / sd))


def cramer_von_mises_p(t: float, n: int, m: int) -> float:
    """Asymptotic two-sample p-value: T is standardised to the limit law, whose series uses Bessel K of order 1/4."""
    total, k = n + m, n * m
    mean = (1 + 1 / total) / 6
    var = (total + 1) * (4 * k * total - 3 * (n * n + m * m) - 2 * k) / (45 * total * total * 4 * k)
    x = 1 / 6 + (t - mean) / math.sqrt(45 * var)
    return cvm_limit_sf(x)


def cvm_limit_sf(x: float) -> float:
    """Upper tail of the Cramer-von Mises limit law; it falls like exp(-pi^2 x / 2)."""
    if x < 0.003:
        return 1.0
    if x > 12:
        return 0.0
    cdf = 0.0
    for i in range(int(math.sqrt(640 * x) / 4) + 3):  # further terms are below exp(-40)
        y = 4 * i + 1
        q = y * y / (16 * x)
        term = math.exp(math.lgamma(i + 0.5) - math.lgamma(i + 1)) * math.sqrt(y) * math.exp(-q) * _bessel_k_quarter(q)
        cdf += term / (math.pi ** 1.5 * math.sqrt(x))
    return min(1.0, max(0.0, 1 - cdf))


def _bessel_k_quarter(x: float) -> float:
    """K_{1/4}(x) by the trapezoid rule on its integral over cosh."""
    top = math.acosh(1 + 40 / x)
    n = 2000
    h = top / n
    return h * sum((0.5 if i in (0, n) else 1.0) * math.exp(-x * math.cosh(i * h)) * math.cosh(0.25 * i * h) for i in range(n + 1))


def binomial_tail(hits: int, trials: int, rate: float) -> float:
    """P(X >= hits) for X ~ Binomial(trials, rate)."""
    if hits <= 0:
        return 1.0
    logs = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(rate) + (trials - k) * math.log1p(-rate) for k in range(hits, trials + 1)] if 0 < rate < 1 else []
    if not logs:
        return 1.0 if rate >= 1 else 0.0
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))
