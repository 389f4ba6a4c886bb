import itertools
import math

import pytest

from veilmark.functions import significance as sig
from veilmark.operators import drift


def statistics(order, n, m):
    """ks, u and cvm of an order (1: first sample)."""
    i = j = 0
    ks = u = total = 0.0
    for first in order:
        i, j = i + first, j + 1 - first
        u += j if first else 0
        ks, total = max(ks, abs(i / n - j / m)), total + (i / n - j / m) ** 2
    return ks, u, n * m / (n + m) ** 2 * total


@pytest.mark.parametrize("n,m", [(1, 1), (1, 8), (2, 5), (3, 3), (4, 7), (5, 5), (6, 4), (7, 8), (8, 8)])
def test_laws_equal_enumeration(n, m):
    every = []
    for places in itertools.combinations(range(n + m), n):
        order = [0] * (n + m)
        for p in places:
            order[p] = 1
        every.append(statistics(order, n, m))
    share = lambda test: sum(map(test, every)) / len(every)
    for ks, u, t in every[:: max(1, len(every) // 25)]:
        assert sig.kolmogorov_exact(ks, n, m) == pytest.approx(share(lambda r: r[0] >= ks - 1e-12), abs=1e-10)
        top = max(u, n * m - u)
        assert sig.mann_whitney_exact(u, n, m) == pytest.approx(min(1, 2 * share(lambda r: r[1] >= top)), abs=1e-12)
        assert sig.cramer_von_mises_exact(t, n, m) == pytest.approx(share(lambda r: r[2] >= t - 1e-9), abs=1e-12)


def test_size_switches_and_limits():
    d = 0.04
    assert sig.kolmogorov_exact(d, 3000, 2500) == pytest.approx(sig.kolmogorov_sf(d, 3000, 2500), rel=0.05)
    assert sig.kolmogorov_p(d, 10_001, 50) == sig.kolmogorov_sf(d, 10_001, 50)
    assert sig.kolmogorov_exact(0.0, 5, 5) == 1 and sig.kolmogorov_exact(1.0, 4, 4) == pytest.approx(2 / math.comb(8, 4))
    assert sig.mann_whitney_exact(8500, 8, 2000) == pytest.approx(sig.mann_whitney_p(8500, 8, 2000, 0), rel=0.02)  # near the centre; tails of 8 values differ
    assert sig.mann_whitney_two_sided(3, 4, 5, 6.0) == sig.mann_whitney_p(3, 4, 5, 6.0)  # ties
    assert sig.mann_whitney_two_sided(30, 9, 9, 0) == sig.mann_whitney_p(30, 9, 9, 0)
    assert sig.cramer_von_mises_exact(0.5, 16, 20) == pytest.approx(sig.cramer_von_mises_p(0.5, 16, 20), abs=0.01)
    assert sig.cramer_von_mises_two_sided(0.5, 21, 5) == sig.cramer_von_mises_p(0.5, 21, 5)


def test_small_samples_through_spark(spark):
    """Separated samples of 8 and 4: one order on either side of all C(12, 4), so each law gives 2 / 495."""
    rows = lambda values: spark.createDataFrame([(float(v),) for v in values], "hours double")
    far = drift.p_values(drift.two_sample(rows(range(100, 108)), rows([1, 2, 3, 4]), "hours").first())
    assert far == pytest.approx([2 / 495] * 3)
    near = drift.p_values(drift.two_sample(rows(range(100, 108)), rows([100.5, 103.5, 105.5, 106.5]), "hours").first())
    assert min(near) > 0.5
