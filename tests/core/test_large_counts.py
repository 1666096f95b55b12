"""Exact tests on counts whose factorials are no floats."""

from math import exp, lgamma

from quillmark.operators import metrics as M


def test_fisher_of_large_counts():
    for a, b, c, d in ((3, 1, 1, 3), (8, 2, 1, 5), (0, 4, 5, 0), (12000, 13500, 12400, 13300), (12000, 14000, 12000, 14000), (30, 9000, 11, 9100)):
        n, row, col = a + b + c + d, a + b, a + c
        choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
        w = [choose(row, x) + choose(n - row, col - x) for x in range(max(0, col - (n - row)), min(row, col) + 1)]
        own, top = choose(row, a) + choose(n - row, col - a), max(w)
        want = sum(exp(x - top) for x in w if x <= own + 1e-7) / sum(exp(x - top) for x in w)
        assert abs(M.fisher_p(a, b, c, d)[1] - want) < 1e-8
    assert M.fisher_p(0, 0, 0, 0)[1] == 1.0
    assert 0 <= M.fisher_p(3_000_000, 3_001_000, 2_999_000, 3_000_500)[1] <= 1
