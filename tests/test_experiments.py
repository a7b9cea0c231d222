"""Posterior of the experiment: quadrature against plain sums and limits."""

import math

import numpy as np

from tidemark.functions import betas
from tidemark.operators import experiments as EX


def plain(at, bt, ac, bc, n=200_001):
    """P(control > treatment) and the distribution of the difference on a fine grid."""
    x = np.linspace(0, 1, n)
    f = [np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) + (b - 1) * np.log(np.maximum(1 - x, 1e-300)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
         for a, b in ((at, bt), (ac, bc))]
    ft, fc = (v / v.sum() for v in f)
    above = 1 - (np.cumsum(fc) - fc / 2)
    return float((ft * above).sum()), x, ft, np.cumsum(fc)


def test_small_counts(spark):
    out = spark.createDataFrame([("treatment", 20, 3), ("control", 20, 7)], "arm string, n long, churned_90d long")
    for r in EX.posterior(out, EX.PRIORS).collect():
        a0, b0 = r["prior_a"], r["prior_b"]
        p, x, ft, Fc = plain(a0 + 3, b0 + 17, a0 + 7, b0 + 13)
        assert abs(r["p_treatment_better"] - p) < 1e-6
        for q, at in ((0.025, r["effect_low_95"]), (0.975, r["effect_high_95"])):
            below = float((ft * np.interp(x + at, x, Fc, left=0.0, right=1.0)).sum())  # P(control - treatment <= at)
            assert abs(below - q) < 2e-5
        assert r["effect_low_95"] < r["effect_mean"] < r["effect_high_95"]


def test_counts_of_a_hundred_million():
    """The normal limit; the work is the same."""
    t, c = betas.Beta(2 + 20_000_000, 8 + 80_000_000), betas.Beta(2 + 20_010_000, 8 + 79_990_000)
    mean, sd = c.mean - t.mean, math.hypot(t.sd, c.sd)
    assert abs(1 - betas.probability_below(t, c, 0.0) - 0.5 * math.erfc(-mean / sd / math.sqrt(2))) < 1e-8
    for p, z in ((0.025, -1.959963984540054), (0.975, 1.959963984540054)):
        assert abs(betas.difference_quantile(t, c, p) - (mean + z * sd)) < 1e-5 * sd


def test_edges():
    flat, sure = betas.Beta(1, 1), betas.Beta(1, 5000)
    assert abs(betas.probability_below(flat, flat, 0.0) - 0.5) < 1e-12
    assert betas.probability_below(flat, flat, 1.0) == 1.0 and betas.probability_below(flat, flat, -1.0) == 0.0
    assert abs(betas.difference_quantile(flat, flat, 0.125) + 0.5) < 1e-9  # triangular
    assert abs(betas.probability_below(sure, flat, 0.0) - 1 / 5001) < 1e-9  # P(y < x) = E[x]
