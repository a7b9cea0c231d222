import numpy as np

from tidemark.operators import cox as CX


def _efron_ll(beta, T, E, X):
    ll = 0.0
    for t in np.unique(T[E == 1]):
        D = (T == t) & (E == 1)
        R = T >= t
        d = D.sum()
        ll += (X[D] @ beta).sum()
        r = np.exp(X @ beta)
        for l_ in range(d):
            ll -= np.log(r[R].sum() - l_ / d * r[D].sum())
    return ll


def test_cox_matches_direct_optimum(spark):
    rng = np.random.default_rng(5)
    n = 300
    X = rng.normal(size=(n, 2))
    T = np.ceil(rng.exponential(scale=np.exp(-0.7 * X[:, 0]) * 50)).astype(int)
    E = (rng.random(n) < 0.8).astype(int)
    rows = [(int(t), int(e), float(a), float(b)) for t, e, a, b in zip(T, E, X[:, 0], X[:, 1])]
    df = spark.createDataFrame(rows, "duration_days int, event int, a double, b double")
    got = {r["covariate"]: r["coef"] for r in CX.fit_cox(df, ["a", "b"], penalizer=0.0).collect()}
    beta = np.array([got["a"], got["b"]])
    # the fitted point is a maximum of the Efron partial likelihood
    base = _efron_ll(beta, T, E, X)
    for delta in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert _efron_ll(beta + np.array(delta), T, E, X) <= base + 1e-9
    assert got["a"] > 0.3


def test_efron_sums_by_brute_force(spark):
    cases = [(r, e, d) for d in (1, 2, 5, 15, 16, 17, 18, 40, 1000, 30_000) for r, e in ((1.0, 1.0), (1.5, 1.0), (40.0, 0.3), (1e6, 2.5))]
    df = spark.createDataFrame([(float(r), float(e), float(d)) for r, e, d in cases], "r double, e double, d double")
    got = CX.with_efron_sums(df, "r", "e", "d").collect()
    for row in got:
        f = np.arange(int(row["d"]), dtype=np.longdouble) / np.longdouble(row["d"])
        den = np.longdouble(row["r"]) - f * np.longdouble(row["e"])
        size = row["d"] / row["e"]
        for k, want, unit in (("a", 1 / den, 0), ("b", f / den, size), ("aa", 1 / den**2, 0), ("ab", f / den**2, size / row["r"]), ("bb", (f / den)**2, size / row["e"])):
            want = float(want.sum())
            assert abs(row[k] - want) <= 1e-11 * want + 1e-14 * unit, (row, k, want)


def test_a_day_of_ten_million_churns(spark):
    """The work of a day does not depend on its churns."""
    df = spark.createDataFrame([(2e7, 1e7, 1e7)], "r double, e double, d double")
    got = CX.with_efron_sums(df, "r", "e", "d").first()
    # sums of smooth terms: integrals over f in [0, 1] of 1/(2 - f), f/(2 - f), with the ends' half term
    assert abs(got["a"] - np.log(2)) < 1e-7 and abs(got["b"] - (2 * np.log(2) - 1)) < 1e-7
