import numpy as np
import pytest

from tessera.operators import windows as w

S = w.Series(("g",), ("t",))


@pytest.fixture(params=[3, 7, 1000])
def series(spark, request):
    """Series that span batches, and batches that span series."""
    r = np.random.default_rng(2)
    rows = [(g, t, float(r.normal(5, 2)), float(r.normal()), float(r.normal())) for g, n in (("a", 40), ("b", 1), ("c", 700), (None, 5)) for t in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield spark.createDataFrame(rows, "g string, t int, x double, y double, z double").repartition(5), rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[2:])
    return {k: np.array(v) for k, v in out.items()}


def test_recursions(series):
    df, rows = series
    got = {(r.g, r.t): r for r in w.ewm(df, S, "x", 9).collect()}
    corr = {(r.g, r.t): r for r in w.ewm_corr(df, S, ["x", "y"], 9).collect()}
    assert len(got) == len(rows) == len(corr)
    for g, v in by_series(rows).items():
        mean, cov = v[0, :2].copy(), np.zeros((2, 2))
        for t, x in enumerate(v[:, :2]):
            if t:
                d = x - mean
                mean, cov = mean + 0.2 * d, 0.8 * (cov + 0.2 * np.outer(d, d))
            assert got[g, t].ewm_mean == pytest.approx(mean[0]) and got[g, t].ewm_var == pytest.approx(cov[0, 0], abs=1e-12)
            both = np.sqrt(cov[0, 0] * cov[1, 1])
            assert corr[g, t].corr_x_y == pytest.approx(cov[0, 1] / both if both > 1e-15 else 0.0, abs=1e-9)


def test_frames(series):
    df, rows = series
    got = {(r.g, r.t): r for r in w.rolling_multi_beta(df, S, "x", ["y", "z"], 6).collect()}
    top = {(r.g, r.t): r for r in w.rolling_pca(df, S, ["x", "y", "z"], 6, 2).collect()}
    for g, v in by_series(rows).items():
        for t in range(len(v)):
            if t < 5:
                assert got[g, t].betas is None and top[g, t].eigenvalues is None
                continue
            f = v[t - 5 : t + 1]
            d = f - f.mean(0)
            np.testing.assert_allclose(got[g, t].betas, np.linalg.lstsq(d[:, 1:], d[:, 0], rcond=None)[0], atol=1e-8)
            np.testing.assert_allclose(top[g, t].eigenvalues, np.linalg.eigvalsh(np.cov(f.T))[::-1][:2])
