"""Series features against their definitions, written out window by window."""

import math

import numpy as np
import pytest

from aeolis.operators import series as se

W = 48


def spectrum_power(x):
    n = min(len(x), 256)
    taper = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))
    acc = 0
    for s in range(0, len(x) - n + 1, n - n // 2):
        seg = x[s : s + n] - x[s : s + n].mean()
        p = np.abs(np.fft.rfft(seg * taper)) ** 2
        p[1:-1] *= 2
        acc = acc + p
    return acc


def entropy(p, bins):
    if p.max() <= 0:
        return np.nan
    h, _ = np.histogram(p / p.max(), bins=bins)
    q = h[h > 0] / h.sum()
    return -(q * np.log(q)).sum()


def longest(flags):
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def expected(x):
    n, mu, var = len(x), x.mean(), x.var()
    d = np.diff(x)
    out = {
        "number_crossing_m__m_0": (np.diff((x > 0).astype(int)) != 0).sum(),
        "number_crossing_m__m_1": (np.diff((x > 1).astype(int)) != 0).sum(),
        "last_location_of_maximum": (np.flatnonzero(x == x.max())[-1] + 1) / n,
        "cid_ce__normalize_false": np.sqrt((d * d).sum()),
        "cid_ce__normalize_true": np.sqrt((d * d).sum() / var),
        "longest_strike_above_mean": longest(x > mu),
        "index_mass_quantile__q_04": (np.flatnonzero(np.abs(x).cumsum() >= 0.4 * np.abs(x).sum())[0] + 1) / n,
    }
    r = {k: ((x[:-k] - mu) * (x[k:] - mu)).sum() / ((n - k) * var) for k in range(1, 10)}
    out |= {f"autocorrelation__lag_{k}": v for k, v in r.items()}
    out |= {"partial_autocorrelation__lag_1": r[1], "partial_autocorrelation__lag_2": (r[2] - r[1] ** 2) / (1 - r[1] ** 2)}
    for q in (0.0, 0.2, 0.4, 0.6, 0.8):
        ok = x >= np.quantile(x, q)
        s = d[ok[1:] & ok[:-1]]
        tag = f"qh_10__ql_{str(q).replace('.', '')}"
        out[f"change_quantiles__f_agg_var__isabs_true__{tag}"] = np.abs(s).var() if len(s) else 0
        out[f"change_quantiles__f_agg_var__isabs_false__{tag}"] = s.var() if len(s) else 0
        if q:
            out[f"change_quantiles__f_agg_mean__isabs_true__{tag}"] = np.abs(s).mean() if len(s) else 0
    f = np.abs(np.fft.rfft(x))
    k = np.arange(len(f))
    m1 = (f * k).sum() / f.sum()
    m2, m3, m4 = ((f * (k - m1) ** p).sum() / f.sum() for p in (2, 3, 4))
    out |= {f"fft_coefficient__attr_abs__coeff_{c}": f[c] for c in se.FFT_COEFFICIENTS if c < len(f)}
    out |= {"fft_aggregated__aggtype_centroid": m1, "fft_aggregated__aggtype_variance": m2}
    out |= {"fft_aggregated__aggtype_skew": m3 / m2**1.5, "fft_aggregated__aggtype_kurtosis": m4 / m2**2}
    p = spectrum_power(x)
    out |= {f"fourier_entropy__bins_{b}": entropy(p, b) for b in (3, 5)}
    design = np.column_stack([np.ones(n - 10)] + [x[10 - j : n - j] for j in range(1, 11)])
    out["ar_coefficient__coeff_1__k_10"] = np.linalg.lstsq(design, x[10:], rcond=None)[0][1]
    slope_r = np.corrcoef(np.arange(n), x)[0, 1]
    t = slope_r * math.sqrt((n - 2) / (1 - slope_r**2))
    grid = np.linspace(-abs(t), abs(t), 200_001)
    dof = n - 2
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    out["linear_trend__attr_pvalue"] = 1 - np.trapezoid(c * (1 + grid**2 / dof) ** (-(dof + 1) / 2), grid)
    return out


@pytest.mark.parametrize("size", [37, 2048])
def test_all_features(panel, panel_pdf, size):
    got = se.series_features(panel, W, size=size).toPandas().set_index(["turb_id", "time"])
    sizes = panel_pdf.groupby("turb_id").size()
    assert len(got) == (sizes - W + 1).sum()
    assert len(got.columns) == len(expected(np.random.default_rng(1).normal(size=W)))
    for turb, time in [(1, W - 1), (1, 60), (1, 333), (1, 699), (2, 100), (3, 89)]:
        g = panel_pdf[panel_pdf["turb_id"] == turb]["patv"].fillna(0).to_numpy()
        for name, want in expected(g[time - W + 1 : time + 1]).items():
            np.testing.assert_allclose(got.loc[(turb, time), f"patv__{name}"], want, rtol=1e-6, atol=1e-6, err_msg=name)


def test_long_window_uses_several_spectrum_segments():
    w = np.random.default_rng(5).normal(size=(3, 432))
    got = se.fourier_entropy(w)
    for i in range(3):
        assert got["fourier_entropy__bins_5"][i] == pytest.approx(entropy(spectrum_power(w[i]), 5))


def test_full_length_window_has_59_features():
    w = np.random.default_rng(6).normal(size=(2, 432))
    names = {n for f in se.WINDOW_FEATURES for n in f(w)} - {"linear_trend__statistic"}
    assert len(names) + 5 == 59  # and the five summed ones


def test_flat_window():
    w = np.full((2, 64), 3.25)
    assert np.isnan(se.autocorrelation(w)["autocorrelation__lag_1"]).all()
    assert (se.linear_trend(w)["linear_trend__attr_pvalue"] == 1).all()
    assert (se.longest_above_mean(w)["longest_strike_above_mean"] == 0).all()
    assert np.isnan(se.ar_coefficient(w)["ar_coefficient__coeff_1__k_10"]).all()
    assert np.isnan(se.fourier_entropy(w)["fourier_entropy__bins_3"]).all()
    assert (se.change_quantiles(w)["change_quantiles__f_agg_var__isabs_true__qh_10__ql_02"] == 0).all()


@pytest.mark.parametrize("dof", [1, 2, 3, 9, 10, 94, 430])
def test_student_tail(dof):
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    for t in (0.0, 0.5, -2.0, 3.5):
        grid = np.linspace(-abs(t), abs(t), 400_001)
        want = 1 - np.trapezoid(c * (1 + grid**2 / dof) ** (-(dof + 1) / 2), grid)
        assert se.two_sided_p(np.array([t]), dof)[0] == pytest.approx(want, abs=1e-8)


def test_regression_on_lags_of_any_window():
    """Full rank: ordinary least squares. Too little rank: the smallest weights, whatever other windows are in the batch."""
    rng = np.random.default_rng(4)
    w = rng.normal(500, 200, (6, 96))
    w[1], w[2], w[4] = np.tile([1.0, 2.0], 48), 7.0, np.tile([0.0, 3.0, 5.0, 1.0], 24)
    weight, off = se.ar_fit(w)
    for i in (0, 3, 5):
        lags = np.lib.stride_tricks.sliding_window_view(w[i] - w[i].mean(), 11)
        design = np.column_stack([np.ones(len(lags)), lags[:, :10]])
        want = np.linalg.lstsq(design, lags[:, 10], rcond=None)[0]
        np.testing.assert_allclose(weight[i, 1:], want[1:], rtol=1e-8, atol=1e-10)
    # 1, 2, 1, 2: every other lag has the same weight of a fifth, of either sign by parity, a tenth each.
    np.testing.assert_allclose(weight[1, 1:], [0.1, -0.1] * 5, atol=1e-9)
    assert np.isnan(weight[2]).all() and np.nanmax(off) < 1e-9
    for i in range(6):
        np.testing.assert_array_equal(se.ar_fit(w[i : i + 1])[0][0], weight[i])


def test_all_features_take_one_exchange(spark):
    df = spark.createDataFrame([(1, i, float(i % 50)) for i in range(600)], "turb_id bigint, time bigint, patv double")
    out = se.series_features(df, 96)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and len(out.columns) == 2 + 47
