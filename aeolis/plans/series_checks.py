"""Queries on the features of the trailing power series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aeolis.operators import series as se
from aeolis.plans.fixture import SERIES as W
from aeolis.plans.registry import ENTRIES, query

KEY = ("turb_id", "time")


def _rows(d):
    return d.full_panel.select("turb_id", F.col("slot").alias("time"), "patv")


def _full(df):
    return df.filter(F.col("time") >= W - 1)


def _summed(*cols):
    def build(d):
        names = [f"patv__{c}" for c in cols]
        return _full(se.summed_features(_rows(d), W)).select(*KEY, *names)

    return build


def _windowed(feature):
    return lambda d: se.window_features(_rows(d), W, [feature])


def _autocorr(prefix):
    def build(d):
        out = se.window_features(_rows(d), W, [se.autocorrelation])
        return out.select(*KEY, *[c for c in out.columns if c.startswith(prefix)])

    return build


query(
    "series_windows",
    "SELECT turb_id, time, count(*) AS n, sum(x) AS total, sum(x * i) AS weighted FROM series GROUP BY turb_id, time",
    "total weighted",
    4,
)(
    lambda d: se.series_windows(_rows(d), W).select(
        *KEY,
        F.size("window").cast("bigint").alias("n"),
        F.aggregate("window", F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.aggregate(F.transform("window", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v).alias("weighted"),
    )
)


def _change_sql() -> str:
    qs = {str(q).replace(".", ""): q for q in se.LOW_QUANTILES}
    quant = ", ".join(f"quantile_cont(x, {q}) AS q{n}" for n, q in qs.items())
    cols = []
    for n, q in qs.items():
        ok = f"FILTER (WHERE p.x >= q{n} AND p.nx >= q{n})"
        tag = f"qh_10__ql_{n}"
        cols.append(f"coalesce(var_pop(abs(nx - x)) {ok}, 0) AS patv__change_quantiles__f_agg_var__isabs_true__{tag}")
        cols.append(f"coalesce(var_pop(nx - x) {ok}, 0) AS patv__change_quantiles__f_agg_var__isabs_false__{tag}")
        if q > 0:
            cols.append(f"coalesce(avg(abs(nx - x)) {ok}, 0) AS patv__change_quantiles__f_agg_mean__isabs_true__{tag}")
    return f"""SELECT p.turb_id, p.time, {", ".join(cols)}
FROM (SELECT *, lead(x) OVER (PARTITION BY turb_id, time ORDER BY i) AS nx FROM series) p
JOIN (SELECT turb_id, time, {quant} FROM series GROUP BY turb_id, time) q ON p.turb_id = q.turb_id AND p.time = q.time
WHERE nx IS NOT NULL GROUP BY p.turb_id, p.time"""


def _names(sql: str) -> str:
    return " ".join(w.strip(",") for w in sql.split() if w.startswith("patv__"))


query("ts_change_quantiles", _change_sql(), _names(_change_sql()), 5)(_windowed(se.change_quantiles))

COEFFS = [c for c in se.FFT_COEFFICIENTS if c <= W // 2]
FFT_SQL = "SELECT turb_id, time, " + ", ".join(
    f"sqrt(pow(sum(x * cos({2 * math.pi * c / W!r} * i)), 2) + pow(sum(x * sin({2 * math.pi * c / W!r} * i)), 2)) "
    f"AS patv__fft_coefficient__attr_abs__coeff_{c}"
    for c in COEFFS
) + " FROM series GROUP BY turb_id, time"
# The angles are looked up: there are only as many as steps in a window.
TURN = f"""SELECT m, cos({2 * math.pi / W!r} * m) AS co, sin({2 * math.pi / W!r} * m) AS si FROM (SELECT unnest(range(0, {W})) AS m) t"""
SPECTRUM = f"""SELECT turb_id, time, k, sqrt(pow(sum(x * co), 2) + pow(sum(x * si), 2)) AS s FROM series,
(SELECT unnest(range(0, {W // 2 + 1})) AS k) f, ({TURN}) a WHERE a.m = (f.k * i) % {W} GROUP BY turb_id, time, k"""


@query("ts_fft_abs", FFT_SQL, _names(FFT_SQL), 5)
def _(d):
    out = se.window_features(_rows(d), W, [se.spectrum])
    return out.select(*KEY, *[c for c in out.columns if "coefficient" in c])


@query("ts_fft_moments", f"""SELECT turb_id, time, centroid AS patv__fft_aggregated__aggtype_centroid,
m2 AS patv__fft_aggregated__aggtype_variance,
CASE WHEN m2 >= 0.5 THEN m3 / pow(m2, 1.5) END AS patv__fft_aggregated__aggtype_skew,
CASE WHEN m2 >= 0.5 THEN m4 / pow(m2, 2) END AS patv__fft_aggregated__aggtype_kurtosis
FROM (SELECT turb_id, time, any_value(c) AS centroid, sum(s * pow(k - c, 2)) / sum(s) AS m2,
  sum(s * pow(k - c, 3)) / sum(s) AS m3, sum(s * pow(k - c, 4)) / sum(s) AS m4
  FROM (SELECT *, sum(s * k) OVER w / sum(s) OVER w AS c FROM ({SPECTRUM}) a WINDOW w AS (PARTITION BY turb_id, time)) b
  GROUP BY turb_id, time) m""",
       " ".join(f"patv__fft_aggregated__aggtype_{n}" for n in ("centroid", "variance", "skew", "kurtosis")))
def _(d):
    out = se.window_features(_rows(d), W, [se.spectrum])
    return out.select(*KEY, *[c for c in out.columns if "aggregated" in c])


SEGMENT = min(W, 256)
STARTS = list(range(0, W - SEGMENT + 1, SEGMENT - SEGMENT // 2))


def _entropy_sql() -> str:
    """Half-overlapping segments, each with its own mean removed and tapered; their powers are added up."""
    cut = f"""SELECT turb_id, time, b AS part, i - b AS i, x FROM series, (SELECT unnest({STARTS}) AS b) s WHERE i >= b AND i < b + {SEGMENT}"""
    tapered = f"(x - mu) * (0.5 - 0.5 * cos({2 * math.pi / SEGMENT!r} * i))"
    tap = f"SELECT turb_id, time, part, i, {tapered} AS v FROM (SELECT *, avg(x) OVER (PARTITION BY turb_id, time, part) AS mu FROM ({cut}) c) s"
    half = SEGMENT // 2
    # The angles are looked up: there are only as many as steps in a segment.
    turn = f"SELECT unnest(range(0, {SEGMENT})) AS m"
    table = f"SELECT m, cos({2 * math.pi / SEGMENT!r} * m) AS co, sin({2 * math.pi / SEGMENT!r} * m) AS si FROM ({turn}) m"
    one = f"""SELECT turb_id, time, part, k, pow(sum(v * co), 2) + pow(sum(v * si), 2) AS s FROM ({tap}) t,
(SELECT unnest(range(0, {half + 1})) AS k) f, ({table}) a WHERE a.m = (f.k * t.i) % {SEGMENT} GROUP BY turb_id, time, part, k"""
    power = f"SELECT turb_id, time, k, (CASE WHEN k = 0 OR k = {half} THEN 1 ELSE 2 END) * sum(s) AS s FROM ({one}) o GROUP BY turb_id, time, k"
    rel = f"""SELECT turb_id, time, s / max(s) OVER w AS r, min(s) OVER w / max(s) OVER w AS lo FROM ({power}) p
WINDOW w AS (PARTITION BY turb_id, time)"""
    counts = f"""SELECT turb_id, time, nb, least(floor((r - lo) / (1 - lo) * nb), nb - 1) AS bin, count(*) / {half + 1}e0 AS p
FROM ({rel}) r, (SELECT unnest([3, 5]) AS nb) b GROUP BY turb_id, time, nb, bin"""
    return f"""SELECT turb_id, time, -sum(p * ln(p)) FILTER (WHERE nb = 3) AS patv__fourier_entropy__bins_3,
-sum(p * ln(p)) FILTER (WHERE nb = 5) AS patv__fourier_entropy__bins_5 FROM ({counts}) c GROUP BY turb_id, time"""


query("ts_fourier_entropy", _entropy_sql(), "patv__fourier_entropy__bins_3 patv__fourier_entropy__bins_5")(
    _windowed(se.fourier_entropy)
)

ACF = ", ".join(
    f"sum((x - mu) * (x{k} - mu)) / (({W} - {k}) * any_value(v)) AS patv__autocorrelation__lag_{k}" for k in se.AUTOCORR_LAGS
)
LEADS = ", ".join(f"lead(x, {k}) OVER o AS x{k}" for k in se.AUTOCORR_LAGS)
ACF_SQL = f"""SELECT turb_id, time, {ACF} FROM (SELECT *, {LEADS}, avg(x) OVER a AS mu, var_pop(x) OVER a AS v FROM series
WINDOW a AS (PARTITION BY turb_id, time), o AS (PARTITION BY turb_id, time ORDER BY i)) s GROUP BY turb_id, time"""
query("ts_autocorrelation", ACF_SQL, _names(ACF_SQL))(_autocorr("patv__autocorrelation"))
query(
    "ts_partial_autocorr",
    f"""SELECT turb_id, time, patv__autocorrelation__lag_1 AS patv__partial_autocorrelation__lag_1,
(patv__autocorrelation__lag_2 - pow(patv__autocorrelation__lag_1, 2)) / (1 - pow(patv__autocorrelation__lag_1, 2))
AS patv__partial_autocorrelation__lag_2 FROM ({ACF_SQL}) r""",
    "patv__partial_autocorrelation__lag_1 patv__partial_autocorrelation__lag_2",
)(_autocorr("patv__partial"))

PREV = "(SELECT *, lag(x) OVER (PARTITION BY turb_id, time ORDER BY i) AS px FROM series) s"
query(
    "ts_number_crossing",
    f"""SELECT turb_id, time, count(*) FILTER (WHERE (x > 0) <> (px > 0)) AS patv__number_crossing_m__m_0,
count(*) FILTER (WHERE (x > 1) <> (px > 1)) AS patv__number_crossing_m__m_1 FROM {PREV} GROUP BY turb_id, time""",
    "patv__number_crossing_m__m_0 patv__number_crossing_m__m_1",
)(_summed("number_crossing_m__m_0", "number_crossing_m__m_1"))
query(
    "ts_last_max_location",
    f"""SELECT turb_id, time, (max(i) FILTER (WHERE x = m) + 1) / {W}e0 AS patv__last_location_of_maximum
FROM (SELECT *, max(x) OVER (PARTITION BY turb_id, time) AS m FROM series) s GROUP BY turb_id, time""",
    "patv__last_location_of_maximum",
)(_summed("last_location_of_maximum"))
query(
    "ts_cid_ce",
    f"""SELECT turb_id, time, sqrt(sum(pow(x - px, 2))) AS patv__cid_ce__normalize_false,
sqrt(sum(pow(x - px, 2))) / stddev_pop(x) AS patv__cid_ce__normalize_true FROM {PREV} GROUP BY turb_id, time""",
    "patv__cid_ce__normalize_false patv__cid_ce__normalize_true",
)(_summed("cid_ce__normalize_false", "cid_ce__normalize_true"))
query(
    "ts_longest_above_mean",
    """SELECT turb_id, time, max(run) AS patv__longest_strike_above_mean FROM (SELECT turb_id, time, grp, count(*) AS run
FROM (SELECT turb_id, time, i - row_number() OVER (PARTITION BY turb_id, time ORDER BY i) AS grp
      FROM (SELECT *, avg(x) OVER (PARTITION BY turb_id, time) AS mu FROM series) s WHERE x > mu) a
GROUP BY turb_id, time, grp) b GROUP BY turb_id, time""",
    "patv__longest_strike_above_mean",
)(_windowed(se.longest_above_mean))
query("ts_ar_coefficient")(_windowed(se.ar_coefficient))
# How far the normal equations of each window's regression are from being met.
query("ts_ar_normal", "SELECT DISTINCT turb_id, time, 0e0 AS patv__off FROM series", "patv__off", 5)(
    _windowed(lambda w: {"off": se.ar_fit(w)[1]})
)

DOF = W - 2
P_SUM = f"""(SELECT sum(CASE WHEN k = 0 THEN 1 ELSE exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(c2, k) END)
FROM (SELECT unnest(range(0, {DOF // 2})) AS k) r)"""
query(
    "ts_trend_pvalue",
    f"""SELECT turb_id, time, t AS patv__linear_trend__statistic,
greatest(1 - abs(t) / sqrt({DOF} + t * t) * {P_SUM}, 0) AS patv__linear_trend__attr_pvalue
FROM (SELECT turb_id, time, t, {DOF} / ({DOF} + t * t) AS c2 FROM (SELECT turb_id, time,
  corr(x, i) * sqrt({DOF}) / sqrt(1 - pow(corr(x, i), 2)) AS t FROM series GROUP BY turb_id, time) a) b""",
    "patv__linear_trend__statistic patv__linear_trend__attr_pvalue",
)(_windowed(se.linear_trend))
query(
    "ts_index_mass_quantile",
    f"""SELECT turb_id, time, min(i + 1) FILTER (WHERE run >= {se.MASS_SHARE * (1 - se.TIE)!r}e0 * tot) / {W}e0 AS patv__index_mass_quantile__q_04
FROM (SELECT turb_id, time, i, sum(abs(x)) OVER (PARTITION BY turb_id, time ORDER BY i) AS run,
      sum(abs(x)) OVER (PARTITION BY turb_id, time) AS tot FROM series) s GROUP BY turb_id, time""",
    "patv__index_mass_quantile__q_04",
)(_windowed(se.index_mass_quantile))


PARTS = (
    "ts_change_quantiles", "ts_fft_abs", "ts_fft_moments", "ts_fourier_entropy", "ts_autocorrelation", "ts_partial_autocorr",
    "ts_number_crossing", "ts_last_max_location", "ts_cid_ce", "ts_longest_above_mean", "ts_index_mass_quantile",
    "ts_trend_pvalue",
)
ALL_SQL = "SELECT * EXCLUDE (patv__linear_trend__statistic) FROM " + " JOIN ".join(
    f"({ENTRIES[part].sql}) p{i}" + (" USING (turb_id, time)" if i else "") for i, part in enumerate(PARTS)
)


@query("series_features", ALL_SQL, " ".join(c for part in PARTS for c in ENTRIES[part].num if "statistic" not in c), 4)
def _(d):
    # the regression on ten lags has no statement; its normal equations have (ts_ar_normal)
    return se.series_features(_rows(d), W).drop("patv__ar_coefficient__coeff_1__k_10")
