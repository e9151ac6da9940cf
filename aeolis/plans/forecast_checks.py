"""Queries on the two legs from end to end (rows-only: they contain fitted models)."""

from __future__ import annotations


from aeolis.plans import forecast as fc
from aeolis.plans.fixture import H, STEPS_PER_DAY, TEST_DAYS, VALID_DAYS, W
from aeolis.plans.registry import query
from aeolis.settings import PanelSettings
from aeolis.session import stage

SETTINGS = PanelSettings(
    steps_per_day=STEPS_PER_DAY, horizon=H, roll=H, series=W, valid_days=VALID_DAYS, test_days=TEST_DAYS, blend_start=16
)
SMALL = fc.Boosting(rounds=5, rate=0.3, leaves=8, members=((50, 0.6), (100, 0.8)))
SEGMENTS = ((0, 6), (6, 12), (12, H))
INPUT = 48


def _panel(d):
    return stage(d.panel, "panel")


def _features(d):
    return stage(fc.long_leg_features(_panel(d), d.curve, d.angle, SETTINGS, SMALL), "labelled")


@query("long_leg_features")
def _(d):
    return _features(d)


@query("long_leg_score")
def _(d):
    features = _features(d)
    return fc.evaluate_long_leg(fc.fit_long_leg(features, SMALL), features, SETTINGS)


@query("long_leg_forecast")
def _(d):
    features = _features(d)
    return fc.forecast_long_leg(fc.fit_long_leg(features, SMALL), features, SETTINGS)


@query("short_leg_values")
def _(d):
    rows = fc.short_leg_rows(_panel(d), d.curve, d.angle, SETTINGS)
    values = fc.short_leg_values(rows, d.hier, SETTINGS)
    series = fc.farm_series(rows).select("slot", "etmp_median", "ws_median", "mask_mean", "sin_tm", "cos_tm")
    return values.join(series, "slot")


@query("short_leg_forecast")
def _(d):
    panel = _panel(d)
    rows = fc.short_leg_rows(panel, d.curve, d.angle, SETTINGS)
    return fc.forecast_short_leg(panel, rows, SETTINGS, INPUT, SEGMENTS, fade=10)


@query("combined_forecast")
def _(d):
    panel = _panel(d)
    features = stage(fc.long_leg_features(panel, d.curve, d.angle, SETTINGS, SMALL), "labelled")
    long = fc.forecast_long_leg(fc.fit_long_leg(features, SMALL), features, SETTINGS)
    rows = fc.short_leg_rows(panel, d.curve, d.angle, SETTINGS)
    short = fc.forecast_short_leg(panel, rows, SETTINGS, INPUT, SEGMENTS, fade=10)
    return fc.combined_forecast(short, long, SETTINGS)
