"""Window lengths and constants of the panel engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSettings:
    """Lengths are counted in grid steps. The defaults are those of a 10-minute grid."""

    steps_per_day: int = 144
    horizon: int = 288
    roll: int = 288
    series: int = 432
    lookback: int = 10
    valid_days: int = 15
    test_days: int = 15
    capacity: float = 1521.6
    blend_start: int = 200


# Rolled features of the long-horizon leg (fixed list).
ROLL_FEATURES = ("wspd", "etmp", "itmp", "prtv", "patv", "max_patv", "w_angle_sin", "w_angle_cos")

# Horizon segments of the short-horizon leg (fixed list).
SEGMENTS = ((0, 12), (12, 36), (36, 72), (72, 144), (144, 288))

# Columns never used as model inputs (fixed list).
NOT_FEATURES = ("day", "slot", "hour", "tmstamp", "data_type", "abnormal", "time", "target")
