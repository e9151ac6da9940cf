import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aeolis.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests", memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel_pdf():
    """Three turbines of unequal length, one of them with most of the rows; gaps, flat and missing stretches."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for turb, n in ((1, 700), (2, 120), (3, 90)):
        x = np.round(rng.normal(300, 200, n), 2)
        x[rng.random(n) < 0.06] = np.nan
        x[40:70] = 0.0
        parts.append(pd.DataFrame({"turb_id": turb, "time": range(n), "slot": [2 * i + turb for i in range(n)], "patv": x}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    from aeolis.functions.scalar import nan_to_null

    return nan_to_null(spark.createDataFrame(panel_pdf)).persist()
