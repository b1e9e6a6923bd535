import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import build_session
    s = build_session("tests", "local[*]", {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Random-walk panel with gaps, a late listing and a name that stops."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2020-01-01", periods=160)
    rows = []
    for k in range(8):
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))
        for i, d in enumerate(days):
            if (k == 1 and i < 40) or (k == 2 and i > 130) or (k >= 3 and rng.random() < 0.01):
                continue
            o = px[i] * (1 + rng.normal(0, 0.005))
            rows.append((f"N{k}", d.date(), i, o, max(o, px[i]) * 1.01, min(o, px[i]) * 0.99, px[i], float(rng.integers(100, 900))))
    pdf = pd.DataFrame(rows, columns=["symbol", "session", "idx", "open", "high", "low", "close", "volume"])
    pdf["idx"] = pdf["idx"].astype("int32")
    df = spark.createDataFrame(pdf, "symbol string, session date, idx int, open double, high double, low double, close double, volume double")
    return df.persist()
