"""The carried book against plain cases, one per gate."""

import datetime as dt

import pytest

from barloom.operators import setups
from barloom.operators.setups import RiskConfig

COLS = ("session date, symbol string, score double, entry double, stop double, atr_pct double, adv_shares double, sector string, cluster string, gate string, "
        "event boolean, risk_off boolean, exit_on date, exit_value double")
DAY = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(20)]
CFG = RiskConfig(capital=1_000_000.0, risk_pct=1.0, max_position_pct=10.0, max_sector_pct=15.0, max_correlated_pct=12.0, max_open_risk_pct=2.4, max_open_positions=3,
                 max_daily_loss_pct=1.5, max_drawdown_pct=2.5, risk_off_exposure_pct=50.0)


def walked(spark, rows, cfg=CFG, **kw):
    base = dict(score=1.0, entry=100.0, stop=80.0, atr_pct=2.0, adv_shares=1e9, sector="S", cluster=None, gate=None, event=False, risk_off=False, exit_on=None, exit_value=None)
    full = [base | dict(session=DAY[d], symbol=s) | r for d, s, r in rows]
    names = [c.split()[0] for c in COLS.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLS)
    return {(r.session, r.symbol): r for r in setups.walk_book(df, cfg, **kw).collect()}


def reasons(out):
    return {s: r.reason for (_, s), r in out.items()}


def test_gates_that_need_no_book(spark):
    out = walked(spark, [(0, "event", {"event": True}), (0, "gated", {"gate": "illiquid_vs_adv"}), (0, "dear", {"entry": 5e6, "stop": 4e6, "sector": "D"}),
                         (0, "large", {"stop": 99.0, "sector": "L"}), (0, "thin", {"adv_shares": 50.0, "sector": "T"}), (1, "half", {"risk_off": True, "sector": "H"})])
    assert reasons(out) == {"event": "event_in_window", "gated": "illiquid_vs_adv", "dear": "qty_rounds_to_zero", "large": None, "thin": "illiquid_vs_adv", "half": None}
    assert out[DAY[0], "large"].qty == 1000 and out[DAY[1], "half"].qty == 250 and out[DAY[1], "half"].open_positions == 1
    none = walked(spark, [(0, "a", {"risk_off": True})], RiskConfig(risk_off_exposure_pct=0.0))
    assert reasons(none) == {"a": "market_risk_off"}


def test_caps_on_what_is_held_until_its_exit(spark):
    rows = [(0, "a", {"exit_on": DAY[5], "exit_value": 1.0, "cluster": "C"}), (1, "a", {"stop": 90.0}), (1, "b", {"stop": 95.0, "sector": "B", "cluster": "C"}),
            (1, "c", {"stop": 95.0}), (1, "d", {"sector": "D", "stop": 80.0}), (2, "e", {"sector": "E", "stop": 80.0}), (6, "f", {"sector": "F", "stop": 80.0})]
    out = walked(spark, rows, top=9)
    assert {(d.day, s): r.reason for (d, s), r in out.items()} == {
        (1, "a"): None, (2, "a"): None, (2, "b"): "correlated_cap", (2, "c"): "sector_cap", (2, "d"): "portfolio_heat_cap",
        (3, "e"): "portfolio_heat_cap", (7, "f"): None}
    assert out[DAY[1], "a"].qty == 500 and out[DAY[6], "f"].equity == pytest.approx(1_000_500.0) and out[DAY[6], "f"].open_positions == 1


def test_a_loss_of_the_day_and_one_from_the_high(spark):
    rows = [(0, "a", {"exit_on": DAY[2], "exit_value": -40.0}), (2, "b", {"sector": "B"}), (3, "c", {"sector": "C", "exit_on": DAY[4], "exit_value": -20.0}), (5, "d", {"sector": "D"})]
    out = walked(spark, rows)
    assert reasons(out) == {"a": None, "b": "daily_loss_cap", "c": None, "d": "drawdown_cap"}
    assert out[DAY[2], "b"].realised_today == -20_000.0 and out[DAY[3], "c"].realised_today == 0.0 and out[DAY[5], "d"].drawdown_pct == pytest.approx(3.0)


def test_positions_trades_and_separate_books(spark):
    rows = [(0, s, {"score": 9.0 - k, "stop": 99.0, "entry": 100.0, "sector": s, "atr_pct": 2.0}) for k, s in enumerate("abcde")]
    rows += [(1, "f", {"sector": "f", "stop": 99.0})]
    cfg = RiskConfig(capital=1_000_000.0, risk_pct=0.1, max_open_positions=3, max_position_pct=50.0)
    assert reasons(walked(spark, rows, cfg, max_trades=2)) == {"a": None, "b": None, "f": None}
    assert reasons(walked(spark, rows, cfg, max_trades=9)) == {"a": None, "b": None, "c": None, "d": "max_open_positions", "e": "max_open_positions", "f": "max_open_positions"}
    df = spark.createDataFrame([(DAY[0], "a", 1.0, 100.0, 99.0, 2.0, 1e9, "s", None, None, False, False, None, None, k) for k in "xy"], COLS + ", book string")
    both = setups.walk_book(df, cfg, keys=["book"]).collect()
    assert sorted((r.book, r.approved, r.open_positions) for r in both) == [("x", True, 0), ("y", True, 0)]
    assert setups.walk_book(df.where("false"), cfg, keys=["book"]).count() == 0
