"""Declared schemas of the data model. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

D, S, L, I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()


def _st(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in cols.items()])


BARS = _st(symbol=S, series=S, session=T.DateType(), prev_close=D, open=D, high=D, low=D,
           close=D, last=D, volume=D, turnover_lacs=D, trades=L, delivery_qty=D,
           delivery_pct=D)
INTRADAY = _st(symbol=S, ts=T.TimestampType(), open=D, high=D, low=D, close=D, volume=D,
               session=T.DateType())
CONTRACTS = _st(trade_date=T.DateType(), symbol=S, instrument=S, expiry=T.DateType(), strike=D,
                option_type=S, open=D, high=D, low=D, close=D, last=D, settle=D,
                prev_close=D, underlying=D, open_interest=D, oi_change=D, volume=D,
                turnover=D, trades=D, lot_size=D, contract=S)
ACTIONS = _st(symbol=S, ex_date=T.DateType(), type=S, factor=D, amount=D, note=S)
PERIOD = _st(period_start=T.DateType(), period_end=T.DateType(), months=I, consolidated=T.BooleanType(),
             revenue=D, profit_after_tax=D, eps_basic=D, paid_up_capital=D, face_value=D,
             profit_before_tax=D, finance_costs=D, depreciation=D, tax_expense=D)
FILINGS = _st(symbol=S, disclosed_at=T.TimestampType(), nature=S, periods=T.ArrayType(PERIOD))
CALENDAR = _st(day=T.DateType(), is_session=T.BooleanType(), name=S)
DECISION = _st(as_of=T.DateType(), recorded_at=T.TimestampType(), version=I, regime=S,
               trades=T.ArrayType(_st(symbol=S, entry=D, stop=D, target=D, qty=L)))
OUTCOME = _st(decision_date=T.DateType(), symbol=S, status=S, exit_price=D,
              exit_date=T.DateType(), exit_reason=S, pnl=D, r_multiple=D, note=S)

#: a bar row must carry at least these to be usable at all
REQUIRED_BAR_COLUMNS = ("symbol", "session", "open", "high", "low", "close", "volume")


class SchemaError(ValueError):
    """A table lacks a column its operator needs."""


def require_columns(df, needed=REQUIRED_BAR_COLUMNS):
    """Return ``df`` or raise naming the absent columns; metadata only, no job."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise SchemaError(f"missing required columns {missing}")
    return df
