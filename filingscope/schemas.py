"""Logical table schemas.  Dates are DATE; 0/1 flags stay INT because NULL means "not applicable"."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _I, _L, _F, _TS = (
    T.StringType(), T.DateType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
)

DISCLOSURE_RAW = _schema(
    firstName=_S, lastName=_S, symbol=_S, assetDescription=_S, type=_S, amount=_S, owner=_S,
    district=_S, disclosureDate=_S, transactionDate=_S,
)

FILERS = _schema(filer_id=_S, name=_S, party=_S, chamber=_S, state=_S)

TRADES = _schema(
    trade_id=_S, filer_id=_S, ticker=_S, company=_S, trade_date=_D, disclosure_date=_D,
    filing_lag_days=_I, transaction_type=_S, size_min=_L, size_max=_L, size_midpoint=_L,
    owner=_S, filing_violation=_S,
)

PRICES = _schema(symbol=_S, date=_D, open=_F, high=_F, low=_F, close=_F)

PRICE_PATHS = _schema(
    trade_id=_S, anchor=_S, day=_I, date=_D, open=_F, high=_F, low=_F, close=_F, pct_change=_F,
)

MEMBERSHIPS = _schema(
    filer_id=_S, committee_id=_S, party=_S, rank=_I, title=_S, start_date=_D, end_date=_D,
    source=_S, confidence=_S,
)

COMMITTEE_SUBSECTOR = _schema(committee_id=_S, subsector=_S)
COMMITTEE_NAME = _schema(committee_id=_S, name=_S)
INDUSTRY_SUBSECTOR = _schema(industry=_S, subsector=_S)
TICKER_SUBSECTOR = _schema(ticker=_S, subsector=_S)

SIGNAL_LEDGER = _schema(trade_id=_S, notified_at=_TS)
FETCH_LOG = _schema(symbol=_S, attempt_no=_L, attempt_date=_D, ok=T.BooleanType())
RUN_HISTORY = _schema(
    id=_L, run_at=_TS, mode=_S, success=_I, new_trades=_I, duration_sec=_F, error_msg=_S,
)

BY_TABLE = {
    "filers": FILERS,
    "trades": TRADES,
    "prices": PRICES,
    "price_paths": PRICE_PATHS,
    "committee_memberships": MEMBERSHIPS,
}
