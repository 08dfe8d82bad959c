"""Explicit schemas of every logical table. Nothing is inferred."""

from pyspark.sql import types as T

_S, _D, _L, _I, _DT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.DateType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PRICES = _struct(stock_symbol=_S, universe=_S, created_at=_DT, open_price=_D, close_price=_D, volume=_D)

LANDED_PRICES = _struct(
    Date=_DT, Open=_D, High=_D, Low=_D, Close=_D, Volume=_D, Symbol=_S
)

FILINGS = _struct(
    company_name=_S, filing_type=_S, filing_number=_S, risk_factors=_S,
    risk_disclosures=_S, filing_url=_S, filing_date=_DT,
)

KEYWORD_WEEKLY_COUNTS = _struct(
    filing_week=_DT, filing_type=_S, keyword=_S, keyword_mentions=_L, total_filings=_L
)

WEEKLY_PRICES = _struct(
    stock_symbol=_S, week_opening_date=_DT, week_open_price=_D, week_close_price=_D
)

CORRELATION_SCORES = _struct(
    stock_symbol=_S, keyword=_S, filing_type=_S, time_delay=_I,
    start_date=_DT, end_date=_DT, correlation=_D, direction=_S,
)

PAIRS = _struct(stock_symbol=_S, keyword=_S, filing_type=_S, time_delay=_I, start_date=_DT, end_date=_DT)

RECOMMENDATIONS = _struct(
    previous_weekly_open_date=_DT, previous_weekly_close_price=_D, predicted_weekly_close_price=_D,
    stock_symbol=_S, keyword=_S, start_date=_DT, time_delay=_I, filing_type=_S,
)

BACKTEST_PREDICTIONS = _struct(
    model_type=_S, monday_end_date=_DT, stock_symbol=_S, keyword=_S, start_date=_DT,
    time_delay=_I, filing_type=_S, current_close_price=_D, predicted_price=_D,
)

PREDICTION_RESULTS = _struct(
    current_week=_I, week_opening_date=_DT, keyword_mentions_rolling_avg=_D,
    current_close_price=_D, next_week_close_price=_D, predicted_price=_D,
)

SYMBOL_NAMES = _struct(stock_symbol=_S, company_name=_S)
SECTORS = _struct(stock_symbol=_S, universe=_S, sector=_S, peratio=_S, evtoebitda=_S)

INCOME_REPORT = _struct(fiscalDateEnding=_S, ebitda=_S)
BALANCE_REPORT = _struct(
    fiscalDateEnding=_S, commonStockSharesOutstanding=_S, totalAssets=_S,
    cashAndCashEquivalentsAtCarryingValue=_S,
)
EARNINGS_REPORT = _struct(fiscalDateEnding=_S, reportedEPS=_S)

INCOME_FILE = T.StructType([
    T.StructField("symbol", _S), T.StructField("quarterlyReports", T.ArrayType(INCOME_REPORT)),
])
BALANCE_FILE = T.StructType([
    T.StructField("symbol", _S), T.StructField("quarterlyReports", T.ArrayType(BALANCE_REPORT)),
])
EARNINGS_FILE = T.StructType([
    T.StructField("symbol", _S), T.StructField("quarterlyEarnings", T.ArrayType(EARNINGS_REPORT)),
])
OVERVIEW_FILE = T.StructType([
    T.StructField("Symbol", _S), T.StructField("Sector", _S),
    T.StructField("PERatio", _S), T.StructField("EVToEBITDA", _S),
])
