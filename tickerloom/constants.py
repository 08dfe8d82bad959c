"""Fixed values the results depend on, stated once."""

# The default keyword dimension.
KEYWORDS = (
    "advertising", "cloud", "COVID", "credit", "currency exchange",
    "digital", "election", "exchange rate", "growth", "housing market",
    "inflation", "insurance", "politic", "profitability", "recession",
    "security", "software", "supply chain", "uncertainty", "war",
)

# Lags in weeks, filing types, rolling frame, warm-up skips.
LAGS = (1, 2, 4, 8)
FILING_TYPES = ("10-K", "10-Q")
ROLLING_PRECEDING = 12          # 12 preceding rows + the current one = 13 rows
CORRELATION_WARMUP = 6
TRAINING_WARMUP = 3
TOP_K = 10

# Pair selection.
PAIR_BLACKLIST = ("GEHC", "CAH", "DDOG", "SIVB", "FRC", "BBBY")
BACKTEST_BLACKLIST = ("GEHC", "CAH", "DDOG")
EXCLUDED_KEYWORD = "cryptocurrency"
EXCLUDED_LAG = 8
POOL_SIZE = 250
PAIR_COUNT = 25
MIN_HISTORY_DAYS = 280          # 40 weeks
GRID_MIN_DAYS = 180
GRID_MAX_DAYS = 365

# Buy lists and back-test.
BUY_BLACKLIST = ("SBNY",)
BUY_EXCLUDED_KEYWORD = "hack"
MIN_GROWTH = 0.05
RECENT_DAYS = 9
BACKTEST_TOP = 5
SLIPPAGE = 0.03
START_CASH = 1000.0
RISK_FREE_RATE = 0.04
WEEKS_PER_YEAR = 52
BACKTEST_END_MARGIN_DAYS = 14

# Index symbols removed from symbol lists, sentinel names.
INDEX_SYMBOLS = ("^GSPC", "^SP500TR")
UNKNOWN_COMPANY = "unknown"
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data"
MEMBERSHIP_SINCE = "2020-01-01"
SPLIT_SEED = 12
UNFILTERED_SCREEN_LIMIT = 100
REPORTS_KEPT = 20
