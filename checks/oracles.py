"""DuckDB twins of the registered queries, built from shared WITH blocks.

Every twin states the reference semantics directly (one window per parameter
combination, explicit joins), independent of how the Spark side arrives at it.
"""

from tickerloom.plans.fundamentals import SCREEN_GROUPS

AS_OF = "2001-11-04"
SINCE = "1998-01-01"
REFERENCE_SYMBOL = "S000001"
KEYWORDS = ["ion", "tion", "that", "with", "from", "license", "@", "copyright"]
LAGS = [1, 2, 4, 8]
#: More than a hundred keywords, some of them twice.
LONG_KEYWORDS = [a + b for a in "aeiorst" for b in "acdehilmnoprstuz"] + ["er", "on", "license", "with"] * 2
TYPES = ["10-K", "10-Q"]
BACKFILL_ENDS = SINCE
BACKFILL_LAGS = LAGS
BACKFILL_KEYWORDS = KEYWORDS
CHART = ("S000001", "1998-01-01", "2001-06-30", "ion", 2)
VALIDATE_FROM = "2000-09-04"
# keyword, filing type, lag, start, end (end is a Monday with a full week)
PAIR_SETS = [("ion", "10-Q", 2, "1998-01-05", "2001-10-29"), ("with", "10-K", 1, "1998-01-05", "2001-10-29")]

MAX_LAG = max(LAGS)


def _values(items):
    return ", ".join(f"('{i}')" if isinstance(i, str) else f"({i})" for i in items)


def day(c):
    return f"CAST({c} AS VARCHAR)"


# ---- inputs ---------------------------------------------------------------

BLOCKS = {}

BLOCKS["prices"] = """
SELECT printf('S%06d', l_suppkey) AS stock_symbol,
       CASE WHEN l_suppkey % 3 = 0 THEN 'russell' ELSE 'sp' END AS universe,
       CAST(l_shipdate AS DATE) AS created_at,
       min(l_extendedprice) AS open_price, max(l_extendedprice) AS close_price, sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2, 3"""

BLOCKS["index_prices"] = "SELECT created_at, round(avg(close_price), 6) AS close_price FROM prices GROUP BY 1"

BLOCKS["filings"] = """
SELECT source AS company_name, CASE WHEN doc_id % 10 < 3 THEN '10-K' ELSE '10-Q' END AS filing_type,
       printf('%010d-01-%06d', doc_id, doc_id % 1000000) AS filing_number,
       CASE WHEN doc_id % 10 < 3 AND lang = 'en' THEN substr(text, 1, length(text) // 2) ELSE text END AS risk_factors,
       CASE WHEN doc_id % 10 < 3 AND lang = 'en' THEN substr(text, length(text) // 2 + 1) END AS risk_disclosures,
       CAST(DATE '1995-01-02' + CAST(doc_id * 37 % 2499 AS INTEGER) AS DATE) AS filing_date
FROM documents"""

BLOCKS["weekly"] = """
SELECT stock_symbol, CAST(date_trunc('week', created_at) AS DATE) AS week_opening_date,
       arg_min(open_price, created_at) AS week_open_price, arg_max(close_price, created_at) AS week_close_price
FROM prices GROUP BY 1, 2"""

BLOCKS["kw"] = f"SELECT * FROM (VALUES {_values(KEYWORDS)}) t(keyword)"

BLOCKS["counts"] = """
SELECT CAST(date_trunc('week', filing_date) AS DATE) AS filing_week, filing_type, keyword,
       CAST(sum(CASE WHEN contains(lower(risk_factors), lower(keyword)) THEN 1
                     WHEN contains(lower(risk_disclosures), lower(keyword)) THEN 1 ELSE 0 END) AS BIGINT) AS keyword_mentions,
       count(*) AS total_filings
FROM filings CROSS JOIN kw GROUP BY 1, 2, 3"""

BLOCKS["lags"] = f"SELECT * FROM (VALUES {_values(LAGS)}) t(time_delay)"

BLOCKS["lagged"] = f"""
SELECT DISTINCT stock_symbol, keyword, filing_type, time_delay, week_opening_date, week_close_price,
       1.0 * keyword_mentions / total_filings AS mention_rate
FROM weekly JOIN lags ON true JOIN counts ON week_opening_date = filing_week + 7 * time_delay
WHERE week_opening_date BETWEEN DATE '{SINCE}' AND DATE '{AS_OF}'"""

BLOCKS["starts"] = f"""
SELECT DISTINCT CAST(date_trunc('month', created_at) AS DATE) AS start_date FROM prices
WHERE stock_symbol = '{REFERENCE_SYMBOL}'
  AND date_trunc('month', created_at) BETWEEN DATE '{SINCE}' AND DATE '{AS_OF}'"""


def corr(x, y):
    return (
        f"CASE WHEN stddev_pop({x}) <= 1e-12 * abs(avg({x})) OR stddev_pop({y}) <= 1e-12 * abs(avg({y})) "
        f"THEN NULL ELSE corr({x}, {y}) END"
    )


BLOCKS["rolled"] = """
SELECT l.*, start_date, avg(mention_rate) OVER (
         PARTITION BY start_date, stock_symbol, keyword, filing_type, time_delay
         ORDER BY week_opening_date ROWS 12 PRECEDING) AS rolling
FROM lagged l JOIN starts ON week_opening_date >= start_date"""

BLOCKS["grid"] = f"""
SELECT stock_symbol, keyword, filing_type, time_delay, start_date, DATE '{AS_OF}' AS end_date,
       round({corr('week_close_price', 'rolling')}, 12) AS correlation
FROM rolled WHERE start_date <= DATE '{AS_OF}' - 180 GROUP BY 1, 2, 3, 4, 5
HAVING correlation IS NOT NULL"""

BLOCKS["ends"] = f"""
SELECT DISTINCT week_opening_date AS end_date FROM weekly
WHERE week_opening_date BETWEEN DATE '{BACKFILL_ENDS}' AND DATE '{AS_OF}'"""

BLOCKS["backfill"] = f"""
SELECT stock_symbol, keyword, filing_type, time_delay, start_date, end_date,
       round({corr('week_close_price', 'rolling')}, 12) AS correlation
FROM rolled JOIN ends ON week_opening_date <= end_date AND end_date - start_date BETWEEN 180 AND 365
WHERE filing_type = '10-K' AND keyword IN ({', '.join(repr(k) for k in BACKFILL_KEYWORDS)})
  AND time_delay IN ({', '.join(map(str, BACKFILL_LAGS))})
GROUP BY 1, 2, 3, 4, 5, 6 HAVING correlation IS NOT NULL"""


def _ranked(source):
    combo = "start_date, end_date, time_delay, keyword, filing_type"
    return f"""
SELECT *, row_number() OVER (PARTITION BY {combo} ORDER BY correlation DESC, stock_symbol) AS d,
       row_number() OVER (PARTITION BY {combo} ORDER BY correlation ASC, stock_symbol) AS i
FROM {source}"""


BLOCKS["across"] = f"""
SELECT stock_symbol, keyword, filing_type, time_delay, DATE '{SINCE}' AS start_date, DATE '{AS_OF}' AS end_date,
       round({corr('week_close_price', 'rolling')}, 12) AS correlation
FROM (SELECT *, avg(mention_rate) OVER (PARTITION BY keyword, filing_type, time_delay
             ORDER BY stock_symbol, week_opening_date ROWS 12 PRECEDING) AS rolling FROM lagged)
GROUP BY 1, 2, 3, 4 HAVING correlation IS NOT NULL"""
BLOCKS["across_ranked"] = _ranked("across")
BLOCKS["grid_ranked"] = _ranked("grid")
BLOCKS["backfill_ranked"] = _ranked("backfill")
_SCORE = "stock_symbol, keyword, filing_type, time_delay, start_date, end_date, round_even(correlation, 4) AS correlation"
for _src in ("grid", "backfill"):
    BLOCKS[f"{_src}_scores"] = f"""
SELECT {_SCORE}, 'direct' AS direction FROM {_src}_ranked WHERE d <= 10
UNION ALL SELECT {_SCORE}, 'inverse' FROM {_src}_ranked WHERE i <= 10"""

_TIES = "stock_symbol, keyword, filing_type, time_delay, start_date"

BLOCKS["eligible"] = f"""
SELECT *, abs(correlation) AS abs_corr FROM grid_scores
WHERE correlation IS NOT NULL AND start_date <= DATE '{AS_OF}' - 280
  AND stock_symbol NOT IN ('GEHC', 'CAH', 'DDOG', 'SIVB', 'FRC', 'BBBY')
  AND abs(correlation) <> 1 AND keyword <> 'cryptocurrency' AND time_delay <> 8"""

BLOCKS["top_pairs"] = f"""
SELECT stock_symbol, keyword, filing_type, time_delay, start_date, end_date, correlation, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_symbol ORDER BY abs_corr DESC, {_TIES}, direction) AS n FROM (
    (SELECT * FROM eligible WHERE direction = 'direct' ORDER BY correlation DESC, {_TIES} LIMIT 250)
    UNION ALL
    (SELECT * FROM eligible WHERE direction = 'inverse' ORDER BY correlation ASC, {_TIES} LIMIT 250)))
WHERE n = 1 ORDER BY abs_corr DESC, {_TIES} LIMIT 25"""

BLOCKS["dated_eligible"] = f"""
SELECT *, abs(correlation) AS abs_corr FROM backfill_scores
WHERE correlation IS NOT NULL AND start_date <= DATE '{AS_OF}' - 280 AND end_date <= DATE '{AS_OF}' - 14
  AND stock_symbol NOT IN ('GEHC', 'CAH', 'DDOG')
  AND correlation <> 1 AND keyword <> 'cryptocurrency' AND time_delay <> 8"""

BLOCKS["dated_pool"] = f"""
SELECT * FROM (
  SELECT *, CASE WHEN direction = 'direct'
      THEN row_number() OVER (PARTITION BY end_date, direction ORDER BY correlation DESC, {_TIES})
      ELSE row_number() OVER (PARTITION BY end_date, direction ORDER BY correlation ASC, {_TIES}) END AS p
  FROM dated_eligible) WHERE p <= 250"""

BLOCKS["dated_pairs"] = f"""
SELECT stock_symbol, keyword, filing_type, time_delay, start_date, end_date, correlation, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY end_date ORDER BY abs_corr DESC, {_TIES}) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY end_date, stock_symbol ORDER BY abs_corr DESC, {_TIES}, direction) AS n
    FROM dated_pool) WHERE n = 1)
WHERE k <= 25"""

# ---- training -------------------------------------------------------------

_PAIR = "stock_symbol, keyword, filing_type, time_delay, start_date, end_date"

BLOCKS["fixed_pairs"] = "SELECT printf('S%06d', s_suppkey) AS stock_symbol, keyword, filing_type, time_delay, " \
    "CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date FROM supplier CROSS JOIN (VALUES " + \
    ", ".join(f"('{k}', '{t}', {n}, '{s}', '{e}')" for k, t, n, s, e in PAIR_SETS) + \
    ") v(keyword, filing_type, time_delay, start_date, end_date)"

BLOCKS["shifted_pairs"] = """
SELECT DISTINCT stock_symbol, keyword, filing_type, time_delay,
       CAST(start_date + CAST((8 - isodow(start_date)) % 7 AS INTEGER) AS DATE) AS start_date, end_date FROM dated_pairs"""


def _pair_weeks(pairs, begin):
    return f"""
SELECT a.*, b.week_close_price AS target_close_price FROM (
  SELECT p.*, w.week_opening_date, w.week_close_price,
         avg(1.0 * keyword_mentions / total_filings) OVER (
            PARTITION BY p.stock_symbol, p.keyword, p.filing_type, p.time_delay, p.start_date, p.end_date
            ORDER BY w.week_opening_date ROWS 12 PRECEDING) AS mention_rolling_avg
  FROM {pairs} p JOIN weekly w ON p.stock_symbol = w.stock_symbol
  JOIN counts c ON c.filing_week = w.week_opening_date AND c.keyword = p.keyword AND c.filing_type = p.filing_type
  WHERE w.week_opening_date >= {begin}) a
JOIN (
  SELECT p.*, w.week_opening_date, w.week_close_price
  FROM {pairs} p JOIN weekly w ON p.stock_symbol = w.stock_symbol
  JOIN counts c ON c.filing_week = w.week_opening_date AND c.keyword = p.keyword AND c.filing_type = p.filing_type
  WHERE w.week_opening_date >= {begin}) b
ON a.stock_symbol = b.stock_symbol AND a.keyword = b.keyword AND a.filing_type = b.filing_type
   AND a.time_delay = b.time_delay AND a.start_date = b.start_date AND a.end_date = b.end_date
   AND b.week_opening_date = a.week_opening_date + 7 * a.time_delay"""


_F = ["current_week", "mention_rolling_avg", "current_close_price"]
_Y = "target_close_price"
_PACKED = ("year(week_opening_date) * 10000 + month(week_opening_date) * 100 + day(week_opening_date)")


def _training_blocks(pairs, cutoff):
    """Blocks from a pair relation to fitted models; cutoff is 'filing' or 'end_date'."""
    blocks = [(f"{pairs}_weeks", f"""
SELECT {_PAIR}, week_opening_date, {_PACKED} AS current_week, mention_rolling_avg,
       week_close_price AS current_close_price, target_close_price FROM ({_pair_weeks(pairs, 'p.start_date')})""")]
    if cutoff == "filing":
        blocks += [
            (f"{pairs}_filing", f"""
SELECT {_PAIR}, week_opening_date AS filing_week
FROM ({_pair_weeks(pairs, "DATE '0001-01-01'")}) WHERE week_opening_date >= start_date"""),
            (f"{pairs}_cut", f"SELECT {_PAIR}, max(filing_week) AS cutoff FROM {pairs}_filing GROUP BY ALL"),
        ]
    else:
        blocks.append((f"{pairs}_cut", f"SELECT {_PAIR}, end_date AS cutoff FROM {pairs}"))
    blocks += [
        (f"{pairs}_use", f"""
SELECT *, md5(concat_ws('|', stock_symbol, keyword, filing_type, CAST(time_delay AS VARCHAR),
             CAST(start_date AS VARCHAR), CAST(week_opening_date AS VARCHAR), '12')) AS h FROM (
  SELECT w.*, row_number() OVER (PARTITION BY {_PAIR} ORDER BY week_opening_date) AS pos
  FROM {pairs}_weeks w JOIN {pairs}_cut c USING ({_PAIR}) WHERE week_opening_date < cutoff) WHERE pos > 3"""),
        (f"{pairs}_train", f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY {_PAIR} ORDER BY h) <=
                 ceil(count(*) OVER (PARTITION BY {_PAIR}) * 0.1) THEN 'test' ELSE 'train' END AS part
FROM {pairs}_use"""),
        (f"{pairs}_score", f"""
SELECT w.*, CAST(week_opening_date + 7 * time_delay AS DATE) AS prediction_date
FROM {pairs}_weeks w JOIN {pairs}_cut c USING ({_PAIR}) WHERE week_opening_date = cutoff"""),
        (f"{pairs}_models", _models(f"SELECT {_PAIR}, {', '.join(_F)}, {_Y} FROM {pairs}_train WHERE part = 'train'")),
    ]
    return blocks


def _models(rows):
    names = [*_F, _Y]
    agg = [f"avg({c}) AS m_{c}" for c in names] + [f"stddev_pop({c}) AS s_{c}" for c in names]
    agg += [f"covar_pop({a}, {b}) AS c_{a}__{b}" for i, a in enumerate(_F) for b in names[i + 1:]]
    moments = f"SELECT {_PAIR}, count({_Y}) AS n_train, {', '.join(agg)} FROM ({rows}) GROUP BY ALL"
    return _solved(moments, _PAIR)


def _solved(moments, keys):
    """Elimination in the features' own units, one pivot after the other; a feature without variance of its own gets none."""
    f1, f2, f3 = _F

    def v(i, j):
        a, b = sorted((i, j))
        names = [*_F, _Y]
        return f"s_{names[a]} * s_{names[a]}" if a == b else f"c_{names[a]}__{names[b]}"

    def over(x, pivot, own):
        return f"CASE WHEN {pivot} > 1e-20 * {own} THEN {x} / ({pivot}) ELSE 0 END"

    one = f"SELECT *, {v(0, 0)} AS p1, " + ", ".join(f"{v(0, j)} AS d1{j}" for j in (1, 2, 3)) + f", m_{f1} * m_{f1} AS o1 FROM ({moments})"
    two = "SELECT *, " + ", ".join(f"{over(f'd1{j}', 'p1', 'o1')} AS l{j}" for j in (1, 2, 3)) + f" FROM ({one})"
    left = f"SELECT *, {v(1, 1)} - l1 * d11 AS p2, {v(1, 2)} - l1 * d12 AS d22, {v(1, 3)} - l1 * d13 AS d23, {v(1, 1)} AS o2 FROM ({two})"
    three = f"SELECT *, {over('d22', 'p2', 'o2')} AS k2, {over('d23', 'p2', 'o2')} AS k3 FROM ({left})"
    last = f"SELECT *, {v(2, 2)} - l2 * d12 - k2 * d22 AS p3, {v(2, 3)} - l2 * d13 - k2 * d23 AS d33 FROM ({three})"
    back = f"SELECT *, {over('d33', 'p3', v(2, 2))} AS b_{f3} FROM ({last})"
    back = f"SELECT *, k3 - k2 * b_{f3} AS b_{f2} FROM ({back})"
    back = f"SELECT *, l3 - l1 * b_{f2} - l2 * b_{f3} AS b_{f1} FROM ({back})"
    inter = " - ".join([f"m_{_Y}", *[f"b_{f} * m_{f}" for f in _F]])
    return f"SELECT {keys}, n_train, {', '.join(f'b_{f}' for f in _F)}, {inter} AS intercept FROM ({back}) WHERE n_train >= 4"


_PRED = "intercept + " + " + ".join(f"b_{f} * {f}" for f in _F)


def _latest(pairs, close="JOIN prices x ON x.stock_symbol = q.stock_symbol AND x.created_at = q.end_date"):
    return f"""
SELECT * FROM (
  SELECT q.*, {_PACKED} AS current_week, x.close_price AS current_close_price,
         row_number() OVER (PARTITION BY {', '.join('q.' + c for c in _PAIR.split(', '))} ORDER BY week_opening_date DESC) AS n
  FROM (SELECT p.*, w.week_opening_date, avg(1.0 * keyword_mentions / total_filings) OVER (
            PARTITION BY p.stock_symbol, p.keyword, p.filing_type, p.time_delay, p.start_date, p.end_date
            ORDER BY w.week_opening_date ROWS 12 PRECEDING) AS mention_rolling_avg
        FROM (SELECT {_PAIR} FROM {pairs}) p JOIN weekly w ON p.stock_symbol = w.stock_symbol
        JOIN counts c ON w.week_opening_date = c.filing_week + 7 * p.time_delay
             AND c.keyword = p.keyword AND c.filing_type = p.filing_type
        WHERE w.week_opening_date BETWEEN p.start_date AND p.end_date) q
  {close}) WHERE n = 1"""


def _trained(pairs):
    return f"(SELECT {_PAIR}, count(*) AS n_rows FROM {pairs}_train WHERE part = 'train' GROUP BY ALL)"


_UNFITTED = "CASE WHEN coalesce(n_rows, 0) < 4 THEN 'too_few_rows' ELSE 'ok' END"


def _recommend(pairs):
    return f"""
SELECT {day('prediction_date')} AS previous_weekly_open_date, s.target_close_price AS previous_weekly_close_price,
       CASE WHEN prediction_date IS NOT NULL THEN
       round(intercept + b_current_week * l.current_week + b_mention_rolling_avg * l.mention_rolling_avg
             + b_current_close_price * l.current_close_price, 2) END AS predicted_weekly_close_price,
       stock_symbol, keyword, {day('start_date')} AS start_date, CAST(time_delay AS BIGINT) AS time_delay, filing_type,
       CASE WHEN prediction_date IS NULL THEN 'no_filing_week' WHEN l.current_week IS NULL THEN 'no_latest_close' ELSE {_UNFITTED} END AS status
FROM (SELECT DISTINCT {_PAIR} FROM {pairs}) LEFT JOIN {pairs}_latest l USING ({_PAIR}) LEFT JOIN {pairs}_models m USING ({_PAIR})
LEFT JOIN {pairs}_score s USING ({_PAIR}) LEFT JOIN {_trained(pairs)} USING ({_PAIR})"""


# ---- fundamentals ----------------------------------------------------------

BLOCKS["reports"] = """
SELECT printf('S%06d', l_suppkey) AS stock_symbol, CASE WHEN l_suppkey % 3 = 0 THEN 'russell' ELSE 'sp' END AS universe,
       fiscal_date,
       CASE WHEN (l_suppkey * 5 + month(fiscal_date) + year(fiscal_date)) % 17 = 0 THEN 'None'
            ELSE CAST(CAST(round(assets - cash, 0) AS BIGINT) AS VARCHAR) END AS ebitda,
       CAST(CAST(round(assets, 0) AS BIGINT) AS VARCHAR) AS total_assets,
       CAST(CAST(round(cash, 0) AS BIGINT) AS VARCHAR) AS total_cash,
       CAST(CAST(shares AS BIGINT) AS VARCHAR) AS shares_outstanding,
       CAST(CAST(round(cash / shares, 0) AS BIGINT) AS VARCHAR) AS reported_eps
FROM (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS fiscal_date,
             sum(l_extendedprice) AS assets, sum(l_extendedprice * l_discount) AS cash, sum(l_quantity) AS shares
      FROM lineitem GROUP BY 1, 2)"""

BLOCKS["symbol_dim"] = """
SELECT printf('S%06d', s_suppkey) AS stock_symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'russell' ELSE 'sp' END AS universe,
       s_name AS company_name, n_name AS sector,
       CAST(CAST(round(s_acctbal / 100, 0) AS BIGINT) AS VARCHAR) AS peratio,
       CASE WHEN s_suppkey % 17 = 0 THEN 'None' ELSE CAST(CAST(round(s_acctbal / 50, 0) AS BIGINT) AS VARCHAR) END AS evtoebitda
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _peaks(where="true"):
    return f"""
SELECT universe, stock_symbol, first(close_price ORDER BY close_price DESC, created_at) AS highest_price,
       first(created_at ORDER BY close_price DESC, created_at) AS peak_date,
       first(close_price ORDER BY created_at DESC) AS current_price, max(created_at) AS current_date_
FROM prices WHERE {where} GROUP BY 1, 2"""


BLOCKS["peaks"] = _peaks()
BLOCKS["screen_peaks"] = _peaks("created_at BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'")

BLOCKS["first_after"] = """
SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY universe, stock_symbol ORDER BY fiscal_date) AS n
  FROM reports r JOIN peaks USING (universe, stock_symbol) WHERE fiscal_date > peak_date) WHERE n = 1"""
BLOCKS["latest_report"] = """
SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY universe, stock_symbol ORDER BY fiscal_date DESC) AS n
  FROM reports r) WHERE n = 1"""

_ASOF = """FROM peaks k JOIN latest_report l USING (universe, stock_symbol)
LEFT JOIN first_after f USING (universe, stock_symbol)"""


def _asof(c):
    return f"CASE WHEN f.n IS NULL THEN l.{c} ELSE f.{c} END"


BLOCKS["income"] = f"""
SELECT universe, stock_symbol, {_asof('ebitda')} AS peak_price_ebitda, {_asof('fiscal_date')} AS peak_price_ebitda_date,
       h.js AS ebitda_last_5_years, l.ebitda AS most_recent_ebitda, l.fiscal_date AS most_recent_ebitda_date
{_ASOF} JOIN (
  SELECT universe, stock_symbol, '{{' || string_agg('"' || CAST(fiscal_date AS VARCHAR) || '":"' || ebitda || '"', ',' ORDER BY fiscal_date DESC) || '}}' AS js
  FROM (SELECT *, row_number() OVER (PARTITION BY universe, stock_symbol ORDER BY fiscal_date DESC) AS k FROM reports)
  WHERE k <= 20 GROUP BY 1, 2) h USING (universe, stock_symbol)"""

BLOCKS["balance"] = f"""
SELECT universe, stock_symbol, {', '.join(f'{_asof(c)} AS peak_price_{c}' for c in ('shares_outstanding', 'total_assets', 'total_cash'))},
       {_asof('fiscal_date')} AS peak_price_report_date,
       {', '.join(f'l.{c} AS most_recent_{c}' for c in ('shares_outstanding', 'total_assets', 'total_cash'))},
       l.fiscal_date AS most_recent_report_date
{_ASOF}"""


def _num0(c):
    return f"CASE WHEN {c} = 'None' THEN 0 ELSE CAST({c} AS DOUBLE) END"


BLOCKS["screen_base"] = f"""
SELECT universe, sector, company_name, stock_symbol, highest_price, current_price, peak_date, current_date_ - peak_date AS days_since_peak,
       CAST(most_recent_total_cash AS DOUBLE) / nullif(CAST(peak_price_total_cash AS DOUBLE), 0) - 1 AS cash_growth,
       CAST(most_recent_total_assets AS DOUBLE) / nullif(CAST(peak_price_total_assets AS DOUBLE), 0) - 1 AS asset_growth,
       CAST(peak_price_shares_outstanding AS DOUBLE) AS ps, CAST(most_recent_shares_outstanding AS DOUBLE) AS rs,
       {_num0('peak_price_ebitda')} AS peak_ebitda, {_num0('most_recent_ebitda')} AS recent_ebitda
FROM screen_peaks JOIN symbol_dim USING (universe, stock_symbol) JOIN balance USING (universe, stock_symbol)
JOIN income USING (universe, stock_symbol)"""

BLOCKS["screen_mid"] = """
SELECT *, current_price / nullif(highest_price, 0) - 1 AS price_change, highest_price * ps AS peak_company_value,
       current_price * rs AS recent_company_value, recent_ebitda / nullif(peak_ebitda, 0) - 1 AS ebitda_change,
       CASE WHEN peak_ebitda <= 0 THEN 0 ELSE peak_ebitda / nullif(ps, 0) END AS peak_eps,
       CASE WHEN recent_ebitda <= 0 THEN 0 ELSE recent_ebitda / nullif(rs, 0) END AS recent_eps FROM screen_base"""

BLOCKS["screen_full"] = """
SELECT *, recent_company_value / nullif(peak_company_value, 0) - 1 AS company_value_change,
       peak_company_value / nullif(peak_ebitda * 4, 0) AS peak_ps, recent_company_value / nullif(recent_ebitda * 4, 0) AS recent_ps,
       recent_eps / nullif(peak_eps, 0) - 1 AS eps_change, highest_price / nullif(peak_eps, 0) AS peak_pe,
       current_price / nullif(recent_eps, 0) AS recent_pe FROM screen_mid"""

# ---- filings ----------------------------------------------------------------

_KIND = "CASE WHEN doc_id % 10 < 3 THEN '10-K' ELSE '10-Q' END"


def _head(item):
    return (f"CASE doc_id % 7 WHEN 1 THEN '<p>Item&nbsp;{item}.' WHEN 2 THEN '<p>ITEM {item}.' "
            f"WHEN 5 THEN '<p>Item&#160;{item}' ELSE '<p>Item {item}.' END")


_TOC = "<p>Item 1A. 1</p><p>Item 1B. 2</p><p>Item 2. 3</p><p>Item 7. 4</p><p>Item 7A. 5</p>"

BLOCKS["submissions"] = f"""
SELECT doc_id, 'sec-edgar-filings/' || printf('%010d', doc_id % 50 + 10000) || '/' || {_KIND} || '/' ||
       printf('%010d-01-%06d', doc_id, doc_id % 1000000) || '/full-submission.txt' AS path,
       {_KIND} AS filing_type,
       '\n<TYPE>' || {_KIND} || '\n<TEXT>\n' || CASE WHEN doc_id % 7 = 0 THEN '{_TOC}' ELSE '' END ||
       {_head('1A')} || ' Risk factors</p><div>' || text || '</div>' ||
       CASE WHEN doc_id % 7 = 3 THEN '' ELSE {_head('1B')} || ' Unresolved comments</p>' END ||
       {_head('2')} || ' Properties</p>' || {_head('7')} || ' Discussion of ' || source || '</p><!-- note --><b>' || text ||
       '</b>&amp;' || {_head('7A')} || ' Market risk</p>' || {_head('8')} || ' Statements</p>' || '\n</TEXT>\n' AS doc
FROM documents"""
BLOCKS["submissions"] = BLOCKS["submissions"].replace("'\n", "E'\\n").replace("\n<TEXT>\n'", "\\n<TEXT>\\n'")


def _last(item):
    tail = "(?:[^A]|$)" if item == "7" else ""
    pattern = f"^(.*)(?:>Item(?: |&#160;|&nbsp;){item}|ITEM {item}){tail}"
    return (f"CASE WHEN regexp_matches(doc, '{pattern}', 's') "
            f"THEN length(regexp_extract(doc, '{pattern}', 1, 's')) END")


BLOCKS["headings"] = "SELECT *, " + ", ".join(f"{_last(i)} AS i{i.lower()}" for i in ("1A", "1B", "2", "7", "7A")) + " FROM submissions"


def _slice(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN substr(doc, {a} + 1, greatest({b} - {a}, 0)) END"


#: What the pages of the HTML query end with, so that references of every kind occur.
REFERENCES = (
    "<p>caf&eacute; &copy; &#167; &#x2019; &euro; &sect; &trade; &#8482; &reg; &para; &deg; &plusmn; &frac12; &times; &divide; &micro; "
    "&laquo;&raquo; &aacute;&Aacute;&ntilde;&Ntilde;&uuml;&Uuml;&szlig;&ccedil;&oslash;&aring; &alpha;&Omega;&pi; &larr;&rarr; &infin; "
    "&ne;&le;&ge; &#x1F600; &#128512; &#150; &#0; &hellip; &bull; &dagger; &permil; &lsaquo; &nbsp;&ensp; &amp;lt; &amp;#65; &copy2001 "
    "&ampx; &unknown; &; &# &#x; &notit; &there4; &bne;</p>")


def _decoded(c):
    """References decoded piece by piece: the text is cut at every ampersand and each piece looked up."""
    from html.entities import html5

    pairs = {k: v for k, v in html5.items()}
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs.items()) + "}"
    old = {128 + i: ch for i, ch in enumerate("€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ")}
    west = "MAP {" + ", ".join(f"{k}: {quoted(v)}" for k, v in old.items()) + "}"
    bare = "|".join(sorted((k for k in pairs if not k.endswith(";")), key=len, reverse=True))
    number = ("(CASE WHEN regexp_matches(p, '^#[0-9]') THEN TRY_CAST(regexp_extract(p, '^#([0-9]+)', 1) AS BIGINT) "
              "ELSE TRY_CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS BIGINT) END)")
    text = (f"CASE WHEN {number} = 0 OR {number} > 1114111 THEN chr(65533) WHEN {number} BETWEEN 128 AND 159 THEN {west}[{number}] "
            f"ELSE chr({number}::INTEGER) END")
    piece = (
        f"CASE WHEN regexp_matches(p, '^#([0-9]|[xX][0-9a-fA-F])') THEN {text} || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') "
        f"WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9]*;') AND {table}[regexp_extract(p, '^[A-Za-z0-9]+;')] IS NOT NULL "
        f"THEN {table}[regexp_extract(p, '^[A-Za-z0-9]+;')] || regexp_replace(p, '^[A-Za-z0-9]+;', '') "
        f"WHEN regexp_matches(p, '^({bare})') THEN {table}[regexp_extract(p, '^({bare})')] || regexp_replace(p, '^({bare})', '') "
        f"ELSE '&' || p END")
    parts = f"string_split({c}, '&')"
    return f"({parts})[1] || array_to_string(list_transform(({parts})[2:], lambda p: {piece}), '')"


def html_text(c):
    markup = "<!--.*?-->|<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>|<[a-z/!?][^>]*>"
    out = f"regexp_replace({c}, '{markup}', chr(1), 'gsi')"
    out = f"regexp_replace({out}, '<[A-Za-z/!?][^>]*$', '', 'g')"
    out = f"regexp_replace({out}, '^\\x01+|\\x01+$', '', 'g')"
    out = f"regexp_replace({out}, '\\x01+', chr(10) || chr(10), 'g')"
    return _decoded(out)


BLOCKS["sections"] = f"""
SELECT doc_id, path, filing_type,
       {html_text(_slice('i1a', "(CASE WHEN filing_type = '10-K' THEN i1b ELSE i2 END)"))} AS risk_factors,
       CASE WHEN filing_type = '10-K' THEN {html_text(_slice('i7', 'i7a'))} END AS risk_disclosures
FROM headings"""

# ---- recommendation shapes ---------------------------------------------------

_GUESS = ("week_close_price * (1 + CAST((datediff('day', DATE '1995-01-02', week_opening_date) // 7 * 7 "
          "+ CAST(substr(stock_symbol, 2, 6) AS BIGINT)) % 21 - 10 AS DOUBLE) / 100.0)")

BLOCKS["recs"] = f"""
SELECT week_opening_date AS previous_weekly_open_date, week_close_price AS previous_weekly_close_price,
       {_GUESS} AS predicted_weekly_close_price, stock_symbol, 'license' AS keyword FROM weekly"""

BLOCKS["allocation"] = f"""
SELECT *, g / sum(g) OVER (PARTITION BY previous_weekly_open_date) AS share FROM (
  SELECT *, predicted_weekly_close_price / previous_weekly_close_price - 1 AS g FROM recs)
WHERE predicted_weekly_close_price > previous_weekly_close_price AND previous_weekly_open_date >= DATE '{AS_OF}' - 9
  AND keyword <> 'hack' AND stock_symbol NOT IN ('SBNY') AND g > 0.05"""

BLOCKS["calendar"] = """
SELECT week_opening_date, lead(week_opening_date) OVER (ORDER BY week_opening_date) AS next_week
FROM (SELECT DISTINCT week_opening_date FROM weekly)"""

BLOCKS["trades"] = f"""
SELECT 'linear' AS model_type, c.next_week AS week_to_buy, p.stock_symbol, 'license' AS keyword, 2 AS time_delay,
       '10-K' AS filing_type, p.current_close_price, p.predicted_price,
       p.predicted_price / p.current_close_price - 1 AS predicted_change,
       CASE WHEN p.current_close_price < p.predicted_price THEN 'buy recommended' ELSE 'dont buy' END AS recommendation,
       w.week_open_price AS buy_open_price, w.week_close_price AS buy_close_price
FROM (SELECT stock_symbol, week_opening_date, week_close_price AS current_close_price, {_GUESS} AS predicted_price FROM weekly) p
JOIN calendar c ON p.week_opening_date = c.week_opening_date
JOIN weekly w ON w.week_opening_date = c.next_week AND w.stock_symbol = p.stock_symbol"""

BLOCKS["curve"] = """
SELECT model_type, week_of_purchases, weekly_return,
       1000 * product(1 + weekly_return) OVER (PARTITION BY model_type ORDER BY week_of_purchases) AS portfolio_value
FROM (SELECT model_type, week_to_buy AS week_of_purchases,
             coalesce(sum(predicted_change * ((buy_close_price - 0.03) - (buy_open_price + 0.03)) / (buy_open_price + 0.03))
                        FILTER (WHERE n <= 5 AND recommendation = 'buy recommended')
                      / sum(predicted_change) FILTER (WHERE n <= 5 AND recommendation = 'buy recommended'), 0) AS weekly_return
      FROM (SELECT *, row_number() OVER (PARTITION BY model_type, week_to_buy, recommendation
                 ORDER BY predicted_change DESC, stock_symbol, keyword, filing_type, time_delay) AS n FROM trades)
      GROUP BY 1, 2)"""

BLOCKS["chain_trades"] = f"""
SELECT 'linear' AS model_type, c.next_week AS week_to_buy, p.stock_symbol, p.keyword, p.time_delay, p.filing_type,
       p.current_close_price, p.predicted_price, p.predicted_price / p.current_close_price - 1 AS predicted_change,
       CASE WHEN p.current_close_price < p.predicted_price THEN 'buy recommended' ELSE 'dont buy' END AS recommendation,
       w.week_open_price AS buy_open_price, w.week_close_price AS buy_close_price
FROM (SELECT *, {_PRED} AS predicted_price FROM shifted_pairs_score JOIN shifted_pairs_models USING ({_PAIR})) p
JOIN calendar c ON p.end_date = c.week_opening_date
JOIN weekly w ON w.week_opening_date = c.next_week AND w.stock_symbol = p.stock_symbol"""
BLOCKS["chain_curve"] = BLOCKS["curve"].replace("FROM trades)", "FROM chain_trades)")

BLOCKS["chain_recs"] = f"""
SELECT * REPLACE (CAST(previous_weekly_open_date AS DATE) AS previous_weekly_open_date) FROM ({_recommend('fixed_pairs')})"""
BLOCKS["chain_allocation"] = BLOCKS["allocation"].replace("FROM recs)", "FROM chain_recs)")

# ---- putting twins together -----------------------------------------------------

NEEDS = {
    "index_prices": ["prices"], "weekly": ["prices"], "counts": ["filings", "kw"],
    "lagged": ["weekly", "lags", "counts"], "starts": ["prices"], "rolled": ["lagged", "starts"], "grid": ["rolled"],
    "across": ["lagged"], "across_ranked": ["across"], "ends": ["weekly"], "backfill": ["rolled", "ends"], "grid_ranked": ["grid"], "backfill_ranked": ["backfill"],
    "grid_scores": ["grid_ranked"], "backfill_scores": ["backfill_ranked"], "eligible": ["grid_scores"],
    "top_pairs": ["eligible"], "dated_eligible": ["backfill_scores"], "dated_pool": ["dated_eligible"],
    "dated_pairs": ["dated_pool"], "shifted_pairs": ["dated_pairs"], "peaks": ["prices"], "screen_peaks": ["prices"],
    "first_after": ["reports", "peaks"], "latest_report": ["reports"],
    "income": ["peaks", "first_after", "latest_report"], "balance": ["peaks", "first_after", "latest_report"],
    "screen_base": ["screen_peaks", "symbol_dim", "balance", "income"], "screen_mid": ["screen_base"],
    "screen_full": ["screen_mid"], "headings": ["submissions"], "sections": ["headings"], "recs": ["weekly"],
    "allocation": ["recs"], "calendar": ["weekly"], "trades": ["weekly", "calendar"], "curve": ["trades"],
    "chain_trades": ["shifted_pairs_models", "shifted_pairs_score", "calendar"], "chain_curve": ["chain_trades"],
    "chain_recs": ["fixed_pairs_models", "fixed_pairs_score", "fixed_pairs_latest"], "chain_allocation": ["chain_recs"],
}
#: Blocks the engine should compute once although several parts read them.
HEAVY = {"prices", "weekly", "counts", "lagged", "grid", "backfill", "grid_ranked", "backfill_ranked"}

BLOCKS["long_pairs"] = "SELECT printf('S%06d', s_suppkey) AS stock_symbol, 'ion' AS keyword, '10-Q' AS filing_type, " \
    "26 AS time_delay, DATE '1998-01-05' AS start_date, DATE '2001-10-29' AS end_date FROM supplier"

for _pairs, _cut in (("fixed_pairs", "filing"), ("long_pairs", "filing"), ("top_pairs", "filing"), ("shifted_pairs", "end_date")):
    _previous = [_pairs, "weekly", "counts"]
    for _name, _sql in _training_blocks(_pairs, _cut):
        BLOCKS[_name], NEEDS[_name] = _sql, list(_previous)
        _previous.append(_name)
    if _cut == "filing":
        BLOCKS[f"{_pairs}_latest"], NEEDS[f"{_pairs}_latest"] = _latest(_pairs), [_pairs, "weekly", "counts", "prices"]


BLOCKS["late_pairs"] = "SELECT * REPLACE (CAST(end_date + CAST(CAST(substr(stock_symbol, 2, 6) AS INTEGER) % 7 AS INTEGER) AS DATE) AS end_date) FROM fixed_pairs"
NEEDS["late_pairs"] = ["fixed_pairs"]
BLOCKS["late_pairs_latest"] = _latest("late_pairs", "ASOF JOIN prices x ON x.stock_symbol = q.stock_symbol AND q.end_date >= x.created_at")
NEEDS["late_pairs_latest"] = ["late_pairs", "weekly", "counts", "prices"]


def _order(names, seen=None):
    seen = [] if seen is None else seen
    for n in names:
        if n not in seen:
            _order(NEEDS.get(n, []), seen)
            if n not in seen:
                seen.append(n)
    return seen


def twin(needs, select):
    names = _order(needs)
    parts = [f"{n} AS {'MATERIALIZED ' if n in HEAVY else ''}({BLOCKS[n].strip()})" for n in names]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + select.strip()


def _dates(*names):
    return ", ".join(f"{day(n)} AS {n}" for n in names)


def _pair_out():
    return (f"stock_symbol, keyword, filing_type, CAST(time_delay AS BIGINT) AS time_delay, {_dates('start_date', 'end_date')}")


ORACLES = {}
O = ORACLES
O["weekly_prices"] = twin(["weekly"], f"SELECT stock_symbol, {_dates('week_opening_date')}, week_open_price, week_close_price FROM weekly")
O["keyword_weekly_counts_long"] = twin(["filings"], f"""
SELECT {day("CAST(date_trunc('week', filing_date) AS DATE)")} AS filing_week, filing_type, keyword,
       count(*) FILTER (contains(lower(risk_factors), lower(keyword)) OR contains(lower(risk_disclosures), lower(keyword))) AS keyword_mentions,
       count(*) AS total_filings
FROM filings CROSS JOIN (SELECT DISTINCT keyword FROM (VALUES {_values(LONG_KEYWORDS)}) t(keyword)) GROUP BY 1, 2, 3""")
O["keyword_weekly_counts"] = twin(["counts"], f"SELECT {_dates('filing_week')}, filing_type, keyword, keyword_mentions, total_filings FROM counts")
O["keyword_occurrences"] = twin(["filings", "kw"], """
SELECT keyword, CAST(sum(n) AS BIGINT) AS keyword_count FROM (
  SELECT keyword, (length(risk_factors) - length(replace(risk_factors, keyword, ''))) // length(keyword) AS n
  FROM filings CROSS JOIN kw WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') WHERE n > 0 GROUP BY 1""")
_SER = "stock_symbol, keyword, filing_type, CAST(time_delay AS BIGINT) AS time_delay"
O["lagged_mentions"] = twin(["lagged"], f"SELECT {_SER}, {_dates('week_opening_date')}, week_close_price, round(mention_rate, 6) AS mention_rate FROM lagged")
O["rolling_mentions"] = twin(["lagged"], f"""
SELECT {_SER}, {_dates('week_opening_date')}, week_close_price, round(mention_rate, 6) AS mention_rate,
       round(avg(mention_rate) OVER (PARTITION BY stock_symbol, keyword, filing_type, time_delay
             ORDER BY week_opening_date ROWS 12 PRECEDING), 6) AS mention_rolling_avg FROM lagged""")
_SC = f"{_pair_out()}, round_even(correlation, 4) AS correlation"
O["topk_correlations"] = twin(["grid_ranked"], f"SELECT {_SC}, 'direct' AS direction FROM grid_ranked WHERE d <= 10")
O["topk_correlations_inverse"] = twin(["grid_ranked"], f"SELECT {_SC}, 'inverse' AS direction FROM grid_ranked WHERE i <= 10")
O["topk_correlations_backfill"] = twin(["backfill_ranked"], f"SELECT {_SC}, 'direct' AS direction FROM backfill_ranked WHERE d <= 10")
O["topk_correlations_across"] = twin(["across_ranked"], f"""
SELECT {_SC}, 'direct' AS direction FROM across_ranked WHERE d <= 10
UNION ALL SELECT {_SC}, 'inverse' FROM across_ranked WHERE i <= 10""")
O["month_starts"] = twin(["starts"], f"SELECT {_dates('start_date')} FROM starts")
O["week_calendar"] = twin(["weekly"], f"SELECT DISTINCT {_dates('week_opening_date')} FROM weekly WHERE week_opening_date BETWEEN DATE '1998-01-01' AND DATE '{AS_OF}'")

_sym, _cs, _ce, _ck, _cl = CHART


def _one_keyword(lag, where, partition):
    return f"""
SELECT *, row_number() OVER (PARTITION BY stock_symbol ORDER BY week_opening_date, filing_type) AS pos,
       avg(mention_rate) OVER ({partition} ORDER BY {'' if partition else 'stock_symbol, '}week_opening_date, filing_type ROWS 12 PRECEDING) AS rolling
FROM (SELECT stock_symbol, week_opening_date, week_close_price, filing_type, keyword, 1.0 * keyword_mentions / total_filings AS mention_rate
      FROM weekly JOIN counts ON week_opening_date = filing_week + {7 * lag}
      WHERE keyword = '{_ck}' AND week_opening_date BETWEEN DATE '{_cs}' AND DATE '{_ce}' AND {where})"""


_PS = "PARTITION BY stock_symbol"
O["pair_correlation"] = twin(["weekly", "counts"], f"""
SELECT stock_symbol, keyword, round_even({corr('week_close_price', 'rolling')}, 4) AS correlation
FROM ({_one_keyword(_cl, f"stock_symbol = '{_sym}'", _PS)}) WHERE pos > 6 GROUP BY 1, 2""")
for _name, _part, _dir in (("topk_keyword_correlations", _PS, "DESC"), ("topk_keyword_correlations_across", "", "ASC")):
    _type = "filing_type = '10-Q'"
    O[_name] = twin(["weekly", "counts"], f"""
SELECT stock_symbol, keyword, round_even(c, 4) AS correlation FROM (
  SELECT stock_symbol, keyword, round({corr('week_close_price', 'rolling')}, 12) AS c
  FROM ({_one_keyword(_cl, _type, _part)}) WHERE pos > 6 GROUP BY 1, 2)
WHERE c IS NOT NULL ORDER BY c {_dir}, stock_symbol LIMIT 10""")
_chart_where = f"stock_symbol = '{_sym}'"
_chart = f"""SELECT week_opening_date, stock_symbol, filing_type, keyword, round_even(week_close_price, 2) AS week_close_price,
       round_even(rolling, 4) AS mention_rolling_avg FROM ({_one_keyword(0, _chart_where, _PS)}) WHERE pos > 6"""
O["mention_chart"] = twin(["weekly", "counts"], f"SELECT * REPLACE ({day('week_opening_date')} AS week_opening_date) FROM ({_chart})")
O["mention_chart_return"] = twin(["weekly", "counts"], f"""
SELECT stock_symbol, first_close, last_close, round(last_close / first_close - 1, 6) AS stock_return FROM (
  SELECT stock_symbol, first(week_close_price ORDER BY week_opening_date, filing_type) AS first_close,
         last(week_close_price ORDER BY week_opening_date, filing_type) AS last_close FROM ({_chart}) GROUP BY 1)""")
O["comovement_rate"] = twin(["weekly", "counts"], f"""
SELECT stock_symbol, round(sum(CASE WHEN sm = km THEN 1 ELSE 0 END) / count(*), 6) AS comovement_rate FROM (
  SELECT c.stock_symbol,
    CASE WHEN c.week_close_price > p.week_close_price THEN 'up' WHEN c.week_close_price < p.week_close_price THEN 'down' ELSE 'same' END AS sm,
    CASE WHEN c.r > p.r THEN 'up' WHEN c.r < p.r THEN 'down' WHEN c.r = p.r THEN 'same' END AS km
  FROM (SELECT *, avg(mention_rate) OVER (PARTITION BY stock_symbol ORDER BY week_opening_date ROWS 12 PRECEDING) AS r
        FROM (SELECT *, lag(week_opening_date, {_cl}) OVER (PARTITION BY stock_symbol ORDER BY week_opening_date) AS lw
              FROM ({_one_keyword(_cl, "filing_type = '10-Q'", _PS)})) WHERE pos > 6) c
  JOIN (SELECT *, avg(mention_rate) OVER (PARTITION BY stock_symbol ORDER BY week_opening_date ROWS 12 PRECEDING) AS r
        FROM ({_one_keyword(_cl, "filing_type = '10-Q'", _PS)}) WHERE pos > 6) p
  ON p.stock_symbol = c.stock_symbol AND p.week_opening_date = c.lw) GROUP BY 1""")
O["top_pairs"] = twin(["top_pairs"], f"SELECT {_pair_out()}, correlation, direction FROM top_pairs")
O["top_pairs_by_end_date"] = twin(["dated_pairs"], f"SELECT {_pair_out()}, correlation, direction FROM dated_pairs")
O["top_pairs_today"] = twin(["top_pairs"], f"SELECT {_pair_out()}, printf('%.2f%%', round_even(correlation * 100, 2)) AS correlation, direction FROM top_pairs")
O["filing_weeks"] = twin(["fixed_pairs_filing"], f"SELECT {_pair_out()}, {_dates('filing_week')} FROM fixed_pairs_filing")
_ROWF = "CAST(current_week AS BIGINT) AS current_week, round(mention_rolling_avg, 6) AS mention_rolling_avg, current_close_price"
O["training_set"] = twin(["fixed_pairs_train"], f"SELECT {_pair_out()}, {_dates('week_opening_date')}, {_ROWF}, target_close_price, part FROM fixed_pairs_train")
O["training_set_lag_26"] = twin(["long_pairs_train"], f"SELECT {_pair_out()}, {_dates('week_opening_date')}, {_ROWF}, target_close_price, part FROM long_pairs_train")
O["scoring_set"] = twin(["fixed_pairs_score"], f"SELECT {_pair_out()}, {_dates('week_opening_date', 'prediction_date')}, {_ROWF}, target_close_price FROM fixed_pairs_score")
O["latest_features"] = twin(["fixed_pairs_latest"], f"SELECT {_pair_out()}, {_dates('week_opening_date')}, {_ROWF} FROM fixed_pairs_latest")
O["latest_features_asof"] = twin(["late_pairs_latest"], f"SELECT {_pair_out()}, {_dates('week_opening_date')}, {_ROWF} FROM late_pairs_latest")
O["fit_predict_linear"] = twin(["fixed_pairs_models", "fixed_pairs_score"], f"""
SELECT {_pair_out()}, {_dates('week_opening_date', 'prediction_date')}, target_close_price,
       CAST(current_week AS BIGINT) AS current_week, current_close_price, round({_PRED}, 2) AS predicted_price, 'ok' AS status
FROM fixed_pairs_score JOIN fixed_pairs_models USING ({_PAIR})""")


def _tree_predictions(pairs, trees=None, depth=None):
    """Predictions per pair: one unbounded tree, or bootstrap trees of a depth, grown in a recursive query."""
    names = ", ".join(f"x{i}" for i in range(3))
    features = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(_F))
    groups = f"SELECT *, row_number() OVER (ORDER BY {_PAIR}) AS g FROM (SELECT DISTINCT {_PAIR} FROM {pairs}_score)"
    train = f"""
SELECT g, row_number() OVER (PARTITION BY g ORDER BY {', '.join(_F)}, {_Y}, week_opening_date) - 1 AS r,
       count(*) OVER (PARTITION BY g) AS n, {features}, {_Y} AS y
FROM {pairs}_train JOIN tree_groups USING ({_PAIR}) WHERE part = 'train'"""
    if trees:
        draws = f"""
SELECT g, t, CAST('0x' || substr(md5(concat_ws('|', CAST(t AS VARCHAR), CAST(r AS VARCHAR), '12')), 1, 7) AS BIGINT) % n AS r, count(*) AS w
FROM tree_train, (SELECT unnest(range({trees})) AS t) GROUP BY ALL"""
        sample = f"SELECT g, t, r, w::DOUBLE AS w, {names}, y FROM tree_train JOIN ({draws}) USING (g, r)"
    else:
        sample = f"SELECT g, 0 AS t, r, 1.0::DOUBLE AS w, {names}, y FROM tree_train"
    cuts, over = [], "PARTITION BY g, t, node"
    for j in range(3):
        v = f"CASE WHEN w > 0 THEN x{j} END"
        cuts.append((f"""{v} AS v{j}, sum(w) OVER o{j} AS n{j}, sum(w * y) OVER o{j} AS s{j}, lead({v}) OVER l{j} AS next{j}""",
                     f"""o{j} AS ({over} ORDER BY {v} NULLS LAST, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), l{j} AS ({over} ORDER BY {v} NULLS LAST, r)"""))
    gain = lambda j: (f"CASE WHEN next{j} > v{j} AND hi > lo THEN round(n{j} * (n - n{j}) * pow(s{j} / n{j} - (s - s{j}) / (n - n{j}), 2) "  # noqa: E731
                      f"/ (n * n * (hi - lo) * (hi - lo)), 10) END")
    tops = ", ".join(f"max(g{j}) OVER node AS top{j}" for j in range(3))
    firsts = ", ".join(f"min(CASE WHEN g{j} = top{j} THEN CASE WHEN (v{j} + next{j}) / 2 < next{j} THEN (v{j} + next{j}) / 2 ELSE v{j} END END) OVER node AS cut{j}" for j in range(3))
    best = "greatest(top0, top1, top2)"
    low = f"CASE WHEN top0 = {best} THEN x0 <= cut0 WHEN top1 = {best} THEN x1 <= cut1 ELSE x2 <= cut2 END"
    leaf = f"{best} IS NULL" + (f" OR level >= {depth}" if depth is not None else "")
    grown = f"""
SELECT g, t, r, w, {names}, y, level + 1 AS level, CASE WHEN leaf THEN node WHEN low THEN node || '0' ELSE node || '1' END AS node,
       CASE WHEN leaf THEN s / n END AS predicted
FROM (SELECT *, max(w = 0 AND low) OVER node AS low_asked, max(w = 0 AND NOT low) OVER node AS high_asked
      FROM (SELECT *, {leaf} AS leaf, {low} AS low
            FROM (SELECT *, {firsts} FROM (SELECT *, {tops} FROM (SELECT *, {', '.join(f'{gain(j)} AS g{j}' for j in range(3))}
                  FROM (SELECT *, sum(w) OVER node AS n, sum(w * y) OVER node AS s, min(CASE WHEN w > 0 THEN y END) OVER node AS lo,
                               max(CASE WHEN w > 0 THEN y END) OVER node AS hi, {', '.join(c for c, _ in cuts)}
                        FROM tree_nodes WHERE predicted IS NULL WINDOW node AS ({over}), {', '.join(w for _, w in cuts)}))
                  WINDOW node AS ({over})) WINDOW node AS ({over})))
      WINDOW node AS ({over}))
WHERE w = 0 OR (NOT leaf AND CASE WHEN low THEN low_asked ELSE high_asked END)"""
    every = "CROSS JOIN (SELECT unnest(range(%d)) AS t)" % (trees or 1)
    start = f"""
SELECT g, t, r, w, {names}, y, 0 AS level, '' AS node, CAST(NULL AS DOUBLE) AS predicted FROM ({sample})
UNION ALL SELECT g, t, -1, 0.0, {names}, NULL, 0, '', NULL
FROM (SELECT g, {features} FROM {pairs}_score JOIN tree_groups USING ({_PAIR})) {every}
WHERE g IN (SELECT g FROM tree_train)"""
    return [("tree_groups", groups), ("tree_train", train), ("tree_nodes", f"({start}) UNION ALL ({grown})"),
            ("tree_predictions", f"SELECT {_PAIR}, avg(predicted) AS predicted_price FROM tree_nodes JOIN tree_groups USING (g) WHERE predicted IS NOT NULL GROUP BY ALL")]


def _tree_twin(pairs, trees, depth, select):
    blocks = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ('tree_groups', 'tree_train') else ''}({sql.strip()})" for n, sql in _tree_predictions(pairs, trees, depth))
    return twin([f"{pairs}_train", f"{pairs}_score"], f", {blocks}\n{select}").replace("WITH ", "WITH RECURSIVE ", 1).replace(")\n, tree_groups", "), tree_groups")


_TREE_STATUS = "CASE WHEN predicted_price IS NULL THEN 'too_few_rows' ELSE 'ok' END"
for _model, _trees, _depth in (("decision_tree", None, None), ("random_forest", 200, 20)):
    O[f"fit_predict_{_model}"] = _tree_twin("fixed_pairs", _trees, _depth, f"""
SELECT {_pair_out()}, {_dates('week_opening_date', 'prediction_date')}, target_close_price,
       CAST(current_week AS BIGINT) AS current_week, current_close_price, round(predicted_price, 6) AS predicted_price, {_TREE_STATUS} AS status
FROM fixed_pairs_score LEFT JOIN tree_predictions USING ({_PAIR})""")
    O[f"backtest_predictions_{_model}"] = _tree_twin("shifted_pairs", _trees, _depth, f"""
SELECT '{_model}' AS model_type, CAST(current_week AS BIGINT) AS current_week, {_dates('prediction_date', 'week_opening_date')},
       current_close_price, target_close_price AS next_week_close_price, round(predicted_price, 6) AS predicted_price,
       stock_symbol, keyword, {_dates('start_date')},
       {day("CAST(end_date + CAST(5 - isodow(end_date) - CASE WHEN isodow(end_date) = 5 THEN 0 ELSE 7 END AS INTEGER) AS DATE)")} AS friday_end_date,
       {day('end_date')} AS monday_end_date, CAST(time_delay AS BIGINT) AS time_delay, filing_type, {_TREE_STATUS} AS status
FROM shifted_pairs_score LEFT JOIN tree_predictions USING ({_PAIR})""")
O["holdout_error"] = twin(["fixed_pairs_models", "fixed_pairs_train"], f"""
SELECT {_pair_out()}, round(avg(abs(target_close_price - ({_PRED}))), 2) AS mae, count(*) AS n_test
FROM fixed_pairs_train JOIN fixed_pairs_models USING ({_PAIR}) WHERE part = 'test' GROUP BY {_PAIR}""")
O["buy_recommendations"] = twin(["top_pairs_models", "top_pairs_score", "top_pairs_latest"], _recommend("top_pairs"))
O["buy_recommendations_all_symbols"] = twin(["fixed_pairs_models", "fixed_pairs_score", "fixed_pairs_latest"], _recommend("fixed_pairs"))


def _walk_forward():
    rows = f"""
SELECT w.*, (row_number() OVER (PARTITION BY {_PAIR} ORDER BY week_opening_date) > 3
       AND CAST('0x' || substr(md5(concat_ws('|', stock_symbol, keyword, filing_type, CAST(time_delay AS VARCHAR),
             CAST(start_date AS VARCHAR), CAST(week_opening_date AS VARCHAR), '12')), 1, 4) AS BIGINT) % 10 <> 0) AS use
FROM fixed_pairs_weeks w"""
    key = "stock_symbol, keyword, filing_type, time_delay, start_date, end_date, score_week"
    names = [*_F, _Y]
    agg = [f"avg({c}) AS m_{c}" for c in names] + [f"stddev_pop({c}) AS s_{c}" for c in names]
    agg += [f"covar_pop({a}, {b}) AS c_{a}__{b}" for i, a in enumerate(_F) for b in names[i + 1:]]
    pairs = f"""
SELECT s.stock_symbol, s.keyword, s.filing_type, s.time_delay, s.start_date, s.end_date, s.week_opening_date AS score_week,
       {', '.join('t.' + c for c in names)}
FROM rows s JOIN rows t USING ({_PAIR})
WHERE s.week_opening_date >= DATE '{VALIDATE_FROM}' AND t.use AND t.week_opening_date < s.week_opening_date"""
    models = _solved(f"SELECT {key}, count({_Y}) AS n_train, {', '.join(agg)} FROM ({pairs}) GROUP BY ALL", key)
    return twin(["fixed_pairs_weeks"], f""", rows AS MATERIALIZED ({rows}), models AS ({models})
SELECT {_pair_out()}, {day('week_opening_date')} AS filing_week,
       {day('CAST(week_opening_date + 7 * time_delay AS DATE)')} AS week_opening_date,
       CAST(current_week AS BIGINT) AS current_week, current_close_price, target_close_price AS next_week_close_price,
       round({_PRED}, 2) AS predicted_price, n_train, 'ok' AS status
FROM rows r JOIN models m USING ({_PAIR}) WHERE m.score_week = r.week_opening_date""").replace(")\n, rows AS", "), rows AS")


O["walk_forward_validation"] = _walk_forward()
O["prediction_accuracy"] = twin(["weekly"], f"""
SELECT stock_symbol, {day('prediction_date')} AS prediction_date, round_even(later - cur, 2) AS actual_price_change,
       round_even(guess - cur, 2) AS predicted_price_change,
       CASE WHEN later IS NULL THEN 'no price comparison'
            WHEN sign(later - cur) = sign(guess - cur) THEN 'correct prediction' ELSE 'incorrect prediction' END AS prediction_validation,
       CASE WHEN later - cur <> 0 THEN round_even(((later - cur) - (guess - cur)) / cur, 4) END AS actual_prediction_percentage_delta
FROM (SELECT a.stock_symbol, CAST(a.week_opening_date + 7 AS DATE) AS prediction_date, a.week_close_price AS cur,
             b.week_close_price AS later, {_GUESS.replace('week_close_price', 'a.week_close_price').replace('week_opening_date', 'a.week_opening_date').replace('stock_symbol', 'a.stock_symbol')} AS guess
      FROM weekly a LEFT JOIN weekly b ON a.stock_symbol = b.stock_symbol AND b.week_opening_date = a.week_opening_date + 7)""")
O["buy_allocation"] = twin(["allocation"], f"""
SELECT {day('CAST(previous_weekly_open_date + 7 AS DATE)')} AS buy_date, stock_symbol, keyword, previous_weekly_close_price,
       round(predicted_weekly_close_price, 6) AS predicted_weekly_close_price, round(g, 6) AS predicted_growth,
       round_even(1000 * share / previous_weekly_close_price, 2) AS number_of_shares_to_purchase,
       CAST(1000 AS DOUBLE) AS principal_amount FROM allocation""")
O["last_week_returns"] = twin(["allocation", "weekly"], """
SELECT round(gain, 4) AS gain, round(gain / 1000, 4) AS performance FROM (
  SELECT coalesce(sum(round_even(1000 * share / previous_weekly_close_price, 2) * (week_close_price - week_open_price)), 0) AS gain
  FROM allocation a JOIN weekly w ON a.stock_symbol = w.stock_symbol AND a.previous_weekly_open_date = w.week_opening_date)""")
O["allocation_chain"] = O["buy_allocation"].replace("FROM allocation", "FROM chain_allocation")
O["allocation_chain"] = twin(["chain_allocation"], O["allocation_chain"][O["allocation_chain"].rindex("\nSELECT") + 1:])
O["allocation_chain_returns"] = twin(["chain_allocation", "weekly"], O["last_week_returns"][O["last_week_returns"].rindex("\nSELECT round(gain") + 1:]
    .replace("FROM allocation a", "FROM chain_allocation a").replace(", 4)", ", 2)"))


def _dollars(c, digits=2):
    return f"'$' || format('{{:,.{digits}f}}', {c})"


O["buy_allocation_display"] = twin(["allocation"], f"""
SELECT {day('CAST(previous_weekly_open_date + 7 AS DATE)')} AS buy_date, stock_symbol, keyword,
       {_dollars('previous_weekly_close_price')} AS previous_weekly_close_price, {_dollars('predicted_weekly_close_price')} AS predicted_weekly_close_price,
       printf('%.0f%%', round_even(g * 100, 0)) AS predicted_growth,
       round_even(1000 * share / previous_weekly_close_price, 2) AS number_of_shares_to_purchase, '$1,000.00' AS principal_amount FROM allocation""")
O["backtest_trades_display"] = twin(["trades"], f"""
SELECT {day('week_to_buy')} AS week_to_buy, stock_symbol, keyword, printf('$%.2f', round_even(current_close_price, 2)) AS close_price,
       printf('$%.2f', round_even(predicted_price, 2)) AS predicted_price, printf('%.0f%%', round_even(predicted_change * 100, 0)) AS predicted_change,
       recommendation, printf('$%.2f', round_even(buy_open_price, 2)) AS purchase_price, printf('$%.2f', round_even(buy_close_price, 2)) AS sale_price
FROM trades""")
O["buy_date"] = twin(["recs"], f"SELECT {day('CAST(max(previous_weekly_open_date) + 7 AS DATE)')} AS buy_date FROM recs")
O["backtest_trades"] = twin(["trades"], f"""
SELECT * REPLACE ({day('week_to_buy')} AS week_to_buy, CAST(time_delay AS BIGINT) AS time_delay,
       round(predicted_price, 6) AS predicted_price, round(predicted_change, 6) AS predicted_change) FROM trades""")
O["backtest_curve"] = twin(["curve"], f"""
SELECT model_type, {_dates('week_of_purchases')}, round(weekly_return, 6) AS weekly_return,
       round(log10(portfolio_value), 6) AS portfolio_log10 FROM curve""")
O["backtest_chain_trades"] = twin(["chain_trades"], f"""
SELECT * REPLACE ({day('week_to_buy')} AS week_to_buy, CAST(time_delay AS BIGINT) AS time_delay,
       round(predicted_price, 2) AS predicted_price, round(predicted_change, 4) AS predicted_change) FROM chain_trades""")
O["backtest_chain_curve"] = twin(["chain_curve"], f"""
SELECT model_type, {_dates('week_of_purchases')}, round(weekly_return, 4) AS weekly_return,
       round(portfolio_value, 2) AS portfolio_value FROM chain_curve""")
O["backtest_predictions"] = twin(["shifted_pairs_models", "shifted_pairs_score"], f"""
SELECT 'linear' AS model_type, CAST(current_week AS BIGINT) AS current_week, {_dates('prediction_date', 'week_opening_date')},
       current_close_price, target_close_price AS next_week_close_price, round({_PRED}, 2) AS predicted_price,
       stock_symbol, keyword, {_dates('start_date')},
       {day("CAST(end_date + CAST(5 - isodow(end_date) - CASE WHEN isodow(end_date) = 5 THEN 0 ELSE 7 END AS INTEGER) AS DATE)")} AS friday_end_date,
       {day('end_date')} AS monday_end_date, CAST(time_delay AS BIGINT) AS time_delay, filing_type, {_UNFITTED} AS status
FROM shifted_pairs_score LEFT JOIN shifted_pairs_models USING ({_PAIR}) LEFT JOIN {_trained('shifted_pairs')} USING ({_PAIR})""")
O["returns_vs_index"] = twin(["curve", "index_prices"], f"""
SELECT model_type, {day('f')} AS first_week, {day('l')} AS last_week, round(il / ix - 1, 6) AS index_return,
       round(log10(pl / pf), 6) AS backtest_log10, round_even((m * 52 - 0.04) / (s * sqrt(52)), 3) AS sharpe_ratio
FROM (SELECT model_type, min(week_of_purchases) AS f, max(week_of_purchases) AS l, arg_min(portfolio_value, week_of_purchases) AS pf,
             arg_max(portfolio_value, week_of_purchases) AS pl, avg(lr) AS m, stddev_samp(lr) AS s
      FROM (SELECT *, ln(portfolio_value / lag(portfolio_value) OVER (PARTITION BY model_type ORDER BY week_of_purchases)) AS lr FROM curve)
      GROUP BY 1)
CROSS JOIN (SELECT arg_min(close_price, created_at) AS ix, arg_max(close_price, created_at) AS il FROM index_prices
            WHERE created_at BETWEEN (SELECT min(week_of_purchases) FROM curve) AND (SELECT max(week_of_purchases) FROM curve))""")
O["backtest_chain_returns_vs_index"] = twin(["chain_curve", "index_prices"], O["returns_vs_index"][O["returns_vs_index"].rindex("\nSELECT model_type") + 1:]
    .replace("FROM curve", "FROM chain_curve").replace("round(il / ix - 1, 6)", "round(il / ix - 1, 4)")
    .replace("round(log10(pl / pf), 6) AS backtest_log10", "round(pl / pf - 1, 4) AS backtest_return")
    .replace("round_even((m * 52 - 0.04) / (s * sqrt(52)), 3)", "round(round_even((m * 52 - 0.04) / (s * sqrt(52)), 3), 2)"))
O["curve_with_index"] = twin(["curve", "index_prices"], f"""
SELECT {_dates('week_of_purchases')}, model_type, round(weekly_return, 4) AS weekly_return,
       round(log10(portfolio_value), 6) AS portfolio_log10, close_price AS index_price FROM curve JOIN index_prices ON created_at = week_of_purchases""")
O["index_returns"] = twin(["index_prices"], """
SELECT round(a, 4) AS first_close, round(b, 4) AS last_close, round(b / a - 1, 4) AS index_return FROM (
  SELECT arg_min(close_price, created_at) AS a, arg_max(close_price, created_at) AS b FROM index_prices
  WHERE created_at BETWEEN DATE '1998-01-01' AND DATE '2000-12-31')""")
_SCREEN = ["price_change", "highest_price", "current_price", "cash_growth", "asset_growth", "company_value_change",
           "peak_company_value", "recent_company_value", "eps_change", "peak_eps", "recent_eps", "ps_change", "peak_ps",
           "recent_ps", "pe_change", "peak_pe", "recent_pe", "ebitda_change", "peak_ebitda", "recent_ebitda"]
BLOCKS["screen"] = "SELECT *, recent_ps / nullif(peak_ps, 0) - 1 AS ps_change, recent_pe / nullif(peak_pe, 0) - 1 AS pe_change FROM screen_full"
NEEDS["screen"] = ["screen_full"]
O["discount_screen"] = twin(["screen"], f"""
SELECT universe, sector, company_name, stock_symbol, CAST(days_since_peak AS BIGINT) AS days_since_peak, {_dates('peak_date')},
       {', '.join(f'round({c}, 4) AS {c}' for c in _SCREEN)} FROM screen""")
O["discount_screen_page"] = twin(["screen"], f"""
SELECT company_name, stock_symbol, round(price_change, 4) AS price_change, highest_price, current_price,
       CAST(days_since_peak AS BIGINT) AS days_since_peak, {day('peak_date')} AS peak_date, round(eps_change, 4) AS eps_change,
       round(peak_eps, 4) AS peak_eps, round(recent_eps, 4) AS recent_eps
FROM (SELECT * FROM screen WHERE price_change BETWEEN -0.9 AND -0.05 ORDER BY price_change, stock_symbol, universe LIMIT 100)""")
_SHOWN = {c: label for group in SCREEN_GROUPS.values() for c, label in group}


def _shown(c):
    if c.endswith(("_change", "_growth")):
        return f"printf('%.1f%%', round_even({c} * 100, 1))"
    if c in ("highest_price", "current_price", "peak_eps", "recent_eps"):
        return _dollars(c)
    if c in ("peak_company_value", "recent_company_value", "peak_ebitda", "recent_ebitda"):
        return _dollars(c, 0)
    if c in ("peak_ps", "recent_ps", "peak_pe", "recent_pe"):
        return f"round_even({c}, 0)"
    return day(c) if c == "peak_date" else f"CAST({c} AS BIGINT)" if c == "days_since_peak" else c


O["discount_screen_display"] = twin(["screen"], f"""
SELECT {', '.join(f'{_shown(c)} AS "{label}"' for c, label in _SHOWN.items())}, '% (e.g. .1 = 10%)' AS unit FROM screen""")
O["quarterly_series"] = twin(["reports"], f"""
SELECT universe, stock_symbol, {day('fiscal_date')} AS reporting_date, TRY_CAST(ebitda AS DOUBLE) AS quarterly_revenue
FROM (SELECT *, row_number() OVER (PARTITION BY universe, stock_symbol ORDER BY fiscal_date DESC) AS k FROM reports) WHERE k <= 20""")
O["filing_sections"] = twin(["sections"], "SELECT path, filing_type, risk_factors, risk_disclosures FROM sections")
O["filing_records"] = twin(["sections"], f"""
SELECT CASE WHEN s_suppkey IS NOT NULL THEN printf('S%06d', doc_id % 50) ELSE 'unknown' END AS company_name, filing_type,
       num AS filing_number,
       CASE WHEN ok THEN risk_factors END AS risk_factors, CASE WHEN ok THEN risk_disclosures END AS risk_disclosures,
       'https://www.sec.gov/Archives/edgar/data/' || replace(num, '-', '') || '/' || num || '-index.html' AS filing_url,
       CASE WHEN doc_id % 11 <> 0 THEN CAST(CAST(DATE '1995-01-02' + CAST(doc_id * 37 % 2499 AS INTEGER) AS DATE) AS VARCHAR) END AS filing_date
FROM (SELECT *, printf('%010d-01-%06d', doc_id, doc_id % 1000000) AS num,
             (filing_type = '10-Q' OR (risk_factors IS NOT NULL AND risk_disclosures IS NOT NULL)) AS ok FROM sections)
LEFT JOIN supplier ON s_suppkey = doc_id % 50""")
O["peak_earnings_asof"] = twin(["peaks", "first_after", "latest_report"], f"""
SELECT universe, stock_symbol, round_even(CAST(f.reported_eps AS DOUBLE), 2) AS peak_price_reported_eps,
       {day('f.fiscal_date')} AS peak_price_eps_date, CAST(l.reported_eps AS DOUBLE) AS most_recent_reported_eps,
       {day('l.fiscal_date')} AS most_recent_eps_date {_ASOF}""")
O["income_asof"] = twin(["income"], f"""
SELECT * REPLACE ({day('peak_price_ebitda_date')} AS peak_price_ebitda_date, {day('most_recent_ebitda_date')} AS most_recent_ebitda_date) FROM income""")
O["balance_asof"] = twin(["balance"], f"""
SELECT * REPLACE ({day('peak_price_report_date')} AS peak_price_report_date, {day('most_recent_report_date')} AS most_recent_report_date) FROM balance""")
O["sector_records"] = twin(["symbol_dim"], """
SELECT stock_symbol, sector, peratio, evtoebitda, TRY_CAST(peratio AS DOUBLE) AS pe_ratio,
       TRY_CAST(evtoebitda AS DOUBLE) AS ev_to_ebitda FROM symbol_dim WHERE universe <> 'sp'""")
O["index_membership_since"] = f"""
SELECT stock_symbol, {_dates('date_added', 'date_ended')} FROM (
  SELECT printf('S%06d', s_suppkey) AS stock_symbol, CAST(DATE '2018-01-01' + CAST(s_suppkey * 13 % 1500 AS INTEGER) AS DATE) AS date_added,
         CASE WHEN s_suppkey % 4 = 0 THEN CAST(DATE '2019-06-01' + CAST(s_suppkey * 7 % 900 AS INTEGER) AS DATE) END AS date_ended FROM supplier)
WHERE date_added >= DATE '2020-01-01' OR date_ended >= DATE '2020-01-01'"""
O["daily_prices_ingest"] = twin(["prices"], f"SELECT {_dates('created_at')}, open_price, close_price, stock_symbol FROM prices")
O["latest_volume"] = twin(["prices"], "SELECT DISTINCT stock_symbol, CAST(volume AS BIGINT) AS yesterday_trading_volume FROM prices")
O["sector_list"] = twin(["symbol_dim"], "SELECT DISTINCT sector FROM symbol_dim")
O["symbol_names"] = twin(["prices", "symbol_dim"], "SELECT DISTINCT universe, stock_symbol, company_name FROM prices JOIN symbol_dim USING (universe, stock_symbol)")
O["recent_closes"] = twin(["prices"], f"""
SELECT stock_symbol, close_price, {day('created_at')} AS close_date FROM prices
WHERE stock_symbol = '{REFERENCE_SYMBOL}' AND created_at BETWEEN DATE '1998-01-01' AND DATE '{AS_OF}'
ORDER BY created_at DESC LIMIT 30""")
O["lag_join"] = twin(["weekly", "counts"], f"""
SELECT {_dates('filing_week', 'week_opening_date')}, stock_symbol, week_close_price, CAST(n AS BIGINT) AS time_delay, keyword, filing_type, keyword_mentions
FROM weekly JOIN (VALUES (1), (2), (4), (8)) v(n) ON true JOIN counts ON week_opening_date = filing_week + 7 * n""")
O["shifted_self_join"] = twin(["weekly"], f"""
SELECT a.stock_symbol, {day('a.week_opening_date')} AS week_opening_date, a.week_close_price, b.week_close_price AS later_close
FROM weekly a JOIN weekly b ON a.stock_symbol = b.stock_symbol AND b.week_opening_date = a.week_opening_date + 28""")
O["interpolate"] = twin(["weekly"], f"""
, s AS (SELECT *, row_number() OVER (PARTITION BY stock_symbol ORDER BY week_opening_date) AS i,
               CASE WHEN weekofyear(week_opening_date) % 3 <> 0 THEN week_close_price END AS v FROM weekly),
p AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS li,
             first_value(v IGNORE NULLS) OVER a AS rv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ri
      FROM s WINDOW b AS (PARTITION BY stock_symbol ORDER BY week_opening_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS (PARTITION BY stock_symbol ORDER BY week_opening_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT stock_symbol, {_dates('week_opening_date')},
       round(CASE WHEN v IS NOT NULL THEN v WHEN rv IS NULL THEN lv ELSE lv + (rv - lv) / (ri - li) * (i - li) END, 4) AS value FROM p
""").replace(")\n,", "),")
O["rolling_across_symbols"] = twin(["lagged"], f"""
SELECT {_SER}, {_dates('week_opening_date')}, week_close_price, round(mention_rate, 6) AS mention_rate,
       round(avg(mention_rate) OVER (PARTITION BY keyword, filing_type, time_delay
             ORDER BY stock_symbol, week_opening_date ROWS 12 PRECEDING), 6) AS rolling
FROM lagged""")
O["lag_rows"] = twin(["weekly"], f"""
SELECT stock_symbol, {_dates('week_opening_date')},
       {day('lag(week_opening_date, 2) OVER (PARTITION BY stock_symbol ORDER BY week_opening_date)')} AS earlier_week FROM weekly""")
O["week_lead"] = twin(["calendar"], f"SELECT {_dates('week_opening_date', 'next_week')} FROM calendar")
O["asof_forward"] = twin(["peaks", "first_after", "latest_report"], f"""
SELECT universe, stock_symbol, {day('peak_date')} AS peak_date, {day('f.fiscal_date')} AS peak_fiscal_date, f.total_assets AS peak_total_assets,
       {day('l.fiscal_date')} AS latest_fiscal_date, l.total_assets AS latest_total_assets {_ASOF}""")
for _name, _sign, _tag, _cols in (("asof_next_report", "<", "next", ("total_assets", "ebitda")), ("asof_last_report", ">=", "last", ("total_assets",))):
    O[_name] = twin(["prices", "reports"], f"""
SELECT p.universe, p.stock_symbol, {day('p.created_at')} AS created_at, p.close_price, {day('r.fiscal_date')} AS {_tag}_fiscal_date,
       {', '.join(f'r.{c} AS {_tag}_{c}' for c in _cols)}
FROM prices p ASOF LEFT JOIN reports r ON p.universe = r.universe AND p.stock_symbol = r.stock_symbol AND p.created_at {_sign} r.fiscal_date""")
O["price_peaks"] = twin(["peaks"], f"""
SELECT universe, stock_symbol, highest_price, {_dates('peak_date')}, current_price, {day('current_date_')} AS "current_date" FROM peaks""")
O["distinct_on"] = twin(["prices"], f"""
SELECT DISTINCT ON (stock_symbol) stock_symbol, {_dates('created_at')}, volume FROM prices ORDER BY stock_symbol, volume DESC, prices.created_at""")
O["json_each"] = "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events"
O["union_universes"] = twin(["prices"], f"""
SELECT stock_symbol, {_dates('created_at')}, close_price, universe FROM prices WHERE universe = 'sp'
UNION ALL SELECT stock_symbol, {_dates('created_at')}, close_price, universe FROM prices WHERE universe = 'russell'""")
O["anti_universe"] = twin(["symbol_dim"], "SELECT stock_symbol, company_name FROM symbol_dim WHERE universe <> 'sp'")
O["format_money"] = """
SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS dollars, '$' || format('{:,.0f}', o_totalprice) AS whole_dollars,
       printf('$%.2f', round_even(o_totalprice, 2)) AS plain, printf('%.1f%%', round_even(o_totalprice / 500000 * 100, 1)) AS share FROM orders"""
O["date_alignment"] = f"""
SELECT o_orderkey, {day("CAST(date_trunc('week', d) AS DATE)")} AS week, {day("CAST(date_trunc('month', d) AS DATE)")} AS month,
       {day('CAST(d + CAST((8 - isodow(d)) % 7 AS INTEGER) AS DATE)')} AS next_monday,
       {day('CAST(d + CAST(5 - isodow(d) - CASE WHEN isodow(d) = 5 THEN 0 ELSE 7 END AS INTEGER) AS DATE)')} AS previous_friday,
       CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS packed, strftime(d, '%Y-%m-%d') AS iso
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
O["html_to_text"] = f"SELECT page_id, {html_text('html')} AS text FROM (SELECT page_id, html || '{REFERENCES}' AS html FROM pages)"
O["filing_dates"] = """
SELECT printf('%010d-01-%06d', doc_id, doc_id % 1000000) AS filing_number,
       CASE WHEN doc_id % 11 <> 0 THEN CAST(CAST(DATE '1995-01-02' + CAST(doc_id * 37 % 2499 AS INTEGER) AS DATE) AS VARCHAR) END AS filing_date
FROM documents"""
O["snapshot_on_tuesday"] = twin(["symbol_dim"], "SELECT DISTINCT sector, '2001-10-30' AS snapshot_date FROM symbol_dim")
O["series_range"] = twin(["weekly"], """
SELECT stock_symbol, round(min(week_close_price) - (max(week_close_price) - min(week_close_price)) * 0.1, 4) AS low,
       round(max(week_close_price) + (max(week_close_price) - min(week_close_price)) * 0.1, 4) AS high FROM weekly GROUP BY 1""")
O["symbol_ciks"] = twin(["submissions"], """
SELECT path, CAST(doc_id % 50 + 10000 AS VARCHAR) AS cik, filing_type, printf('%010d-01-%06d', doc_id, doc_id % 1000000) AS filing_number,
       CASE WHEN s_suppkey IS NOT NULL THEN printf('S%06d', doc_id % 50) ELSE 'unknown' END AS company_name
FROM submissions LEFT JOIN supplier ON s_suppkey = doc_id % 50""")
O["event_weeks"] = f"""
SELECT user_id, {day("CAST(date_trunc('week', ts) AS DATE)")} AS week_opening_date,
       round(first(value ORDER BY ts, value), 6) AS first_value, round(last(value ORDER BY ts, value), 6) AS last_value
FROM events GROUP BY user_id, date_trunc('week', ts)"""


# ---- landed files --------------------------------------------------------------

_TURN = "(CAST(substr(stock_symbol, 2, 6) AS BIGINT) * 31 + (created_at - DATE '1995-01-02')) % 50"
_NUM = "CAST(substr(stock_symbol, 2, 6) AS BIGINT)"
O["landed_prices"] = twin(["prices"], f"SELECT {_dates('created_at')}, open_price, close_price, stock_symbol FROM prices WHERE {_TURN} NOT IN (7, 11)")
O["landed_prices_rejects"] = twin(["prices"], f"""
SELECT stock_symbol AS "Symbol", CASE WHEN {_TURN} = 7 THEN CAST(created_at AS VARCHAR) END AS "Date",
       'no usable value: ' || CASE WHEN {_TURN} = 7 THEN 'Close' ELSE 'Date' END AS reason FROM prices WHERE {_TURN} IN (7, 11)""")
O["landed_income_reports"] = twin(["reports"], f"""
SELECT stock_symbol, {day('fiscal_date')} AS fiscal_date, ebitda FROM reports
WHERE {_NUM} % 10 <> 3 AND NOT ({_NUM} % 7 = 2 AND month(fiscal_date) = 3)""")
O["landed_income_rejects"] = twin(["reports"], f"""
SELECT reason, count(*) AS records, count(*) AS kept_texts FROM (
  SELECT 'unreadable' AS reason FROM (SELECT DISTINCT stock_symbol FROM reports) WHERE {_NUM} % 10 = 3
  UNION ALL SELECT 'no usable value: fiscal_date' FROM reports WHERE {_NUM} % 10 <> 3 AND {_NUM} % 7 = 2 AND month(fiscal_date) = 3) GROUP BY reason""")
O["landed_symbol_ciks"] = """
SELECT CAST(s_suppkey + 10000 AS VARCHAR) AS cik, printf('S%06d', s_suppkey) AS company_name FROM supplier
WHERE s_nationkey % 5 <> 3 AND s_suppkey % 9 <> 4"""
O["landed_symbol_ciks_rejects"] = """
SELECT reason, count(*) AS records FROM (
  SELECT 'unreadable' AS reason FROM (SELECT DISTINCT s_nationkey FROM supplier) WHERE s_nationkey % 5 = 3
  UNION ALL SELECT 'no usable value: cik' FROM supplier WHERE s_nationkey % 5 <> 3 AND s_suppkey % 9 = 4) GROUP BY reason"""
O["append_twice"] = O["refresh_weekly_prices"] = O["weekly_prices"]
O["refresh_keyword_counts"] = O["keyword_weekly_counts"]
O["replace_table"] = "SELECT printf('S%06d', s_suppkey) AS stock_symbol, s_name AS company_name FROM supplier"
