"""SQL text that oracles share: the panel of bars, written for DuckDB independently of the Spark plans."""

BARS = """b AS (SELECT CAST(l_shipdate AS DATE) AS date, concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS close, MAX(l_extendedprice / l_quantity) AS high,
 MIN(l_extendedprice / l_quantity) AS low, SUM(l_quantity) AS volume, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
 FROM lineitem GROUP BY 1, 2)"""
PANEL = BARS + """,
p AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
SECTORS = """s AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS ticker, r_name AS sector, n_name AS industry
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FUNDS = """fq AS (SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS report_date,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS gross_profit,
 SUM(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
f AS (SELECT ticker, report_date, CAST(report_date + INTERVAL 45 DAY AS DATE) AS publish_date, revenue, gross_profit * 0.5 AS net_income, gross_profit,
 SUM(revenue) OVER w AS total_assets, (SUM(revenue) OVER w) * 0.6 AS total_equity, SUM(qty) OVER w AS shares
 FROM fq WINDOW w AS (PARTITION BY ticker ORDER BY report_date ROWS UNBOUNDED PRECEDING))"""


def w(n: int) -> str:
    """The last n rows of a ticker."""
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {least} THEN {agg.replace('?', x)} OVER {w(n)} END"


def lagged(raw: str, k: int, source: str, digits: int = 6) -> str:
    """Final select: the raw factor lagged by k rows, rounded."""
    return f"SELECT date, ticker, round(lag(raw, {k}) OVER (PARTITION BY ticker ORDER BY date), {digits}) AS value FROM (SELECT date, ticker, {raw} AS raw FROM {source})"


def rank(x: str, by: str) -> str:
    """Average rank of x within by."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"
