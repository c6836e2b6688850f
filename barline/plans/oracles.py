"""The registered queries as SQL over the same tables, for comparison by value.

Statements are assembled from common table expressions: bars, numbered bars, features, usable rows with their
split, forecaster rows. They compute everything from first principles (self-joins for exponential means, one
window per whole series) and share no code with the DataFrame operators.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

FLAG = """bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
SUPP = FLAG.replace("l_returnflag AS symbol", "CAST(l_suppkey AS VARCHAR) AS symbol")
EVENTS = """bars AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
    first(value ORDER BY event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
NUM = """num AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos,
    count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""

SER = "PARTITION BY symbol ORDER BY date"


def over(n: int) -> str:
    return f"OVER ({SER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {over(n)} = {n} THEN {fn}({c}) {over(n)} END"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({SER})"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def when(gate: str, x: str) -> str:
    return f"CASE WHEN {gate} THEN {x} END"


def r(x: str, digits: int, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


F1 = f"""f1 AS (
  SELECT *, {div('close', lag('close'))} - 1 AS returns, ln({div('close', lag('close'))}) AS log_returns,
    CASE WHEN close - {lag('close')} > 0 THEN close - {lag('close')} ELSE 0.0 END AS gain,
    CASE WHEN close - {lag('close')} < 0 THEN {lag('close')} - close ELSE 0.0 END AS loss,
    100 * {div(f"close - ({full('min', 'low', 14)})", f"({full('max', 'high', 14)}) - ({full('min', 'low', 14)})")} AS k
  FROM num)"""


def f2(window: int = 7) -> str:
    """Every feature but the exponential ones; gates on the length of the series."""
    cols = {
        "price_range": div("high - low", "close"),
        "price_change": div("close - open", "open"),
        "volume_ma_ratio": div("volume", f"({full('avg', 'volume', 20)})"),
        "price_volume": "close * volume",
    }
    for w in (5, 10, 20, 50):
        mean = full("avg", "close", w)
        gate = "n >= 1000" if w > 10 else "TRUE"
        cols[f"MA_{w}"] = when(gate, mean)
        cols[f"MA_{w}_ratio"] = when(gate, div("close", f"({mean})"))
    gain, loss = full("avg", "gain", 14), full("avg", "loss", 14)
    cols["RSI"] = when("n > 20", f"CASE WHEN ({loss}) = 0 AND ({gain}) > 0 THEN 100.0 ELSE 100 - 100 / (1 + {div(gain, f'({loss})')}) END")
    mid, sd = f"({full('avg', 'close', 20)})", f"(2 * ({full('stddev_samp', 'close', 20)}))"
    cols["BB_upper"] = when("n > 25", f"{mid} + {sd}")
    cols["BB_middle"] = when("n > 25", mid)
    cols["BB_lower"] = when("n > 25", f"{mid} - {sd}")
    cols["BB_width"] = when("n > 25", f"({mid} + {sd}) - ({mid} - {sd})")
    cols["BB_position"] = when("n > 25", div(f"close - ({mid} - {sd})", f"(({mid} + {sd}) - ({mid} - {sd}))"))
    cols["Stoch_K"] = when("n > 20", "k")
    cols["Stoch_D"] = when("n > 20", full("avg", "k", 3))
    for k in range(1, window + 1):
        for c in ("close", "returns", "volume"):
            cols[f"{c}_lag_{k}"] = lag(c, k)
    for w in (5, 10, 20):
        gate = "n >= 1000" if w > 10 else "TRUE"
        cols[f"close_std_{w}"] = when(gate, full("stddev_samp", "close", w))
        cols[f"returns_std_{w}"] = when(gate, full("stddev_samp", "returns", w))
        cols[f"close_min_{w}"] = when(gate, full("min", "close", w))
        cols[f"close_max_{w}"] = when(gate, full("max", "close", w))
    body = ",\n    ".join(f"{x} AS {name}" for name, x in cols.items())
    return f"""f2 AS (
  SELECT *, lead(close, 1) OVER ({SER}) AS target,
    {body}
  FROM f1)"""


EMA = """ema AS (
  SELECT a.symbol, a.date,
    sum(b.close * pow(11e0/13, a.pos - b.pos)) / sum(pow(11e0/13, a.pos - b.pos)) AS EMA_12,
    sum(b.close * pow(25e0/27, a.pos - b.pos)) / sum(pow(25e0/27, a.pos - b.pos)) AS EMA_26,
    any_value(a.pos) AS pos
  FROM num a JOIN num b ON a.symbol = b.symbol AND b.pos <= a.pos GROUP BY 1, 2),
sig AS (
  SELECT a.symbol, a.date, any_value(a.EMA_12) AS EMA_12, any_value(a.EMA_26) AS EMA_26,
    any_value(a.EMA_12 - a.EMA_26) AS macd0,
    sum((b.EMA_12 - b.EMA_26) * pow(8e-1, a.pos - b.pos)) / sum(pow(8e-1, a.pos - b.pos)) AS sig0
  FROM ema a JOIN ema b ON a.symbol = b.symbol AND b.pos <= a.pos GROUP BY 1, 2)"""
F3 = """f3 AS (
  SELECT f2.*, EMA_12, close / EMA_12 AS EMA_12_ratio, EMA_26, close / EMA_26 AS EMA_26_ratio,
    CASE WHEN n > 30 THEN macd0 END AS MACD, CASE WHEN n > 30 THEN sig0 END AS MACD_signal,
    CASE WHEN n > 30 THEN macd0 - sig0 END AS MACD_histogram
  FROM f2 JOIN sig USING (symbol, date))"""
F3_EMA12 = """ema AS (
  SELECT a.symbol, a.date, sum(b.close * pow(11e0/13, a.pos - b.pos)) / sum(pow(11e0/13, a.pos - b.pos)) AS EMA_12
  FROM num a JOIN num b ON a.symbol = b.symbol AND b.pos <= a.pos GROUP BY 1, 2),
f3 AS (SELECT f2.*, EMA_12 FROM f2 JOIN ema USING (symbol, date))"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"  # may be continued with ", name AS (...)"


def feats(bars: str = FLAG, window: int = 7) -> tuple[str, ...]:
    return bars, NUM, F1, f2(window)


def digits_of(name: str) -> int:
    if name.endswith("_ratio"):
        return 6
    if "mse" in name or name == "price_volume":
        return 2
    if name.startswith("MA_") or name == "BB_middle":
        return 4
    starts = ("MA_", "EMA_", "MACD", "BB_upper", "BB_middle", "BB_lower", "BB_width", "close_", "open", "high", "low",
              "close", "target", "prediction", "predicted_value", "actual_value", "confidence_", "median", "mean", "std", "quantile")
    if name.startswith(("EMA_", "MACD")):
        return 5
    return 3 if name.startswith(starts) else 6


def rounded(*names: str, **digits: int) -> str:
    return ", ".join(r(c, digits.get(c, digits_of(c))) for c in names)


FEATURE_NAMES = (
    ["returns", "log_returns", "price_range", "price_change", "volume_ma_ratio", "price_volume"]
    + [f"MA_{w}{t}" for w in (5, 10, 20, 50) for t in ("", "_ratio")]
    + [f"EMA_{s}{t}" for s in (12, 26) for t in ("", "_ratio")]
    + ["RSI", "MACD", "MACD_signal", "MACD_histogram"]
    + ["BB_upper", "BB_middle", "BB_lower", "BB_width", "BB_position", "Stoch_K", "Stoch_D"]
    + [f"{c}_lag_{k}" for k in range(1, 8) for c in ("close", "returns", "volume")]
    + [f"{c}_{w}" for w in (5, 10, 20) for c in ("close_std", "returns_std", "close_min", "close_max")]
)


def feature_sql(*names: str, bars: str = FLAG, exponential: bool = False) -> str:
    if exponential:
        return ctes(*feats(bars), EMA, F3) + f"SELECT symbol, date, {rounded(*names)} FROM f3"
    return ctes(*feats(bars)) + f"SELECT symbol, date, {rounded(*names)} FROM f2"


# ---- sources ----------------------------------------------------------------------------------------------------

BAR_LIST = rounded("open", "high", "low", "close", "volume")
ORACLES["s1_read_csv"] = ctes(FLAG) + f"SELECT symbol, date, {BAR_LIST} FROM bars"
ORACLES["s2_read_directory"] = ctes(SUPP) + "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, TRUE AS has_files FROM bars"
ORACLES["s3_scan_symbol"] = ctes(FLAG) + (
    f"SELECT symbol, date, {BAR_LIST} FROM bars WHERE symbol = 'N' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' "
    "ORDER BY date LIMIT 500")
ORACLES["s4_source_fallback"] = ctes(FLAG) + (
    "SELECT symbol, date, round(CASE WHEN symbol = 'R' THEN close + 1 ELSE close END, 3) + 0.0 AS close FROM bars")
ORACLES["s5_symbols"] = ctes(SUPP) + "SELECT DISTINCT symbol FROM bars"
ORACLES["s6_date_range"] = ctes(SUPP) + "SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1"
ORACLES["s7_upsert"] = ctes(FLAG) + (
    "SELECT symbol, date, round(CASE WHEN date >= DATE '1998-01-01' THEN close * 2 ELSE close END, 3) + 0.0 AS close, "
    "date >= DATE '1998-01-01' AND date < DATE '2000-01-01' AS updated FROM bars")
ORACLES["s7_inserted"] = ctes(FLAG) + "SELECT count(*) AS inserted FROM bars WHERE date >= DATE '2000-01-01'"
ORACLES["s8_delete_symbol"] = ctes(FLAG) + (
    "SELECT symbol, count(*) AS rows, (SELECT count(*) FROM bars WHERE symbol = 'A') AS deleted FROM bars WHERE symbol <> 'A' GROUP BY 1")
ORACLES["s9_sources"] = (
    "SELECT r_name AS name, 'known' AS description FROM region UNION ALL "
    "SELECT n_name, 'new' FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)")
ORACLES["s10_import_jobs"] = ctes(SUPP) + """,
t AS (SELECT symbol, count(*) AS c, CAST(symbol AS INTEGER) % 7 = 0 AS bad FROM bars GROUP BY 1)
SELECT 'csv_import' AS source, symbol, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN bad THEN 0 ELSE c END AS records_processed, CASE WHEN bad THEN 0 ELSE c - 3 END AS records_inserted,
  CASE WHEN bad THEN 0 ELSE 1 END::BIGINT AS records_updated, CASE WHEN bad THEN 0 ELSE 2 END::BIGINT AS records_skipped,
  CASE WHEN bad THEN 'Validation failed: negative close' END AS error_message,
  CASE WHEN bad THEN '{"errors":["negative close"],"warnings":[]}' ELSE '{"errors":[],"warnings":[]}' END AS validation_errors
FROM t"""
BAD_SUPP = """raw AS (
  SELECT symbol AS dataset, date, open, high, low, volume,
    CASE WHEN CAST(symbol AS INTEGER) % 7 = 0 AND year(date) = 1997 THEN -close ELSE close END AS close FROM bars)"""
VALID = """valid AS (
  SELECT dataset, count_if(close < 0) AS negative, count_if(high < close) AS hc, count_if(close < low) AS lc,
    max(date) - min(date) AS days, count(*) AS c, count_if(date >= DATE '1996-01-01') AS later
  FROM raw GROUP BY 1)"""
ORACLES["s11_import_files"] = ctes(SUPP, BAD_SUPP, """facts AS (
  SELECT dataset, count(*) AS c, count_if(close < 0) AS negative, max(date) - min(date) AS days,
    count_if(dayofyear(date) % 40 = 0) AS gaps, count_if(dayofyear(date) % 40 <> 0 AND date >= DATE '1996-01-01') AS fresh,
    count_if(dayofyear(date) % 40 <> 0 AND date < DATE '1996-01-01') AS again,
    min(date) FILTER (WHERE dayofyear(date) % 40 <> 0) AS first_day, max(date) FILTER (WHERE dayofyear(date) % 40 <> 0) AS last_day
  FROM raw GROUP BY 1)""") + """
SELECT dataset AS symbol, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN ok THEN c ELSE 0 END AS records_processed, CASE WHEN ok THEN fresh ELSE 0 END AS records_inserted,
  CASE WHEN ok THEN again ELSE 0 END AS records_updated, CASE WHEN ok THEN gaps ELSE 0 END AS records_skipped,
  CASE WHEN ok THEN first_day END AS data_start_date, CASE WHEN ok THEN last_day END AS data_end_date
FROM (SELECT *, negative = 0 AND gaps * 100.0 / c <= 10 AND days / 365.25 >= 2 AS ok FROM facts)"""
ORACLES["s12_filter_length"] = ctes(SUPP, EVENTS.replace("bars AS", "short AS"), "panel AS (SELECT * FROM bars UNION ALL SELECT * FROM short)") + f"""
SELECT symbol, date, {rounded('open', 'high', 'low', 'close')} FROM panel
WHERE symbol IN (SELECT symbol FROM panel GROUP BY 1 HAVING max(date) - min(date) > 365 * 5)"""
ORACLES["s13_available_datasets"] = ctes(SUPP) + "SELECT DISTINCT symbol AS dataset FROM bars"
ORACLES["s14_load_validated"] = ctes(SUPP, BAD_SUPP) + f"""
SELECT dataset AS symbol, date, {rounded('open', 'high', 'low', 'close')} FROM raw
WHERE dataset IN (SELECT dataset FROM raw GROUP BY 1 HAVING count_if(close < 0) = 0 AND max(date) - min(date) >= 730)"""
ORACLES["s15_ingest_zone"] = ctes(FLAG) + """
SELECT zone, symbol, count(*) AS rows FROM bars, (VALUES ('raw'), ('processed')) z(zone) GROUP BY ALL"""
ORACLES["s16_archive"] = ctes(EVENTS) + f"SELECT symbol, date, {rounded('close')}, '20240101_000000' AS archived_at FROM bars"

# ---- projections, filters, scalar functions ----------------------------------------------------------------------

ORACLES["p1_select_drop"] = ctes(FLAG) + 'SELECT symbol, date, close AS "Close" FROM bars'
ORACLES["p2_lenient_cast"] = """
WITH t AS (SELECT event_type, CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS text FROM events)
SELECT event_type, count(TRY_CAST(text AS DOUBLE)) AS castable,
  count_if(text IS NOT NULL AND TRY_CAST(text AS DOUBLE) IS NULL) AS uncastable, round(sum(TRY_CAST(text AS DOUBLE)), 6) + 0.0 AS total
FROM t GROUP BY 1"""
ORACLES["p3_range_filter"] = ctes(FLAG) + f"SELECT symbol, date, {BAR_LIST} FROM bars WHERE symbol = 'R' AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
ORACLES["p4_drop_null_target"] = ctes(FLAG) + (
    f"SELECT symbol, date, {rounded('target')} FROM (SELECT *, lead(close, 5) OVER ({SER}) AS target FROM bars) WHERE target IS NOT NULL")
ORACLES["p5_drop_empty_rows"] = ctes(*feats()) + (
    f"SELECT symbol, date, {rounded('returns', 'RSI', 'MA_50')} FROM f2 WHERE returns IS NOT NULL OR RSI IS NOT NULL OR MA_50 IS NOT NULL")


def short_rows() -> str:
    """Event series have 30 bars: forward fill never changes a warm-up gap, so complete rows start at the last one's end."""
    return ctes(*feats(EVENTS)) + f""",
usable AS (SELECT * FROM f2 WHERE target IS NOT NULL),
filled AS (SELECT *, last_value(RSI IGNORE NULLS) OVER w AS rsi_f, last_value(volume_ma_ratio IGNORE NULLS) OVER w AS vol_f,
  last_value(BB_position IGNORE NULLS) OVER w AS bbp_f, last_value(Stoch_D IGNORE NULLS) OVER w AS d_f, last_value(returns_std_10 IGNORE NULLS) OVER w AS rs_f,
  last_value(returns_lag_7 IGNORE NULLS) OVER w AS rl_f, last_value(BB_upper IGNORE NULLS) OVER w AS bbu_f, last_value(returns IGNORE NULLS) OVER w AS ret_f
  FROM usable WINDOW w AS ({SER})),
kept AS (SELECT * FROM filled WHERE rsi_f IS NOT NULL AND vol_f IS NOT NULL AND bbp_f IS NOT NULL AND d_f IS NOT NULL
  AND rs_f IS NOT NULL AND rl_f IS NOT NULL AND bbu_f IS NOT NULL)
SELECT symbol, date, round(ret_f, 6) + 0.0 AS returns, {rounded('MA_10')}, round(rsi_f, 6) + 0.0 AS RSI, {rounded('close_lag_7', 'target')},
  row_number() OVER ({SER}) AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM kept"""


ORACLES["p6_short_series"] = short_rows()
ROWS = """rows_ AS (
  SELECT * EXCLUDE (n), n - 1 AS n, CASE WHEN pos > n - 1 - floor((n - 1) * 2e-1) THEN 'test'
    WHEN pos > n - 1 - floor((n - 1) * 2e-1) - floor((n - 1 - floor((n - 1) * 2e-1)) * 2e-1) THEN 'val' ELSE 'train' END AS split
  FROM {source} WHERE target IS NOT NULL)"""
ROWS2, ROWS3 = ROWS.format(source="f2"), ROWS.format(source="f3")


def scaled_sql(names: list[str], centre: str, spread: str, keys: str = "symbol, date, split", digits: int = 6) -> str:
    """centre and spread are patterns over {c}; statistics come from the train rows."""
    source = (*feats(), ROWS2) if len(names) < 10 else (*feats(), EMA, F3, ROWS3)
    stats = ", ".join(f"{centre.format(c=c)} AS {c}_m, {spread.format(c=c)} AS {c}_s" for c in names)
    out = ", ".join(f"round(coalesce(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 0), {2 if c == 'price_volume' and digits == 4 else digits}) + 0.0 AS {c}" for c in names)
    return ctes(*source) + f""",
stats AS (SELECT symbol, {stats} FROM rows_ WHERE split = 'train' GROUP BY 1)
SELECT {keys}, {out} FROM rows_ JOIN stats USING (symbol)"""


PREPARED = FEATURE_NAMES
ORACLES["p7_fill_after_scaling"] = scaled_sql(["MA_20_ratio", "returns"], "avg({c})", "stddev_pop({c})")
ORACLES["p8_coalesce_volume"] = ctes(EVENTS) + (
    "SELECT upper(symbol) AS symbol, date, CASE WHEN day(date) % 3 <> 0 THEN volume END AS volume, CAST(NULL AS DOUBLE) AS market_cap FROM bars")
ORACLES["p9_supervised"] = ctes(FLAG, NUM) + f"""
SELECT symbol, date, {rounded('open', 'high', 'low', 'volume')}, {rounded('target')}, pos, n - 3 AS n
FROM (SELECT *, lead(close, 3) OVER ({SER}) AS target FROM num) WHERE target IS NOT NULL"""
ORACLES["f1_upper"] = ctes(EVENTS) + "SELECT upper(symbol) AS symbol, date FROM bars"
ORACLES["f2_file_names"] = "SELECT n_nationkey, 'series_' || n_name AS stem, string_split(n_name, '_')[-1] AS token FROM nation"
ORACLES["f3_key_prefix"] = "SELECT 'exp_' || n_name || '_' || n_regionkey AS key FROM nation"
ORACLES["f4_timestamps"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts, '%Y-%m-%d') AS day FROM events"
ORACLES["f5_date_arithmetic"] = ctes(SUPP) + """
SELECT symbol, CAST(b + 1 AS DATE) AS next_date, CAST(b - a AS INTEGER) AS days, round((b - a) / 365.25, 6) AS years, b - a >= 730 AS long_enough
FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY 1)"""
ORACLES["f6_date_spine"] = ctes(SUPP) + """
SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY 1)"""
ORACLES["f7_math"] = ctes(FLAG) + f"""
SELECT symbol, date, {r('ln(close)', 6, 'ln_close')}, {r('sqrt(volume)', 6, 'root_volume')}, {r('abs(close - open)', 3, 'move')},
  {r('close * 100 / open', 6, 'pct')} FROM bars"""
ORACLES["f8_json"] = """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation"""
ORACLES["f9_conditional"] = ctes(FLAG) + f"SELECT symbol, date, {r('greatest(close - open, 0.0)', 6, 'open_gain')} FROM bars"

# ---- joins -------------------------------------------------------------------------------------------------------

ORACLES["j1_aligned_columns"] = feature_sql("returns", "MA_5", "RSI", "BB_width", "Stoch_K")
ORACLES["j2_semi_by_index"] = ctes(*feats()) + f"SELECT symbol, date, {rounded('MA_5')} FROM f2 WHERE target IS NOT NULL"
ORACLES["j3_upsert_match"] = ctes(FLAG) + """
SELECT symbol, CASE WHEN date < DATE '2000-01-01' THEN 'update' ELSE 'insert' END AS action, count(*) AS rows
FROM bars WHERE date >= DATE '1998-01-01' GROUP BY ALL"""
ORACLES["j4_actual_lookup"] = ctes(SUPP) + f"""
SELECT a.symbol, a.date, {r('a.open', 3, 'predicted_value')}, {r('b.close', 3, 'actual_value')}
FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.date = a.date + 2"""
SPINE = """spine AS (
  SELECT symbol, CAST(unnest(generate_series(a, b + 5, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY 1))"""
ORACLES["j5_asof_join"] = ctes(SUPP, SPINE) + f"""
SELECT s.symbol, s.date, b.date AS asof_date, {r('b.close', 3, 'close')}, {r('b.volume', 6, 'volume')}
FROM spine s ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND s.date > b.date"""
ORACLES["j6_bounded_range_join"] = ctes(FLAG) + """,
spine AS (SELECT symbol, CAST(unnest(generate_series(b - 29, b, INTERVAL 1 DAY)) AS DATE) AS pred_date
  FROM (SELECT symbol, max(date) AS b FROM bars GROUP BY 1)),
ranked AS (SELECT s.symbol, s.pred_date, b.date, b.close, row_number() OVER (PARTITION BY s.symbol, s.pred_date ORDER BY b.date DESC) AS k
  FROM spine s JOIN bars b ON s.symbol = b.symbol AND b.date < s.pred_date)
SELECT symbol, pred_date, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, round(sum(close), 3) + 0.0 AS close_sum
FROM ranked WHERE k <= 100 GROUP BY 1, 2"""
PAIRS = f"""pairs AS (
  SELECT CASE WHEN pos <= floor((n - 1) * 6e-1) THEN 'train' WHEN pos <= floor((n - 1) * (6e-1 + 2e-1)) THEN 'val' ELSE 'test' END AS dataset,
    pos * 10 + ascii(symbol) % 10 AS id, target AS y_real, close AS y_pred
  FROM (SELECT *, lead(close) OVER ({SER}) AS target FROM num) WHERE target IS NOT NULL)"""
ALIGN = """
SELECT dataset, count(*) AS real_rows, count_if(id % 7 <> 0) AS pred_rows, count_if(id % 7 = 0) AS unmatched,
  CAST(0 AS BIGINT) AS real_missing, CAST(0 AS BIGINT) AS pred_missing{extra} FROM pairs GROUP BY 1"""
ORACLES["j7_alignment"] = ctes(FLAG, NUM, PAIRS) + ALIGN.format(extra="")
ORACLES["j8_symbols_in_both"] = "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"
ORACLES["j9_foreign_keys"] = """
SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) + 0.0 AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
ORACLES["j10_apply_statistics"] = ctes(SUPP) + """
SELECT symbol, date, round((close - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS close
FROM bars JOIN (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s FROM bars GROUP BY 1) USING (symbol)"""

# ---- aggregates --------------------------------------------------------------------------------------------------

FAULTY = """raw0 AS (
  SELECT symbol AS dataset, date,
    CASE WHEN symbol = 'A' AND day(date) = 13 THEN NULL WHEN day(date) = 29 THEN 0.0 ELSE open END AS open, FALSE AS open_bad,
    CASE WHEN symbol = 'N' AND day(date) = 7 THEN low - 1 ELSE high END AS high, low,
    CASE WHEN symbol = 'R' AND day(date) = 3 THEN NULL WHEN symbol = 'N' AND day(date) = 5 THEN -close ELSE close END AS close,
    symbol = 'R' AND day(date) = 3 AS close_bad,
    CASE WHEN day(date) <= 2 THEN NULL ELSE volume END AS volume, 'x' AS note
  FROM bars WHERE NOT (month(date) = 6 AND day(date) > 20)),
raw AS (SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE dataset = 'N' AND day(date) = 1)"""
RAW = (FLAG, FAULTY)
PRICES = ("open", "high", "low", "close")
STRUCTURE = {
    "high_below_low": ("high", "low"), "high_below_open": ("high", "open"), "high_below_close": ("high", "close"),
    "open_below_low": ("open", "low"), "close_below_low": ("close", "low"),
}
MISSING = """missing AS (
  SELECT dataset, 'date' AS "column", 0 AS missing, count(*) AS c FROM raw GROUP BY 1
  UNION ALL SELECT dataset, 'open', count_if(open IS NULL), count(*) FROM raw GROUP BY 1
  UNION ALL SELECT dataset, 'high', 0, count(*) FROM raw GROUP BY 1
  UNION ALL SELECT dataset, 'low', 0, count(*) FROM raw GROUP BY 1
  UNION ALL SELECT dataset, 'close', count_if(close IS NULL AND NOT close_bad), count(*) FROM raw GROUP BY 1
  UNION ALL SELECT dataset, 'volume', count_if(volume IS NULL), count(*) FROM raw GROUP BY 1
  UNION ALL SELECT dataset, 'note', 0, count(*) FROM raw GROUP BY 1)"""
ORACLES["a1_row_count"] = ctes(*RAW) + "SELECT dataset, count(*) AS rows, 7 AS columns FROM raw GROUP BY 1"
ORACLES["a2_null_counts"] = ctes(*RAW, MISSING) + """
SELECT dataset, "column", CAST(missing AS BIGINT) AS missing, round(missing / c * 100, 6) + 0.0 AS pct FROM missing"""
ORACLES["a3_conditional_counts"] = ctes(*RAW) + "SELECT dataset, " + ", ".join(
    [f"count_if({c} < 0) AS {c}__negative, count_if({c} = 0) AS {c}__zero" for c in PRICES]
    + [f"count_if({a} < {b}) AS {name}" for name, (a, b) in STRUCTURE.items()]) + " FROM raw GROUP BY 1"
ORACLES["a4_exact_quantiles"] = ctes(SUPP) + " UNION ALL ".join(
    f"""SELECT symbol, '{c}' AS "column", {p} AS fraction, round(quantile_cont({c}, {p}), 4) + 0.0 AS quantile FROM bars GROUP BY 1"""
    for c in ("open", "close") for p in ("1e-2", "25e-2", "75e-2", "99e-2"))


def stats_list(names: list[str], digits: dict[str, tuple[int, int, int]]) -> str:
    out = []
    for c in names:
        a, b, d = digits.get(c, (6, 6, 6))
        out += [f"round(avg({c}), {a}) + 0.0 AS {c}__mean", f"round(stddev_samp({c}), {b}) + 0.0 AS {c}__std", f"round(median({c}), {d}) + 0.0 AS {c}__median"]
    return ", ".join(out)


ORACLES["a5_mean_std_median"] = ctes(*feats(), EMA, F3) + "SELECT symbol, " + ", ".join(
    f"round({f}({c}), {2 if c == 'price_volume' else 4}) + 0.0 AS {c}__{s}"
    for c in FEATURE_NAMES for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"))) + " FROM f3 GROUP BY 1"
ORACLES["a6_spans"] = ctes(*RAW) + """
SELECT dataset, min(date) AS first_date, max(date) AS last_date, CAST(max(date) - min(date) AS INTEGER) AS span_days,
  round((max(date) - min(date)) / 365.25, 6) AS span_years FROM raw GROUP BY 1"""
ORACLES["a7_duplicate_dates"] = ctes(*RAW) + "SELECT dataset, count(*) - count(DISTINCT date) AS duplicates FROM raw GROUP BY 1"
STEPS = """steps AS (
  SELECT dataset, step, count(*) AS times FROM (
    SELECT dataset, CAST(date - lag(date) OVER (PARTITION BY dataset ORDER BY date) AS INTEGER) AS step FROM raw)
  WHERE step IS NOT NULL GROUP BY 1, 2),
usual AS (SELECT dataset, step AS usual_step FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY times DESC, step) AS k FROM steps) WHERE k = 1),
gaps AS (SELECT dataset, usual_step, CAST(sum(CASE WHEN step > 2 * usual_step THEN times ELSE 0 END) AS BIGINT) AS gaps
  FROM steps JOIN usual USING (dataset) GROUP BY 1, 2)"""
SUPP_RAW = "raw AS (SELECT symbol AS dataset, * FROM bars)"
ORACLES["a8_usual_step"] = ctes(SUPP, SUPP_RAW, STEPS) + "SELECT * FROM usual"
ORACLES["a9_large_gaps"] = ctes(SUPP, SUPP_RAW, STEPS) + "SELECT * FROM gaps"

FORECASTERS = {"persistence": "close", "ma_5": "MA_5", "ma_10": "MA_10", "ema_12": "EMA_12"}
LONG = "preds AS (" + " UNION ALL ".join(
    f"SELECT symbol, date, split, target, pos, n, '{m}' AS model, {c} AS prediction FROM rows_ WHERE {c} IS NOT NULL" for m, c in FORECASTERS.items()) + ")"
FORECAST = (*feats(), F3_EMA12, ROWS3, LONG)
ERR = "(target - prediction)"
METRIC = {
    "mse": f"avg({ERR} * {ERR})", "mae": f"avg(abs({ERR}))", "rmse": f"sqrt(avg({ERR} * {ERR}))",
    "r2": f"1 - sum({ERR} * {ERR}) / (var_pop(target) * count(*))", "mape_pct": f"avg(abs({ERR} / target)) * 100",
}
METRICS = "metrics AS (SELECT symbol, model, split, " + ", ".join(f"{x} AS {m}" for m, x in METRIC.items()) + " FROM preds GROUP BY 1, 2, 3)"
ORACLES["a10_training_metrics"] = ctes(*FORECAST, METRICS) + " UNION ALL ".join(
    f"SELECT symbol, model, split, '{m}' AS metric, round({m}, 2) + 0.0 AS value FROM metrics" for m in METRIC)
Y = "(y_real - y_pred)"
PAIR_METRIC = {
    "mape": f"avg(abs{Y} / greatest(abs(y_real), 2.220446049250313e-16))", "mse": f"avg({Y} * {Y})",
    "rmse": f"sqrt(avg({Y} * {Y}))", "r2": f"1 - sum({Y} * {Y}) / (var_pop(y_real) * count(*))",
}
PAIR_DIGITS = {"mape": 6, "mse": 2, "rmse": 3, "r2": 6}


def pair_metrics(*names: str) -> str:
    return ", ".join(r(PAIR_METRIC[m], PAIR_DIGITS[m], m) for m in names)


ORACLES["a11_regression_metrics"] = ctes(FLAG, NUM, PAIRS) + f"SELECT dataset, {pair_metrics(*PAIR_METRIC)} FROM pairs GROUP BY 1"
ORACLES["u1_metric_registry"] = ORACLES["a11_regression_metrics"]
ORACLES["a12_classification_metrics"] = """
WITH c AS (SELECT ['train', 'val', 'test'][doc_id % 3 + 1] AS dataset, count_if(quality = 1 AND toxic = 1)::DOUBLE AS tp, count_if(quality = 0 AND toxic = 0)::DOUBLE AS tn,
  count_if(quality = 0 AND toxic = 1)::DOUBLE AS fp, count_if(quality = 1 AND toxic = 0)::DOUBLE AS fn FROM labels GROUP BY 1),
k AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM c)
SELECT dataset, round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS acc,
  round((CASE WHEN tp + fn > 0 THEN r1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN r0 ELSE 0 END) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT), 6) + 0.0 AS b_acc,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision,
  round((r1 + r0) / ((tp + fn + fp > 0)::INT + (tn + fp + fn > 0)::INT), 6) + 0.0 AS recall FROM k"""
ORACLES["a13_metric_driver"] = ctes(FLAG, NUM, PAIRS) + f""",
m AS (SELECT dataset, {pair_metrics('mape', 'r2', 'rmse')} FROM pairs GROUP BY 1)
SELECT 'persistence' AS comment, """ + ", ".join(
    f"max({m}) FILTER (dataset = '{d}') AS {m}_{d}" for d in ("train", "val", "test") for m in ("mape", "r2", "rmse")) + " FROM m"
ORACLES["a14_split_metrics"] = ctes(FLAG, NUM, PAIRS) + f"""
SELECT CASE WHEN dataset = 'val' THEN 'validation' ELSE dataset END AS dataset, {pair_metrics('mape', 'r2')} FROM pairs GROUP BY 1"""
FOLDS = f"""scores AS (
  SELECT symbol, model, fold, -avg({ERR} * {ERR}) AS score FROM preds, range(5) t(fold)
  WHERE pos > n - (5 - fold) * (n // 6) AND pos <= n - (4 - fold) * (n // 6) GROUP BY 1, 2, 3),
cv AS (SELECT symbol, model, avg(score) AS cv_score_mean, stddev_pop(score) AS cv_score_std FROM scores GROUP BY 1, 2)"""
ORACLES["a15_cv_summary"] = ctes(*FORECAST, FOLDS) + "SELECT symbol, model, round(cv_score_mean, 2) + 0.0 AS cv_score_mean, round(cv_score_std, 2) + 0.0 AS cv_score_std FROM cv"
WEIGHTS = f"""score AS (SELECT symbol, model, 1 / (avg({ERR} * {ERR}) + 1e-10) AS score FROM preds WHERE split = 'val' GROUP BY 1, 2),
weights AS (SELECT symbol, model, score / sum(score) OVER (PARTITION BY symbol) AS weight FROM score)"""


def combined(rows: str) -> str:
    return f"""combined AS (SELECT symbol, date, sum(weight * prediction) / sum(weight) AS predicted_value, stddev_pop(prediction) AS sd, count(*) AS models
  FROM {rows} JOIN weights USING (symbol, model) GROUP BY 1, 2)"""


BACKTEST = (*FORECAST, WEIGHTS, """spine AS (
  SELECT symbol, CAST(unnest(generate_series(b - 59, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT symbol, max(date) AS b FROM bars GROUP BY 1)),
known AS (SELECT s.symbol, s.date, """ + ", ".join(f"f.{c}" for c in FORECASTERS.values()) + """ FROM spine s ASOF JOIN f3 f ON s.symbol = f.symbol AND s.date > f.date WHERE f.pos >= 7),
asked AS (""" + " UNION ALL ".join(f"SELECT symbol, date, '{m}' AS model, {c} AS prediction FROM known" for m, c in FORECASTERS.items()) + ")",
    combined("asked"),
    """result AS (SELECT c.symbol, c.date, predicted_value, b.close AS actual_value, predicted_value - 1.96 * sd AS confidence_lower,
  predicted_value + 1.96 * sd AS confidence_upper FROM combined c LEFT JOIN bars b ON b.symbol = c.symbol AND b.date = c.date + 1)""")
BAND = ", ".join(r(c, 3) for c in ("predicted_value", "actual_value", "confidence_lower", "confidence_upper"))
ORACLES["m20_backtest"] = ctes(*BACKTEST) + f"SELECT symbol, date AS timestamp, {BAND}, 'ensemble' AS model_used, 1 AS prediction_horizon FROM result"
ORACLES["a16_prediction_summary"] = ctes(*BACKTEST) + """
SELECT symbol, count(predicted_value) AS total_predictions, count(actual_value) AS predictions_with_actuals, round(avg(predicted_value), 3) + 0.0 AS mean_prediction,
  round(stddev_pop(predicted_value), 3) + 0.0 AS std_prediction, round(min(predicted_value), 3) + 0.0 AS min_prediction, round(max(predicted_value), 3) + 0.0 AS max_prediction,
  round(avg((actual_value - predicted_value) ** 2), 2) + 0.0 AS mse, round(avg(abs(actual_value - predicted_value)), 3) + 0.0 AS mae FROM result GROUP BY 1"""
WIDE = "wide AS (SELECT symbol, model, " + ", ".join(
    f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("test", "val") for m in METRIC) + " FROM metrics GROUP BY 1, 2)"
COMPARE = (*FORECAST, METRICS, WIDE, FOLDS)
WIDE_DIGITS = {f"{s}_{m}": d for s in ("test", "val") for m, d in (("mse", 2), ("mae", 3), ("rmse", 2), ("r2", 6), ("mape_pct", 6))}
ORACLES["k4_compare_models"] = ctes(*COMPARE) + "SELECT symbol, model, " + ", ".join(
    r(c, d) for c, d in (WIDE_DIGITS | {"test_rmse": 3, "val_rmse": 3, "cv_score_mean": 2, "cv_score_std": 2}).items()) + " FROM wide JOIN cv USING (symbol, model)"
ORACLES["k5_best_model"] = ctes(*COMPARE) + f"""
SELECT symbol, model, {r('test_mse', 2)}, {r('test_r2', 6)} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY test_mse, model) AS k FROM wide) WHERE k = 1"""
ORACLES["a17_experiment_overview"] = ctes(*COMPARE) + f"""
SELECT symbol, count(DISTINCT symbol) AS symbols, count(*) AS models, {r('avg(test_mse)', 2, 'avg_test_mse')}, {r('avg(test_mae)', 3, 'avg_test_mae')},
  {r('avg(test_r2)', 6, 'avg_test_r2')}, {r('avg(test_mape_pct)', 6, 'avg_test_mape_pct')} FROM wide GROUP BY ROLLUP (symbol)"""
ORACLES["a17_model_performance"] = ctes(*COMPARE) + f"""
SELECT symbol, model, {r('test_mse', 2)}, {r('test_mae', 3)}, {r('test_r2', 6)}, {r('test_mape_pct', 6)},
  CAST(row_number() OVER (PARTITION BY symbol ORDER BY test_mse, model) AS INTEGER) AS place FROM wide"""
ORACLES["j9_references"] = ctes(*FORECAST) + """
SELECT 'job_source' AS relation, CAST(s_suppkey AS VARCHAR) AS symbol, count(*) AS rows, count_if(r_name <> 'ASIA') AS known, count_if(r_name = 'ASIA') AS orphans
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT 'prediction_model', symbol, count(*), count_if(model <> 'ma_10'), count_if(model = 'ma_10') FROM preds GROUP BY symbol
UNION ALL SELECT 'prediction_bar', p.symbol, count(*), count(b.date), count_if(b.date IS NULL) FROM preds p LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = p.date + 1 GROUP BY p.symbol
UNION ALL SELECT 'metric_model', symbol, 5 * count(*), 5 * count_if(model <> 'ma_10'), 5 * count_if(model = 'ma_10')
  FROM (SELECT DISTINCT symbol, model, split FROM preds) GROUP BY symbol"""
SCORED = FEATURE_NAMES
SCORES = (*feats(), EMA, F3, ROWS3, "scores AS (" + " UNION ALL ".join(
    f"""SELECT symbol, {i} AS position, '{c}' AS feature, x * x / (1 - x * x) * (c - 2) AS score FROM (
    SELECT symbol, corr(coalesce({c}, 0), target) AS x, count(*) AS c FROM rows_ WHERE split = 'train' GROUP BY 1)"""
    for i, c in enumerate(SCORED)) + ")", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC NULLS LAST, position DESC) AS rank FROM scores)""")
ORACLES["a18_f_scores"] = ctes(*SCORES) + "SELECT symbol, position, feature, round(score, 2) + 0.0 AS score FROM scores"
ORACLES["k3_top_features"] = ctes(*SCORES) + "SELECT symbol, feature, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 50"
ORACLES["m5_select_apply"] = ctes(*SCORES, "sizes AS (SELECT symbol, count(*) AS c FROM rows_ GROUP BY 1)") + "SELECT symbol, " + ", ".join(
    f"coalesce(max(CASE WHEN feature = '{c}' AND rank <= 50 THEN c END), 0) AS n_{c}" for c in SCORED) + " FROM ranked JOIN sizes USING (symbol) GROUP BY 1"
ORACLES["a19_dataset_info"] = ctes(*RAW) + """
SELECT dataset, count(*) AS rows, 7 AS columns, 'date,open,high,low,close,volume,note' AS column_names, min(date) AS first_date, max(date) AS last_date,
  CAST(max(date) - min(date) AS INTEGER) AS span_days, round((max(date) - min(date)) / 365.25, 6) AS span_years FROM raw GROUP BY 1"""

# ---- windows -----------------------------------------------------------------------------------------------------

ORACLES["w1_moving_averages"] = ctes(SUPP) + "SELECT symbol, date, " + ", ".join(
    f"{r(full('avg', 'close', w), 4, f'MA_{w}')}, {r(div('close', '(' + full('avg', 'close', w) + ')'), 6, f'MA_{w}_ratio')}" for w in (5, 10, 20, 50)) + " FROM bars"
ORACLES["w2_exponential_averages"] = feature_sql("EMA_12", "EMA_12_ratio", "EMA_26", "EMA_26_ratio", exponential=True)
ORACLES["w3_rsi"] = feature_sql("RSI", bars=SUPP)
ORACLES["w4_macd"] = feature_sql("MACD", "MACD_signal", "MACD_histogram", exponential=True)
MID, SD = f"({full('avg', 'close', 20)})", f"(2 * ({full('stddev_samp', 'close', 20)}))"
ORACLES["w5_bollinger"] = ctes(SUPP, f"b AS (SELECT *, {MID} AS m, {SD} AS s FROM bars)") + f"""
SELECT symbol, date, {r('m + s', 3, 'BB_upper')}, {r('m', 4, 'BB_middle')}, {r('m - s', 3, 'BB_lower')}, {r('(m + s) - (m - s)', 3, 'BB_width')},
  {r(div('close - (m - s)', '((m + s) - (m - s))'), 6, 'BB_position')} FROM b"""
ORACLES["w6_stochastic"] = feature_sql("Stoch_K", "Stoch_D", bars=SUPP)
ORACLES["w7_returns"] = feature_sql("returns", "log_returns", bars=SUPP)
ORACLES["w8_bar_shape"] = ctes(SUPP) + f"SELECT symbol, date, {r('(high - low) / close', 6, 'price_range')}, {r('(close - open) / open', 6, 'price_change')} FROM bars"
ORACLES["w9_volume"] = feature_sql("volume_ma_ratio", "price_volume", bars=SUPP)
ORACLES["w10_lags"] = feature_sql(*[f"{c}_lag_{k}" for k in range(1, 8) for c in ("close", "returns", "volume")])
ORACLES["w11_rolling_spread"] = feature_sql(*[f"{c}_{n}" for n in (5, 10, 20) for c in ("close_std", "returns_std", "close_min", "close_max")])


def frame_sql(bars: str) -> str:
    return ctes(*feats(bars), EMA, F3) + f"SELECT symbol, date, {rounded('close', *FEATURE_NAMES, 'target')}, pos, n FROM f3"


ORACLES["w12_feature_frame"] = frame_sql(FLAG)
ORACLES["w12_short_series"] = frame_sql(EVENTS)
ORACLES["flagship"] = feature_sql("returns", "MA_5", "MA_10", "MA_20", "MA_20_ratio", "BB_upper", "BB_lower", "BB_position", "RSI", "MACD_signal", exponential=True)


def null_count_sql() -> str:
    gates = {c: "n >= 1000" for c in FEATURE_NAMES if c.startswith(("MA_20", "MA_50")) or c.endswith("_20")}
    gates |= {c: "n > 20" for c in ("RSI", "Stoch_K", "Stoch_D")} | {c: "n > 25" for c in FEATURE_NAMES if c.startswith("BB_")}
    skip = {"MACD", "MACD_signal", "MACD_histogram", "EMA_12", "EMA_12_ratio", "EMA_26", "EMA_26_ratio"}  # never NULL
    parts = [f"(({gates.get(c, 'TRUE')}) AND {c} IS NULL)::BIGINT" for c in FEATURE_NAMES if c not in skip]
    return ctes(*feats(SUPP)) + f"SELECT symbol, count(*) AS rows, CAST(sum({' + '.join(parts)}) AS BIGINT) AS feature_nulls, count_if(target IS NULL) AS target_nulls FROM f2 GROUP BY 1"


ORACLES["w12_null_budget"] = null_count_sql()
ORACLES["w13_forward_target"] = ctes(SUPP) + f"SELECT symbol, date, round(lead(close, 3) OVER ({SER}), 3) + 0.0 AS target FROM bars"
ORACLES["w14_split_fraction"] = ctes(SUPP, NUM) + """
SELECT symbol, date, CASE WHEN pos > n - t THEN 'test' WHEN pos > n - t - floor((n - t) * 2e-1) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, floor(n * 2e-1) AS t FROM num)"""
ORACLES["w15_split_date"] = ctes(SUPP, NUM) + """
SELECT symbol, date, CASE WHEN date >= DATE '2000-01-01' THEN 'test' WHEN pos > floor(m * 8e-1) THEN 'val' ELSE 'train' END AS split
FROM num JOIN (SELECT symbol, count_if(date < DATE '2000-01-01') AS m FROM bars GROUP BY 1) USING (symbol)"""
ORACLES["w16_split_ratio"] = ctes(SUPP, NUM) + """
SELECT symbol, date, CAST(a AS BIGINT) AS train_end, CAST(b AS BIGINT) AS val_end, CASE WHEN pos <= a THEN 'train' WHEN pos <= b THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, floor(n * 6e-1) AS a, floor(n * (6e-1 + 2e-1)) AS b FROM num)"""
SIZES = "sizes AS (SELECT symbol, count(*) AS n, ceil(count(*) * 2e-1) AS t FROM bars GROUP BY 1)"
ORACLES["w17_split_random"] = ctes(SUPP, SIZES) + """
SELECT symbol, split, CAST(rows AS BIGINT) AS rows FROM (
  SELECT symbol, unnest(['train', 'val', 'test']) AS split, unnest([n - t - v, v, t]) AS rows FROM (SELECT *, ceil((n - t) * (2e-1 / (6e-1 + 2e-1))) AS v FROM sizes))"""
ORACLES["w17_split_random_two"] = ctes(SUPP, SIZES) + """
SELECT symbol, split, CAST(rows AS BIGINT) AS rows FROM (SELECT symbol, unnest(['train', 'test']) AS split, unnest([n - t, t]) AS rows FROM sizes)"""
ORACLES["w18_expanding_folds"] = ctes(SUPP, NUM) + """
SELECT symbol, CAST(fold AS INTEGER) AS fold, CASE WHEN pos > s THEN 'test' ELSE 'train' END AS role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date
FROM (SELECT *, n - (5 - fold) * (n // 6) AS s, n // 6 AS m FROM num, range(5) t(fold)) WHERE pos <= s + m GROUP BY ALL"""
ORACLES["w19_date_steps"] = ctes(SUPP) + f"SELECT symbol, date, CAST(date - {lag('date')} AS INTEGER) AS step FROM bars"

# ---- sort, limit, top-k, sets ------------------------------------------------------------------------------------

ORACLES["k1_order_limit"] = ctes(SUPP) + f"SELECT symbol, date, {BAR_LIST} FROM bars WHERE symbol = '1' ORDER BY date LIMIT 20"
ORACLES["k2_tail"] = ctes(SUPP, NUM) + f"SELECT symbol, date, {rounded('close')} FROM num WHERE pos > n - 3"
ORACLES["k2_last_row"] = ctes(SUPP, NUM) + f"SELECT symbol, date, {BAR_LIST} FROM num WHERE pos = n"
LOG = "log AS (" + " UNION ALL ".join(
    f"SELECT symbol || '_' || model AS run_id, ascii(symbol) AS at, split || '_{m}' AS key, {m} AS number FROM metrics" for m in METRIC) + ")"
ORACLES["s23_run_log"] = ctes(*FORECAST, METRICS, LOG) + """
SELECT run_id, 'metric' AS kind, key, CAST(NULL AS VARCHAR) AS value, round(number, 2) + 0.0 AS number FROM log
UNION ALL SELECT DISTINCT symbol || '_' || model, 'param', 'config', '{"symbol":"' || symbol || '","model":"' || model || '"}', CAST(NULL AS DOUBLE) FROM metrics"""
ORACLES["k6_best_runs"] = ctes(*FORECAST, METRICS, WIDE) + f"""
SELECT run_id, {r('test_mse', 2)}, {r('test_r2', 6)} FROM (SELECT symbol || '_' || model AS run_id, * FROM wide) ORDER BY test_mse, run_id LIMIT 5"""
ORACLES["k7_search_runs"] = ctes(*FORECAST, METRICS, WIDE) + f"""
SELECT run_id, {r('test_mse', 2)}, {r('val_mae', 3)} FROM (
  SELECT symbol || '_' || model AS run_id, * FROM wide ORDER BY ascii(symbol) DESC, symbol || '_' || model LIMIT 7)"""
ORACLES["x1_union"] = ctes(FLAG) + """
SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1
UNION ALL SELECT DISTINCT event_type, CAST(NULL AS DATE), CAST(NULL AS DATE) FROM events"""
ORACLES["x2_difference"] = ctes(FLAG) + "SELECT symbol, date FROM bars WHERE date < DATE '1998-01-01'"
ORACLES["x3_distinct"] = ctes(FLAG) + "SELECT DISTINCT symbol, CAST(year(date) AS INTEGER) AS year FROM bars"

# ---- validation --------------------------------------------------------------------------------------------------


def finding(check: str, column: str, severity: str, n: str, source: str = "raw") -> str:
    return f"""SELECT dataset, '{check}' AS "check", '{column}' AS "column", {severity} AS severity, CAST(n AS BIGINT) AS n
FROM (SELECT dataset, {n} AS n FROM {source} GROUP BY 1) WHERE n > 0"""


ORACLES["v1_empty"] = ctes(SUPP) + """SELECT DISTINCT symbol AS dataset, 'empty' AS "check", 'error' AS severity FROM bars WHERE CAST(symbol AS INTEGER) % 5 = 0"""
ORACLES["v2_columns"] = ctes(*RAW) + """SELECT DISTINCT dataset, 'columns' AS "check", 'note' AS "column", 'warning' AS severity, CAST(1 AS BIGINT) AS n FROM raw"""
ORACLES["v3_types"] = ctes(*RAW) + finding("type", "close", "'error'", "count_if(close_bad)")
ORACLES["v4_missing"] = ctes(*RAW, MISSING) + """
SELECT dataset, 'missing' AS "check", "column", CASE WHEN missing / c * 100 > 10 THEN 'error' ELSE 'warning' END AS severity, CAST(missing AS BIGINT) AS n
FROM missing WHERE missing > 0 AND "column" NOT IN ('volume', 'note')"""
ORACLES["v5_duplicates"] = ctes(*RAW) + finding("duplicates", "date", "'error'", "count(*) - count(DISTINCT date)") + " UNION ALL " + finding(
    "date_range", "date", "'warning'", "max(date) - min(date)")
ORACLES["v6_gaps"] = ctes(*RAW, STEPS) + finding("gaps", "date", "'warning'", "max(gaps)", "gaps")
ORACLES["v7_length"] = ctes(*RAW) + finding("length", "date", "CASE WHEN n / 365.25 < 2 THEN 'error' ELSE 'warning' END", "max(date) - min(date)")
ORACLES["v8_signs"] = ctes(*RAW) + " UNION ALL ".join(
    finding(k, c, f"'{s}'", f"count_if({c} {op} 0)") for c in PRICES for k, s, op in (("negative", "error", "<"), ("zero", "warning", "=")))
def bounds(c: str) -> tuple[str, str]:
    q = {p: f"quantile_cont({c}, {p})" for p in ("1e-2", "25e-2", "75e-2", "99e-2")}
    return (f"{q['1e-2']} - 3 * ({q['75e-2']} - {q['25e-2']})", f"{q['99e-2']} + 3 * ({q['75e-2']} - {q['25e-2']})")


def outlier_sql(source: str) -> str:
    lims = ", ".join(f"{bounds(c)[0]} AS {c}_lo, {bounds(c)[1]} AS {c}_hi" for c in PRICES)
    outs = ", ".join(f"count_if({c} > {c}_hi OR {c} < {c}_lo) AS {c}__outliers" for c in PRICES)
    return f"lims AS (SELECT dataset, {lims} FROM {source} GROUP BY 1), outl AS (SELECT dataset, {outs} FROM {source} JOIN lims USING (dataset) GROUP BY 1)"


ORACLES["v9_outliers"] = ctes(*RAW, outlier_sql("raw")) + " UNION ALL ".join(
    finding("outliers", c, "'warning'", f"max({c}__outliers)", "outl") for c in PRICES)
ORACLES["v9_outlier_counts"] = ctes(
    SUPP, "raw AS (SELECT symbol AS dataset, open, high, low, CASE WHEN dayofyear(date) = 100 THEN close * 50 ELSE close END AS close FROM bars)",
    outlier_sql("raw")) + "SELECT * FROM outl"
ORACLES["v10_ohlc"] = ctes(*RAW) + " UNION ALL ".join(
    finding(name, a, "'error'", f"count_if({a} < {b})") for name, (a, b) in STRUCTURE.items())
ORACLES["v10_bad_rows"] = ctes(*RAW) + "SELECT * FROM (SELECT dataset, CASE " + " ".join(
    f"WHEN {a} < {b} THEN '{name}'" for name, (a, b) in STRUCTURE.items()) + " END AS relation, count(*) AS rows FROM raw GROUP BY ALL) WHERE relation IS NOT NULL"
JUDGED = """judged AS (SELECT dataset, (negative > 0)::BIGINT + (lc > 0)::BIGINT + (hc > 0)::BIGINT + (days / 365.25 < 2)::BIGINT AS errors, days, negative, c FROM valid)"""
ORACLES["v11_verdicts"] = ctes(SUPP, BAD_SUPP, VALID, JUDGED) + "SELECT dataset, errors, errors = 0 AS is_valid FROM judged"
ORACLES["v11_totals"] = ctes(SUPP, BAD_SUPP, VALID, JUDGED) + "SELECT count(*) AS datasets, count_if(errors = 0) AS passed, count_if(errors > 0) AS failed FROM judged"
ORACLES["v11_fail_fast"] = ctes(SUPP, BAD_SUPP, VALID) + """
SELECT dataset, negative = 0 AND days >= 730 AS passed, CASE WHEN negative > 0 THEN 'negative' WHEN days < 730 THEN 'length' END AS failed_check,
  CASE WHEN negative > 0 THEN 'close' WHEN days < 730 THEN 'date' END AS failed_column,
  CAST(CASE WHEN negative > 0 THEN negative WHEN days < 730 THEN days END AS BIGINT) AS n FROM valid"""
ORACLES["v11_fail_fast_faulty"] = ctes(*RAW) + """
SELECT dataset, FALSE AS passed, CASE WHEN bad > 0 THEN 'type' WHEN gone > 0 THEN 'missing' ELSE 'negative' END AS failed_check,
  CASE WHEN bad > 0 THEN 'close' WHEN gone > 0 THEN 'open' ELSE 'close' END AS failed_column, CASE WHEN bad > 0 THEN bad WHEN gone > 0 THEN gone ELSE neg END AS n
FROM (SELECT dataset, count_if(close_bad) AS bad, count_if(open IS NULL) AS gone, count_if(close < 0) AS neg FROM raw GROUP BY 1)"""
ORACLES["v12_metric_input"] = ctes(FLAG, NUM, PAIRS) + ALIGN.format(extra=", 'incompatible_lengths' AS reason")

# ---- preparation and ensembles -----------------------------------------------------------------------------------


def outlier_replace_sql(threshold: str, where: str) -> str:
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s, median({c}) AS {c}_d" for c in PREPARED)
    out = ", ".join(r(f"CASE WHEN abs(({c} - {c}_m) / nullif({c}_s, 0)) > {threshold} THEN {c}_d ELSE {c} END", 2 if c == "price_volume" else 3 if c.startswith("MACD") else 4, c) for c in PREPARED)
    return ctes(*feats(), EMA, F3, ROWS3) + f", stats AS (SELECT symbol, {stats} FROM rows_ WHERE {where} GROUP BY 1) SELECT symbol, date, split, {out} FROM rows_ JOIN stats USING (symbol)"


ORACLES["m1_outliers"] = outlier_replace_sql("3", "TRUE")
ORACLES["m1_outliers_train"] = outlier_replace_sql("2", "split = 'train'")
ORACLES["m2_standard_scaler"] = scaled_sql(PREPARED, "avg({c})", "stddev_pop({c})", digits=4)
ORACLES["m3_minmax_scaler"] = scaled_sql(PREPARED, "min({c})", "max({c}) - min({c})", digits=4)
ORACLES["m4_robust_scaler"] = scaled_sql(PREPARED, "quantile_cont({c}, 5e-1)", "quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2)", digits=4)
ORACLES["m6_preprocess"] = ctes(FLAG, NUM, f"f2 AS (SELECT *, lead(close) OVER ({SER}) AS target FROM num)", ROWS2) + "SELECT symbol, split, count(*) AS rows, CAST(50 AS BIGINT) AS features FROM rows_ GROUP BY 1, 2"
ORACLES["m17_ensemble_weights"] = ctes(*FORECAST, WEIGHTS) + "SELECT symbol, model, round(weight, 6) + 0.0 AS weight FROM weights"
ORACLES["m17_equal_weights"] = ctes(*FORECAST) + "SELECT DISTINCT symbol, model, 25e-2 AS weight FROM preds WHERE split = 'val'"
ORACLES["m18_model_predictions"] = ctes(*FORECAST) + f"SELECT symbol, date, model, {rounded('prediction')} FROM preds"
ORACLES["m19_ensemble"] = ctes(*FORECAST, WEIGHTS, combined("(SELECT * FROM preds WHERE split = 'test')")) + f"""
SELECT symbol, date, {r('predicted_value', 3)}, {r('predicted_value - 1.96 * sd', 3, 'confidence_lower')}, {r('predicted_value + 1.96 * sd', 3, 'confidence_upper')}, models FROM combined"""
ORACLES["m19_simple_average"] = ctes(*FORECAST) + f"""
SELECT symbol, date, {r('avg(prediction)', 3, 'predicted_value')}, {r('avg(prediction) - 1.96 * stddev_pop(prediction)', 3, 'confidence_lower')},
  {r('avg(prediction) + 1.96 * stddev_pop(prediction)', 3, 'confidence_upper')}, count(*) AS models FROM preds WHERE split = 'test' GROUP BY 1, 2"""
ORACLES["m21_next_value"] = ctes(*FORECAST, WEIGHTS, "asked AS (" + " UNION ALL ".join(
    f"SELECT symbol, date, '{m}' AS model, {c} AS prediction FROM f3 WHERE pos = n" for m, c in FORECASTERS.items()) + ")", combined("asked")) + f"""
SELECT symbol, CAST(date + 1 AS DATE) AS timestamp, {r('predicted_value', 3)}, CAST(NULL AS DOUBLE) AS actual_value, {r('predicted_value - 1.96 * sd', 3, 'confidence_lower')},
  {r('predicted_value + 1.96 * sd', 3, 'confidence_upper')}, 'ensemble' AS model_used, 1 AS prediction_horizon FROM combined"""
ORACLES["m22_chart_series"] = ctes(FLAG, NUM) + f"""
SELECT symbol, date, pos, CASE WHEN pos <= a THEN 'train' WHEN pos <= b THEN 'val' ELSE 'test' END AS split, CAST(a AS BIGINT) AS train_end, CAST(b AS BIGINT) AS val_end,
  {rounded('close')}, {r('target', 3, 'actual')}, {r('m', 3, 'prediction')}
FROM (SELECT *, lead(close) OVER ({SER}) AS target, {full('avg', 'close', 5)} AS m, floor((n - 1) * 6e-1) AS a, floor((n - 1) * (6e-1 + 2e-1)) AS b FROM num) WHERE target IS NOT NULL"""
ORACLES["m23_split_rule"] = ctes(SUPP, NUM) + " UNION ALL ".join(f"""
SELECT CASE WHEN pos <= floor(n * {a}) THEN 'train' WHEN pos <= floor(n * ({a} + {b})) THEN 'val' ELSE 'test' END AS split, count(*) AS rows, '{name}' AS rule FROM num GROUP BY 1"""
    for name, a, b in (("over", "6e-1", "2e-1"), ("under", "5e-1", "2e-1")))
ORACLES["s19_prediction_sink"] = ctes(*BACKTEST) + """
SELECT symbol, count(*) AS rows, round(avg(predicted_value), 3) + 0.0 AS mean, count(*) AS in_sidecar FROM result GROUP BY 1"""
ORACLES["s20_experiment_sink"] = "SELECT DISTINCT 'exp_1' AS experiment_id, l_returnflag AS symbol, CAST(4 AS BIGINT) AS models FROM lineitem"
ORACLES["s21_metrics_sink"] = ctes(FLAG, NUM, PAIRS) + f"SELECT dataset, {pair_metrics('mape', 'r2')}, '2024-01-01 00:00:00' AS run_ts FROM pairs GROUP BY 1"
ORACLES["u3_objective"] = ctes(FLAG, NUM, f"""told AS (
  SELECT symbol, target, CASE WHEN pos <= floor((n - 1) * 6e-1) THEN 'train' WHEN pos <= floor((n - 1) * (6e-1 + 2e-1)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, lead(close) OVER ({SER}) AS target FROM num) WHERE target IS NOT NULL)""") + """
SELECT symbol, 1e12 AS alpha, round(-avg(abs(target - m) / greatest(abs(target), 2.220446049250313e-16)), 6) + 0.0 AS score
FROM told JOIN (SELECT symbol, avg(target) AS m FROM told WHERE split = 'train' GROUP BY 1) USING (symbol) WHERE split = 'val' GROUP BY symbol"""
SPLIT_ROWS = (FLAG, NUM, f"f2 AS (SELECT *, lead(close) OVER ({SER}) AS target FROM num)", ROWS2)
TYPES = "(VALUES ('decision_tree'), ('random_forest'), ('xgboost'), ('lasso')) m(model)"
ORACLES["m15_train_all"] = ctes(*SPLIT_ROWS) + f"""
SELECT symbol, model, split, count(*) AS rows, CASE WHEN split = 'train' AND model IN ('decision_tree', 'lasso') THEN round(avg(target), 2) + 0.0 END AS mean,
  TRUE AS inside_train FROM rows_, {TYPES} GROUP BY symbol, model, split"""
ORACLES["s22_model_sink"] = ctes(*SPLIT_ROWS) + f"SELECT symbol, model, split, count(*) AS rows, count(*) AS same FROM rows_, {TYPES} GROUP BY ALL"
ORACLES["u2_model_factory"] = ctes(*SPLIT_ROWS) + f"""
SELECT symbol, model, count(*) AS rows, TRUE AS tree_repeats, TRUE AS inside_train FROM rows_, {TYPES} WHERE split = 'train' GROUP BY ALL"""
ORACLES["k8_importance_totals"] = ctes(FLAG) + f"""
SELECT DISTINCT symbol, model, CAST(50 AS BIGINT) AS features, CASE model WHEN 'lasso' THEN 0.0 ELSE 1.0 END AS total, TRUE AS none_negative FROM bars, {TYPES}"""
ORACLES["s2_files_of_three_headers"] = ctes(SUPP) + """
SELECT symbol AS dataset, count(*) AS rows, count(*) AS n_date, CASE k WHEN 2 THEN 0 ELSE count(*) END AS n_open, count(*) AS n_close,
  CASE k WHEN 1 THEN 0 ELSE count(*) END AS n_volume, CASE k WHEN 1 THEN count(*) ELSE 0 END AS n_note,
  CASE k WHEN 0 THEN 'close,date,high,low,marketcap,name,open,sno,symbol,volume' WHEN 1 THEN 'close,date,high,low,name,note,open,sno,symbol'
    ELSE 'close,date,high,low,marketcap,name,sno,symbol,volume' END AS columns
FROM (SELECT *, CAST(symbol AS INTEGER) % 3 AS k FROM bars) GROUP BY symbol, k"""
ORACLES["v2_columns_of_each_file"] = ctes(SUPP) + """
SELECT symbol AS dataset, c AS "column", CASE c WHEN 'open' THEN 'error' ELSE 'warning' END AS severity,
  CASE c WHEN 'open' THEN 'Missing required column: ' ELSE 'Unexpected column: ' END || c AS message
FROM (SELECT DISTINCT symbol, CAST(symbol AS INTEGER) % 3 AS k FROM bars),
  (VALUES ('sno', 0), ('sno', 1), ('sno', 2), ('name', 0), ('name', 1), ('name', 2), ('symbol', 0), ('symbol', 1), ('symbol', 2), ('marketcap', 0), ('marketcap', 2),
    ('note', 1), ('open', 2)) v(c, of) WHERE of = k"""
ORACLES["s11_import_of_three_headers"] = ctes(SUPP) + """
SELECT symbol, CASE WHEN max(CAST(symbol AS INTEGER) % 3) = 2 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN max(CAST(symbol AS INTEGER) % 3) = 2 THEN 0 ELSE count(*) END AS records_processed,
  nullif(CASE WHEN max(CAST(symbol AS INTEGER) % 3) = 2 THEN count_if(date < DATE '1996-01-01') ELSE count(*) END, 0) AS stored FROM bars GROUP BY symbol"""
ORACLES["m12_trial_counts"] = ctes(FLAG) + f"""
SELECT DISTINCT symbol, model, CAST(25 AS BIGINT) AS trials, CAST(25 AS BIGINT) AS numbers, CAST(25 AS BIGINT) AS scored, FALSE AS positive FROM bars, {TYPES}"""
ORACLES["m11_defaults_and_boxes"] = ctes(FLAG) + """
SELECT DISTINCT symbol, p.* FROM bars, (VALUES
  ('decision_tree', 'max_depth', 10.0, 3.0, 20.0, 2.0, 20.0), ('decision_tree', 'min_samples_split', 5, 2, 20, 2, 20), ('decision_tree', 'min_samples_leaf', 2, 1, 10, 1, 20),
  ('random_forest', 'n_estimators', 100, 50, 200, 10, 200), ('random_forest', 'max_depth', 10, 3, 20, 2, 20), ('random_forest', 'min_samples_split', 5, 2, 20, 2, 20),
  ('random_forest', 'min_samples_leaf', 2, 1, 10, NULL, NULL), ('xgboost', 'n_estimators', 100, 50, 200, 10, 200), ('xgboost', 'max_depth', 6, 3, 10, 2, 10),
  ('xgboost', 'learning_rate', 0.1, 0.01, 0.3, 0.01, 0.3), ('xgboost', 'subsample', 0.8, 0.6, 1, NULL, NULL), ('xgboost', 'colsample_bytree', 0.8, 0.6, 1, NULL, NULL),
  ('lasso', 'alpha', 1, 0.001, 10, 0.001, 10), ('lasso', 'max_iter', 1000, NULL, NULL, 100, 5000), ('lasso', 'tol', 0.0001, NULL, NULL, 0.0001, 0.01)
) p(model, parameter, value, low, high, validation_low, validation_high)"""
ASKED = """asked AS (
  SELECT e.symbol, CAST(d AS DATE) AS date, b.close AS actual_value
  FROM (SELECT symbol, unnest(generate_series(max(date) - 29, max(date), INTERVAL 1 DAY)) AS d FROM bars GROUP BY 1) e
  LEFT JOIN bars b ON b.symbol = e.symbol AND b.date = CAST(d AS DATE) + 1
  WHERE (SELECT count(*) FROM bars x WHERE x.symbol = e.symbol AND x.date < e.d) >= 7)"""
ORACLES["m20_backtest_models"] = ctes(FLAG, ASKED) + f"""
SELECT symbol, date AS timestamp, {rounded('actual_value')}, 'ensemble' AS model_used, 1 AS prediction_horizon, TRUE AS inside_band, TRUE AS error_if_actual,
  FALSE AS wrong_error FROM asked"""
ORACLES["m24_pipeline"] = ctes(FLAG, ASKED) + """
SELECT symbol, count(DISTINCT symbol) AS symbols, 4 * count(DISTINCT symbol) AS models, count(*) AS total_predictions, count(actual_value) AS predictions_with_actuals,
  symbol IS NOT NULL AS best_is_known, TRUE AS scored FROM asked GROUP BY ROLLUP (symbol)"""
for _query, _model in (("m7_train_means", "decision_tree"), ("m10_train_means", "lasso")):
    ORACLES[_query] = ctes(FLAG, NUM, f"f2 AS (SELECT *, lead(close) OVER ({SER}) AS target FROM num)", ROWS2) + f"""
SELECT symbol, '{_model}' AS model, count(*) AS rows, round(avg(target), 2) + 0.0 AS mean_prediction FROM rows_ WHERE split = 'train' GROUP BY 1"""
