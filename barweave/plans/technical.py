"""Queries: technical indicators over weekly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import base_features as bf, events as ev, indicators as ti, recurrences as rc
from barweave.plans.context import guard
from barweave.plans.registry import query, rounded
from barweave.plans.sqlparts import WEEKLY, ewm, recursive, wilder, wilder_inputs, with_
from barweave.sources.demo import weekly_bars

W = "(PARTITION BY symbol ORDER BY datetime)"
NUMBERED = f"seq AS (SELECT *, row_number() OVER {W} AS i, (high + low + close) / 3 AS tp, lag(close) OVER {W} AS pc FROM bars)"
RUN = "(PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"


def last(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY datetime ROWS {n - 1} PRECEDING)"


def wma_sql(n: int, x: str = "close") -> str:
    """Weighted mean spelled out lag by lag for short windows, over a list for long ones."""
    return (
        f"CASE WHEN count({x}) OVER {last(n)} >= {n} THEN list_sum(list_transform(list({x}) OVER {last(n)}, lambda v, k : v * k)) / {n * (n + 1) / 2} END"
    )


SMA_NAMES = " ".join(f"sma_{n}" for n in ti.AVERAGE_BARS)
WMA_NAMES = " ".join(f"wma_{n}" for n in ti.AVERAGE_BARS)


@query("t1_t3_sma_wma", f"symbol:i datetime:t {rounded(SMA_NAMES + ' ' + WMA_NAMES, 'd4')}", with_(WEEKLY, select="SELECT symbol, datetime, " + ", ".join(
    f"{guard('avg(close)', 'close', n, n)} AS sma_{n}, {wma_sql(n)} AS wma_{n}" for n in ti.AVERAGE_BARS) + " FROM bars"))
def sma_wma(spark, folder):
    return ti.add_moving_averages(weekly_bars(spark, folder), hull=())


@query("t27_hull", "symbol:i datetime:t hma_21:d4 hma_55:d4", with_(WEEKLY,
       f"h AS (SELECT symbol, datetime, 2 * ({wma_sql(10)}) - ({wma_sql(21)}) AS a, 2 * ({wma_sql(27)}) - ({wma_sql(55)}) AS b FROM bars)",
       select=f"SELECT symbol, datetime, {wma_sql(4, 'a')} AS hma_21, {wma_sql(7, 'b')} AS hma_55 FROM h"))
def hull(spark, folder):
    return ti.add_moving_averages(weekly_bars(spark, folder), lengths=())


EMA_REC = recursive("emas", "seq", {f"e{n}": ewm("close", f"e{n}", 2.0 / (n + 1)) for n in ti.AVERAGE_BARS})


@query("t2_ema", "symbol:i datetime:t " + rounded(" ".join(f"ema_{n}" for n in ti.AVERAGE_BARS), "d4"),
       with_(WEEKLY, NUMBERED, EMA_REC, rec=True, select="SELECT symbol, datetime, " + ", ".join(
           f"CASE WHEN i >= {n} THEN e{n} END AS ema_{n}" for n in ti.AVERAGE_BARS) + " FROM emas"))
def exponential(spark, folder):
    return rc.add_recurrences(weekly_bars(spark, folder), ("averages",))


@query("b11_ma_distance", "symbol:i datetime:t dist_sma_20:d dist_wma_20:d dist_ema_20:d dist_hma_21:d",
       with_(WEEKLY, NUMBERED, recursive("emas", "seq", {"e20": ewm("close", "e20", 2.0 / 21)}), f"""
       h AS (SELECT *, 2 * ({wma_sql(10)}) - ({wma_sql(21)}) AS a, {guard('avg(close)', 'close', 20, 20)} AS s, {wma_sql(20)} AS w FROM emas)""",
       rec=True, select=f"""SELECT symbol, datetime, (close - s) / s AS dist_sma_20, (close - w) / w AS dist_wma_20,
       CASE WHEN i >= 20 THEN (close - e20) / e20 END AS dist_ema_20, (close - ({wma_sql(4, 'a')})) / ({wma_sql(4, 'a')}) AS dist_hma_21 FROM h"""))
def ma_distance(spark, folder):
    frame = rc.add_recurrences(weekly_bars(spark, folder), ("averages",))
    return bf.add_distances(ti.add_moving_averages(frame, (20,), (21,)))


def rsi_value(n: int) -> str:
    return f"CASE WHEN i >= {n} THEN CASE WHEN d{n} = 0 THEN 100 ELSE 100 - 100 / (1 + u{n} / d{n}) END END"


RSI_SRC = "steps AS (SELECT *, coalesce(greatest(close - pc, 0), 0) AS gain, coalesce(greatest(pc - close, 0), 0) AS loss FROM seq)"
RSI_REC = recursive(
    "rsis", "steps",
    {f"{k}{n}": ewm(x, f"{k}{n}", 1.0 / n) for n in ti.OSCILLATOR_BARS for k, x in (("u", "gain"), ("d", "loss"))},
)


@query("t4_t9_rsi", "symbol:i datetime:t " + rounded("rsi_7 rsi_14 rsi_21 stochrsi_14 stochrsi_k_14 stochrsi_d_14", "d5"),
       with_(WEEKLY, NUMBERED, RSI_SRC, RSI_REC,
             "v AS (SELECT symbol, datetime, " + ", ".join(f"{rsi_value(n)} AS rsi_{n}" for n in ti.OSCILLATOR_BARS) + " FROM rsis)",
             f"""q AS (SELECT *, (rsi_14 - {guard('min(rsi_14)', 'rsi_14', 14, 14)}) / nullif({guard('max(rsi_14)', 'rsi_14', 14, 14)} - {guard('min(rsi_14)', 'rsi_14', 14, 14)}, 0) AS stochrsi_14 FROM v)""",
             f"k AS (SELECT *, {guard('avg(stochrsi_14)', 'stochrsi_14', 3, 3)} AS stochrsi_k_14 FROM q)",
             rec=True, select=f"SELECT *, {guard('avg(stochrsi_k_14)', 'stochrsi_k_14', 3, 3)} AS stochrsi_d_14 FROM k"))
def rsi(spark, folder):
    return ti.add_stoch_rsi(rc.add_recurrences(weekly_bars(spark, folder), ("momentum",)))


def cci_sql(n: int) -> str:
    mean = f"avg(tp) OVER {last(n)}"
    return f"CASE WHEN count(tp) OVER {last(n)} >= {n} THEN [tp - {mean}, {mean}] END AS m{n}, list(tp) OVER {last(n)} AS l{n}"


@query("t5_t8_oscillators", "symbol:i datetime:t " + rounded("cci_7 cci_14 cci_21 roc_7 roc_14 roc_21 willr_7 willr_14 willr_21 stoch_k_14 stoch_d_14", "d4"),
       with_(WEEKLY, NUMBERED, "o AS (SELECT *, " + ", ".join(
           f"{cci_sql(n)}, 100 * (close / lag(close, {n}) OVER {W} - 1) AS roc_{n}, CASE WHEN count(high) OVER {last(n)} >= {n} THEN "
           f"-100 * (max(high) OVER {last(n)} - close) / nullif(max(high) OVER {last(n)} - min(low) OVER {last(n)}, 0) END AS willr_{n}" for n in ti.OSCILLATOR_BARS)
           + f""", CASE WHEN count(high) OVER {last(14)} >= 14 THEN 100 * (close - min(low) OVER {last(14)}) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0) END AS stoch_k_14 FROM seq)""",
           select="SELECT *, " + ", ".join(
           f"m{n}[1] / nullif(0.015 * list_avg(list_transform(l{n}, lambda x : abs(x - m{n}[2]))), 0) AS cci_{n}" for n in ti.OSCILLATOR_BARS)
           + f", {guard('avg(stoch_k_14)', 'stoch_k_14', 3, 3)} AS stoch_d_14 FROM o"))
def oscillators(spark, folder):
    return ti.add_oscillators(weekly_bars(spark, folder))


FAST_REC = recursive("base", "seq", {
    "f": ewm("close", "f", 2.0 / 13), "s": ewm("close", "s", 2.0 / 27), "t1": ewm("close", "t1", 2.0 / 16)})
MACD_SRC = """
macd0 AS (SELECT *, CASE WHEN i >= 26 THEN f - s END AS macd, CASE WHEN i >= 26 THEN (f - s) / s * 100 END AS ppo, CASE WHEN i >= 15 THEN t1 END AS x1 FROM base)"""
SIG_REC = recursive("sig", "macd0", {
    "ms": ewm("macd", "ms", 0.2), "ps": ewm("ppo", "ps", 0.2), "t2": ewm("x1", "t2", 2.0 / 16)})
TRIX_SRC = "trix0 AS (SELECT *, CASE WHEN i >= 29 THEN t2 END AS x2 FROM sig)"
TRIX_REC = recursive("trix1", "trix0", {"t3": ewm("x2", "t3", 2.0 / 16)})


@query("t10_t12_macd_ppo_trix", "symbol:i datetime:t macd_12_26:d4 macd_signal_9:d4 macd_diff_9:d4 ppo_12_26:d5 ppo_signal_9:d5 ppo_hist_9:d5 trix_15:d5",
       with_(WEEKLY, NUMBERED, FAST_REC, MACD_SRC, SIG_REC, TRIX_SRC, TRIX_REC, "tr AS (SELECT *, CASE WHEN i >= 43 THEN t3 END AS x3 FROM trix1)", rec=True, select=f"""
       SELECT symbol, datetime, macd AS macd_12_26, CASE WHEN i >= 34 THEN ms END AS macd_signal_9, CASE WHEN i >= 34 THEN macd - ms END AS macd_diff_9,
              ppo AS ppo_12_26, CASE WHEN i >= 34 THEN ps END AS ppo_signal_9, CASE WHEN i >= 34 THEN ppo - ps END AS ppo_hist_9,
              (x3 / lag(x3) OVER {W} - 1) * 100 AS trix_15 FROM tr"""))
def momentum(spark, folder):
    return rc.add_recurrences(weekly_bars(spark, folder), ("momentum",))


@query("t13_kst", "symbol:i datetime:t kst:d4 kst_signal:d4", with_(WEEKLY,
       "r AS (SELECT *, " + ", ".join(f"close / lag(close, {n}) OVER {W} - 1 AS r{n}" for n in (10, 15, 20, 30)) + " FROM bars)",
       f"""k AS (SELECT symbol, datetime, 100 * ({guard('avg(r10)', 'r10', 10, 10)} + 2 * ({guard('avg(r15)', 'r15', 10, 10)})
            + 3 * ({guard('avg(r20)', 'r20', 10, 10)}) + 4 * ({guard('avg(r30)', 'r30', 15, 15)})) AS kst FROM r)""",
       select=f"SELECT *, {guard('avg(kst)', 'kst', 9, 1)} AS kst_signal FROM k"))
def kst(spark, folder):
    return ti.add_kst(weekly_bars(spark, folder))


TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
ATR_SRC = f"trs0 AS (SELECT *, {TR} AS tr FROM seq), trs AS (SELECT *, {wilder_inputs('tr', 14)} FROM trs0)"
ATR_REC = recursive("atrs", "trs", {"atr": wilder("tr", "atr", 14)})


@query("t14_atr", "symbol:i datetime:t atr_14:d4 natr_14:d",
       with_(WEEKLY, NUMBERED, ATR_SRC, ATR_REC, rec=True, select="SELECT symbol, datetime, atr AS atr_14, atr / close AS natr_14 FROM atrs"))
def atr(spark, folder):
    return rc.add_recurrences(weekly_bars(spark, folder), ("ranges",))


ADX_SRC = f"""
dm0 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN {TR} END AS tr, high - lag(high) OVER {W} AS up, lag(low) OVER {W} - low AS dn FROM seq),
dm1 AS (SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS pd,
               CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS nd FROM dm0),
dm AS (SELECT *, {wilder_inputs('tr', 14)}, {wilder_inputs('pd', 14)}, {wilder_inputs('nd', 14)} FROM dm1)"""
DM_REC = recursive("dms", "dm", {"st": wilder("tr", "st", 14), "sp": wilder("pd", "sp", 14), "sn": wilder("nd", "sn", 14)})
DX = """
dx0 AS (SELECT * EXCLUDE (tr_n, tr_m, pd_n, pd_m, nd_n, nd_m), 100 * sp / st AS adx_pos_14, 100 * sn / st AS adx_neg_14,
               CASE WHEN st IS NOT NULL THEN CASE WHEN sp + sn > 0 THEN 100 * abs(sp - sn) / (sp + sn) ELSE 0 END END AS dx FROM dms),
dx1 AS (SELECT *, """ + wilder_inputs("dx", 14) + " FROM dx0)"
DX_REC = recursive("adxs", "dx1", {"adx_14": wilder("dx", "adx_14", 14)})


@query("t15_adx", "symbol:i datetime:t adx_14:d5 adx_pos_14:d5 adx_neg_14:d5",
       with_(WEEKLY, NUMBERED, ADX_SRC, DM_REC, DX, DX_REC, rec=True, select="SELECT * FROM adxs"))
def adx(spark, folder):
    return rc.add_recurrences(weekly_bars(spark, folder), ("ranges",))


# state per bar: side, pace, level, peak, trough; bars 1 and 2 only seed it
SAR_SRC = f"""
sar0 AS (SELECT *, lag(low) OVER {W} AS l1, lag(low, 2) OVER {W} AS l2, lag(high) OVER {W} AS h1, lag(high, 2) OVER {W} AS h2 FROM seq)"""
SAR_WALK = """
sar AS (
  SELECT symbol, i, 1 AS side, CAST(0.02 AS DOUBLE) AS pace, close AS level, high AS peak, low AS trough, false AS flip FROM sar0 WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN flip THEN -side ELSE side END,
         CASE WHEN i = 2 THEN 0.02 WHEN flip THEN 0.02 WHEN side = 1 AND high > peak THEN least(pace + 0.02, 0.2)
              WHEN side = -1 AND low < trough THEN least(pace + 0.02, 0.2) ELSE pace END,
         CASE WHEN i = 2 THEN close WHEN flip THEN CASE WHEN side = 1 THEN peak ELSE trough END
              WHEN side = 1 THEN CASE WHEN l2 < raw THEN l2 ELSE least(raw, l1) END
              ELSE CASE WHEN h2 > raw THEN h2 ELSE greatest(raw, h1) END END,
         CASE WHEN i = 2 THEN peak WHEN flip THEN CASE WHEN side = -1 THEN high ELSE peak END WHEN side = 1 AND high > peak THEN high ELSE peak END,
         CASE WHEN i = 2 THEN trough WHEN flip THEN CASE WHEN side = 1 THEN low ELSE trough END WHEN side = -1 AND low < trough THEN low ELSE trough END,
         false
  FROM (SELECT *, i > 2 AND CASE WHEN side = 1 THEN low < raw ELSE high > raw END AS flip
        FROM (SELECT s.symbol, s.i, s.close, s.high, s.low, s.l1, s.l2, s.h1, s.h2, r.side, r.pace, r.peak, r.trough,
                     r.level + r.pace * (CASE WHEN r.side = 1 THEN r.peak ELSE r.trough END - r.level) AS raw
              FROM sar r JOIN sar0 s ON s.symbol = r.symbol AND s.i = r.i + 1)))"""


@query("t16_psar", "symbol:i datetime:t psar_up:d4 psar_down:d4", with_(WEEKLY, NUMBERED, SAR_SRC, SAR_WALK, rec=True, select="""
       SELECT s.symbol, s.datetime, CASE WHEN side = 1 AND w.i > 2 THEN level END AS psar_up, CASE WHEN side = -1 AND w.i > 2 THEN level END AS psar_down
       FROM sar0 s JOIN sar w ON s.symbol = w.symbol AND s.i = w.i"""))
def psar(spark, folder):
    return rc.add_recurrences(weekly_bars(spark, folder), ("stops",))


ST_SRC = f"str0 AS (SELECT *, {TR} AS tr FROM seq), str1 AS (SELECT *, {wilder_inputs('tr', 10)} FROM str0)"
ST_ATR = recursive("str2", "str1", {"atr": wilder("tr", "atr", 10)})
ST_WALK = """
st AS (
  SELECT symbol, i, CAST(1 AS DOUBLE) AS side, (high + low) / 2 + 3 * atr AS upper, (high + low) / 2 - 3 * atr AS lower FROM str2 WHERE i = 10
  UNION ALL
  SELECT symbol, i, side, CASE WHEN held AND side < 0 THEN least(u, pu) ELSE u END, CASE WHEN held AND side > 0 THEN greatest(l, pl) ELSE l END
  FROM (SELECT s.symbol, s.i, (high + low) / 2 + 3 * atr AS u, (high + low) / 2 - 3 * atr AS l, r.upper AS pu, r.lower AS pl,
               CASE WHEN close > r.upper THEN 1 WHEN close < r.lower THEN -1 ELSE r.side END AS side, close <= r.upper AND close >= r.lower AS held
        FROM st r JOIN str2 s ON s.symbol = r.symbol AND s.i = r.i + 1))"""


@query("t28_supertrend", "symbol:i datetime:t supertrend_10_3:d4 supertrend_dir_10_3:x", with_(WEEKLY, NUMBERED, ST_SRC, ST_ATR, ST_WALK, rec=True, select="""
       SELECT s.symbol, s.datetime, CASE WHEN w.i > 10 THEN CASE WHEN side > 0 THEN lower ELSE upper END END AS supertrend_10_3,
              CASE WHEN w.i > 10 THEN side END AS supertrend_dir_10_3 FROM str2 s LEFT JOIN st w ON s.symbol = w.symbol AND s.i = w.i"""))
def supertrend(spark, folder):
    return rc.add_recurrences(weekly_bars(spark, folder), ("stops",))


CHANNELS = (
    "bb_mavg_20_2:d4 bb_hband_20_2:d4 bb_lband_20_2:d4 bb_pband_20_2:d5 bb_wband_20_2:d4 kc_mband_20:d4 kc_hband_20:d4 kc_lband_20:d4 "
    "kc_wband_20:d4 donchian_hband_20:x donchian_lband_20:x donchian_mband_20:d4 donchian_wband_20:d4"
)


@query("t17_t19_channels", f"symbol:i datetime:t {CHANNELS}", with_(WEEKLY, NUMBERED, f"""
ch AS (SELECT symbol, datetime, close, count(*) OVER {last(20)} AS n, avg(close) OVER {last(20)} AS m, stddev_pop(close) OVER {last(20)} AS s,
       avg(tp) OVER {last(20)} AS km, avg((4 * high - 2 * low + close) / 3) OVER {last(20)} AS kh, avg((-2 * high + 4 * low + close) / 3) OVER {last(20)} AS kl,
       max(high) OVER {last(20)} AS dh, min(low) OVER {last(20)} AS dl FROM seq)""", select="""
SELECT symbol, datetime, """ + ", ".join(f"CASE WHEN n >= 20 THEN {e} END AS {c}" for c, e in {
    "bb_mavg_20_2": "m", "bb_hband_20_2": "m + 2 * s", "bb_lband_20_2": "m - 2 * s", "bb_pband_20_2": "(close - (m - 2 * s)) / nullif(4 * s, 0)",
    "bb_wband_20_2": "4 * s / m * 100", "kc_mband_20": "km", "kc_hband_20": "kh", "kc_lband_20": "kl", "kc_wband_20": "(kh - kl) / km * 100",
    "donchian_hband_20": "dh", "donchian_lband_20": "dl", "donchian_mband_20": "(dh - dl) / 2 + dl", "donchian_wband_20": "(dh - dl) / m * 100"}.items()) + " FROM ch"))
def channels(spark, folder):
    return ti.add_channels(weekly_bars(spark, folder))


@query("t20_t24_volume", "symbol:i datetime:t obv:d3 pvt:d3 eom_14:d0 mfi_14:d5 cmf_20:d", with_(WEEKLY, NUMBERED, f"""
vv AS (SELECT *, lag(tp) OVER {W} AS ptp, CASE WHEN close < pc THEN -volume ELSE volume END AS sv, (close / pc - 1) * volume AS tv,
       coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS fl,
       ((high - lag(high) OVER {W}) + (low - lag(low) OVER {W})) * (high - low) / (2 * volume) * 100000000 AS eom_14 FROM seq),
v2 AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS dn FROM vv),
v3 AS (SELECT *, {guard('sum(up)', 'up', 14, 14)} AS su, {guard('sum(dn)', 'dn', 14, 14)} AS sd FROM v2)""", select=f"""
SELECT symbol, datetime, sum(sv) OVER {RUN} AS obv, sum(tv) OVER {RUN} AS pvt, eom_14,
       CASE WHEN sd = 0 THEN 100 ELSE 100 - 100 / (1 + su / sd) END AS mfi_14,
       {guard('sum(fl)', 'fl', 20, 20)} / {guard('sum(volume)', 'volume', 20, 20)} AS cmf_20 FROM v3"""))
def volume(spark, folder):
    return ti.add_volume_indicators(weekly_bars(spark, folder))


@query("t25_t26_vortex_ulcer", "symbol:i datetime:t vortex_pos_14:d vortex_neg_14:d ulcer_index_14:d5", with_(WEEKLY, NUMBERED, f"""
vx AS (SELECT *, {TR} AS tr, abs(high - lag(low) OVER {W}) AS vp, abs(low - lag(high) OVER {W}) AS vm,
       (close - max(close) OVER {last(14)}) / max(close) OVER {last(14)} * 100 AS fall FROM seq)""", select=f"""
SELECT symbol, datetime, {guard('sum(vp)', 'vp', 14, 14)} / {guard('sum(tr)', 'tr', 14, 14)} AS vortex_pos_14,
       {guard('sum(vm)', 'vm', 14, 14)} / {guard('sum(tr)', 'tr', 14, 14)} AS vortex_neg_14,
       sqrt({guard('avg(fall * fall)', 'fall', 14, 14)}) AS ulcer_index_14 FROM vx"""))
def vortex_ulcer(spark, folder):
    return ti.add_vortex_ulcer(weekly_bars(spark, folder))


@query("t29_efficiency_entropy", "symbol:i datetime:t efficiency_ratio_10:d entropy_10:d", with_(WEEKLY, NUMBERED, f"""
ee AS (SELECT *, abs(close - pc) AS st, close / ({guard('sum(close)', 'close', 10, 10)}) AS sh FROM seq)""", select=f"""
SELECT symbol, datetime, abs(close - lag(close, 10) OVER {W}) / ({guard('sum(st)', 'st', 10, 10)}) AS efficiency_ratio_10,
       {guard('sum(-sh * ln(sh) / ln(2))', 'sh', 10, 10)} AS entropy_10 FROM ee"""))
def efficiency_entropy(spark, folder):
    return ti.add_efficiency_entropy(weekly_bars(spark, folder))


@query("t30_latest_momentum", "symbol:i bars:i rsi_14:d5 ppo_12_26:d5", with_(WEEKLY, NUMBERED, RSI_SRC, RSI_REC.replace("steps", "steps"),
       recursive("fs", "rsis", {"f": ewm("close", "f", 2.0 / 13), "s": ewm("close", "s", 2.0 / 27)}), rec=True, select=f"""
       SELECT symbol, count(*) AS bars, CASE WHEN count(*) >= 30 THEN arg_max({rsi_value(14)}, i) END AS rsi_14,
              CASE WHEN count(*) >= 30 THEN arg_max((f - s) / s * 100, i) END AS ppo_12_26 FROM fs GROUP BY symbol"""))
def latest_momentum(spark, folder):
    return rc.latest_momentum(weekly_bars(spark, folder))


# state: weighted value and the weight the old value still has after gaps
DECAY_SRC = f"sparse AS (SELECT *, CASE WHEN i % 5 IN (2, 3) THEN close / pc - 1 END AS x FROM seq)"
DECAY_WALK = """
decay AS (
  SELECT symbol, i, x AS y, CAST(1 AS DOUBLE) AS wt FROM sparse WHERE i = 1
  UNION ALL
  SELECT s.symbol, s.i,
         CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x ELSE (r.wt * (1 - 2.0 / 21) * r.y + 2.0 / 21 * s.x) / (r.wt * (1 - 2.0 / 21) + 2.0 / 21) END,
         CASE WHEN s.x IS NULL THEN CASE WHEN r.y IS NULL THEN 1 ELSE r.wt * (1 - 2.0 / 21) END ELSE 1 END
  FROM decay r JOIN sparse s ON s.symbol = r.symbol AND s.i = r.i + 1)"""


@query("e20_surprise_decay", "symbol:i datetime:t earnings_surprise_decay_20:d", with_(WEEKLY, NUMBERED, DECAY_SRC, DECAY_WALK, rec=True, select="""
       SELECT s.symbol, s.datetime, d.y AS earnings_surprise_decay_20 FROM sparse s JOIN decay d ON s.symbol = d.symbol AND s.i = d.i"""))
def surprise_decay(spark, folder):
    from barweave.functions.windows import by_symbol, pct_change

    w = by_symbol()
    bars = weekly_bars(spark, folder).select("symbol", "datetime", "close")
    filled = (F.row_number().over(w) % 5).isin(2, 3)
    sparse = bars.withColumn("earnings_eps_surprise_pct", F.when(filled, pct_change(F.col("close"), w)))
    return rc.add_decay(sparse, "earnings_eps_surprise_pct", "earnings_surprise_decay_20")
