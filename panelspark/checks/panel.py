"""Queries of rolling primitives and technical indicators over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import indicators as ind
from ..operators.scan import alpha_of, ewm
from ..sources.views import bars, near
from . import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Columns of each query besides ticker and date.
SHOWN: dict = {}


def _add(name: str, make, cols: list[str], ctes: list[str], last: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(bars(spark, sf_dir))
        return out.select("secid", "date", *[near(c, 4).alias(c) for c in cols])

    QUERIES[name], SHOWN[name] = run, cols
    ORACLE_SQL[name] = "WITH RECURSIVE " + ",\n".join([sql.BARS, *ctes]) + "\n" + sql.shown(cols, last)


def _with(name: str, source: str, cols: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f'{e} AS "{c}"' for c, e in cols.items()) + f" FROM {source})"


def _join(name: str, left: str, right: str) -> str:
    return f"{name} AS (SELECT * FROM {left} JOIN {right} USING (secid, date))"


F5 = sql.full
_safe = lambda a, b: f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"
_TP = "((high + low + close) / 3)"
_TR = f"(CASE WHEN {sql.lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {sql.lag('close')}), abs(low - {sql.lag('close')})) END)"
_UP, _DOWN = f"(high - {sql.lag('high')})", f"({sql.lag('low')} - low)"
_FLOW = _safe("(close - low) - (high - close)", "high - low") + " * volume"
_STRENGTH = "CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN up > 0 THEN 100 END"


def _many_rolling(df: DataFrame) -> DataFrame:
    return ind.rollings(df, *[("close", 10, fn, None) for fn in ("mean", "sum", "min", "max", "std")], ("volume", 7, "mean", 1))


_add("rolling_windows", _many_rolling, ["close_mean_10", "close_sum_10", "close_min_10", "close_max_10", "close_std_10", "volume_mean_7"], [_with("o", "bars", {f"close_{n}_10": F5("close", 10, f) for n, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))} | {"volume_mean_7": "avg(volume) OVER (PARTITION BY secid ORDER BY date ROWS 6 PRECEDING)"})], "o")
_add("shift_diff_cumsum", lambda d: ind.shifts(d, "close", 3), ["close_lag_3", "close_diff", "close_cumsum"], [_with("o", "bars", {"close_lag_3": sql.lag("close", 3), "close_diff": f"close - {sql.lag('close')}", "close_cumsum": sql.so_far("close")})], "o")
_add("ewm_spans", lambda d: ewm(d, {"e3": ("close", alpha_of(3)), "e200": ("volume", alpha_of(200)), "e14": ("high", 1 / 14)}), ["e3", "e200", "e14"], [sql.ewm("o", "bars", {"e3": ("close", alpha_of(3)), "e200": ("volume", alpha_of(200)), "e14": ("high", 1 / 14)})], "o")
_MA = (5, 10, 20, 50, 200)
_add("moving_averages", ind.moving_averages, [f"{a}_{n}" for a in ("SMA", "EMA") for n in _MA], [sql.ewm("e", "bars", {f"EMA_{n}": ("close", alpha_of(n)) for n in _MA}), _join("j", "bars", "e"), _with("o", "j", {f"SMA_{n}": F5("close", n, "avg") for n in _MA})], "o")
_add("rsi", ind.rsi, ["RSI"], [_with("a", "bars", {"d": f"coalesce(close - {sql.lag('close')}, 0)"}), _with("b", "a", {"g": "greatest(d, 0)", "l": "greatest(-d, 0)"}), _with("c", "b", {"up": F5("g", 14, "avg"), "dn": F5("l", 14, "avg")}), _with("o", "c", {"RSI": _STRENGTH})], "o")
_add("macd", ind.macd, ["MACD", "MACD_Signal", "MACD_Hist"], [sql.ewm("e", "bars", {"f": ("close", alpha_of(12)), "s": ("close", alpha_of(26))}), _with("m", "e", {"MACD": "f - s"}), sql.ewm("g", "m", {"MACD_Signal": ('"MACD"', alpha_of(9))}), _join("j", "m", "g"), _with("o", "j", {"MACD_Hist": '"MACD" - "MACD_Signal"'})], "o")
_add("bollinger", ind.bollinger, ["BB_Middle", "BB_Upper", "BB_Lower", "BB_Width"], [_with("a", "bars", {"BB_Middle": F5("close", 20, "avg"), "sd": F5("close", 20, "stddev_samp")}), _with("b", "a", {"BB_Upper": '"BB_Middle" + 2 * sd', "BB_Lower": '"BB_Middle" - 2 * sd'}), _with("o", "b", {"BB_Width": _safe('"BB_Upper" - "BB_Lower"', '"BB_Middle"')})], "o")
_add("stochastic", ind.stochastic, ["STOCH_K", "STOCH_D"], [_with("a", "bars", {"lo": F5("low", 14, "min"), "hi": F5("high", 14, "max")}), _with("b", "a", {"raw": "100 * " + _safe("close - lo", "hi - lo")}), _with("c", "b", {"STOCH_K": F5("raw", 3, "avg")}), _with("o", "c", {"STOCH_D": F5('"STOCH_K"', 3, "avg")})], "o")
_add("atr", ind.atr, ["ATR"], [_with("a", "bars", {"tr": _TR}), _with("o", "a", {"ATR": F5("tr", 14, "avg")})], "o")
_add("vwap", ind.vwap, ["VWAP"], [_with("a", "bars", {"v": "waprice * volume"}), _with("o", "a", {"VWAP": _safe(F5("v", 20, "sum"), F5("volume", 20, "sum"))})], "o")
_add("obv", ind.obv, ["OBV", "OBV_MA"], [_with("a", "bars", {"v": f"sign(close - {sql.lag('close')}) * volume"}), _with("b", "a", {"OBV": sql.so_far("v")}), _with("o", "b", {"OBV_MA": F5('"OBV"', 20, "avg")})], "o")
_add("williams_r", ind.williams_r, ["Williams_R"], [_with("a", "bars", {"lo": F5("low", 14, "min"), "hi": F5("high", 14, "max")}), _with("o", "a", {"Williams_R": "-100 * " + _safe("hi - close", "hi - lo")})], "o")
_add("momentum", ind.momentum, ["Momentum"], [_with("o", "bars", {"Momentum": f"close - {sql.lag('close', 14)}"})], "o")
_ADX = [_with("a", "bars", {"tr": _TR, "up": _UP, "dn": _DOWN}), _with("b", "a", {"p": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "m": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"}), sql.ewm("e", "b", {"et": ("tr", 1 / 14), "ep": ("p", 1 / 14), "em": ("m", 1 / 14)}), _with("f", "e", {"Plus_DI": "100 * " + _safe("ep", "et"), "Minus_DI": "100 * " + _safe("em", "et")}), _with("g", "f", {"dx": "100 * " + _safe('abs("Plus_DI" - "Minus_DI")', '"Plus_DI" + "Minus_DI"')}), sql.ewm("h", "g", {"ADX": ("dx", 1 / 14)}), _join("o", "g", "h")]
_add("adx", ind.adx, ["Plus_DI", "Minus_DI", "ADX"], _ADX, "o")
_add("mfi", ind.mfi, ["MFI"], [_with("a", "bars", {"tp": _TP}), _with("b", "a", {"d": f"tp - {sql.lag('tp')}"}), _with("c", "b", {"i": "CASE WHEN d > 0 THEN tp * volume ELSE 0 END", "u": "CASE WHEN d < 0 THEN tp * volume ELSE 0 END"}), _with("e", "c", {"up": F5("i", 14, "sum"), "dn": F5("u", 14, "sum")}), _with("o", "e", {"MFI": _STRENGTH})], "o")
_add("pvo", ind.pvo, ["PVO", "PVO_Signal", "PVO_Hist"], [sql.ewm("e", "bars", {"f": ("volume", alpha_of(12)), "s": ("volume", alpha_of(26))}), _with("m", "e", {"PVO": "100 * " + _safe("f - s", "s")}), sql.ewm("g", "m", {"PVO_Signal": ('"PVO"', alpha_of(9))}), _join("j", "m", "g"), _with("o", "j", {"PVO_Hist": '"PVO" - "PVO_Signal"'})], "o")
_AD = [_with("a", "bars", {"fl": _FLOW}), _with("b", "a", {"Chaikin_AD": sql.so_far("fl")})]
_add("chaikin_ad", ind.chaikin_ad, ["Chaikin_AD"], _AD, "b")
_add("chaikin_oscillator", ind.chaikin_osc, ["Chaikin_Oscillator"], [*_AD, sql.ewm("e", "b", {"f": ('"Chaikin_AD"', alpha_of(3)), "s": ('"Chaikin_AD"', alpha_of(10))}), _with("o", "e", {"Chaikin_Oscillator": "f - s"})], "o")
_add("cci", ind.cci, ["CCI"], [_with("a", "bars", {"tp": _TP}), _with("b", "a", {"ma": F5("tp", 20, "avg")}), _with("c", "b", {"off": "abs(tp - ma)"}), _with("d", "c", {"md": F5("off", 20, "avg")}), _with("o", "d", {"CCI": _safe("tp - ma", "0.015 * md")})], "o")
_add("emv", ind.emv, ["EMV"], [_with("a", "bars", {"m": "(high + low) / 2"}), _with("b", "a", {"e": _safe(f"(m - {sql.lag('m')}) * (high - low)", "volume / 10000.0")}), _with("o", "b", {"EMV": F5("e", 14, "avg")})], "o")
_add("ad_line", ind.ad_line, ["AD_Line"], [_with("a", "bars", {"fl": f"CASE WHEN NOT (high = low AND close = high) THEN coalesce({_FLOW}, 0) END"}), _with("o", "a", {"AD_Line": sql.so_far("fl")})], "o")
_add("bull_bear_power", ind.bull_bear, ["Bull_Power", "Bear_Power"], [sql.ewm("e", "bars", {"x": ("close", alpha_of(13))}), _join("j", "bars", "e"), _with("o", "j", {"Bull_Power": "high - x", "Bear_Power": "low - x"})], "o")
_T = alpha_of(20)
_add("tema", ind.tema, ["TEMA"], [sql.ewm("e", "bars", {"e1": ("close", _T)}), sql.ewm("g", "e", {"e2": ("e1", _T)}), sql.ewm("h", "g", {"e3": ("e2", _T)}), _join("j", "e", "g"), _join("k", "j", "h"), _with("o", "k", {"TEMA": "3 * e1 - 3 * e2 + e3"})], "o")
_add("sma_min_periods", lambda d: ind.sma_min1(d, ("close",)), [f"close_SMA_{n}" for n in (1, 3, 7, 30, 180)], [_with("o", "bars", {f"close_SMA_{n}": f"avg(close) OVER (PARTITION BY secid ORDER BY date ROWS {n - 1} PRECEDING)" for n in (1, 3, 7, 30, 180)})], "o")


_PARTS = ("moving_averages", "rsi", "macd", "bollinger", "stochastic", "atr", "vwap", "obv", "williams_r", "momentum", "adx", "mfi", "pvo", "chaikin_ad", "chaikin_oscillator", "cci", "emv", "ad_line", "bull_bear_power", "tema")
FEATURES = [c for name in _PARTS for c in SHOWN[name]]
FEATURES_SQL = "SELECT * FROM " + " JOIN ".join(f"({ORACLE_SQL[name]}) {name}_part" + (" USING (secid, date)" if i else "") for i, name in enumerate(_PARTS))


def technical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators in one panel, rounded as in the queries of each."""
    out = ind.technical_features(bars(spark, sf_dir))
    return out.select("secid", "date", *[near(c, 4).alias(c) for c in FEATURES])


QUERIES["technical_features"] = technical_features
ORACLE_SQL["technical_features"] = FEATURES_SQL
