"""Technical indicators over bars ``secid, date, open, high, low, close, volume, waprice``.

Rows of a ticker are taken by date, which must be distinct within a ticker. Rolling values are null
until the window is full of values; a division by zero is null. Every function adds columns to its
input and keeps all others. Bars are laid out once (see ``blocks``): a long ticker is cut into blocks,
windows of fixed length see copies of the rows before their block, and running sums and exponential
means pass on what a block ends with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import in_block, laid_out, reaching, running_sums
from .scan import alpha_of, ewm


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Rows of a window that are read anew for every row, oldest first.
PLAIN_ROWS = 20


class Sliding:
    """Values over the last n rows of a block, long ones by values over short runs of rows.

    A window of more than ``PLAIN_ROWS`` rows is a few short runs that follow each other, so a row costs about twice the
    square root of n steps and not n. Sums add up neighbouring rows only, and counts are differences of
    running counts, so nothing is lost by cancellation. ``parts`` are the columns that must be there.
    """

    def __init__(self) -> None:
        self.parts: dict[str, Column] = {}
        self.names: dict[tuple, str] = {}

    def part(self, key: tuple, value: Column) -> Column:
        name = self.names.setdefault(key, f"_part_{len(self.names)}")
        self.parts[name] = value
        return F.col(name)

    def __call__(self, c: Column | str, n: int, fn: Callable[[Column], Column], least: int | None = None) -> Column:
        """``fn`` over the last n rows of a block, null unless ``least`` (all n) values are there."""
        c, upto = _c(c), in_block().rowsBetween(Window.unboundedPreceding, 0)
        seen = self.part((str(c), "seen"), F.count(c).over(upto))
        count = seen - F.coalesce(before(seen, n), F.lit(0))
        return F.when(count >= (least or n), self._value(c, n, fn, count))

    def _value(self, c: Column, n: int, fn: Callable[[Column], Column], count: Column) -> Column:
        if n <= PLAIN_ROWS or fn not in (F.avg, F.sum, F.min, F.max):
            return fn(c).over(in_block().rowsBetween(1 - n, 0))
        inner = F.sum if fn is F.avg else fn
        run = min((r for r in range(1, n + 1) if n % r == 0), key=lambda r: r + 2 * n // r)
        run = run if run + 2 * n // run <= 4 * n**0.5 + 4 else int(n**0.5)
        short = lambda r: self.part((str(c), inner.__name__, r), inner(c).over(in_block().rowsBetween(1 - r, 0)))
        runs = [before(short(run), i * run) if i else short(run) for i in range(n // run)]
        if n % run:
            runs.append(before(short(n % run), n - n % run))
        if inner is not F.sum:
            return runs[0] if len(runs) == 1 else (F.least if inner is F.min else F.greatest)(*runs)
        total = runs[0]
        for r in runs[1:]:
            total = F.coalesce(total, F.lit(0)) + F.coalesce(r, F.lit(0))
        return total / count if fn is F.avg else total


def before(c: Column | str, k: int = 1) -> Column:
    return F.lag(_c(c), k).over(in_block())


def _fixed(df: DataFrame, reach: int, *stages: dict[str, Column] | Callable[[Sliding], dict[str, Column]]) -> DataFrame:
    """Columns by windows that look back ``reach`` rows in all; a stage may use those before it."""

    def add(d: DataFrame) -> DataFrame:
        for stage in stages:
            full = Sliding()
            columns = stage(full) if callable(stage) else stage
            if full.parts:
                d = d.withColumns(full.parts)
            d = d.withColumns(columns).drop(*full.parts)
        return d

    return reaching(df, reach, add)


@laid_out
def rollings(df: DataFrame, *windows: tuple[str, int, str, int | None]) -> DataFrame:
    """Add ``<col>_<fn>_<n>`` for each ``col, n, fn, min_periods``: mean, sum, min, max or std (sample)
    of n rows with enough values."""
    fns = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return _fixed(df, max(n for _, n, _, _ in windows), lambda full: {f"{c}_{fn}_{n}": full(c, n, fns[fn], least) for c, n, fn, least in windows})


def rolling(df: DataFrame, col: str, n: int, fn: str, min_periods: int | None = None) -> DataFrame:
    """One of ``rollings``."""
    return rollings(df, (col, n, fn, min_periods))


@laid_out
def shifts(df: DataFrame, col: str, k: int) -> DataFrame:
    """Add the value k rows before, the difference to the row before and the running sum (null on null)."""
    df = _fixed(df, max(k, 1), {f"{col}_lag_{k}": before(col, k), f"{col}_diff": F.col(col) - before(col)})
    return running_sums(df, {f"{col}_cumsum": col})


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


@laid_out
def moving_averages(df: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50, 200), price: str = "close") -> DataFrame:
    df = ewm(df, {f"EMA_{n}": (price, alpha_of(n)) for n in periods})
    return _fixed(df, max(periods), lambda full: {f"SMA_{n}": full(price, n, F.avg) for n in periods})


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0)


@laid_out
def rsi(df: DataFrame, period: int = 14, price: str = "close") -> DataFrame:
    d = F.coalesce(F.col(price) - before(price), F.lit(0.0))
    moves = {"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))}
    df = _fixed(df, period, moves, lambda full: {"_up": full("_up", period, F.avg), "_down": full("_down", period, F.avg)})
    return df.withColumn("RSI", _strength(F.col("_up"), F.col("_down"))).drop("_up", "_down")


@laid_out
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    df = ewm(df, {"_fast": (price, alpha_of(fast)), "_slow": (price, alpha_of(slow))}).withColumn("MACD", F.col("_fast") - F.col("_slow"))
    df = ewm(df.drop("_fast", "_slow"), {"MACD_Signal": ("MACD", alpha_of(signal))})
    return df.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))


def _bands(width: float) -> dict[str, Column]:
    upper, lower = (F.col("BB_Middle") + sign * width * F.col("_sd") for sign in (1, -1))
    return {"BB_Upper": upper, "BB_Lower": lower, "BB_Width": ratio(upper - lower, F.col("BB_Middle"))}


@laid_out
def bollinger(df: DataFrame, period: int = 20, width: float = 2.0, price: str = "close") -> DataFrame:
    df = _fixed(df, period, lambda full: {"BB_Middle": full(price, period, F.avg), "_sd": full(price, period, F.stddev_samp)})
    return df.withColumns(_bands(width)).drop("_sd")


def _range(period: int) -> Callable[[Sliding], dict[str, Column]]:
    return lambda full: {"_lo": full("low", period, F.min), "_hi": full("high", period, F.max)}


def _raw_stochastic() -> Column:
    return 100 * ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo"))


@laid_out
def stochastic(df: DataFrame, period: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    stages = _range(period), {"_raw": _raw_stochastic()}, lambda full: {"STOCH_K": full("_raw", smooth_k, F.avg)}, lambda full: {"STOCH_D": full("STOCH_K", smooth_d, F.avg)}
    return _fixed(df, period + smooth_k + smooth_d, *stages).drop("_lo", "_hi", "_raw")


def true_range() -> Column:
    """Null on a ticker's first row, as there is no close before it."""
    p = before("close")
    return F.when(p.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)))


@laid_out
def atr(df: DataFrame, period: int = 14) -> DataFrame:
    return _fixed(df, period, {"_tr": true_range()}, lambda full: {"ATR": full("_tr", period, F.avg)}).drop("_tr")


def _traded(full: Sliding, period: int) -> Column:
    return ratio(full(F.col("waprice") * F.col("volume"), period, F.sum), full("volume", period, F.sum))


@laid_out
def vwap(df: DataFrame, period: int = 20) -> DataFrame:
    return _fixed(df, period, lambda full: {"VWAP": _traded(full, period)})


def _signed_volume() -> Column:
    return F.signum(F.col("close") - before("close")) * F.col("volume")


@laid_out
def obv(df: DataFrame, period: int = 20) -> DataFrame:
    df = running_sums(_fixed(df, 1, {"_v": _signed_volume()}), {"OBV": "_v"}).drop("_v")
    return _fixed(df, period, lambda full: {"OBV_MA": full("OBV", period, F.avg)})


def _williams() -> Column:
    return -100 * ratio(F.col("_hi") - F.col("close"), F.col("_hi") - F.col("_lo"))


@laid_out
def williams_r(df: DataFrame, period: int = 14) -> DataFrame:
    return _fixed(df, period, _range(period)).withColumn("Williams_R", _williams()).drop("_lo", "_hi")


@laid_out
def momentum(df: DataFrame, period: int = 14, price: str = "close") -> DataFrame:
    return _fixed(df, period, {"Momentum": F.col(price) - before(price, period)})


def _directions() -> dict[str, Column]:
    up, down = F.col("high") - before("high"), before("low") - F.col("low")
    move = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(0.0)
    return {"_tr": true_range(), "_pdm": move(up, down), "_mdm": move(down, up)}


def _indices() -> tuple[dict[str, Column], dict[str, Column]]:
    """The two directional indices from smoothed ranges and moves, and their relative difference."""
    plus, minus = F.col("Plus_DI"), F.col("Minus_DI")
    return {"Plus_DI": 100 * ratio(F.col("_ep"), F.col("_etr")), "Minus_DI": 100 * ratio(F.col("_em"), F.col("_etr"))}, {"_dx": 100 * ratio(F.abs(plus - minus), plus + minus)}


@laid_out
def adx(df: DataFrame, period: int = 14) -> DataFrame:
    a = 1.0 / period
    df = ewm(_fixed(df, 1, _directions()), {"_etr": ("_tr", a), "_ep": ("_pdm", a), "_em": ("_mdm", a)})
    for columns in _indices():
        df = df.withColumns(columns)
    return ewm(df.drop("_tr", "_pdm", "_mdm", "_etr", "_ep", "_em"), {"ADX": ("_dx", a)}).drop("_dx")


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def _flows() -> dict[str, Column]:
    """What a bar moves in or out, by the change of its typical price."""
    d, flow = typical_price() - before(typical_price()), typical_price() * F.col("volume")
    return {"_in": F.when(d > 0, flow).otherwise(0.0), "_out": F.when(d < 0, flow).otherwise(0.0)}


@laid_out
def mfi(df: DataFrame, period: int = 14) -> DataFrame:
    df = _fixed(df, period, _flows(), lambda full: {"_in": full("_in", period, F.sum), "_out": full("_out", period, F.sum)})
    return df.withColumn("MFI", _strength(F.col("_in"), F.col("_out"))).drop("_in", "_out")


@laid_out
def pvo(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(df, {"_fast": ("volume", alpha_of(fast)), "_slow": ("volume", alpha_of(slow))})
    df = df.withColumn("PVO", 100 * ratio(F.col("_fast") - F.col("_slow"), F.col("_slow"))).drop("_fast", "_slow")
    df = ewm(df, {"PVO_Signal": ("PVO", alpha_of(signal))})
    return df.withColumn("PVO_Hist", F.col("PVO") - F.col("PVO_Signal"))


def _money_flow() -> Column:
    h, lo, c = (F.col(x) for x in ("high", "low", "close"))
    return ratio((c - lo) - (h - c), h - lo) * F.col("volume")


@laid_out
def chaikin_ad(df: DataFrame) -> DataFrame:
    """Running money flow; null on a bar without range, and later bars go on."""
    return running_sums(df.withColumn("_f", _money_flow()), {"Chaikin_AD": "_f"}).drop("_f")


@laid_out
def chaikin_osc(df: DataFrame, fast: int = 3, slow: int = 10) -> DataFrame:
    drop = [] if "Chaikin_AD" in df.columns else ["Chaikin_AD"]
    df = df if not drop else chaikin_ad(df)
    df = ewm(df, {"_fast": ("Chaikin_AD", alpha_of(fast)), "_slow": ("Chaikin_AD", alpha_of(slow))})
    return df.withColumn("Chaikin_Oscillator", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow", *drop)


def _channel(period: int) -> tuple:
    """The deviation is the rolling mean of each row's distance to its own moving average."""
    off = F.abs(typical_price() - F.col("_ma"))
    return lambda full: {"_ma": full(typical_price(), period, F.avg)}, lambda full: {"_md": full(off, period, F.avg)}, {"CCI": ratio(typical_price() - F.col("_ma"), 0.015 * F.col("_md"))}


@laid_out
def cci(df: DataFrame, period: int = 20) -> DataFrame:
    return _fixed(df, 2 * period, *_channel(period)).drop("_ma", "_md")


def _ease(scale: float) -> Column:
    mid = (F.col("high") + F.col("low")) / 2
    return ratio((mid - before(mid)) * (F.col("high") - F.col("low")), F.col("volume") / scale)


@laid_out
def emv(df: DataFrame, scale: float = 10000.0, period: int = 14) -> DataFrame:
    return _fixed(df, period, {"_e": _ease(scale)}, lambda full: {"EMV": full("_e", period, F.avg)}).drop("_e")


def _line_flow() -> Column:
    same = (F.col("high") == F.col("low")) & (F.col("close") == F.col("high"))
    return F.when(~same, F.coalesce(_money_flow(), F.lit(0.0)))


@laid_out
def ad_line(df: DataFrame) -> DataFrame:
    """Running money flow with 0 for bars whose flow would be infinite; null where high = low = close."""
    return running_sums(df.withColumn("_f", _line_flow()), {"AD_Line": "_f"}).drop("_f")


@laid_out
def bull_bear(df: DataFrame, period: int = 13) -> DataFrame:
    df = ewm(df, {"_e": ("close", alpha_of(period))})
    return df.withColumns({"Bull_Power": F.col("high") - F.col("_e"), "Bear_Power": F.col("low") - F.col("_e")}).drop("_e")


@laid_out
def tema(df: DataFrame, period: int = 20, price: str = "close") -> DataFrame:
    a = alpha_of(period)
    df = ewm(df, {"_e1": (price, a)})
    df = ewm(df, {"_e2": ("_e1", a)})
    df = ewm(df, {"_e3": ("_e2", a)})
    return df.withColumn("TEMA", 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")).drop("_e1", "_e2", "_e3")


@laid_out
def sma_min1(df: DataFrame, cols: tuple[str, ...], periods: tuple[int, ...] = (1, 3, 7, 30, 180)) -> DataFrame:
    """Plain trailing means that also cover the first, shorter windows."""
    return _fixed(df, max(periods), lambda full: {f"{c}_SMA_{n}": full(c, n, F.avg, 1) for c in cols for n in periods})


#: Defaults of every period, each of which ``technical_features`` can override.
PERIODS = {"ma": (5, 10, 20, 50, 200), "rsi": 14, "macd": (12, 26, 9), "bollinger": (20, 2.0), "stochastic": (14, 3, 3), "atr": 14, "vwap": 20, "obv": 20, "williams": 14, "momentum": 14, "adx": 14, "mfi": 14, "pvo": (12, 26, 9), "chaikin": (3, 10), "cci": 20, "emv": 10000.0, "power": 13, "tema": 20}


@laid_out
def technical_features(df: DataFrame, **periods: object) -> DataFrame:
    """All indicators in one layout: lags, running sums, three stages of exponential means, and then
    all windows of fixed length, three levels in one pass."""
    p = PERIODS | periods
    price = {f"EMA_{n}": ("close", alpha_of(n)) for n in p["ma"]}
    (fast, slow, sig), (vf, vs, vsig), (cf, cs), a = p["macd"], p["pvo"], p["chaikin"], 1.0 / p["adx"]
    d = F.coalesce(F.col("close") - before("close"), F.lit(0.0))
    df = _fixed(df, 1, _directions() | _flows() | {"_v": _signed_volume(), "_e": _ease(p["emv"]), "_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))})
    df = running_sums(df.withColumns({"_f": _money_flow(), "_lf": _line_flow()}), {"OBV": "_v", "Chaikin_AD": "_f", "AD_Line": "_lf"}).drop("_v", "_f", "_lf")
    df = ewm(df, price | {"_mf": ("close", alpha_of(fast)), "_ms": ("close", alpha_of(slow)), "_vf": ("volume", alpha_of(vf)), "_vs": ("volume", alpha_of(vs)), "_etr": ("_tr", a), "_ep": ("_pdm", a), "_em": ("_mdm", a), "_cf": ("Chaikin_AD", alpha_of(cf)), "_cs": ("Chaikin_AD", alpha_of(cs)), "_pw": ("close", alpha_of(p["power"])), "_e1": ("close", alpha_of(p["tema"]))})
    indices, spread = _indices()
    df = df.withColumns({"MACD": F.col("_mf") - F.col("_ms"), "PVO": 100 * ratio(F.col("_vf") - F.col("_vs"), F.col("_vs")), "Chaikin_Oscillator": F.col("_cf") - F.col("_cs"), "Bull_Power": F.col("high") - F.col("_pw"), "Bear_Power": F.col("low") - F.col("_pw")} | indices).withColumns(spread)
    df = df.drop("_pdm", "_mdm", "_mf", "_ms", "_vf", "_vs", "_etr", "_ep", "_em", "_cf", "_cs", "_pw")
    df = ewm(df, {"MACD_Signal": ("MACD", alpha_of(sig)), "PVO_Signal": ("PVO", alpha_of(vsig)), "ADX": ("_dx", a), "_e2": ("_e1", alpha_of(p["tema"]))})
    df = ewm(df, {"_e3": ("_e2", alpha_of(p["tema"]))})
    df = df.withColumns({"MACD_Hist": F.col("MACD") - F.col("MACD_Signal"), "PVO_Hist": F.col("PVO") - F.col("PVO_Signal"), "TEMA": 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")}).drop("_dx", "_e1", "_e2", "_e3")
    (k, smooth_k, smooth_d), (width, sd) = p["stochastic"], p["bollinger"]
    ma, md, cci_ = _channel(p["cci"])

    def first(full: Sliding) -> dict[str, Column]:
        out = {f"SMA_{n}": full("close", n, F.avg) for n in p["ma"]} | ma(full)
        out |= {"_gain": full("_up", p["rsi"], F.avg), "_loss": full("_down", p["rsi"], F.avg), "_paid": full("_in", p["mfi"], F.sum), "_got": full("_out", p["mfi"], F.sum)}
        out |= {"_lo": full("low", k, F.min), "_hi": full("high", k, F.max), "_wlo": full("low", p["williams"], F.min), "_whi": full("high", p["williams"], F.max)}
        return out | {"BB_Middle": full("close", width, F.avg), "_sd": full("close", width, F.stddev_samp), "ATR": full("_tr", p["atr"], F.avg), "VWAP": _traded(full, p["vwap"]), "OBV_MA": full("OBV", p["obv"], F.avg), "EMV": full("_e", 14, F.avg), "Momentum": F.col("close") - before("close", p["momentum"])}

    williams = -100 * ratio(F.col("_whi") - F.col("close"), F.col("_whi") - F.col("_wlo"))
    second = _bands(sd) | {"_raw": _raw_stochastic(), "RSI": _strength(F.col("_gain"), F.col("_loss")), "MFI": _strength(F.col("_paid"), F.col("_got")), "Williams_R": williams}
    reach = max(*p["ma"], 2 * p["cci"], k + smooth_k + smooth_d, *(p[n] for n in ("rsi", "mfi", "williams", "atr", "vwap", "obv", "momentum")), width)
    df = _fixed(df, reach, first, second, lambda full: md(full) | {"STOCH_K": full("_raw", smooth_k, F.avg)}, lambda full: cci_ | {"STOCH_D": full("STOCH_K", smooth_d, F.avg)})
    return df.drop("_tr", "_in", "_out", "_e", "_up", "_down", "_gain", "_loss", "_paid", "_got", "_lo", "_hi", "_wlo", "_whi", "_sd", "_ma", "_md", "_raw")
