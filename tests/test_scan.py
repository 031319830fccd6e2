import datetime as dt
import random

import pandas as pd
import pytest

from panelspark.operators import blocks, scan
from panelspark.operators import indicators as ind
from panelspark.operators.scan import ewm

DAY = dt.date(2020, 1, 1)


def frame(spark, columns):
    rows = [(k, DAY + dt.timedelta(days=i), x) for k, xs in columns.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "secid string, date date, x double")


@pytest.mark.parametrize("alpha,rows", [(0.5, None), (0.5, 70), (1 / 14, None), (1 / 14, 100), (2 / 201, None), (0.999, 13), (1.0, None), (1.0, 64)])
def test_ewm_equals_pandas_with_gaps(spark, monkeypatch, alpha, rows):
    if rows:
        monkeypatch.setattr(blocks, "LAID_ROWS", rows)
        monkeypatch.setattr(scan, "MOST_ROWS", 9)
    else:
        monkeypatch.setattr(scan, "MOST_ROWS", 130)
    rng = random.Random(3)
    gaps = [None if rng.random() < 0.2 else rng.gauss(100, 5) for _ in range(1100)]
    gaps[:3] = [None] * 3
    cols = {"a": gaps, "b": [5.0], "c": [None, None], "d": [1.0, None, None, None, None, None, 2.0], "e": [3.0] + [None] * 200 + [4.0]}
    out = ewm(frame(spark, cols), {"y": ("x", alpha)}).toPandas().sort_values(["secid", "date"])
    for k, xs in cols.items():
        want = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=False).mean()
        got = out[out.secid == k].y.reset_index(drop=True).astype(float)
        pd.testing.assert_series_equal(got, want, check_names=False, rtol=1e-9, atol=1e-9)


def bars(spark, rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=i), *map(float, r)) for k, rs in rows.items() for i, r in enumerate(rs)], "secid string, date date, open double, high double, low double, close double, volume double, waprice double")


def test_indicators_on_edge_bars(spark):
    flat = [(5, 5, 5, 5, 0, 5)] * 40
    rising = [(i, i + 1, i - 1, i, 10, i) for i in range(1, 41)]
    df = bars(spark, {"flat": flat, "up": rising, "one": [(1, 2, 0, 1, 1, 1)]})
    out = ind.technical_features(df).toPandas().sort_values(["secid", "date"]).set_index("secid")
    assert len(out) == 81
    up, flat_, one = out.loc["up"], out.loc["flat"], out.loc[["one"]]
    assert up.RSI.isna().sum() == 13 and (up.RSI.dropna() == 100).all()
    assert up.ATR.isna().sum() == 14 and up.CCI.isna().sum() == 38 and up.OBV.isna().sum() == 1 and up.OBV_MA.isna().sum() == 20
    assert (up.MFI.dropna() == 100).all()
    for c in ("RSI", "MFI", "STOCH_K", "Williams_R", "CCI", "EMV", "Chaikin_AD", "AD_Line", "VWAP", "ADX"):
        assert flat_[c].isna().all(), c
    assert one.SMA_5.isna().all() and one.EMA_5.iloc[0] == 1


def test_all_at_once_equals_one_by_one(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(90):
        c, o = rng.uniform(90, 110), rng.uniform(90, 110)
        rows.append((o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, rng.randint(1, 99), (o + c) / 2))
    df = bars(spark, {"a": rows}).cache()
    whole = ind.technical_features(df).toPandas().sort_values("date").reset_index(drop=True)
    for fn in (ind.macd, ind.adx, ind.pvo, ind.chaikin_osc, ind.tema, ind.bull_bear, ind.rsi, ind.bollinger):
        one = fn(df).toPandas().sort_values("date").reset_index(drop=True)
        for c in set(one.columns) - set(df.columns):
            pd.testing.assert_series_equal(whole[c].astype(float), one[c].astype(float), rtol=1e-9)


def test_empty_table(spark):
    df = bars(spark, {})
    assert ind.technical_features(df).count() == 0


def test_indicators_of_long_tickers_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = {}
    for key, n in (("a", 300), ("b", 40), ("c", 121)):
        rows[key] = []
        for _ in range(n):
            c, o = rng.uniform(90, 110), rng.uniform(90, 110)
            rows[key].append((o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, rng.randint(1, 99), (o + c) / 2))
    df = bars(spark, rows).cache()
    sort = lambda d: d.toPandas().sort_values(["secid", "date"]).reset_index(drop=True)
    want = sort(ind.technical_features(df)), sort(ind.shifts(df, "close", 3)), sort(ind.sma_min1(df, ("close",)))
    monkeypatch.setattr(blocks, "LAID_ROWS", 60)
    got = sort(ind.technical_features(df)), sort(ind.shifts(df, "close", 3)), sort(ind.sma_min1(df, ("close",)))
    for x, y in zip(got, want, strict=True):
        pd.testing.assert_frame_equal(x, y, rtol=1e-9)


def test_a_long_ticker_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LAID_ROWS", 2000)
    df = spark.range(20000).selectExpr("'hot' AS secid", "date_add(DATE'1900-01-01', cast(id AS int)) AS date", "cast(id % 97 AS double) AS x")
    laid = blocks.lay_out(df)
    assert [r["count"] for r in laid.groupBy("_block").count().collect()] == [2000] * 10
    last = ewm(laid, {"y": ("x", 0.1)}).filter("_index = 19999").first()
    assert last["y"] == pytest.approx(pd.Series([i % 97 for i in range(20000)], dtype=float).ewm(alpha=0.1, adjust=False).mean().iloc[-1])


@pytest.mark.parametrize("rows", [None, 70])
def test_long_windows_are_short_runs(spark, monkeypatch, rows):
    if rows:
        monkeypatch.setattr(blocks, "LAID_ROWS", rows)
    rng = random.Random(4)
    xs = {"A": [None if rng.random() < 0.02 else round(rng.random() * 90, 2) for _ in range(300)], "B": [1.5] * 40}
    windows = [("x", 50, "sum", None), ("x", 53, "mean", None), ("x", 30, "min", 1), ("x", 48, "max", None), ("x", 60, "mean", 1)]
    out = ind.rollings(frame(spark, xs), *windows).toPandas().sort_values(["secid", "date"])
    for _, some in out.groupby("secid"):
        for c, n, fn, least in windows:
            want = getattr(some[c].astype(float).rolling(n, min_periods=least or n), fn)()
            pd.testing.assert_series_equal(some[f"{c}_{fn}_{n}"].astype(float), want, check_names=False, rtol=1e-9)
    full = ind.Sliding()
    full("x", 200, ind.F.avg)
    assert sorted(full.names) == [("Column<'x'>", "seen"), ("Column<'x'>", "sum", 20)]
