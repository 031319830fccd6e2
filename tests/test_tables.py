import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalars as sc
from panelspark.operators import clustering as cl
from panelspark.operators import fundamentals as fu
from panelspark.operators import models as mo
from panelspark.operators import signals as sg


def d(text):
    return dt.date.fromisoformat(text)


def test_rollup_edges(spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]  # Friday to Monday
    cal = spark.createDataFrame([(d(x), i in (0, 3)) for i, x in enumerate(days)], "date date, is_trading_day boolean")

    def roll(values, **kw):
        rows = spark.createDataFrame([(d(x), "news", "A", v) for x, v in zip(days, values) if v != "-"], "date date, source string, secid string, score double")
        return {str(r["date"])[-2:]: r["score"] for r in sg.rollup_scores(rows, cal, **kw).collect()}

    assert roll([1.0, 2.0, 3.0, 1.0]) == {"05": 1.9, "08": 1.0}
    assert roll([0.0, 2.0, None, 1.0]) == {"05": 2.0, "08": 1.0}
    assert roll([None, 2.0, 3.0, "-"]) == {"05": 2.5}
    assert roll(["-", 2.0, 3.0, 1.0]) == {"08": 1.0}
    assert roll([1.0, 2.0, 3.0, 1.0], direction="forward") == {"05": 1.0, "08": 1.9}


def test_targets_tail(spark):
    rows = spark.createDataFrame([("A", d(f"2024-01-0{i}"), float(c)) for i, c in ((1, 10), (2, 10), (3, 11))], "secid string, date date, close double")
    out = sg.binary_targets(sg.pct_targets(rows, (1,)), (1,)).orderBy("date").collect()
    assert [(r["target_1d"], r["target_1d_binary"]) for r in out] == [(0.0, 0), (10.0, 1), (None, 0)]
    out = sg.binary_targets(sg.pct_targets(rows, (1,)), (1,), null_tail=True).orderBy("date").collect()
    assert out[2]["target_1d_binary"] is None


def test_reports(spark):
    cells = [("f", "T", "quarterly", r, label, p, t) for r, label, p, t in ((1, "Дата отчета", "2023Q4", "15.02.2024"), (2, "Капитал, млн руб", "2023Q4", "12,5"), (3, "Чистые активы", "2023Q4", "99"), (2, "Капитал, млн руб", "2023Q3", "10"), (2, "Капитал, млн руб", "2017Q3", "7"), (2, "Капитал, млн руб", "LTM", "8"), (4, "Долг, млрд руб", "2023Q4", ";"))]
    out = fu.reports_long(spark.createDataFrame(cells, "file string, ticker string, report_type string, row_no int, label string, period string, text string")).orderBy("period_end").collect()
    assert [(str(r["period_end"]), str(r["publication_date"]), r["metric"], r["value"]) for r in out] == [("2023-09-30", "2023-11-14", "Equity", 10e6), ("2023-12-31", "2024-02-15", "Equity", 12.5e6)]


def test_ratios_without_size(spark):
    df = spark.createDataFrame([("A", 10.0, 2.0, 0.0, 5.0)], "secid string, close double, NetProfit_y double, Equity_y double, issue_size double")
    r = fu.financial_ratios(df).first()
    assert r["ROE_y"] is None and r["EPS_y"] == 2.0 / 5 * 1e6 and r["PB_y"] is None and r["EV_EBITDA_y"] is None


def test_asof_and_columns(spark):
    left = spark.createDataFrame([("A", d("2024-01-01")), ("A", d("2024-01-03")), ("B", d("2024-01-03"))], "ticker string, date date")
    right = spark.createDataFrame([("A", d("2024-01-02"), 1.0), ("A", d("2024-01-03"), None)], "ticker string, date date, v double")
    assert {(r["ticker"], str(r["date"])): r["v"] for r in fu.asof_join(left, right, "ticker").collect()} == {("A", "2024-01-01"): None, ("A", "2024-01-03"): 1.0, ("B", "2024-01-03"): None}
    wide = spark.createDataFrame([(1, None, "[1,2]", "a"), (2, None, None, "b")], "a int, b int, c string, e string")
    assert sc.drop_all_null_columns(wide).columns == ["a", "c", "e"]
    assert sc.find_json_array_column(wide) == "c"
    assert sc.effective_end_date(dt.datetime(2024, 1, 2, 19)) == d("2024-01-01")
    assert sc.effective_end_date(dt.datetime(2024, 1, 2, 19), inclusive=True) == d("2024-01-02")


def average_linkage(distance, threshold):
    """Smallest member of every point's cluster, by the plain method on the whole matrix."""
    groups = [[i] for i in range(len(distance))]
    while True:
        best = min(((distance[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), default=(9, 0, 0))
        if best[0] >= threshold:
            return {i: min(g) for g in groups for i in g}
        groups[best[1]] += groups.pop(best[2])


def dense_clusters(rows, cfg):
    v = np.array([r[3] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = 1 - v @ v.T
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            same, x = a[2] == b[2], min(1.0, dist[i, j] * (cfg.same_channel if a[2] == b[2] else 1))
            if cfg.image_bonus and min(a[5], b[5]) >= 1 and max(a[5], b[5]) <= 2 and a[6] == b[6] and not (same and cfg.channel_skips_time):
                x = max(0.0, x * (1 - cfg.image_bonus))
            hours = abs((a[1] - b[1]).total_seconds()) / 3600 - cfg.shift_hours
            spared = (cfg.channel_skips_time and same) or (a[4] in cfg.exempt_topics and b[4] in cfg.exempt_topics)
            dist[i, j] = x if spared else min(1.0, x * (1 + (cfg.time_modifier - 1) / (1 + np.exp(-hours))))
    return {rows[i][0]: rows[g][0] for i, g in average_linkage(dist, cfg.threshold).items()}


MESSAGES = "id long, datetime timestamp, channel_name string, embedding array<double>, topic string, n_images int, image_group int"
VARIANTS = [{}, {"channel_skips_time": True}, {"exempt_topics": ("tech", "oil")}, {"image_bonus": 0.6}, {"image_bonus": 0.4, "channel_skips_time": True, "exempt_topics": ("tech",)}]


@pytest.mark.parametrize("variant", VARIANTS)
def test_clusters_equal_dense_average_linkage(spark, variant):
    rng = np.random.default_rng(len(str(variant)))
    centres = rng.normal(size=(6, 8))
    cfg = cl.ClusterConfig(threshold=0.2, same_channel=3.0, **variant)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 1440))), str(rng.integers(0, 3)), (centres[i % 6] + rng.normal(size=8) * 0.4).tolist(), str(rng.choice(["tech", "oil", "x"])), int(rng.integers(0, 4)), int(rng.integers(0, 2))) for i in range(40)]
    rows += [(60 + i, *rows[i % 4][1:2], str(i % 3), rows[i % 4][3], "x", 1, 0) for i in range(12)]
    few = [(100 + i, dt.datetime(2024, 1, 5, i), "x", centres[0].tolist(), "x", 0, 0) for i in range(4)]
    df = spark.createDataFrame(rows + few, MESSAGES)
    got = {r["id"]: r["cluster"] for r in cl.cluster_windows(spark, cl.assign_windows(df), cfg).collect()}
    want = dense_clusters(rows, cfg)
    assert len(set(want.values())) < len(want) - 8 and got == want


def test_messages_of_one_channel_far_apart_cluster_as_their_pair_says(spark):
    cfg = cl.ClusterConfig(threshold=0.2, channel_skips_time=True, min_docs=2)
    rows = [(1, dt.datetime(2024, 1, 1), "a", [1.0, 0.0], "x", 0, 0), (2, dt.datetime(2024, 1, 1, 20), "a", [1.0, 0.2], "x", 0, 0)]
    df = cl.assign_windows(spark.createDataFrame(rows, MESSAGES))
    assert cl.pair_distances(df, cfg, 0.2).count() == 1
    assert {r["cluster"] for r in cl.cluster_windows(spark, df, cfg).collect()} == {1}


def test_many_copies_in_one_window_are_one_point(spark):
    df = spark.range(50_000).selectExpr("id", "timestamp_seconds(1704067200 + id) AS datetime", "cast(id % 7 AS string) AS channel_name", "array(1.0D, 2.0D) AS embedding", "DATE'2024-01-01' AS window")
    near = spark.createDataFrame([(60_000 + i, dt.datetime(2024, 1, 1, 6), f"n{i}", [1.0, 2.0 + i / 50], dt.date(2024, 1, 1)) for i in range(3)] + [(70_000, dt.datetime(2024, 1, 1), "z", [-1.0, 0.0], dt.date(2024, 1, 1))], "id long, datetime timestamp, channel_name string, embedding array<double>, window date")
    got = cl.cluster_windows(spark, df.unionByName(near))
    assert {r["cluster"]: r["count"] for r in got.groupBy("cluster").count().collect()} == {0: 50_003, 70_000: 1}


@pytest.mark.parametrize("bound", [0.02, 0.1, 0.4])
def test_close_pairs_are_all_there(spark, monkeypatch, bound):
    from panelspark.operators import neighbours
    from panelspark.scratch import Scratch

    monkeypatch.setattr(neighbours, "TILE", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    v = np.vstack([centres[i % 30] + rng.normal(size=16) * 0.15 for i in range(600)] + [rng.normal(size=(40, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([(dt.date(2024, 1, 1 + i % 2), i, v[i].tolist()) for i in range(len(v))], "window date, id long, v array<double>").repartition(5)
    scratch = Scratch(spark, "test")
    got = {(r["a"], r["b"]) for r in neighbours.close_pairs(points, bound, scratch).collect()}
    raw = 1 - v @ v.T
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if i % 2 == j % 2 and raw[i, j] < bound}
    compared = neighbours.comparisons(neighbours.cells(points, bound, scratch))
    assert compared < 2 * 320 * 319 / 2 * (0.3 if bound < 0.05 else 0.7 if bound < 0.2 else 1.01)


@pytest.mark.parametrize("held, guests", [(40, 30), (100_000, 100_000)])
def test_vectors_travel_to_groups_of_cells(spark, monkeypatch, held, guests):
    from panelspark.operators import neighbours
    from panelspark.scratch import Scratch

    monkeypatch.setattr(neighbours, "HELD", held)
    monkeypatch.setattr(neighbours, "GUESTS", guests)
    v = np.random.default_rng(5).normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([(dt.date(2024, 1, 1 + i % 2), i, v[i].tolist()) for i in range(len(v))], "window date, id long, v array<double>")
    travels = neighbours.groups(points, 0.9, Scratch(spark, "test")).agg(F.sum(F.size("visits"))).first()[0]
    assert travels <= 300 * (1 if held > 300 else 4)
    got = sorted((r["a"], r["b"]) for r in neighbours.close_pairs(points, 0.9, Scratch(spark, "test")).collect())
    assert got == [(i, j) for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2 and 1 - v[i] @ v[j] < 0.9]


def test_embedding_counts_each_word_once(spark):
    words = ["alpha", "Beta", "gamma", "delta", "alpha"]
    df = spark.createDataFrame([(w,) for w in [*words, " ".join(words), None, " . "]], "news string")
    *one, whole, null, none = (r["embedding"] for r in cl.embed(df).collect())
    total = np.sum(one, axis=0)
    assert np.allclose(whole, total / np.linalg.norm(total), atol=1e-6) and null is None and none is None
    assert "aggregate(" not in cl.embed(df)._jdf.queryExecution().optimizedPlan().toString()


def test_image_bonus_and_topics(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "a", [1.0, 0.5], "tech", 1, 7), (2, dt.datetime(2024, 1, 1, 20), "b", [1.0, 0.0], "tech", 1, 7), (3, dt.datetime(2024, 1, 1, 20), "a", [1.0, 0.1], "x", 0, 0)]
    df = cl.assign_windows(spark.createDataFrame(rows, "id long, datetime timestamp, channel_name string, embedding array<double>, topic string, n_images int, image_group int"))
    got = {(r["a"], r["b"]): r["distance"] for r in cl.pair_distances(df, cl.ClusterConfig(exempt_topics=("tech",), image_bonus=0.5, channel_skips_time=True)).collect()}
    raw12 = 1 - 1 / np.sqrt(1.25)
    assert got[(1, 2)] == pytest.approx(raw12 / 2)
    assert got[(1, 3)] == pytest.approx(min(1, 5 * (1 - 1.05 / np.sqrt(1.25) / np.sqrt(1.01))))


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(d("2024-01-01") + dt.timedelta(days=i), float(x), None if i % 9 == 0 else float(x) * 2, float(3 * x + 0.1), int(x > 0)) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "date date, a double, b double, y double, up int")
    split = mo.ordered_split(df)
    assert {r["part"]: r["count"] for r in split.groupBy("part").count().collect()} == {"train": 84, "val": 18, "test": 18}
    reg = mo.train_regressors(df, ["a", "b"], ["y"], maxIter=5)
    cls = mo.train_classifiers(df.withColumn("same", F.lit(1)), ["a", "b"], ["up", "same"], maxIter=5)
    assert set(cls) == {"up"}
    out = mo.score(df, reg | cls)
    assert out.columns == [*df.columns, "y_pred", "up_pred"] and out.count() == 120
    assert mo.classification_metrics(out, "up", "up_pred").first()["roc_auc"] > 0.95
    assert {r["feature"] for r in mo.feature_importance(spark, reg["y"]).collect()} == {"a", "b"}
    grid = mo.run_grid(spark, {"all": df}, ["y", "nothing"], {"one": ["a"]}, maxIter=2).collect()
    assert grid[0]["error"] is None and grid[1]["error"]


def test_tiles_and_image_groups_equal_all_pairs(spark, monkeypatch):
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 8))
    v = np.vstack([v + rng.normal(size=v.shape) * 0.05 for _ in range(5)])
    rows = [(i, dt.datetime(2024, 1, 1 + i % 2, i % 24), f"c{i % 7}", [float(x) for x in v[i]]) for i in range(len(v))]
    df = cl.assign_windows(spark.createDataFrame(rows, "id long, datetime timestamp, channel_name string, embedding array<double>"))
    want = sorted(map(tuple, cl.pair_distances(df, below=0.9).collect()))
    monkeypatch.setattr(cl, "TILE", 11)
    assert sorted(map(tuple, cl.pair_distances(df, below=0.9).collect())) == want
    images = spark.createDataFrame([(i // 2, i % 2, [float(x) for x in v[i]]) for i in range(len(v))], "id long, position int, embedding array<double>")
    got = {r["id"]: r["image_group"] for r in cl.image_groups(spark, images, 0.05).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = average_linkage(1 - u @ u.T, 0.05)
    assert all((got[i] == got[j]) == (label[2 * i + 1] == label[2 * j + 1]) for i, j in itertools.combinations(range(len(v) // 2), 2))


def test_asof_refuses_clashing_columns(spark):
    from panelspark.operators.fundamentals import asof_join

    left = spark.createDataFrame([("k", dt.date(2024, 1, 2), 1.0)], "k string, date date, x double")
    with pytest.raises(ValueError, match="x"):
        asof_join(left, left, "k")
    right = spark.createDataFrame([("k", dt.date(2024, 1, 1), 9.0)], "k string, date date, y double")
    assert asof_join(left, right, "k").first()["y"] == 9.0


def test_folds_of_few_days(spark):
    def folds(n):
        df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), i) for i in range(n)], "date date, i int")
        return [r["fold"] for r in mo.time_series_folds(df).orderBy("i").collect()]

    assert folds(1) == [0] and folds(2) == [0, 1] and folds(5) == [0, 0, 0, 0, 1] and folds(6) == [0, 1, 2, 3, 4, 5]


def test_grid_of_both_models(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7), float(i % 3), float(i % 7 > 3), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, a double, b double, up double, flat double")
    out = {(r["target"], r["model"]): r for r in mo.run_grid(spark, {"x": df}, ["up", "flat"], {"all": ["a", "b"]}, ("regressor", "classifier"), maxIter=2, maxDepth=2).collect()}
    assert len(out) == 4 and out[("up", "classifier")]["accuracy"] == 1.0 and out[("up", "classifier")]["mae"] is None
    assert out[("up", "regressor")]["mae"] < 0.3 and out[("up", "regressor")]["n_test"] == 10
    assert "class" in out[("flat", "classifier")]["error"]


def test_training_derives_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("x"), noted((F.col("id") % 5).cast("double")).alias("y"))
    models = mo.train_regressors(df, ["x"], ["y"], maxIter=2, maxDepth=2)
    assert seen.value == 200 and set(models) == {"y"}


@pytest.mark.parametrize("held", [7, 16_384])
def test_close_pairs_bring_what_is_known_of_their_sides(spark, monkeypatch, held):
    import numpy as np

    from panelspark.operators import neighbours
    from panelspark.scratch import Scratch

    monkeypatch.setattr(neighbours, "HELD", held)
    v = np.random.default_rng(5).normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([(i % 2, 59 - i, v[i].tolist(), f"c{59 - i}") for i in range(60)], "window int, id long, v array<double>, c string").repartition(3)
    got = sorted((r["a"], r["b"], r["c_a"], r["c_b"]) for r in neighbours.close_pairs(points, 0.7, Scratch(spark, "test")).collect())
    want = sorted((59 - j, 59 - i, f"c{59 - j}", f"c{59 - i}") for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and 1 - v[i] @ v[j] < 0.7)
    assert got == want


def test_pairs_over_all_cross_midnights(spark, monkeypatch):
    from panelspark.operators import neighbours

    monkeypatch.setattr(neighbours, "HELD", 50)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(12, 6))
    v = np.vstack([v + rng.normal(size=v.shape) * 0.3 for _ in range(12)])
    hours = np.sort(rng.integers(0, 96 * 60, len(v))) / 60
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=round(h * 60)), f"c{i % 5}", v[i].tolist()) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "id long, datetime timestamp, channel_name string, embedding array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for cfg in (cl.ClusterConfig(), cl.ClusterConfig(channel_skips_time=True), cl.ClusterConfig(time_modifier=1.0)):
        want = {}
        for i in range(len(v)):
            for j in range(i + 1, len(v)):
                same = i % 5 == j % 5
                d = min(1.0, (1 - u[i] @ u[j]) * (5 if same else 1))
                if cfg.time_modifier > 1 and not (same and cfg.channel_skips_time):
                    d = min(1.0, d * (1 + 3 / (1 + np.exp(8 - (hours[j] - hours[i])))))
                if d < 0.9:
                    want[i, j] = (rows[i][1].date(), d)
        got = {(r["a"], r["b"]): r for r in cl.pair_distances_over_all(df, cfg, 0.9).collect()}
        assert got.keys() == want.keys() and sum(rows[i][1].date() != rows[j][1].date() for i, j in got) > 50
        assert all(r["window"] == want[k][0] and r["distance"] == pytest.approx(want[k][1]) for k, r in got.items())


@pytest.mark.parametrize("far", [[-1.0, 0.0], [0.0, 0.0]])
def test_image_bonus_brings_any_vectors_under_the_threshold(spark, far):
    rows = [(1, dt.datetime(2024, 1, 1), "a", [1.0, 0.0], "x", 1, 7), (2, dt.datetime(2024, 1, 1), "b", far, "x", 1, 7)]
    df = cl.assign_windows(spark.createDataFrame(rows, MESSAGES))
    got = cl.pair_distances(df, cl.ClusterConfig(image_bonus=0.5), 0.9).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and got[0]["distance"] == pytest.approx(0.5, abs=0.001)


def test_the_market_panel_joins_before_the_indicators(spark):
    from panelspark.checks.texts import QUERIES

    plan = QUERIES["market_panel_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("SMA_5") and "Join" not in plan[: plan.index("Window")]


def test_bars_of_the_market_panel_travel_once(spark, monkeypatch):
    from panelspark.checks.texts import QUERIES
    from panelspark.plans import market

    panel = QUERIES["market_panel_plan"](spark, "/root/testdata/sf0.001")
    assert panel._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(market, "BROADCAST_ROWS", 0)
    shuffled = QUERIES["market_panel_plan"](spark, "/root/testdata/sf0.001")
    assert panel.count() > 0 and panel.exceptAll(shuffled).isEmpty() and shuffled.exceptAll(panel).isEmpty()
