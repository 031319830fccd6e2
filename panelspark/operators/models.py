"""Splits, boosted trees, scoring, evaluation and experiment tables with Spark ML."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Feature sets by name; those that the panel lacks are left out.
TECHNICAL = ("SMA_5", "SMA_10", "SMA_20", "SMA_50", "SMA_200", "EMA_5", "EMA_10", "EMA_20", "EMA_50", "EMA_200", "RSI", "MACD", "MACD_Signal", "MACD_Hist", "BB_Middle", "BB_Upper", "BB_Lower", "BB_Width", "STOCH_K", "STOCH_D", "ATR", "VWAP", "OBV", "OBV_MA", "Williams_R", "Momentum", "Plus_DI", "Minus_DI", "ADX", "MFI", "PVO", "PVO_Signal", "PVO_Hist", "Chaikin_AD", "Chaikin_Oscillator", "CCI", "EMV", "AD_Line", "Bull_Power", "Bear_Power", "TEMA")
BARS = ("open", "high", "low", "close", "volume", "waprice")


def feature_set(columns: list[str], name: str, macro: tuple[str, ...] = (), signals: tuple[str, ...] = (), ratios: tuple[str, ...] = ()) -> list[str]:
    """Columns of a named set that are there: tech_only, tech_macro, base (with ratios), extended (with signals)."""
    sets = {"tech_only": BARS + TECHNICAL, "tech_macro": BARS + TECHNICAL + macro, "base": BARS + TECHNICAL + macro + ratios, "extended": BARS + TECHNICAL + macro + ratios + signals}
    there = set(columns)
    return [c for c in sets[name] if c in there]


def ordered_split(df: DataFrame, train: float = 0.7, val: float = 0.15, order: str = "date") -> DataFrame:
    """Add ``part`` (train, val, test) by the share of rows on earlier days; a day is never split."""
    days = df.groupBy(F.col(order).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_d")) - F.col("_n")
    days = days.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy())})
    share = F.col("_before") / F.col("_all")
    days = days.select("_d", F.when(share < train, "train").when(share < train + val, "val").otherwise("test").alias("part"))
    return df.join(days, F.col(order).eqNullSafe(F.col("_d"))).drop("_d")


def time_series_folds(df: DataFrame, k: int = 5, order: str = "date") -> DataFrame:
    """Add ``fold``: days in k + 1 equal blocks, numbered from 0; fold i trains on blocks before i.

    With fewer days than blocks, the last 15 percent of the days, one at least, are fold 1 and the
    others fold 0; a single day is fold 0.
    """
    days = df.select(F.col(order).alias("_d")).distinct()
    every = Window.partitionBy()
    days = days.withColumns({"_n": F.count(F.lit(1)).over(every), "_i": F.row_number().over(Window.orderBy("_d")), "_block": F.ntile(k + 1).over(Window.orderBy("_d")) - 1})
    last = F.col("_i") > F.col("_n") - F.greatest(F.floor(0.15 * F.col("_n")), F.lit(1))
    days = days.select("_d", F.when(F.col("_n") > k, F.col("_block")).otherwise((last & (F.col("_n") > 1)).cast("int")).alias("fold"))
    return df.join(days, F.col(order) == F.col("_d")).drop("_d")


def _pipeline(features: list[str], model) -> Pipeline:
    filled = [f"_f_{i}" for i in range(len(features))]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="keep"), model])


def _usable(df: DataFrame, features: list[str]) -> list[str]:
    n = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if n[c]]


def _trained_on(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Features and targets as one table: training reads its rows dozens of times and must not derive them anew."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], *[c for c in dict.fromkeys(targets) if c not in features])
    return Scratch(df.sparkSession, "training").table(rows, "rows")


def train_classifiers(df: DataFrame, features: list[str], targets: list[str], **params: object) -> dict[str, PipelineModel]:
    """A boosted-tree classifier for each 0/1 target; null targets are dropped, one-class targets skipped."""
    df = _trained_on(df, features, targets)
    features, out = _usable(df, features), {}
    for t in targets:
        rows = df.filter(F.col(t).isNotNull()).withColumn(t, F.col(t).cast("double"))
        if rows.select(t).distinct().count() >= 2:
            out[t] = _pipeline(features, GBTClassifier(labelCol=t, featuresCol="_features", predictionCol=f"{t}_class", seed=42, **params).setProbabilityCol(f"{t}_prob").setRawPredictionCol(f"{t}_raw")).fit(rows)
    return out


def train_regressors(df: DataFrame, features: list[str], targets: list[str], **params: object) -> dict[str, PipelineModel]:
    """A boosted-tree regressor with absolute loss for each target."""
    df = _trained_on(df, features, targets)
    features = _usable(df, features)
    return {t: _pipeline(features, GBTRegressor(labelCol=t, featuresCol="_features", predictionCol=f"{t}_pred", lossType="absolute", seed=42, **params)).fit(df.filter(F.col(t).isNotNull())) for t in targets}


def score(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Every row with ``<target>_pred``: the predicted value, or the probability of class 1."""
    keep = list(df.columns)
    for t, m in models.items():
        df = df.withColumns({c: F.col(c).cast("double") for c in m.stages[0].getInputCols()})
        df = m.transform(df)
        if f"{t}_prob" in df.columns:
            df = df.withColumn(f"{t}_pred", vector_to_array(f"{t}_prob")[1])
        keep.append(f"{t}_pred")
        df = df.select(*keep)
    return df


def regression_metrics(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and the share of equal signs over rows with both values."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    e = F.col(truth) - F.col(pred)
    spread = F.var_pop(truth)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(spread > 0, 1 - F.avg(e * e) / spread).alias("r2"), F.avg((F.signum(truth) == F.signum(pred)).cast("double")).alias("sign_accuracy"))


#: Ranges of scores that are ranked apart.
RANGES = 64


def classification_metrics(df: DataFrame, truth: str, score: str, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and the rank-sum ROC-AUC.

    Distinct scores are counted first, so the ranks need one row per score, not per row; ranges of
    scores between quantiles are ranked apart and added up, so no task sees all scores.
    """
    by = list(by)
    hit = F.col(score) >= threshold
    agg = lambda t, p: F.sum(((F.col(truth) == t) & (hit == p)).cast("long"))
    rows = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    conf = rows.groupBy(*by).agg(agg(1, True).alias("tp"), agg(0, True).alias("fp"), agg(1, False).alias("fn"), agg(0, False).alias("tn"))
    each = rows.groupBy(*by, score).agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) == 0).cast("long")).alias("q"))
    cuts = rows.agg(F.percentile_approx(F.col(score).cast("double"), [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c <= F.col(score).cast("double")))
    each = each.withColumn("_range", at)
    ranges = each.groupBy(*by, F.col("_range")).agg(F.sum("q").alias("_q"))
    ranges = ranges.withColumn("_before", F.sum("_q").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_q")).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), "_before")
    same = F.col("_range") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    each = each.join(ranges, same)
    below = F.col("_before") + F.coalesce(F.sum("q").over(Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = each.withColumn("u", F.col("p") * (below + F.col("q") / 2)).groupBy(*by).agg(F.sum("u").alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    auc = auc.select(*by, F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq"))).alias("roc_auc"))
    both = conf.join(auc, by) if by else conf.crossJoin(auc)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return both.select(*by, (tp + fp + fn + tn).alias("n"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "roc_auc")


_REGRESSION, _CLASSES = ("mae", "rmse", "r2", "sign_accuracy"), ("accuracy", "precision", "recall", "f1", "roc_auc")


def run_grid(spark: SparkSession, datasets: dict[str, DataFrame], targets: list[str], feature_sets: dict[str, list[str]], models: tuple[str, ...] = ("regressor",), **params: object) -> DataFrame:
    """One result row per data set, target, model and feature set: metrics of the last fold, or the error.

    ``models`` are ``regressor`` and ``classifier``; the metrics of the other kind are null.
    """
    measures = ", ".join(f"{m} double" for m in (*_REGRESSION, *_CLASSES))
    schema = f"dataset string, target string, model string, feature_set string, n_train long, n_test long, n_features int, {measures}, error string"

    def one(folds: DataFrame, last: int, t: str, model: str, features: list[str]) -> dict:
        known = folds.filter(F.col(t).isNotNull())
        train, test = known.filter(F.col("fold") < last), known.filter(F.col("fold") == last)
        size = {"n_train": train.count(), "n_test": test.count()}
        if model == "classifier":
            fitted = train_classifiers(train, features, [t], **params)
            if not fitted:
                raise ValueError("one class only")
            return size | classification_metrics(score(test, fitted), t, f"{t}_pred").first().asDict()
        return size | regression_metrics(score(test, train_regressors(train, features, [t], **params)), t, f"{t}_pred").first().asDict()

    out = []
    for name, df in datasets.items():
        folds = time_series_folds(df).cache()
        last = folds.agg(F.max("fold")).first()[0]
        for t in targets:
            for model in models:
                for fs, features in feature_sets.items():
                    row = dict.fromkeys((*_REGRESSION, *_CLASSES, "n_train", "n_test", "error")) | {"dataset": name, "target": t, "model": model, "feature_set": fs, "n_features": len(features)}
                    try:
                        m = one(folds, last, t, model, features)
                        row |= {k: m[k] for k in m if k in row}
                    except Exception as e:  # noqa: BLE001  an experiment that fails is a row of the table
                        row["error"] = str(e)[:200]
                    out.append(row)
        folds.unpersist()
    return spark.createDataFrame(out, schema)


def summarize_results(results: DataFrame, metric: str, base: str, by: list[str] = ("target",), column: str = "feature_set", names: list[str] = ()) -> DataFrame:
    """Mean metric by group and feature set as columns, and the improvement in percent over ``base``."""
    value = F.expr(f"try_cast({metric} AS double)")
    wide = results.withColumn("_m", value).groupBy(*by).pivot(column, list(names)).agg(F.avg("_m"))
    return wide.withColumns({f"{n}_gain": F.when(F.col(base) != 0, (F.col(n) / F.col(base) - 1) * 100) for n in names if n != base}).orderBy(*by)


def tune(df: DataFrame, features: list[str], target: str, trials: int = 50, k: int = 5, seed: int = 42) -> tuple[dict, float]:
    """Random search over tree parameters by mean ROC-AUC of the folds; one-class folds are skipped."""
    rng, best = random.Random(seed), ({}, float("-inf"))
    folds = time_series_folds(df.filter(F.col(target).isNotNull()), k).cache()
    for _ in range(trials):
        params = {"maxDepth": rng.randint(2, 6), "maxIter": rng.choice([5, 10, 20]), "stepSize": rng.uniform(0.03, 0.3), "subsamplingRate": rng.uniform(0.5, 1.0), "minInstancesPerNode": rng.randint(1, 20), "maxBins": rng.choice([16, 32, 64]), "minInfoGain": rng.choice([0.0, 0.001, 0.01]), "featureSubsetStrategy": rng.choice(["all", "sqrt", "onethird"]), "minWeightFractionPerNode": rng.choice([0.0, 0.01])}
        found = []
        for i in range(1, k + 1):
            models = train_classifiers(folds.filter(F.col("fold") < i), features, [target], **params)
            if models:
                auc = classification_metrics(score(folds.filter(F.col("fold") == i), models), target, f"{target}_pred").first()["roc_auc"]
                found += [auc] if auc is not None else []
        if found and (mean := sum(found) / len(found)) > best[1]:
            best = (params, mean)
    folds.unpersist()
    return best


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``feature, importance``, the most important first."""
    names, tree = model.stages[0].getInputCols(), model.stages[-1]
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, tree.featureImportances.toArray(), strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
