"""Models on feature frames: a late-arrival classifier, quantile regressors, championship of two of them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import classification_metrics, quantile_metrics
from ..operators.baseline import compare_metrics, fit_baseline, predict_baseline, promotion_verdict, score_postprocess
from ..sources.tables import load_split, shared_path, version_order, written
from .boosting import Binning, Boost, best_splits, log_odds, scored

__all__ = ["Binning", "Boost", "Bundle", "best_splits", "championship", "fit_binning", "fit_classifier", "fit_quantile", "log_odds", "model_metrics", "scored", "train_cv"]

#: The features that are names, not numbers.
CATEGORICAL = ["station_name", "train_type", "train_number"]


def fit_binning(df: DataFrame, features: Sequence[str]) -> Binning:
    return Binning.fit(df, [c for c in features if c not in CATEGORICAL], [c for c in CATEGORICAL if c in features])


def fit_boost(binned: DataFrame, binning: Binning, target: str, loss: str | float, rounds: int, **sizes) -> Boost:
    return Boost(loss, rounds, **sizes).fit(binned, target, binning.widths, len(binning.numeric))


def fit_classifier(binned: DataFrame, binning: Binning, rounds: int = 300, depth: int | None = None, label: str = "target_delayed6", leaves: int | None = 127, min_rows: int = 100) -> Boost:
    """By default the whole model: 300 trees of 127 leaves with 100 rows each, split best first to any depth."""
    return fit_boost(binned, binning, label, "logistic", rounds, depth=depth, leaves=leaves, min_rows=min_rows)


def fit_quantile(binned: DataFrame, binning: Binning, alpha: float, rounds: int = 4, depth: int = 4, target: str = "target_delay_min") -> Boost:
    return fit_boost(binned, binning, target, alpha, rounds, depth=depth, step=0.5, l2=0.0)


class Bundle:
    """A version's models with the feature list that they were trained on."""

    def __init__(self, version: str, features: Sequence[str]):
        self.version, self.features = version, list(features)

    def fit(self, df: DataFrame, rounds: int = 10, boost_rounds: int = 4) -> Bundle:
        self.binning = fit_binning(df, self.features)
        binned = written(self.binning.apply(df, only=["target_delayed6", "target_delay_min"]), "binned")
        self.models = {"delay_probability": fit_classifier(binned, self.binning, rounds, 5, leaves=None, min_rows=20)}
        self.models |= {name: fit_quantile(binned, self.binning, alpha, boost_rounds) for name, alpha in (("p50", 0.5), ("p90", 0.9))}
        return self

    def save(self, path: str) -> None:
        """Writes the bundle below path, a folder a version; its description comes last, so that what is there is whole."""
        state = {"binning": self.binning.state(), "models": {name: m.state() for name, m in self.models.items()}}
        for part, text in (("models", state), ("about", {"version": self.version, "features": self.features})):
            SparkSession.active().createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{self.version}/{part}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> Bundle:
        """The bundle of that version, or of the newest one (see version_order)."""
        found = spark.read.text(f"{path}/*/about").withColumn("version", F.get_json_object("value", "$.version"))
        found = found.where(F.col("version") == version) if version is not None else found.orderBy(version_order("version").desc()).limit(1)
        about = json.loads(found.first()["value"])
        out = cls(about["version"], about["features"])
        state = json.loads(spark.read.text(f"{path}/{out.version}/models").first()["value"])
        out.binning, out.models = Binning(**state["binning"]), {name: Boost.of(x) for name, x in state["models"].items()}
        return out

    def score(self, df: DataFrame, mode: str = "serve") -> DataFrame:
        """df with delay_probability, p50 and p90; championship: without the features, only the rest goes through Python."""
        binned = self.binning.apply(df, "_bins", [c for c in df.columns if c not in self.features] if mode == "championship" else None)
        return score_postprocess(scored(binned, self.models, len(self.binning.widths), "_bins"), mode)


def model_metrics(scored: DataFrame) -> DataFrame:
    """(metric, value) of a scored frame, which is scored once for all of them."""
    s = written(scored.select(F.col("target_delayed6").cast("double").alias("_y"), "target_delay_min", "delay_probability", "p50", "p90"), "scored")
    y = F.col("target_delay_min").cast("double")
    wide = classification_metrics(s, "_y", "delay_probability").join(s.agg(*[c.alias(k) for k, c in quantile_metrics(y, F.col("p50"), F.col("p90")).items()]))
    return wide.unpivot([], wide.columns, "metric", "value")


def train_cv(features: DataFrame, folds: dict[str, list[str]], names: Sequence[str], rounds: int = 10, boost_rounds: int = 4) -> DataFrame:
    """(val_month, metric, model, baseline) of each fold {val_month: train_months}, and the folds' mean: models and
    baselines are fitted on the same months and scored on the same rows."""
    columns, out = sorted({*names, *CATEGORICAL, "target_delayed6", "target_delay_min"}), None
    for val, train in folds.items():
        rows = load_split(features, train, columns)
        scored = Bundle(val, names).fit(rows, rounds, boost_rounds).score(load_split(features, [val], columns), "cv")
        base = predict_baseline(fit_baseline(rows), scored.drop("delay_probability", "p50", "p90"))
        base = base.withColumnsRenamed({"baseline_prob": "delay_probability", "baseline_p50": "p50", "baseline_p90": "p90"})
        both = compare_metrics(model_metrics(base), model_metrics(scored))
        one = both.select(F.lit(val).alias("val_month"), "metric", F.col("challenger").alias("model"), F.col("champion").alias("baseline"))
        out = one if out is None else out.union(one)
    path = shared_path(features.sparkSession, "folds")
    out.write.parquet(path)
    out = features.sparkSession.read.parquet(path)
    return out.union(out.groupBy("metric").agg(F.avg("model").alias("model"), F.avg("baseline").alias("baseline")).select(F.lit("mean"), "metric", "model", "baseline"))


def championship(champion: Bundle, features: DataFrame, train_months: list[str], eval_month: str, refit_months: list[str], challenger_features: Sequence[str], rounds: int = 10, boost_rounds: int = 4) -> tuple[DataFrame, Bundle | None]:
    """(verdict, bundle): a challenger from the months before, both scored on the month, each on its own features; the
    bundle is the challenger refitted on refit_months if it is promoted."""
    columns = lambda names: sorted({*names, "target_delayed6", "target_delay_min"})
    challenger = Bundle(eval_month, challenger_features).fit(load_split(features, train_months, columns(challenger_features)), rounds, boost_rounds)
    old, new = (model_metrics(b.score(load_split(features, [eval_month], columns(b.features)), "championship")) for b in (champion, challenger))
    verdict = written(promotion_verdict(compare_metrics(old, new)), "verdict")
    if not verdict.first()["promote"]:
        return verdict, None
    return verdict, Bundle(f"{eval_month}-refit", challenger_features).fit(load_split(features, refit_months, columns(challenger_features)), rounds, boost_rounds)
