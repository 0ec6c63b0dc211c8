"""Score algebra: normalise, vote, measure disagreement, threshold; the ranked scorer and its summaries.

Scores of a model are a double column. Fitted parameters are a few scalars from
one aggregate; what they parametrise stays lazy.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import clamp01

LEAST_ROWS, COLLAPSED, LOW_SPREAD = 30, 1e-6, 1e-4


@dataclass
class Normaliser:
    """Maps each model's scores to [0, 1] by their range or by quantiles; parameters by model."""

    strategy: str = "minmax"
    quantiles: tuple[float, float] = (0.05, 0.95)
    parameters: dict[str, dict] = field(default_factory=dict)

    def fit(self, df: DataFrame, models: list[str]) -> Normaliser:
        """One pass over all models. A constant model becomes 0.5, or itself if it is an identity score in [0, 1]; little spread means quantiles."""
        low, high = self.quantiles
        parts = []
        for m in models:
            c = F.col(m).cast("double")
            parts += [F.count(c), F.min(c), F.max(c), F.stddev_pop(c), F.percentile(c, F.array(F.lit(low), F.lit(high)))]
        row = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
        for i, m in enumerate(models):
            n, least, most, spread, q = row[5 * i : 5 * i + 5]
            if n < LEAST_ROWS:
                raise ValueError(f"{m}: {n} scores, {LEAST_ROWS} are needed")
            if most - least < COLLAPSED:
                self.parameters[m] = {"mode": "same" if m.startswith("identity_") and 0 <= least and most <= 1 else "constant"}
            elif self.strategy == "minmax" and spread >= LOW_SPREAD:
                self.parameters[m] = {"mode": "minmax", "low": least, "high": most}
            else:
                self.parameters[m] = {"mode": "quantile", "low": q[0], "high": q[1]}
        return self

    def column(self, model: str) -> Column:
        p = self.parameters[model]
        if p["mode"] == "constant":
            return F.lit(0.5)
        x = F.col(model).cast("double")
        return clamp01(x) if p["mode"] == "same" else clamp01((x - p["low"]) / max(p["high"] - p["low"], COLLAPSED))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({m: self.column(m) for m in self.parameters})


def vote(models: list[str], strategy: str = "mean", weights: dict[str, float] | None = None, trim: float = 0.2) -> Column:
    """One score from several: mean, median, trimmed_mean (each side loses its share, one at least) or weighted."""
    k = len(models)
    values = F.array_sort(F.array(*[F.col(m).cast("double") for m in models]))
    mean = reduce(lambda a, m: a + F.col(m), models, F.lit(0.0)) / k
    if strategy == "mean":
        return mean
    if strategy == "median":
        return F.get(values, F.lit(k // 2)) if k % 2 else (F.get(values, F.lit(k // 2 - 1)) + F.get(values, F.lit(k // 2))) / 2
    if strategy == "trimmed_mean":
        n = max(1, round(k * trim))
        if 2 * n >= k:
            return mean
        return F.aggregate(F.slice(values, n + 1, k - 2 * n), F.lit(0.0), lambda a, x: a + x) / (k - 2 * n)
    if strategy == "weighted":
        w = {m: (weights or {}).get(m, 1.0) for m in models}
        total = sum(w.values())
        return mean if total == 0 else reduce(lambda a, m: a + F.col(m) * w[m], models, F.lit(0.0)) / total
    raise ValueError(f"unknown strategy {strategy}")


def disagreement(models: list[str]) -> Column:
    """Jensen-Shannon divergence of the models' shares from the uniform mixture: (sum p ln p + ln k) / k; 0 for equal scores."""
    k = len(models)
    if k < 2:
        return F.lit(0.0)
    raised = [F.col(m) + 1e-10 for m in models]
    total = reduce(lambda a, x: a + x, raised)
    shares = [x / total for x in raised]
    return F.greatest((reduce(lambda a, p: a + p * F.log(p), shares, F.lit(0.0)) + math.log(k)) / k, F.lit(0.0))


def softmax_entropy(models: list[str]) -> Column:
    powers = [F.exp(F.col(m)) for m in models]
    total = reduce(lambda a, x: a + x, powers)
    return -reduce(lambda a, x: a + (x / total) * F.log(x / total), powers, F.lit(0.0))


def variance(models: list[str]) -> Column:
    k = len(models)
    mean = reduce(lambda a, m: a + F.col(m), models, F.lit(0.0)) / k
    return reduce(lambda a, m: a + (F.col(m) - mean) * (F.col(m) - mean), models, F.lit(0.0)) / k


def most_entropy(k: int) -> float:
    return math.log(k) if k > 1 else 0.0


@dataclass
class Threshold:
    """The score that a share ``contamination`` of events reaches; keeps its history for drift."""

    contamination: float = 0.05
    history: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, score: str) -> float:
        n, tau = df.agg(F.count(score), F.percentile(score, 1 - self.contamination)).first()
        if n < 10:
            raise ValueError("a threshold needs ten scores")
        self.history.append(float(tau))
        return self.history[-1]

    update = fit

    @property
    def current(self) -> float:
        if not self.history:
            raise ValueError("the threshold isn't fitted")
        return self.history[-1]

    @property
    def instability(self) -> float:
        """Mean step between thresholds."""
        steps = [abs(b - a) for a, b in zip(self.history, self.history[1:], strict=False)]
        return sum(steps) / len(steps) if steps else 0.0

    def predict(self, score: str) -> Column:
        return F.col(score) >= self.current


def sensitivity(df: DataFrame, score: str, low: float = 0.01, high: float = 0.30, steps: int = 20) -> DataFrame:
    """(contamination, threshold, flagged_share) for evenly spaced contaminations, in two scans."""
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    taus = df.agg(F.percentile(score, F.array(*[F.lit(1 - c) for c in grid])).alias("t")).first()["t"]
    counts = df.agg(*[F.avg((F.col(score) >= t).cast("double")).alias(f"r{i}") for i, t in enumerate(taus)])
    rows = F.array(*[F.struct(F.lit(c).alias("contamination"), F.lit(t).alias("threshold"), F.col(f"r{i}").alias("flagged_share")) for i, (c, t) in enumerate(zip(grid, taus, strict=True))])
    return counts.select(F.inline(rows))


@dataclass
class Pipeline:
    """Normalise, vote, measure disagreement, threshold; optionally a hard floor on two identity scores."""

    models: list[str]
    strategy: str = "mean"
    contamination: float = 0.05
    weights: dict[str, float] | None = None
    floor_model: str | None = None
    floor: float = 0.58
    support_model: str | None = None
    support: float = 0.55
    normaliser: Normaliser = field(default_factory=Normaliser)
    threshold: Threshold | None = None

    def _voted(self, df: DataFrame) -> DataFrame:
        return self.normaliser.transform(df).withColumn("ensemble", vote(self.models, self.strategy, self.weights))

    def fit(self, df: DataFrame) -> Pipeline:
        self.normaliser.fit(df, self.models)
        self.threshold = Threshold(self.contamination)
        self.threshold.fit(self._voted(df), "ensemble")
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with normalised models, ensemble, disagreement, variance, floor_hit, is_anomaly."""
        if self.threshold is None:
            raise ValueError("fit the pipeline first")
        hit = F.lit(False)
        if self.floor_model in self.models:
            hit = F.col(self.floor_model) >= self.floor
            if self.support_model is not None:
                hit = hit & (F.col(self.support_model) >= self.support) if self.support_model in self.models else F.lit(False)
        df = self._voted(df).withColumns({"disagreement": disagreement(self.models), "variance": variance(self.models), "floor_hit": hit})
        df = df.withColumn("is_anomaly", self.threshold.predict("ensemble") | F.col("floor_hit"))
        return df.withColumn("ensemble", F.when(F.col("floor_hit"), 1.0).otherwise(F.col("ensemble")))

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Pipeline:
        raw = json.loads(text)
        n, t = raw.pop("normaliser"), raw.pop("threshold")
        n["quantiles"] = tuple(n["quantiles"])
        return cls(**raw, normaliser=Normaliser(**n), threshold=Threshold(**t) if t else None)


def scored(df: DataFrame, score: str, contamination: float = 0.05, floor: Column | None = None) -> DataFrame:
    """Low scores are anomalous here: threshold at the lower percentile, signed confidence, percentile rank, the user's mean score."""
    tau = float(df.agg(F.percentile(score, contamination)).first()[0] or 0.0)
    distance = (F.lit(tau) - F.col(score)) / max(abs(tau), 0.1)
    anomaly = (F.col(score) < tau) | (floor if floor is not None else F.lit(False))
    # the rank over all rows comes from counts by value, so no window runs over the whole table
    counts = df.groupBy(F.col(score).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = percentile_ranks(counts)
    df = df.withColumns({"is_anomaly": anomaly})
    df = df.withColumn("confidence", F.least(F.lit(1.0), F.when(F.col("is_anomaly"), distance).otherwise(-distance)))
    df = df.join(ranks, F.col(score) == F.col("__v"), "left").drop("__v").withColumnRenamed("__rank", "percentile_rank")
    return df.withColumn("user_baseline", F.avg(score).over(Window.partitionBy("user_id")))


def percentile_ranks(counts: DataFrame, pieces: int = 64) -> DataFrame:
    """(__v, __rank): the share of rows at or below each value, from (__v, __n), by prefix sums over ranges of values.

    Values are cut into ranges at approximate quantiles; sums within a range and
    over the few ranges add up.
    """
    cuts = counts.agg(F.percentile_approx("__v", F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), 1000)).first()[0] or []
    part = reduce(lambda a, c: a + (F.col("__v") > c).cast("int"), sorted(set(cuts)), F.lit(0))
    placed = counts.withColumn("__p", part)
    sums = placed.groupBy("__p").agg(F.sum("__n").alias("__s"))
    everything = Window.partitionBy(F.lit(0)).orderBy("__p")
    before = sums.select(F.col("__p").alias("__q"), (F.sum("__s").over(everything) - F.col("__s")).alias("__b"), F.sum("__s").over(Window.partitionBy(F.lit(0))).alias("__all"))
    within = F.sum("__n").over(Window.partitionBy("__p").orderBy("__v"))
    return placed.withColumn("__w", within).join(F.broadcast(before), F.col("__p") == F.col("__q")).select("__v", ((F.col("__w") + F.col("__b")) / F.col("__all")).alias("__rank"))


def user_summary(results: DataFrame, score: str) -> DataFrame:
    """Counts, rates, score statistics and risk of each user."""
    out = results.groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("n_anomalies"),
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.stddev_pop(score).alias("std_score"),
    )
    rate = F.col("n_anomalies") / F.col("n_events")
    risk = (
        F.when((rate > 0.5) | (F.col("min_score") < -0.5), "critical")
        .when((rate > 0.2) | (F.col("mean_score") < -0.1), "high")
        .when((rate > 0.05) | (F.col("n_anomalies") > 0), "medium")
        .otherwise("low")
    )
    return out.withColumns({"anomaly_rate": rate, "risk": risk})


def ranked_summary(summary: DataFrame, n: int) -> DataFrame:
    """The ``n`` users of highest risk, then rate: a top-k report."""
    order = F.when(F.col("risk") == "critical", 0).when(F.col("risk") == "high", 1).when(F.col("risk") == "medium", 2).otherwise(3)
    return summary.orderBy(order, F.desc("anomaly_rate"), "user_id").limit(n)


def distribution(df: DataFrame, score: str) -> DataFrame:
    """Count, mean, spread, range and nine percentiles of a score, one row."""
    points = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    one = df.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"), F.percentile(score, F.array(*[F.lit(p / 100) for p in points])).alias("q"))
    return one.select("n", "mean", "std", "least", "most", *[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate(points)])
