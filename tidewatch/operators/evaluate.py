"""Evaluation of scores against known attacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import scoring

TARGETS = (0.01, 0.05, 0.10, 0.20)


def detection_rates(df: DataFrame, score: str, truth: str, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(target_fpr, detection_rate): the best share of attacks found at a threshold whose share of false alarms is within the target.

    Counts by score value are summed over ranges of values first, so no window
    runs over all rows.
    """
    counts = df.groupBy(F.col(score).alias("v")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))
    pieces = 64
    cuts = counts.agg(F.percentile_approx("v", F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), 1000)).first()[0] or []
    part = reduce(lambda a, c: a + (F.col("v") > c).cast("int"), sorted(set(cuts)), F.lit(0))
    placed = counts.withColumn("part", part)
    sums = placed.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("part"))
    everything = Window.partitionBy(F.lit(0))
    above = sums.select(F.col("part").alias("q"), (F.sum("sp").over(down) - F.col("sp")).alias("bp"), (F.sum("sn").over(down) - F.col("sn")).alias("bn"), F.sum("sp").over(everything).alias("ap"), F.sum("sn").over(everything).alias("an"))
    own = Window.partitionBy("part").orderBy(F.desc("v"))
    placed = placed.withColumns({"p": F.sum("p").over(own), "n": F.sum("n").over(own)}).join(F.broadcast(above), F.col("part") == F.col("q"))
    tp, fp = F.col("p") + F.col("bp"), F.col("n") + F.col("bn") - F.col("p") - F.col("bp")
    rates = placed.select((tp / F.greatest("ap", F.lit(1))).alias("tpr"), F.when(F.col("an") > F.col("ap"), fp / F.greatest(F.col("an") - F.col("ap"), F.lit(1))).alias("fpr"))
    best = rates.agg(*[F.coalesce(F.max(F.when(F.col("fpr") <= t, F.col("tpr"))), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(targets)])
    return best.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target_fpr"), F.col(f"t{i}").alias("detection_rate")) for i, t in enumerate(targets)])))


def robustness(df: DataFrame, models: list[str], ensemble: str, flagged: str, truth: str) -> DataFrame:
    """One row: disagreement and variance over models, true and false positives of the flags."""
    bad, good = F.col(truth), ~F.col(truth)
    return df.agg(
        F.count("*").alias("n_events"),
        F.count(F.when(F.col(flagged), 1)).alias("n_flagged"),
        F.count(F.when(bad, 1)).alias("n_injected"),
        F.count(F.when(F.col(flagged) & bad, 1)).alias("true_positives"),
        F.count(F.when(F.col(flagged) & good, 1)).alias("false_positives"),
        (F.count(F.when(F.col(flagged) & good, 1)) / F.greatest(F.count(F.when(good, 1)), F.lit(1))).alias("false_positive_rate"),
        F.avg(scoring.softmax_entropy(models)).alias("entropy_mean"),
        F.stddev_pop(scoring.softmax_entropy(models)).alias("entropy_std"),
        F.avg(scoring.variance(models)).alias("variance_mean"),
        F.avg(ensemble).alias("ensemble_mean"),
    )


def slices(df: DataFrame, masks: dict, score: str, baseline: str, flagged: str) -> DataFrame:
    """(slice, n, flagged_share, mean_score, mean_baseline) for each named condition over events, in one pass."""
    parts = []
    for i, m in enumerate(masks.values()):
        inside = F.coalesce(m, F.lit(False))
        parts += [F.count(F.when(inside, 1)).alias(f"n{i}"), F.avg(F.when(inside, F.col(flagged).cast("double"))).alias(f"f{i}"), F.avg(F.when(inside, F.col(score))).alias(f"s{i}"), F.avg(F.when(inside, F.col(baseline))).alias(f"b{i}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(name).alias("slice"), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("flagged_share"), F.col(f"s{i}").alias("mean_score"), F.col(f"b{i}").alias("mean_baseline")) for i, name in enumerate(masks)]
    return one.select(F.inline(F.array(*rows)))


def standard_masks(truth: str) -> dict:
    """The nine conditions that a benchmark reports on: true attacks that show in one family of identity signals.

    Fixed values: the limits of each signal.
    """
    c, true = F.col, F.coalesce(F.col(truth).cast("boolean"), F.lit(False))
    at = lambda **limits: reduce(lambda a, b: a | b, [c(n) >= x for n, x in limits.items()])
    coordinated = at(relationship_score=0.2, sync_peer_count=1, infra_burst_peer_count=1, shared_ip_users=1, shared_device_users=1)
    return {
        "takeover_only": true & at(takeover_score=0.5, takeover_support=0.55),
        "coordination_heavy": true & coordinated,
        "infra_reuse_heavy": true & at(shared_infra_pair_users=1, infra_burst_peer_count=1),
        "mfa_bypass_focus": true & at(mfa_bypass_suspicion=1),
        "session_concurrency_focus": true & at(session_concurrency=0.5, session_replay_burst=0.5, session_fingerprint_drift=0.5),
        "geo_velocity_focus": true & at(geo_velocity_score=0.5, geo_velocity_flag=1, high_risk_country=1),
        "spray_focus": true & at(password_spray_score=0.5),
        "low_and_slow_focus": true & at(low_and_slow_score=0.5),
        "campaign_focus": true & (at(campaign_score=0.5) | coordinated),
    }


def benchmark(train: DataFrame, test: DataFrame, models: list[str], truth: str, contamination: float = 0.05) -> DataFrame:
    """Detection rates of the fitted pipeline and of the plain mean of raw scores, for the same targets."""
    engine = scoring.Pipeline(models, contamination=contamination).fit(train)
    ours = detection_rates(engine.score(test), "ensemble", truth).withColumn("method", F.lit("pipeline"))
    naive = detection_rates(test.withColumn("ensemble", scoring.vote(models)), "ensemble", truth).withColumn("method", F.lit("mean"))
    return ours.unionByName(naive)
