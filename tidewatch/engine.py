"""End-to-end runs: score a log without labels, detect with a trained model and rules, benchmark with injected attacks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.models import outliers
from tidewatch.models.outliers import create
from tidewatch.operators import cases, evaluate, features, identity, rules, scoring
from tidewatch.operators.inject import inject
from tidewatch.operators.patterns import attach
from tidewatch.operators.rules import is_failure

#: Identity signals that vote beside the models.
CHANNELS = ("sequence_score", "relationship_score", "fusion_score", "takeover_score", "takeover_support", "campaign_score", "password_spray_score", "low_and_slow_score", "session_context_shift", "takeover_sequence_score")


@dataclass
class Run:
    """What a run gives; tables stay lazy."""

    events: DataFrame
    results: DataFrame
    cases: DataFrame
    matches: DataFrame | None = None
    users: DataFrame | None = None
    model: object = None


def statistics(events: DataFrame) -> DataFrame:
    """One row: events, users, types, first and last time, how many rows have each optional column."""
    optional = ("ip_address", "asn", "country_code", "user_agent", "device_fingerprint", "session_id", "session_duration_seconds", "auth_method", "mfa_used", "success")
    return events.agg(
        F.count("*").alias("n_events"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("event_type").alias("n_types"),
        F.unix_micros(F.min("timestamp")).alias("first_at"),
        F.unix_micros(F.max("timestamp")).alias("last_at"),
        *[F.count(c).alias(f"with_{c}") for c in optional],
    )


def featured(events: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """Events with base features and identity signals, and the names of the numeric ones.

    The table is kept (in memory, else on disk): models pass over it many
    times, and its windows and joins are dearer than all of that.
    """
    groups = config.features.groups or list(features.GROUPS)
    names = [n for g in groups for n in features.NAMES[g]]
    df = identity.signals(events) if config.features.identity else events
    # both begin at the events, so neither plan holds the other
    df = attach(df.drop(*names), features.build(events, groups).drop("user_id"))
    if config.features.identity:
        names += list(identity.SIGNALS)
    return df.persist(), names


def with_models(train: DataFrame, test: DataFrame, names: list[str], config: Config) -> tuple[DataFrame, list[str], list]:
    """``test`` with one raw score column per detector, high for outliers, fitted on ``train``."""
    columns, fitted = [], []
    for name in config.model.detectors:
        model = create(name, contamination=config.model.contamination)
        if hasattr(model, "seed"):
            model.seed = config.model.seed
        model.fit(train, names)
        fitted.append(model)
        test = test.join(model.score(test).select(F.col("event_index").alias("__i"), (-F.col("score")).alias(name)), F.col("event_index") == F.col("__i")).drop("__i")
        columns.append(name)
    return test, columns, fitted


def run(events: DataFrame, config: Config | None = None) -> Run:
    """Unsupervised scoring end to end."""
    config = config or Config()
    df, names = featured(events, config)
    df, models, _ = with_models(df, df, names, config)
    if config.features.identity:
        df = df.withColumns({f"identity_{c}": F.col(c) for c in CHANNELS})
        models += [f"identity_{c}" for c in CHANNELS]
    pipeline = scoring.Pipeline(models, config.engine.strategy, config.model.contamination, normaliser=scoring.Normaliser(config.engine.normalisation)).fit(df)
    scored = pipeline.score(df).withColumn("score", -F.col("ensemble"))
    return Run(df, scored, cases_of(scored, config), model=pipeline)


def cases_of(scored: DataFrame, config: Config) -> DataFrame:
    """The cases of scored events; cases are made of identity signals, so there are none without them."""
    if not config.features.identity:
        scored = scored.withColumns({c: F.lit(0.0) for c in (*cases.SCORES, "relationship_score")})
    return cases.aggregate(scored, config.cases.window_minutes)


def train(events: DataFrame, config: Config | None = None, detector: str = "isolation_forest", path: str | None = None):
    """A detector fitted on the features of ``events``; written below ``path`` if that is given."""
    config = config or Config()
    df, names = featured(events, config)
    model = create(detector, contamination=config.model.contamination)
    model.fit(df, names)
    if path is not None:
        outliers.save(model, events.sparkSession, path)
    return model


def detect(train_events: DataFrame | None, events: DataFrame, config: Config | None = None, detector: str = "isolation_forest", model=None) -> Run:
    """A model, given or fitted on ``train_events``, scores ``events``; rules, user summaries and cases go with it. Low scores are anomalous."""
    config = config or Config()
    model = model if model is not None else train(train_events, config, detector)
    df, _ = featured(events, config)
    df = df.join(model.score(df).select(F.col("event_index").alias("__i"), "score"), F.col("event_index") == F.col("__i")).drop("__i")
    floor = None
    if config.engine.floor_enabled and config.features.identity:
        floor = (F.col("fusion_score") >= config.engine.floor) & (F.col("takeover_support") >= config.engine.support)
    scored = scoring.scored(df, "score", config.model.contamination, floor)
    return Run(df, scored, cases_of(scored, config), rules.evaluate(events, parameters=config.rules), scoring.user_summary(scored, "score"), model)


def benchmark(events: DataFrame, kind: str, config: Config | None = None, magnitude: float = 2.0, seed: int = 42) -> dict[str, DataFrame]:
    """Split by position, inject an attack into the later part, and measure who finds it: rates, case detection, slices."""
    config = config or Config()
    cut = events.agg(F.percentile("event_index", config.evaluation.train_share)).first()[0]
    train, test = events.where(F.col("event_index") <= cut), events.where(F.col("event_index") > cut)
    mixed = inject(test, kind, magnitude, config.evaluation.injection_window, seed)
    a, names = featured(train, config)
    b, _ = featured(mixed, config)
    a2, models, _ = with_models(a, a, names, config)
    b2, _, _ = with_models(a, b, names, config)
    engine = scoring.Pipeline(models, config.engine.strategy, config.model.contamination).fit(a2)
    scored = engine.score(b2)
    found = cases_of(scored, config)
    rates = evaluate.detection_rates(scored, "ensemble", "synthetic").withColumn("method", F.lit("pipeline"))
    naive = evaluate.detection_rates(b2.withColumn("ensemble", scoring.vote(models)), "ensemble", "synthetic").withColumn("method", F.lit("mean"))
    masks = {"all": F.lit(True), "injected": F.col("synthetic"), "ordinary": ~F.col("synthetic"), "failures": is_failure()}
    if config.features.identity:
        masks |= evaluate.standard_masks("synthetic")
    scored = scored.persist()
    return {
        "rates": reduce(DataFrame.unionByName, [rates, naive]),
        "cases": cases.detection(found, mixed.where("synthetic"), kind),
        "found": found,
        "slices": evaluate.slices(scored.withColumn("mean_raw", scoring.vote(models)), masks, "ensemble", "mean_raw", "is_anomaly"),
    }


def posture(results: DataFrame, found: DataFrame) -> dict:
    """A short review for analysts: counts, the worst cases (a top-k list), and what to do about their types."""
    n = results.agg(F.count("*").alias("events"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies")).first()
    by_type = {r["case_type"]: r["count"] for r in found.groupBy("case_type").count().collect()}
    worst = [r.asDict() for r in found.orderBy(F.desc("score"), "case_id").limit(5).select("case_id", "case_type", "severity", "score", "users").collect()]
    advice = {
        "session_takeover_case": "End the sessions named and ask their users to sign in anew.",
        "password_spray_case": "Block or slow the addresses and ask for a second factor.",
        "low_and_slow_campaign_case": "Lower the limits for failures by address over hours.",
        "coordinated_identity_campaign_case": "Look at the shared device or address and the users on it.",
    }
    critical = sum(1 for w in worst if w["severity"] == "critical")
    level = "critical" if critical else "elevated" if by_type else "calm"
    return {"posture": level, "events": n["events"], "anomalies": n["anomalies"], "cases": by_type, "worst": worst, "advice": [advice[t] for t in sorted(by_type)]}
