"""Fleet windows, alert gates, duplicate suppression, alert severities, analyst feedback."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import between
from tidewatch.operators.patterns import attach, first_seen, greedy_bursts, micros, with_order

SEVERITIES = ("info", "low", "medium", "high", "critical")


def fleet_windows(events: DataFrame, minutes: int = 60, step: int = 1, least: int = 10, anomalous: Column | None = None) -> DataFrame:
    """Sliding windows over the whole fleet: users, users on a new address, the largest network's share, anomalous users.

    A user's first event counts as a new address. Windows with fewer than
    ``least`` users are left out. Every count is a two-level aggregate by
    (window, user) or (window, asn).
    """
    new = with_order(events, "user_id").withColumn("is_new", first_seen("user_id", "ip_address"))
    new = new.withColumn("odd", (anomalous if anomalous is not None else F.lit(False)).cast("int"))
    # windows begin and end on multiples of the step, so events of one step go through all windows together
    tick = F.window("timestamp", f"{step} minutes")["start"]
    steps = new.groupBy(tick.alias("tick"), "user_id").agg(F.max("is_new").alias("is_new"), F.max("odd").alias("odd"), F.count("*").alias("n"))
    w = F.window("tick", f"{minutes} minutes", f"{step} minutes").alias("w")
    users = steps.select(w, "user_id", "is_new", "odd", "n").groupBy("w", "user_id").agg(F.max("is_new").alias("is_new"), F.max("odd").alias("odd"), F.sum("n").alias("n"))
    totals = users.groupBy("w").agg(F.count("*").alias("users"), F.sum("is_new").alias("new_ip_users"), F.sum("odd").alias("odd_users"), F.sum("n").alias("logins"))
    of_nets = new.where("asn IS NOT NULL").groupBy(tick.alias("tick"), "asn").count().select(w, "asn", F.col("count").alias("n"))
    nets = of_nets.groupBy("w", "asn").agg(F.sum("n").alias("count")).groupBy(F.col("w").alias("v")).agg(F.max("count").alias("top_asn"), F.sum("count").alias("with_asn"))
    joined = totals.join(nets, F.col("w") == F.col("v"), "left").where(F.col("users") >= least)
    return joined.select(
        micros(F.col("w.end")).alias("window_end"),
        "users",
        (F.col("new_ip_users") / F.col("users")).alias("new_ip_share"),
        F.coalesce(F.col("top_asn") / F.col("with_asn"), F.lit(0.0)).alias("asn_share"),
        (F.col("odd_users") / F.col("users")).alias("odd_share"),
    )


def fleet_alerts(windows: DataFrame) -> DataFrame:
    """(window_end, alert_type, severity, share) of windows past a threshold."""
    kinds = (("MASS_NEW_IP", "new_ip_share", 0.20, 0.40), ("ASN_CONCENTRATION", "asn_share", 0.50, 0.75), ("SYNCHRONIZED_ANOMALY", "odd_share", 0.30, 0.50))
    found = F.array(*[F.when(F.col(c) >= warn, F.struct(F.lit(n).alias("alert_type"), F.when(F.col(c) >= worst, "CRITICAL").otherwise("WARNING").alias("severity"), F.col(c).alias("share"))) for n, c, warn, worst in kinds])
    return windows.select("window_end", F.inline(F.filter(found, lambda x: x.isNotNull())))


def cooled_down(alerts: DataFrame, key: str = "alert_type", at: str = "window_end", seconds: int = 300) -> DataFrame:
    """Alerts of a kind that are at least so many seconds after the last one let through."""
    us = seconds * 1_000_000
    rows = alerts.withColumns({"__key": F.col(key), "__ts": F.timestamp_micros(at), "ord": F.col(at)})
    # a burst skips times up to its start plus the window; the next alert may be exactly the cooldown later
    return greedy_bursts(rows, ["__key"], us - 1, ts="__ts", order="ord").drop("__key", "__ts", "ord")


def gated(df: DataFrame, tau: float, floor: float = 0.97, jsd_floor: float = 0.2, least: int = 2, percentile: float = 0.95, history: int = 500, fp: Column | None = None, fp_limit: float = 0.8) -> DataFrame:
    """Whether a scored event becomes an alert: two of three signals agree, or the score is past the floor.

    ``df`` has user_id, event_index, timestamp, score, nll, jsd. The signals are
    score >= tau, nll above the user's own 95th percentile of the last 500
    (once there are ten), and jsd. ``fp`` is a triage model's probability of a
    false positive, which vetoes.
    """
    w = Window.partitionBy("user_id").orderBy("ord").rowsBetween(-history, -1)
    df = with_order(df, "user_id").withColumn("__v", F.sort_array(F.collect_list("nll").over(w)))
    df = df.withColumns({"__n": F.size("__v"), "__at": percentile * (F.size("__v") - 1)})
    low, high = (F.get("__v", f("__at").cast("int")) for f in (F.floor, F.ceil))
    df = df.withColumn("__p", between(low, high, F.col("__at") - F.floor("__at"))).drop("__v", "__at")
    signals = {"ensemble_fired": F.col("score") >= tau, "temporal_fired": F.coalesce((F.col("__n") >= 10) & (F.col("nll") > F.col("__p")), F.lit(False)), "jsd_fired": F.col("jsd") >= jsd_floor}
    df = df.withColumns(signals).withColumn("hard_bypass", F.col("score") >= floor)
    n = sum((F.col(s).cast("int") for s in signals), F.lit(0))
    vetoed = F.lit(False) if fp is None else F.coalesce(fp >= fp_limit, F.lit(False))
    return df.withColumn("n_signals", n).withColumn("passes", F.col("hard_bypass") | ((F.col("n_signals") >= least) & ~vetoed)).drop("__n", "__p", "ord")


def deduplicated(alerts: DataFrame, seconds: int = 60, most: int = 3) -> DataFrame:
    """``alerts`` with ``emitted``: at most so many of a user within the window of time, counting those emitted.

    Emissions depend on earlier emissions only, so a user's times are streamed
    in order and the last few emitted ones are held.
    """
    us = seconds * 1_000_000

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, kept = None, deque()
        for batch in batches:
            out = []
            for who, t in zip(batch.column("user_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if who != user:
                    user, kept = who, deque()
                while kept and t - kept[0] > us:
                    kept.popleft()
                take = len(kept) < most
                if take:
                    kept.append(t)
                out.append(take)
            yield pa.RecordBatch.from_arrays([batch.column("event_index"), pa.array(out, pa.bool_())], ["event_index", "emitted"])

    rows = alerts.select("user_id", "event_index", micros().alias("t")).repartition("user_id").sortWithinPartitions("user_id", "t", "event_index")
    return attach(alerts, rows.mapInArrow(scan, "event_index long, emitted boolean"))


def burst_summaries(deduped: DataFrame, score: str = "score") -> DataFrame:
    """What was held back per user: how many, the highest score, from when to when. Each held-back alert counts once."""
    held = deduped.where("NOT emitted")
    return held.groupBy("user_id").agg(F.count("*").alias("suppressed"), F.max(score).alias("max_score"), micros(F.min("timestamp")).alias("began"), micros(F.max("timestamp")).alias("ended"))


def alert_severity(score: Column, tau: Column, jsd: Column) -> Column:
    """By how far the score exceeds the threshold, one step up if models disagree strongly."""
    ratio = (score - tau) / F.greatest(tau, F.lit(1e-9))
    level = F.when(ratio < 0.1, 1).when(ratio < 0.5, 2).when(ratio < 1.0, 3).otherwise(4)
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.least(level + (jsd > 0.5).cast("int"), F.lit(4)) + 1)


def at_least(severity: Column, least: str) -> Column:
    order = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return F.element_at(order, severity) >= SEVERITIES.index(least)


VERDICTS = ("fp", "tp", "unsure")


def append_feedback(records: DataFrame, path: str) -> None:
    """Add verdicts (event_id, verdict, analyst_id, user_id, at) to a table; rows with an unknown verdict or no event are left out."""
    kept = records.where(F.col("verdict").isin(*VERDICTS) & F.col("event_id").isNotNull())
    kept.select("event_id", "verdict", F.coalesce("analyst_id", F.lit("anon")).alias("analyst_id"), "user_id", "at").write.mode("append").parquet(path)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """One row: how many verdicts there are of each kind, and the share of false positives."""
    counts = [F.count(F.when(F.col("verdict") == v, 1)) for v in VERDICTS]
    total = F.count("*")
    return feedback.agg(total.alias("total"), *[c.alias(v) for c, v in zip(counts, VERDICTS, strict=True)], F.coalesce(counts[0] / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("fp_rate"))


def confirmed(feedback: DataFrame, quorum: int = 2) -> DataFrame:
    """(event_id, verdict) that enough different analysts gave."""
    return feedback.groupBy("event_id", "verdict").agg(F.count_distinct("analyst_id").alias("analysts")).where(F.col("analysts") >= quorum).select("event_id", "verdict")


def false_positive_rates(feedback: DataFrame, quorum: int = 2) -> DataFrame:
    """(user_id, events, fp_rate): the share of a user's judged events that are confirmed false positives."""
    fp = confirmed(feedback, quorum).where("verdict = 'fp'").select(F.col("event_id").alias("__e"))
    judged = feedback.select("user_id", "event_id").distinct().join(fp, F.col("event_id") == F.col("__e"), "left")
    return judged.groupBy("user_id").agg(F.count("*").alias("events"), F.avg(F.col("__e").isNotNull().cast("double")).alias("fp_rate"))


def confirmed_since(feedback: DataFrame, verdict: str, cutoff: str, quorum: int = 2) -> DataFrame:
    """The latest record of each event with this verdict, if confirmed, from ``cutoff`` on."""
    fp = confirmed(feedback, quorum).where(F.col("verdict") == verdict).select(F.col("event_id").alias("__e"))
    w = Window.partitionBy("event_id").orderBy(F.desc("at"))
    rows = feedback.where((F.col("verdict") == verdict) & (F.col("at") >= F.lit(cutoff).cast("timestamp"))).join(fp, F.col("event_id") == F.col("__e"), "left_semi")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def poisoning_analysts(feedback: DataFrame, quorum: int = 2, least: int = 5, limit: float = 0.40) -> DataFrame:
    """Analysts who contradict confirmed verdicts in more than so large a share of their labels."""
    settled = confirmed(feedback, quorum).select(F.col("event_id").alias("__e"), F.col("verdict").alias("__v"))
    work = feedback.where("analyst_id <> 'anon'").withColumn("__id", F.monotonically_increasing_id())
    against = work.join(settled, (F.col("event_id") == F.col("__e")) & (F.col("verdict") != F.col("__v")), "left").groupBy("analyst_id", "__id").agg(F.max(F.col("__e").isNotNull().cast("int")).alias("against"))
    rates = against.groupBy("analyst_id").agg(F.count("*").alias("labels"), F.avg("against").alias("disagreement"))
    return rates.where((F.col("labels") >= least) & (F.col("disagreement") > limit))
