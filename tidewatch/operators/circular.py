"""Circular statistics of login hours: von Mises fits in batch and with decay, likelihoods, drift of the mean hour."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import angular_distance, bessel_log_i0, concentration, fractional_hour
from tidewatch.operators.patterns import with_order

LEAST, DECAY = 10, 0.995


def angle() -> Column:
    return fractional_hour(F.col("timestamp")) * 2 * math.pi / 24


def turned(cosine: bool) -> Column:
    """The cosine or sine of ``angle``, which has 1,440 values, as the C library rounds them."""
    f = math.cos if cosine else math.sin
    values = F.array(*[F.lit(f((m // 60 + m % 60 / 60.0) * 2 * math.pi / 24)) for m in range(1440)])
    return F.get(values, F.hour("timestamp") * 60 + F.minute("timestamp"))


def scaled_round(x: Column, digits: int) -> Column:
    """``x`` to so many digits, halves away from 0, rounded as a multiple of the last digit's unit."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits + 0.0


def direction(s: str, c: str) -> Column:
    """The angle of a vector by the C library, whose last digit is right where Java's often isn't."""

    @F.pandas_udf("double")
    def angles(s: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([math.atan2(y, x) for y, x in zip(s, c, strict=True)], dtype=float)

    return angles(s, c)


def moments(events: DataFrame, least: int = LEAST) -> DataFrame:
    """(user_id, n, mean_angle, resultant): the mean direction and resultant length of a user's hours; flat below ``least`` events."""
    one = events.groupBy("user_id").agg(F.count("*").alias("n"), scaled_round(F.avg(turned(True)), 12).alias("c"), scaled_round(F.avg(turned(False)), 12).alias("s"))  # opposite hours cancel out exactly
    enough = F.col("n") >= least
    one = one.withColumn("mu", F.pmod(direction("s", "c"), F.lit(2 * math.pi)))
    return one.select("user_id", "n", F.when(enough, F.col("mu")).otherwise(0.0).alias("mean_angle"), F.when(enough, F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).otherwise(0.0).alias("resultant"))


def fit(events: DataFrame, least: int = LEAST) -> DataFrame:
    """(user_id, n, mean_angle, kappa)."""
    return moments(events, least).select("user_id", "n", "mean_angle", concentration(F.col("resultant")).alias("kappa"))


def surprise(events: DataFrame, models: DataFrame) -> DataFrame:
    """event_index, user_id and nll: negative log likelihood of the hour, at least 0; 0 for flat or unknown users."""
    flat = math.log(2 * math.pi) + bessel_log_i0(F.col("kappa"))  # once a user
    joined = events.join(models.select(F.col("user_id").alias("__u"), "mean_angle", "kappa", flat.alias("__flat")), F.col("user_id") == F.col("__u"), "left")
    nll = F.col("__flat") - F.col("kappa") * F.cos(angle() - F.col("mean_angle"))
    return joined.select("event_index", "user_id", F.when(F.col("kappa") > 0, F.greatest(nll, F.lit(0.0))).otherwise(0.0).alias("nll"))


def online(events: DataFrame, decay: float = DECAY) -> DataFrame:
    """event_index, user_id and the decayed sums (c, s, w) after each event: each step multiplies what came before by ``decay``.

    A decayed sum up to event i is decay^i times the plain sum of x_j / decay^j,
    so it is a running sum; steps are rebased every thousand events of a user
    by carrying the state of whole thousands.
    """
    block = 1000
    w = Window.partitionBy("user_id").orderBy("ord")
    df = with_order(events, "user_id").withColumn("i", F.row_number().over(w) - 1)
    df = df.withColumns({"b": F.floor(F.col("i") / block), "k": F.col("i") % block})
    run = Window.partitionBy("user_id", "b").orderBy("ord")
    grown = lambda x: F.pow(F.lit(decay), F.col("k")) * F.sum(x * F.pow(F.lit(decay), -F.col("k"))).over(run)
    df = df.withColumns({"c0": grown(F.cos(angle())), "s0": grown(F.sin(angle())), "w0": grown(F.lit(1.0))})
    ends = df.where(F.col("k") == block - 1).select(F.col("user_id").alias("u"), (F.col("b") + 1).alias("nb"), "c0", "s0", "w0")
    carry = Window.partitionBy("u").orderBy("nb")
    at = F.pow(F.lit(decay), F.lit(float(block)))
    state = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    seen = F.collect_list(F.struct("c0", "s0", "w0")).over(carry)
    ends = ends.withColumn("st", F.aggregate(seen, state, lambda a, x: F.struct((a["c"] * at + x["c0"]).alias("c"), (a["s"] * at + x["s0"]).alias("s"), (a["w"] * at + x["w0"]).alias("w"))))
    df = df.join(ends.select("u", "nb", "st"), (F.col("user_id") == F.col("u")) & (F.col("b") == F.col("nb")), "left")
    more = F.pow(F.lit(decay), F.col("k") + 1)
    total = lambda n, f: F.col(n) + more * F.coalesce(F.col("st")[f], F.lit(0.0))
    return df.select("event_index", "user_id", total("c0", "c").alias("c"), total("s0", "s").alias("s"), total("w0", "w").alias("w"))


def online_models(sums: DataFrame) -> DataFrame:
    length = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("w")
    return sums.select("event_index", "user_id", F.pmod(F.atan2("s", "c"), F.lit(2 * math.pi)).alias("mean_angle"), concentration(length).alias("kappa"))


def drift(observations: DataFrame, window: int = 7, hours: float = 24.0, warn: float = 30.0, critical: float = 90.0) -> DataFrame:
    """Alerts on a user's mean angle, given as (user_id, at, degrees): far from the first one, or moving fast over the last seven.

    ``velocity`` is degrees a day: the mean step of the window scaled by the
    hours between observations.
    """
    w = Window.partitionBy("user_id").orderBy("at")
    step = angular_distance(F.col("degrees"), F.lag("degrees").over(w))
    df = observations.withColumns({"step": step, "moved": angular_distance(F.col("degrees"), F.first("degrees").over(w))})
    df = df.withColumn("velocity", F.avg("step").over(w.rowsBetween(2 - window, 0)) * (24.0 / max(hours, 0.1)))
    level = F.when(F.col("moved") >= critical, "CRITICAL").when(F.col("velocity") >= warn, "WARNING")
    return df.where("step IS NOT NULL").withColumn("severity", level).where("severity IS NOT NULL").select("user_id", "at", "severity", "velocity", "moved")


def online_state(events: DataFrame, before: DataFrame | None = None, decay: float = DECAY) -> DataFrame:
    """(user_id, c, s, w): the decayed sums of each user after ``events``, going on from the state ``before`` them.

    A state is a table, so it is saved and read like any other.
    """
    sums = online(events, decay)
    last = sums.join(with_order(events, "user_id").select(F.col("event_index").alias("__i"), F.col("ord").alias("__n")), F.col("event_index") == F.col("__i"))
    new = last.groupBy("user_id").agg(F.max_by(F.struct("c", "s", "w"), "__n").alias("x"), F.max("__n").alias("n")).select("user_id", "x.*", "n")
    if before is None:
        return new.drop("n")
    old = before.select(F.col("user_id").alias("__u"), *[F.col(x).alias(f"__{x}") for x in "csw"])
    joined = new.join(old, F.col("user_id") == F.col("__u"), "full")
    faded = F.pow(F.lit(decay), F.coalesce("n", F.lit(0)))
    kept = [(F.coalesce(F.col(x), F.lit(0.0)) + faded * F.coalesce(F.col(f"__{x}"), F.lit(0.0))).alias(x) for x in "csw"]
    return joined.select(F.coalesce("user_id", "__u").alias("user_id"), *kept)


def forget(state: DataFrame, users: list[str]) -> DataFrame:
    """A state, or a table of drift baselines, without these users: they begin anew."""
    return state.where(~F.col("user_id").isin(*users)) if users else state


def drift_baselines(observations: DataFrame, before: DataFrame | None = None, resets: DataFrame | None = None) -> DataFrame:
    """(user_id, at, degrees): the angle that a user's drift is measured from: a reset, else the one known before, else the first seen."""
    first = observations.groupBy("user_id").agg(F.min(F.struct("at", "degrees")).alias("x")).select("user_id", "x.*", F.lit(2).alias("rank"))
    rows = first
    for rank, table in ((1, before), (0, resets)):
        if table is not None:
            rows = rows.unionByName(table.select("user_id", F.col("at").cast(observations.schema["at"].dataType).alias("at"), "degrees", F.lit(rank).alias("rank")))
    return rows.groupBy("user_id").agg(F.min_by(F.struct("at", "degrees"), F.struct("rank", F.unix_micros(F.col("at").cast("timestamp")))).alias("x")).select("user_id", "x.*")


def drift_status(observations: DataFrame, baselines: DataFrame, window: int = 7) -> DataFrame:
    """(user_id, status, baseline, current, moved, n_recent) of each user with a baseline or an observation; users without a baseline say so."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))
    recent = observations.withColumn("__p", place).where(F.col("__p") <= window).groupBy("user_id").agg(F.max_by("degrees", "at").alias("current"), F.count("*").alias("n_recent"))
    known = baselines.select(F.col("user_id").alias("__u"), F.col("degrees").alias("baseline"))
    joined = recent.join(known, F.col("user_id") == F.col("__u"), "full")
    return joined.select(
        F.coalesce("user_id", "__u").alias("user_id"),
        F.when(F.col("baseline").isNull(), "no_baseline").otherwise("tracked").alias("status"),
        "baseline",
        "current",
        F.coalesce(angular_distance(F.col("baseline"), F.col("current")), F.lit(0.0)).alias("moved"),
        F.coalesce("n_recent", F.lit(0)).alias("n_recent"),
    )
