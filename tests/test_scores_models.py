import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_patterns_rules import FAIL, events  # noqa: F401
from tidewatch.functions import scalar
from tidewatch.models import outliers
from tidewatch.operators import cases, circular, evaluate, identity, monitor, scoring
from tidewatch.operators.inject import TYPES, inject


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i % 9}", rng.random(), rng.gauss(5, 2), 3.0) for i in range(300)]
    return spark.createDataFrame(rows, "event_index long, user_id string, a double, b double, c double").cache()


def test_normaliser_modes(table):
    n = scoring.Normaliser().fit(table, ["a", "b", "c"])
    out = n.transform(table)
    low, high, flat = out.agg(F.min("b"), F.max("b"), F.max("c")).first()
    assert (low, high, flat) == (0.0, 1.0, 0.5)
    assert n.parameters["c"]["mode"] == "constant"
    same = table.withColumn("identity_x", F.lit(0.2))
    assert scoring.Normaliser().fit(same, ["identity_x"]).parameters["identity_x"]["mode"] == "same"
    with pytest.raises(ValueError):
        scoring.Normaliser().fit(table.limit(5), ["a"])


def test_votes_and_disagreement(spark):
    df = spark.createDataFrame([(0.0, 0.5, 1.0, 0.9), (0.3, 0.3, 0.3, 0.3)], "a double, b double, c double, d double")
    m = ["a", "b", "c", "d"]
    rows = df.select(scoring.vote(m).alias("mean"), scoring.vote(m, "median").alias("median"), scoring.vote(m, "trimmed_mean").alias("trimmed"), scoring.vote(m, "weighted", {"a": 0, "b": 0, "c": 2, "d": 0}).alias("weighted"), scoring.disagreement(m).alias("d"), scoring.variance(m).alias("v")).collect()
    r = rows[0]
    assert (r["mean"], r["median"], r["trimmed"], r["weighted"]) == (pytest.approx(0.6), pytest.approx(0.7), pytest.approx(0.7), pytest.approx(1.0))
    assert r["v"] == pytest.approx(np.var([0, 0.5, 1.0, 0.9]))
    assert rows[1]["d"] == pytest.approx(0, abs=1e-9) and 0 < r["d"] <= math.log(4) / 4


def test_pipeline_rate_floor_and_reload(table):
    p = scoring.Pipeline(["a", "b"], contamination=0.1).fit(table)
    out = p.score(table)
    assert out.where("is_anomaly").count() == pytest.approx(30, abs=2)
    again = scoring.Pipeline.loads(p.dumps())
    assert again.score(table).where("is_anomaly").count() == out.where("is_anomaly").count()
    floored = scoring.Pipeline(["a", "b"], contamination=0.01, floor_model="a", floor=0.9, support_model="b", support=0.5).fit(table).score(table)
    assert floored.where("floor_hit").count() == floored.where("a >= 0.9 AND b >= 0.5").count() > 0
    assert floored.where("floor_hit AND (NOT is_anomaly OR ensemble <> 1)").count() == 0


def test_scorer_ranks(table):
    out = {r["event_index"]: r for r in scoring.scored(table, "a").collect()}
    values = sorted(r["a"] for r in out.values())
    assert all(r["percentile_rank"] == pytest.approx(np.searchsorted(values, r["a"], "right") / 300) for r in out.values())


def test_detection_rates_with_ties(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 1), rng.random() < 0.2) for _ in range(400)]
    got = {r["target_fpr"]: r["detection_rate"] for r in evaluate.detection_rates(spark.createDataFrame(rows, "s double, t boolean"), "s", "t").collect()}
    attacks, normal = [s for s, t in rows if t], [s for s, t in rows if not t]
    for target, rate in got.items():
        best = max([sum(a >= tau for a in attacks) / len(attacks) for tau in {s for s, _ in rows} if sum(n >= tau for n in normal) / len(normal) <= target], default=0)
        assert rate == pytest.approx(best)


def test_circular_functions(spark):
    ks = [0.1, 0.5, 1.0, 2.0, 5.0, 20.0, 80.0]
    df = spark.createDataFrame([(k,) for k in ks], "k double")
    grid = np.linspace(0, 2 * math.pi, 200_001)
    for r in df.select("k", scalar.bessel_ratio(F.col("k")).alias("ratio"), scalar.bessel_log_i0(F.col("k")).alias("log"), scalar.concentration(scalar.bessel_ratio(F.col("k"))).alias("back")).collect():
        e = np.exp(r["k"] * (np.cos(grid) - 1))
        i0 = np.trapezoid(e, grid) / (2 * math.pi)
        i1 = np.trapezoid(e * np.cos(grid), grid) / (2 * math.pi)
        assert r["ratio"] == pytest.approx(i1 / i0, rel=1e-4)
        assert r["log"] == pytest.approx(math.log(i0) + r["k"], abs=1e-5)
        assert r["back"] == pytest.approx(r["k"], rel=2e-3)


def test_online_sums_equal_a_fold(events):  # noqa: F811
    rng = random.Random(9)
    rows = [("a", sum(rng.randint(1, 90) for _ in range(i % 5 + 1)) + 97 * i, {}) for i in range(60)]
    df = events(rows)
    stamps = {r["event_index"]: r["timestamp"] for r in df.collect()}
    c = w = 0.0
    want = {}
    for i in sorted(stamps, key=lambda i: (stamps[i], i)):
        angle = (stamps[i].hour + stamps[i].minute / 60) * 2 * math.pi / 24
        c, w = c * 0.9 + math.cos(angle), w * 0.9 + 1
        want[i] = (c, w)
    got = {r["event_index"]: (r["c"], r["w"]) for r in circular.online(df, 0.9).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_dedup_limits_alerts(events):  # noqa: F811
    df = events([("a", m / 60, {}) for m in (0, 10, 20, 30, 61, 62, 200)])
    assert {r["event_index"]: r["emitted"] for r in monitor.deduplicated(df).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
    held = monitor.burst_summaries(monitor.deduplicated(df).withColumn("score", F.lit(0.5))).collect()
    assert held[0]["suppressed"] == 2


def test_gate_needs_two_signals(events):  # noqa: F811
    df = events([("a", m, {}) for m in range(14)]).withColumns({"score": F.when(F.col("event_index") == 12, 0.99).otherwise(0.7), "nll": F.when(F.col("event_index") == 13, 9.0).otherwise(1.0), "jsd": F.when(F.col("event_index") == 3, 0.5).otherwise(0.0)})
    got = {r["event_index"] for r in monitor.gated(df, tau=0.6).where("passes").collect()}
    assert got == {3, 12, 13}


def test_models_find_planted_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    x[:6] += 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event_index long, a double, b double, c double, d double")
    for model in (outliers.IsolationForest(trees=60), outliers.LocalOutlierFactor(k=15), outliers.Ensemble([outliers.IsolationForest(trees=30), outliers.LocalOutlierFactor(k=15)])):
        model.fit(df, ["a", "b", "c", "d"])
        worst = [r["event_index"] for r in model.score(df).orderBy("score").limit(6).collect()]
        assert set(worst) == set(range(6)), type(model)
    forest = outliers.IsolationForest(trees=20).fit(df, ["a", "b", "c", "d"])
    assert outliers.inspect(forest.dumps())["trees"] == 20
    same = outliers.IsolationForest.loads(forest.dumps()).score(df)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, outliers.IsolationForest(trees=20).fit(df, ["a", "b", "c", "d"]).score(df).collect()))
    top = df.select(outliers.explain(["a", "b"], outliers.Scaler().fit(df, ["a", "b"]), 1).alias("t")).first()["t"][0]
    assert top["feature"] in ("a", "b")
    assert len(outliers.topology_lifetimes(df, ["a", "b"], 50)) == 49
    with pytest.raises(KeyError):
        outliers.create("nothing")


def test_injections_are_seeded_and_marked(events):  # noqa: F811
    df = events([(f"u{i % 7}", 13 * i, {"ip_address": f"10.0.0.{i % 5}"}) for i in range(140)])
    want = {"credential_stuffing": 50, "burst_attack": 100, "session_hijack": 3 + 16 + 20 + 3, "mfa_bypass": 3, "low_and_slow": 16, "password_spraying": 7, "coordinated_campaign": 14, "volume_spike": 40, "temporal_shift": 20, "asn_shift": 20, "identity_drift": 20, "temporal_jitter": 20}
    for kind in TYPES:
        a = inject(df, kind).where("synthetic")
        assert a.count() == want[kind], kind
        b = inject(df.repartition(3), kind).where("synthetic")
        key = lambda d: sorted((r["event_index"], r["user_id"], str(r["timestamp"]), str(r["ip_address"])) for r in d.collect())
        if kind in ("session_hijack", "password_spraying"):
            assert key(a) == key(b)
    assert inject(df.where("false"), "burst_attack").count() == 0


def test_hijack_becomes_a_case(events):  # noqa: F811
    df = events([("a", 60 * i, {"session_id": f"s{i}"}) for i in range(6)])
    mixed = inject(df, "session_hijack")
    assert "identity_takeover_score" in identity.signals(mixed).select(identity.signal_map().alias("m")).first()["m"]
    signals = identity.signals(mixed).withColumn("is_anomaly", F.col("takeover_score") >= 0.5)
    found = cases.aggregate(signals)
    got = cases.detection(found, mixed.where("synthetic"), "session_hijack").first()
    assert got["synthetic_cases"] > 0 and got["matches_expected"] == 1


def test_feedback(spark, tmp_path):
    rows = [(f"e{i}", "fp", a, "u1") for i in range(6) for a in ("x", "y")] + [(f"e{i}", "tp", "z", "u1") for i in range(6)]
    df = spark.createDataFrame(rows, "event_id string, verdict string, analyst_id string, user_id string").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    assert monitor.confirmed(df).count() == 6
    monitor.append_feedback(df, str(tmp_path / "fb"))
    monitor.append_feedback(df.withColumn("verdict", F.lit("odd")), str(tmp_path / "fb"))
    assert spark.read.parquet(str(tmp_path / "fb")).count() == 18
    assert monitor.feedback_summary(df).first()["fp"] == 12
    assert monitor.false_positive_rates(df).first()["fp_rate"] == 1.0
    assert [r["analyst_id"] for r in monitor.poisoning_analysts(df).collect()] == ["z"]
    assert monitor.confirmed_since(df, "fp", "2025-01-01").count() == 6


def test_outlier_factor_uses_all_rows_exactly(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(3000, 2)) * [1, 5], 2)
    x[:60] = x[0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event_index long, a double, b double")
    model = outliers.LocalOutlierFactor(k=10, cell=100).fit(df, ["a", "b"])
    assert model.points.agg(F.sum("n")).first()[0] == 3000 and len(model.cells[1]) > 8
    got = {r["event_index"]: r["score"] for r in model.score(df).collect()}
    z = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    own = d.copy()
    np.fill_diagonal(own, np.inf)
    reach = np.sort(own, 1)[:, 9]
    found = {r["at"]: r["reach"] for r in model.known.collect()}
    ids = {r["event_index"]: r["id"] for r in model._points(outliers.numeric(df, ["a", "b"])).collect()}
    assert len(got) == 3000 and np.allclose([found[ids[i]] for i in range(3000)], reach, atol=1e-9)
    near = np.argsort(own, 1, kind="stable")[:, :10]
    density = 1 / (np.maximum(np.take_along_axis(own, near, 1), reach[near]).mean(1) + 1e-10)
    near = np.argsort(d, 1, kind="stable")[:, :10]
    want = 1.5 - density[near].mean(1) * (np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(1) + 1e-10)
    assert np.mean(np.isclose([got[i] for i in range(3000)], want, rtol=1e-6)) > 0.9  # rows whose last neighbours tie may differ


def test_registered_outlier_factor_fits_every_event(spark, monkeypatch):
    from tidewatch.plans import queries_engine

    fitted = []
    fit = outliers.LocalOutlierFactor.fit
    monkeypatch.setattr(outliers.LocalOutlierFactor, "fit", lambda self, df, features: fitted.append(fit(self, df, features)) or fitted[0])
    queries_engine.QUERIES["lof"](spark, "/root/testdata/sf0.01")
    assert fitted[0].points.agg(F.sum("n")).first()[0] == 10_000


def test_bessel_logarithms_are_exact_to_twelve_digits(spark):
    ks = [0.0, 0.3, 1.7, 3.74, 3.76, 12.0, 19.99, 20.01, 60.0, 200.0]
    df = spark.createDataFrame([(k,) for k in ks], "k double").select("k", scalar.bessel_log_i0(F.col("k")).alias("log"))
    grid = np.arange(4096) * (2 * math.pi / 4096)  # equal steps over a whole period: the mean is exact
    for r in df.collect():
        assert r["log"] == pytest.approx(math.log(np.exp(r["k"] * (np.cos(grid) - 1)).mean()) + r["k"], abs=1e-12)


def test_gate_interpolates_with_one_rounding(spark, events):  # noqa: F811
    pairs = [(random.Random(i).random(), random.Random(-i - 1).random(), i / 997) for i in range(997)]
    df = spark.createDataFrame(pairs, "a double, b double, f double")
    for a, b, f, got in df.select("a", "b", "f", scalar.between(F.col("a"), F.col("b"), F.col("f"))).collect():
        assert got == math.fma(a, 1 - f, b * f)
    # of 12 values the percentile lies nine twentieths between the last two: 52 + 9 of 99, what the next row has
    df = events([("a", m, {}) for m in range(13)])
    nll = F.when(F.col("event_index") == 12, 61.0).when(F.col("event_index") == 11, 72.0).otherwise(52.0) / 99
    fired = monitor.gated(df.withColumns({"score": F.lit(0.0), "nll": nll, "jsd": F.lit(0.0)}), tau=0.6).where("temporal_fired")
    assert sorted(r["event_index"] for r in fired.collect()) == [11, 12]


def test_distances_of_angles_are_rounded_once(spark):
    rng = random.Random(8)
    pairs = [(rng.random() * 360, rng.random() * 360) for _ in range(500)]
    df = spark.createDataFrame(pairs, "a double, b double")
    for a, b, got in df.select("a", "b", scalar.angular_distance(F.col("a"), F.col("b"))).collect():
        assert got == min(abs(a - b), 360 - abs(a - b))


def test_mean_angles_equal_the_c_library(events):  # noqa: F811
    df = events([(f"u{m}", m, {}) for m in range(0, 1440, 3)])
    got = {r["user_id"]: r["mean_angle"] for r in circular.moments(df, 1).collect()}
    for r in df.selectExpr("user_id", "hour(timestamp) h", "minute(timestamp) m").collect():
        a = (r["h"] + r["m"] / 60) * 2 * math.pi / 24
        c, s = (math.floor(abs(x) * 1e12 + 0.5) / 1e12 * math.copysign(1, x) + 0.0 for x in (math.cos(a), math.sin(a)))
        assert got[r["user_id"]] == math.atan2(s, c) % (2 * math.pi)


def test_outlier_factor_finds_training_rows_scores_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(np.r_[rng.normal(size=(900, 3)), rng.normal(size=(300, 3)) * 0.01 + 4, np.repeat(rng.normal(size=(2, 3)) * 9, 40, 0)], 2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event_index long, a double, b double, c double")
    model = outliers.LocalOutlierFactor(k=7, cell=90).fit(df, ["a", "b", "c"])
    scores = lambda: {r["event_index"]: r["score"] for r in model.score(df).collect()}
    nearest = outliers.LocalOutlierFactor._nearest
    monkeypatch.setattr(outliers.LocalOutlierFactor, "_nearest", lambda *a: pytest.fail("searched again"))
    kept = scores()
    monkeypatch.setattr(outliers.LocalOutlierFactor, "_nearest", nearest)
    model.scored = None  # as if loaded: every row is searched for
    assert len(kept) == len(x)
    assert kept == pytest.approx(scores(), rel=1e-9, abs=1e-9)


def test_ensemble_scores_each_member_once_in_fitting(table, monkeypatch):
    scored = []
    score = outliers.LocalOutlierFactor.score
    monkeypatch.setattr(outliers.LocalOutlierFactor, "score", lambda self, df: scored.append(1) or score(self, df))
    model = outliers.Ensemble([outliers.IsolationForest(trees=10), outliers.LocalOutlierFactor(k=5)]).fit(table, ["a", "b"])
    assert len(scored) == 1
    flagged = model.predict(table).where("prediction = -1").count()
    assert 0 < flagged <= 15
