import json

from pyspark.sql import functions as F
from test_patterns_rules import FAIL, events  # noqa: F401
from tidewatch import cli, engine
from tidewatch.config import Config
from tidewatch.streaming import live


def many(events, n=120):  # noqa: F811
    return events([(f"u{i % 6}", 17 * i, {"session_id": f"s{i % 6}-{i // 30}", "session_duration_seconds": float(i % 50), "ip_address": f"10.0.0.{i % 6}", **(FAIL if i % 9 == 0 else {})}) for i in range(n)])


def test_run_and_detect(events):  # noqa: F811
    config = Config.of({"model": {"detectors": ["isolation_forest"]}, "unknown": 1})
    out = engine.run(many(events), config)
    assert out.results.count() == 120
    assert 0 < out.results.where("is_anomaly").count() < 40
    found = engine.detect(many(events), many(events), config)
    assert found.users.count() == 6 and found.matches.count() >= 0
    review = engine.posture(out.results, out.cases)
    assert review["events"] == 120


def test_benchmark(events):  # noqa: F811
    config = Config.of({"model": {"detectors": ["isolation_forest"]}, "features": {"groups": ["velocity", "auth"]}})
    out = engine.benchmark(many(events, 160), "burst_attack", config)
    assert {r["method"] for r in out["rates"].collect()} == {"pipeline", "mean"}
    slices = {r["slice"]: r["n"] for r in out["slices"].collect()}
    assert slices["injected"] == 100 and slices["all"] == slices["injected"] + slices["ordinary"]


def test_config_round_trip(tmp_path):
    c = Config.of({"cases": {"window_minutes": 5}})
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c
    (tmp_path / "c.yaml").write_text("cases:\n  window_minutes: 5\n")
    assert Config.load(str(tmp_path / "c.yaml")) == c


def test_command_line(events, tmp_path, capsys):  # noqa: F811
    many(events).drop("raw_fields").write.csv(str(tmp_path / "log.csv"), header=True)
    assert cli.main(["init"]) == 0 and "detectors" in json.loads(capsys.readouterr().out)["model"]
    for command in (["info"], ["rules"], ["baseline"], ["correlate"]):
        assert cli.main([*command, str(tmp_path / "log.csv")]) == 0


def test_watch_scores_files_as_they_come(spark, events, tmp_path):  # noqa: F811
    many(events).repartition(3).write.parquet(str(tmp_path / "in"))
    seen, state = [], live.Bootstrap(observe=30, warm=90)

    def handle(batch, number):
        out = state.ingest(batch.withColumn("score", F.col("session_duration_seconds")))
        seen.append((batch.count(), None if out is None else out.where("is_anomaly").count()))

    def broken(batch, number):
        raise ValueError("no")

    live.run_batches(live.watch(spark, str(tmp_path / "in")), handle, str(tmp_path / "cp")).awaitTermination()
    assert sum(n for n, _ in seen) == 120 and state.phase == "mature" and state.threshold is not None
    assert live.Bootstrap.loads(state.dumps()) == state
    q = live.run_batches(live.watch(spark, str(tmp_path / "in")), live.isolated(broken, handle), str(tmp_path / "cp2"))
    try:
        q.awaitTermination()
    except Exception as e:
        assert "no" in str(e)
    assert sum(n for n, _ in seen) > 120


def test_stream_windows_equal_batch_windows(spark, events, tmp_path):  # noqa: F811
    df = many(events)
    df.write.parquet(str(tmp_path / "in"))
    q = live.fleet(live.watch(spark, str(tmp_path / "in"), 10)).writeStream.format("memory").queryName("fleet").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = df.groupBy(F.window("timestamp", "60 minutes", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    assert {r["w"]["end"]: r["logins"] for r in spark.table("fleet").collect()} == {r["w"]["end"]: r["n"] for r in batch.collect()}


def test_stream_limits_alerts_per_user(spark, events, tmp_path):  # noqa: F811
    events([("a", m / 60, {}) for m in (0, 10, 20, 30, 61, 62, 200)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.limited(live.watch(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_index"]: r["emitted"] for r in spark.table("limited").collect()} == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 70


def test_saved_models_score_alike(spark, events, tmp_path):  # noqa: F811
    from tidewatch.models import outliers

    df = many(events).withColumn("a", F.col("session_duration_seconds")).withColumn("b", F.hour("timestamp").cast("double"))
    fitted = [outliers.IsolationForest(trees=20), outliers.LocalOutlierFactor(k=5)]
    fitted.append(outliers.Ensemble([outliers.IsolationForest(trees=20), outliers.LocalOutlierFactor(k=5)]))
    for i, model in enumerate(fitted):
        model.fit(df, ["a", "b"])
        outliers.save(model, spark, str(tmp_path / f"m{i}"))
        again = outliers.load(spark, str(tmp_path / f"m{i}"))
        rows = lambda m: sorted((r["event_index"], round(r["score"], 9), r["prediction"]) for r in m.predict(df).collect())
        assert rows(again) == rows(model)
        (top,) = again.explain(df.where("event_index = 3"), 1).collect()
        assert top["top"][0]["feature"] in ("a", "b")
    assert all(len(t["feature"]) > 1 for t in fitted[0].forest)


def test_train_then_detect_and_watch_from_the_command_line(spark, events, tmp_path):  # noqa: F811
    (tmp_path / "c.json").write_text(json.dumps({"features": {"groups": ["velocity", "auth"], "identity": False}, "model": {"contamination": 0.1}}))
    config = ["--config", str(tmp_path / "c.json")]
    rows = many(events).drop("raw_fields").toPandas()
    (tmp_path / "in").mkdir()
    rows.to_csv(tmp_path / "in" / "one.csv", index=False)
    rows.assign(timestamp=rows["timestamp"].astype(str)).to_json(tmp_path / "in" / "two.jsonl", orient="records", lines=True)
    assert cli.main(["train", str(tmp_path / "in" / "one.csv"), str(tmp_path / "model"), *config]) == 0
    seen = []
    live.watch_files(spark, str(tmp_path / "in"), lambda e, path: seen.append((path.rsplit("/", 1)[-1], e.count())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("one.csv", 120), ("two.jsonl", 120)]
    from tidewatch.models.outliers import load
    from tidewatch.sources.readers import read_events

    log = read_events(spark, str(tmp_path / "in" / "one.csv"))
    found = engine.detect(None, log, Config.load(str(tmp_path / "c.json")), model=load(spark, str(tmp_path / "model")))
    assert found.results.count() == 120 and found.users.count() == 6


def test_runs_without_identity_signals_have_no_cases(events):  # noqa: F811
    config = Config.of({"features": {"groups": ["velocity"], "identity": False}, "model": {"detectors": ["isolation_forest"]}})
    found = engine.run(many(events), config)
    assert found.results.count() == 120 and found.cases.count() == 0


def test_online_state_goes_on_and_drift_status(spark, events):  # noqa: F811
    from tidewatch.operators import circular

    df = many(events, 60)
    whole = {r["user_id"]: (r["c"], r["s"], r["w"]) for r in circular.online_state(df).collect()}
    first = circular.online_state(df.where("event_index < 30"))
    later = {r["user_id"]: (r["c"], r["s"], r["w"]) for r in circular.online_state(df.where("event_index >= 30"), first).collect()}
    assert set(whole) == set(later) and all(abs(a - b) < 1e-9 for u in whole for a, b in zip(whole[u], later[u], strict=True))
    assert circular.forget(first, ["u1"]).where("user_id = 'u1'").count() == 0
    seen = spark.createDataFrame([("a", "2026-01-01", 10.0), ("a", "2026-01-02", 50.0), ("b", "2026-01-01", 350.0)], "user_id string, at string, degrees double")
    resets = spark.createDataFrame([("b", "2026-01-03", 20.0)], "user_id string, at string, degrees double")
    status = {r["user_id"]: (r["status"], r["baseline"], r["current"], r["moved"], r["n_recent"]) for r in circular.drift_status(seen, circular.drift_baselines(seen, resets=resets)).collect()}
    assert status == {"a": ("tracked", 10.0, 50.0, 40.0, 2), "b": ("tracked", 20.0, 350.0, 30.0, 1)}
    assert circular.drift_status(seen, circular.forget(circular.drift_baselines(seen), ["a"])).where("status = 'no_baseline'").count() == 1
