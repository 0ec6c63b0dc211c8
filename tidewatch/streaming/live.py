"""Structured Streaming: watching a folder, fleet windows, alert limits per user, and start-up phases."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.sources.readers import read_events
from tidewatch.sources.schema import EVENT


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Canonical events of the parquet files that appear in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def watch_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, str], None], checkpoint: str, pattern: str = "*", files_per_batch: int = 1, every: str | None = None):
    """Hand the canonical events of each new file of any kind that ``read_events`` knows to ``handle``, with the file's path.

    The stream carries names only; a file is read by the reader of its kind.
    Files that fail are named together at the end of their batch.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    names = names.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).load(folder).select("path")

    def each(batch: DataFrame, number: int) -> None:
        failed = []
        for path in sorted(r["path"] for r in batch.collect()):  # ``files_per_batch`` names at most
            try:
                handle(read_events(batch.sparkSession, path), path)
            except Exception as e:
                failed.append(f"{path}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))

    return run_batches(names, each, checkpoint, every)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand each micro-batch to ``handle``; without ``every`` what is there is read and the query ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def isolated(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One handler for several sinks: each gets the batch, and those that fail are named together at the end."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        failed = []
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception as e:
                    failed.append(f"{getattr(sink, '__name__', sink)}: {e}")
        finally:
            batch.unpersist()
        if failed:
            raise RuntimeError("; ".join(failed))

    return handle


def fleet(stream: DataFrame, minutes: int = 60, step: int = 10, late: str = "1 hour") -> DataFrame:
    """Sliding windows with approximate numbers of users and networks; rows later than the watermark are left out."""
    marked = stream.withWatermark("timestamp", late)
    return marked.groupBy(F.window("timestamp", f"{minutes} minutes", f"{step} minutes").alias("w")).agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.approx_count_distinct("asn", 0.01).alias("networks"), F.count("*").alias("logins"))


def sessions(stream: DataFrame, gap: str = "45 minutes", late: str = "1 hour") -> DataFrame:
    marked = stream.withWatermark("timestamp", late)
    return marked.groupBy("user_id", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n_events"))


def limited(alerts: DataFrame, seconds: int = 60, most: int = 3) -> DataFrame:
    """Alerts (user_id, timestamp, event_index) with ``emitted``: at most so many of a user within the window, by event time.

    State is the times of a user's last emitted alerts, ``most`` at most.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["timestamp", "event_index"])
        flags = []
        for t in rows["timestamp"].astype("int64") // 1000:
            kept = [k for k in kept if t - k <= seconds * 1_000_000]
            flags.append(len(kept) < most)
            if flags[-1]:
                kept.append(int(t))
        state.update((kept,))
        yield pd.DataFrame({"user_id": key[0], "event_index": rows["event_index"], "emitted": flags})

    rows = alerts.select("user_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "event_index")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id string, event_index long, emitted boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Bootstrap:
    """Start-up of a scorer on a stream: observe, then warm, then mature, by events seen.

    While mature, the threshold is renewed every ``renew`` events. A batch
    whose mean is far from the running mean is counted as suspect and doesn't
    move it.
    """

    observe: int = 500
    warm: int = 2500
    renew: int = 1000
    contamination: float = 0.05
    pace: float = 0.1
    far: float = 4.0
    seen: int = 0
    since: int = 0
    threshold: float | None = None
    mean: float | None = None
    spread: float = 0.0
    suspect: int = 0
    instability: list[float] = field(default_factory=list)

    @property
    def phase(self) -> str:
        return "observe" if self.seen < self.observe else "warm" if self.seen < self.warm else "mature"

    def ingest(self, batch: DataFrame, score: str = "score") -> DataFrame | None:
        """Take a micro-batch in; once past observing, the batch with is_anomaly, before that None."""
        n, mean, spread, tau = batch.agg(F.count(score), F.avg(score), F.stddev_pop(score), F.percentile(score, 1 - self.contamination)).first()
        if not n:
            return None
        odd = self.mean is not None and self.spread > 0 and abs(mean - self.mean) > self.far * self.spread
        if odd:
            self.suspect += 1
        else:
            self.mean = mean if self.mean is None else (1 - self.pace) * self.mean + self.pace * mean
            self.spread = spread if self.spread == 0 else (1 - self.pace) * self.spread + self.pace * spread
        self.seen += n
        self.since += n
        if not odd and (self.threshold is None or self.phase == "warm" or self.since >= self.renew):
            if self.threshold is not None:
                self.instability.append(abs(tau - self.threshold))
            self.threshold, self.since = float(tau), 0
        if self.phase == "observe" or self.threshold is None:
            return None
        return batch.withColumn("is_anomaly", F.col(score) >= self.threshold)

    def reset(self) -> None:
        """Forget everything but the settings."""
        self.__dict__.update(asdict(Bootstrap(self.observe, self.warm, self.renew, self.contamination, self.pace, self.far)))

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Bootstrap:
        return cls(**json.loads(text))
