"""Helpers that the operators of this folder share: scratch tables, prefix offsets, word patterns.

Scratch tables live under ``spark.checkpoint.dir``, which every executor of a
cluster sees. Only a local master may fall back to a temporary folder.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = f"[^{SPACE_CLASS}]+"

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(_roots[app])
    return _roots[app]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no DataFrame reads any more."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_dir(spark)}/tidewatch-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = root

        def clean() -> None:
            try:
                remove(spark, root)
            except Exception:  # the JVM may be gone already
                pass

        atexit.register(clean)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of an Arrow batch between Spark and its Python workers: texts are long, and both sides hold a batch twice.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the session's executors, once per application, and keep Arrow batches small."""
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(limit))) != BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    if f"ship-{sc.applicationId}" in _roots:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidewatch-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _roots[f"ship-{sc.applicationId}"] = str(target)


def trim() -> None:
    """Give freed memory of a Python worker back to the system: workers live on between tasks beside the executor's heap."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, whatever it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: F.Column, body) -> F.Column:
    """``body(value)`` with ``value`` computed once: a lambda over a one-element array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text) -> F.Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def n_words(text) -> F.Column:
    """How many words a text has, without building them: word starts are counted in a copy where each word is one letter."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(squeezed, f"[{SPACE_CLASS}]+", "")).cast("long")


def ranked(df: DataFrame, group: str | None, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the gapless position from 0 of each row within its ``group`` by ``order``.

    Rows are dealt out by range over (group, order) and sorted within
    partitions; a group's partitions get offsets from their counts (one row per
    partition and group), so that no group has to fit into one task. The input
    is written once, which pins the partitions that both passes read.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in ([group] if group else []) + order]
    pinned, _ = materialise(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("__at", 33).alias("__part")
    by = [F.col(group).alias("__group")] if group else [F.lit(0).alias("__group")]
    counts = pinned.select(*by, part, "__at").groupBy("__group", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    rows = sorted(counts.collect(), key=lambda r: r["__part"])  # at most partitions + groups rows
    seen: dict = {}
    offsets = []
    for r in rows:
        offsets.append((r["__group"], r["__part"], seen.get(r["__group"], 0) - r["__first"]))
        seen[r["__group"]] = seen.get(r["__group"], 0) + r["__n"]
    kind = pinned.schema[group].dataType.simpleString() if group else "int"
    small = spark.createDataFrame(offsets, f"__group {kind}, __part long, __shift long")
    on = (F.col(group) if group else F.lit(0)).eqNullSafe(F.col("__group")) & (F.shiftright("__at", 33) == F.col("__part"))
    return (
        pinned.join(F.broadcast(small), on)
        .withColumn(name, F.col("__at") + F.col("__shift"))
        .drop("__at", "__group", "__part", "__shift")
    )


def running(df: DataFrame, group: str, at: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """``df``, one row per ``group`` and place ``at``, with ``name``: the sum of ``value`` over the group's smaller places.

    Sums of spans of places run first, then places within their span, so that
    no window holds all places of a large group.
    """
    g, s, b = fresh(df, "__running_group", "__running_span", "__running_before")
    placed = df.withColumn(s, F.floor(F.col(at) / span).cast("long"))
    earlier = Window.partitionBy(g).orderBy(f"{s}_").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy(F.col(group).alias(g), F.col(s).alias(f"{s}_")).agg(F.sum(value).alias(b))
    spans = spans.withColumn(b, F.coalesce(F.sum(b).over(earlier), F.lit(0)))
    inside = Window.partitionBy(group, s).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = placed.join(spans, F.col(group).eqNullSafe(F.col(g)) & (F.col(s) == F.col(f"{s}_")), "left")
    return joined.withColumn(name, F.col(name) + F.col(b)).drop(g, s, b, f"{s}_")
