"""Sharding by a k-d tree: recursive splits at distributed weighted medians along the widest metadata dimension.

Metadata columns become coordinates in [0, 32767]. A node that is to hold
several leaves is split along its widest dimension at the weighted median, so
that bytes stand in the ratio of the leaves on either side, until each leaf
holds its target bytes. Medians of all nodes of a level are found together, by
descending over the digits of a sort key: each pass sums weights by (node,
digit) and picks each node's digit in the cluster, so that one row per node
reaches the driver.

Equal texts share their coordinates (the least of their rows') and a hash in
the sort key, so they stay together. A group of equal texts that outweighs
``TOLERANCE`` of a leaf is dealt into pieces next to each other; only where a
split falls into such a group do its pieces part, because bytes come first.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._shared import materialise, ranked, remove

TOLERANCE = 0.01
#: A sort key is 15 bits of coordinate, 32 of the text's hash and 16 of the piece; a pass reads 13 bits of it.
GRID, HASH_BITS, PIECE_BITS, DIGIT = 32767, 32, 16, 13


#: Splits of a level up to which their table is broadcast; beyond, the join is by shuffle.
BROADCAST_SPLITS = 100_000


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def coordinate(df: DataFrame, name: str, skip: int = 0) -> Column:
    """A number that keeps a column's order: numbers as they are, strings by six bytes after the ``skip`` first; null comes first."""
    if is_number(df, name):
        x = F.col(name).cast("double")
        return F.when(F.isnan(x), None).otherwise(x)
    some = F.substring(F.rpad(F.substring(F.hex(F.col(name).cast("string")), 2 * skip + 1, 12), 12, "0"), 1, 12)
    return F.when(F.col(name).isNotNull(), F.conv(some, 16, 10).cast("double"))


def common_prefixes(df: DataFrame, names: tuple[str, ...]) -> dict[str, int]:
    """The number of bytes that all values of each string column begin with: those that the least and the greatest share."""
    some = [n for n in names if not is_number(df, n)]
    if not some:
        return {}
    ends = df.agg(*[f(F.col(n).cast("string")).alias(f"{i}{k}") for i, n in enumerate(some) for k, f in (("a", F.min), ("b", F.max))]).first()
    return {n: len(os.path.commonprefix([(ends[f"{i}a"] or "").encode(), (ends[f"{i}b"] or "").encode()])) for i, n in enumerate(some)}


def keyed_rows(docs: DataFrame, dims: tuple[str, ...], text: str, key: str, n_leaves: int) -> tuple[DataFrame, list[str]]:
    """One row per document: key, size, text_crc32 and the sort key of each dimension; with the scratch tables to remove."""
    body = F.coalesce(F.col(text), F.lit(""))
    shared = common_prefixes(docs, dims)
    base = docs.select(
        F.col(key).alias("doc"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.xxhash64(body).alias("hash"),
        *[coordinate(docs, d, shared.get(d, 0)).alias(f"x{i}") for i, d in enumerate(dims)],
    )
    base, base_path = materialise(base, "kd-base")
    n = range(len(dims))
    spans = base.agg(F.coalesce(F.sum("size"), F.lit(0)), *[f(f"x{i}") for i in n for f in (F.min, F.max)]).first()
    total = spans[0]
    piece_bytes = max(1.0, TOLERANCE * total / n_leaves)
    groups = base.groupBy("crc", "hash", "size").agg(F.count("*").alias("copies"), *[F.min(f"x{i}").alias(f"g{i}") for i in n])
    groups = groups.select(F.col("crc").alias("c"), F.col("hash").alias("h"), F.col("size").alias("s"), F.least(F.ceil(F.col("copies") * F.col("size") / piece_bytes), F.lit(1 << PIECE_BITS)).alias("pieces"), *[f"g{i}" for i in n])
    groups, groups_path = materialise(groups, "kd-groups")  # a table, so that AQE can split the rows of a large group in the join
    joined = base.join(groups, (base["crc"] == groups["c"]) & (base["hash"] == groups["h"]) & (base["size"] == groups["s"]))
    piece = F.pmod(F.xxhash64("doc"), F.greatest(F.col("pieces"), F.lit(1)))
    tail = F.shiftleft(F.col("crc"), PIECE_BITS) + piece
    keys = []
    for i in n:
        low, high = spans[1 + 2 * i], spans[2 + 2 * i]
        scaled = F.lit(0) if low is None or low == high else F.coalesce(F.floor((F.col(f"g{i}") - low) / (high - low) * GRID), F.lit(0))
        keys.append(F.shiftleft(scaled.cast("long"), HASH_BITS + PIECE_BITS) + tail)
    rows, rows_path = materialise(joined.select("doc", "size", "crc", F.array(*keys).alias("keys")), "kd-rows")
    remove(docs.sparkSession, base_path, groups_path)
    return rows, [rows_path]


def _per_node(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row per node, marked for broadcast while it is small."""
    small = spark.createDataFrame(rows, schema)
    return F.broadcast(small) if len(rows) <= BROADCAST_SPLITS else small


def _assign(df: DataFrame, splits: list[tuple]) -> DataFrame:
    """``df`` with ``node`` after the splits of one level: the first leaf of the node that each row lies in."""
    small = _per_node(df.sparkSession, splits, "n int, dim int, bound long, right int")
    df = df.join(small, F.col("node") == F.col("n"), "left")
    return df.withColumn("node", F.when(F.col("n").isNotNull() & (F.element_at("keys", F.col("dim") + 1) >= F.col("bound")), F.col("right")).otherwise(F.col("node"))).drop("n", "dim", "bound", "right")


def _medians(units: DataFrame, wanted: dict[int, tuple[int, float]]) -> dict[int, int]:
    """The first key right of the split for each node; ``wanted`` has its dimension and the bytes that go left."""
    spark = units.sparkSession
    state = {node: (0, 0) for node in wanted}  # key digits so far, bytes before them
    bound = {}
    shift = 15 + HASH_BITS + PIECE_BITS
    in_order = Window.partitionBy("n").orderBy("digit")  # 2^DIGIT rows of a node at most
    while shift > 0:
        step = min(DIGIT, shift)
        small = _per_node(spark, [(n, wanted[n][0], p, float(wanted[n][1] - before)) for n, (p, before) in state.items()], "n int, dim int, prefix long, goal double")
        key = F.element_at("keys", F.col("dim") + 1)
        near = units.join(small, F.col("node") == F.col("n")).where(F.shiftright(key, shift) == F.col("prefix"))
        shift -= step
        digit = F.shiftright(key, shift).bitwiseAND((1 << step) - 1)
        sums = near.groupBy("n", "goal", digit.alias("digit")).agg(F.sum("weight").alias("w"))
        sums = sums.withColumns({"upto": F.sum("w").over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "more": F.lead("digit").over(in_order)})
        found = sums.where("upto >= goal OR more IS NULL").groupBy("n").agg(F.min(F.struct("digit", "upto", "w")).alias("x")).select("n", "x.*")
        for n, chosen, upto, w in found.collect():  # one row per node
            prefix, before = state[n]
            state[n] = ((prefix << step) + chosen, before + upto - w)
            if not shift:  # one unit straddles the median: it goes where it leaves the smaller error
                rest = wanted[n][1] - state[n][1]
                bound[n] = state[n][0] + int(rest > w - rest)
    return bound


def grow(units: DataFrame, n_dims: int, n_leaves: int) -> list[list[tuple]]:
    """The tree as levels of (node, dimension, first key to the right, right child); nodes are named by their first leaf.

    ``units`` has keys and weights; each level is written once with the nodes of its units.
    """
    leaves = {0: n_leaves}
    levels: list[list[tuple]] = []
    placed, path = units.withColumn("node", F.lit(0)), None
    here = [F.shiftright(F.element_at("keys", i + 1), HASH_BITS + PIECE_BITS) for i in range(n_dims)]
    while any(k > 1 for k in leaves.values()):
        spans = placed.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(x) - F.min(x)).alias(f"w{i}") for i, x in enumerate(here)]).collect()  # one row per node
        wanted = {}
        for r in spans:
            k = leaves[r["node"]]
            if k > 1:
                widest = max(range(n_dims), key=lambda i: (r[f"w{i}"], -i))
                wanted[r["node"]] = (widest, r["w"] * (k // 2) / k)
        if not wanted:
            break
        bounds = _medians(placed, wanted)
        levels.append([(n, wanted[n][0], b, n + leaves[n] // 2) for n, b in bounds.items()])
        leaves = {m: c for n, k in leaves.items() for m, c in (((n, k // 2), (n + k // 2, k - k // 2)) if n in bounds else ((n, 1),))}
        if any(k > 1 for k in leaves.values()):
            following, new_path = materialise(_assign(placed, levels[-1]), "kd-level")
            if path:
                remove(units.sparkSession, path)
            placed, path = following, new_path
    if path:
        remove(units.sparkSession, path)
    return levels


def shard(docs: DataFrame, n_leaves: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang", "n_chars"), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each document: leaves of about equal bytes, slots gapless from 0 in each by (key, crc, size).

    Give the number of leaves or their target bytes. Null texts count as empty
    (size 1); null metadata comes first in its dimension; equal texts stay in
    one shard unless a split falls into a group heavier than TOLERANCE of a
    leaf, whose pieces are chosen by a hash of the key; repeated rows get slots
    of their own; an empty table gives an empty result; other columns are
    ignored.
    """
    if n_leaves is None:
        total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1)).first()[0] or 0
        n_leaves = max(1, -(-total // target_bytes))
    rows, scratch = keyed_rows(docs, dims, text, key, n_leaves)
    units, units_path = materialise(rows.groupBy("keys").agg(F.sum("size").alias("weight")), "kd-units")
    levels = grow(units, len(dims), n_leaves)
    placed = reduce(_assign, levels, rows.withColumn("node", F.lit(0))).select("doc", "size", "crc", F.col("node").alias("shard"))
    out = ranked(placed, "shard", ["doc", "crc", "size"], "slot")
    remove(docs.sparkSession, units_path, *scratch)
    return out.select(F.col("doc").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def query(docs: DataFrame) -> DataFrame:
    out = shard(docs.select("doc_id", "text", "source", "lang", "n_chars"), n_leaves=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
