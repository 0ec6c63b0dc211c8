"""Outlier models: scaler, isolation forest, local outlier factor, ensemble, explanations, registry.

Scores are low for outliers. Fitted state is small: scaler moments, at most
``psi`` rows a tree; the local outlier factor keeps its training rows as a
distributed table. Scoring is a vectorised function over batches, or plain
columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY: dict[str, type] = {}


def register(name: str):
    """Class decorator: make a detector known by name."""

    def put(cls):
        REGISTRY[name] = cls
        return cls

    return put


def create(name: str, **parameters):
    if name not in REGISTRY:
        raise KeyError(f"unknown detector {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**parameters)


def numeric(df: DataFrame, features: list[str]) -> DataFrame:
    """The features in order as doubles, missing ones and nulls as 0; event_index stays."""
    return df.select("event_index", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


@dataclass
class Scaler:
    """Standard (population spread, 0 counts as 1) or robust (median and interquartile range) scaling."""

    kind: str = "standard"
    centre: dict[str, float] = field(default_factory=dict)
    width: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str]) -> Scaler:
        if self.kind == "standard":
            row = df.agg(*[x for i, c in enumerate(features) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
        else:
            row = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(features)]).first()
        for i, c in enumerate(features):
            m, s = (row[f"m{i}"], row[f"s{i}"]) if self.kind == "standard" else (row[f"q{i}"][1], row[f"q{i}"][2] - row[f"q{i}"][0])
            self.centre[c], self.width[c] = float(m or 0.0), float(s or 0.0) or 1.0
        return self

    def column(self, c: str) -> Column:
        return (F.col(c) - self.centre[c]) / self.width[c]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.centre})


def explain(features: list[str], scaler: Scaler, k: int = 5) -> Column:
    """The ``k`` features of a raw row that lie farthest from the training mean, as (feature, value, z)."""
    z = [F.struct((-F.abs(scaler.column(c))).alias("order"), F.lit(c).alias("feature"), F.col(c).alias("value"), scaler.column(c).alias("z")) for c in features]
    top = F.slice(F.array_sort(F.array(*z)), 1, k)
    return F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["z"].alias("z")))


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@register("isolation_forest")
@dataclass
class IsolationForest:
    """Random trees on hash-chosen samples of ``psi`` rows each; the score is minus the anomaly score, plus one half."""

    trees: int = 150
    psi: int = 256
    seed: int = 42
    contamination: float = 0.05
    features: list[str] = field(default_factory=list)
    forest: list[dict] = field(default_factory=list)
    scaler: Scaler = field(default_factory=Scaler)
    offset: float = 0.0

    def _grow(self, x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
        """A tree as flat arrays: split feature (-1 at leaves), threshold, children, and depth plus the rest of the path at leaves."""
        tree = {"feature": [], "cut": [], "left": [], "right": [], "path": []}

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(tree["feature"])
            for v in tree.values():
                v.append(0)
            spread = x[rows].max(0) - x[rows].min(0) if len(rows) else np.zeros(x.shape[1])
            if depth >= limit or len(rows) <= 1 or not spread.any():
                tree["feature"][at], tree["path"][at] = -1, float(depth + average_path(len(rows)))
                return at
            f = int(rng.choice(np.flatnonzero(spread)))
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = float(rng.uniform(low, high))
            left = rows[x[rows, f] < cut]
            right = rows[x[rows, f] >= cut]
            tree["feature"][at], tree["cut"][at] = f, cut
            tree["left"][at], tree["right"][at] = node(left, depth + 1), node(right, depth + 1)
            return at

        node(np.arange(len(x)), 0)
        return tree

    def _samples(self, rows: DataFrame) -> list[np.ndarray]:
        """For each tree its ``psi`` rows of the smallest hashes among all rows, each tree with hashes of its own.

        Rows whose hash is far above what the smallest can be are left out
        before they are sorted; trees x psi rows reach the driver.
        """
        n = rows.count()
        share = min(1.0, (self.psi + 8 * self.psi**0.5 + 16) / max(n, 1))
        drawn = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(self.seed), t, F.col("event_index")).alias("hash"))),
            lambda x: (x["hash"].cast("double") / 2.0**64 + 0.5 < share) | F.lit(share >= 1.0),
        )
        placed = rows.select("event_index", F.array(*[F.col(c) for c in self.features]).alias("x"), F.inline(drawn))
        first = Window.partitionBy("tree").orderBy("hash", "event_index")
        found = placed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= self.psi).select("tree", "place", "x").toPandas().sort_values(["tree", "place"])
        return [np.array(g["x"].tolist(), float) for _, g in found.groupby("tree")]

    def fit(self, df: DataFrame, features: list[str]) -> IsolationForest:
        self.features = list(features)
        rows = numeric(df, self.features)
        self.scaler.fit(rows, self.features)
        samples = self._samples(self.scaler.transform(rows))
        rng = np.random.default_rng(self.seed)
        size = max((len(x) for x in samples), default=0)
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.forest = [self._grow(x, rng, limit) for x in samples]
        self.size = size
        tau = self.score(df).agg(F.percentile("score", self.contamination)).first()[0]
        self.offset = float(tau or 0.0)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """(event_index, score); 0 if the forest was fitted on nothing."""
        if not self.forest:
            return df.select("event_index", F.lit(0.0).alias("score"))
        forest = [{k: np.asarray(v) for k, v in t.items()} for t in self.forest]
        norm = float(average_path(self.size)) or 1.0

        @F.pandas_udf("double")
        def depth(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            total = np.zeros(len(x))
            for t in forest:
                at = np.zeros(len(x), int)
                while True:
                    f = t["feature"][at]
                    live = np.flatnonzero(f >= 0)
                    if not len(live):
                        break
                    here = at[live]
                    less = x[live, f[live]] < t["cut"][here]
                    at[live] = np.where(less, t["left"][here], t["right"][here])
                total += t["path"][at]
            return pd.Series(0.5 - 2.0 ** (-total / len(forest) / norm))

        rows = self.scaler.transform(numeric(df, self.features))
        return rows.select("event_index", depth(*[F.col(c) for c in self.features]).alias("score"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", F.when(F.col("score") < self.offset, -1).otherwise(1))

    def explain(self, df: DataFrame, k: int = 5) -> DataFrame:
        return explained(df, self.features, self.scaler, k)

    def state(self) -> tuple[dict, dict[str, DataFrame]]:
        return json.loads(self.dumps()), {}

    @classmethod
    def restore(cls, raw: dict, table) -> IsolationForest:
        return cls.loads(json.dumps(raw))

    def dumps(self) -> str:
        return json.dumps({"features": self.features, "forest": self.forest, "size": self.size, "offset": self.offset, "centre": self.scaler.centre, "width": self.scaler.width})

    @classmethod
    def loads(cls, text: str) -> IsolationForest:
        raw = json.loads(text)
        out = cls(features=raw["features"], forest=raw["forest"], scaler=Scaler(centre=raw["centre"], width=raw["width"]), offset=raw["offset"])
        out.size = raw["size"]
        return out


def _placer(nodes: list[list]):
    """The function that finds the cell of a row in a tree of (dimension or -1, cut, left, right)."""
    dims, cuts, lefts, rights = (np.array(c) for c in zip(*nodes, strict=True))

    @F.pandas_udf("int")
    def place(xs: pd.Series) -> pd.Series:
        x, at = np.stack(xs.to_list()) if len(xs) else np.zeros((0, 1)), np.zeros(len(xs), int)
        while True:
            live = np.flatnonzero(dims[at] >= 0)
            if not len(live):
                return pd.Series(at.astype("int32"))
            here = at[live]
            at[live] = np.where(x[live, dims[here]] < cuts[here], lefts[here], rights[here])

    return place


@register("lof")
@dataclass
class LocalOutlierFactor:
    """Density of a row against that of its ``k`` nearest training rows: all rows, or the ``most`` rows of the smallest hashes if that is given.

    Neighbours are exact. Equal rows are one point with a count. Points are
    dealt into cells of a k-d tree, whose cuts come from a sample; a point
    finds its nearest in its own cell and then in each cell whose box is no
    farther than the last of them. Equal distances go to the smaller hash.
    """

    k: int = 20
    most: int | None = None
    seed: int = 42
    contamination: float = 0.05
    features: list[str] = field(default_factory=list)
    scaler: Scaler = field(default_factory=Scaler)
    offset: float = 0.0
    #: Points to a cell, about, and points that the cuts are found from.
    cell: int = 2048
    cut_rows: int = 50_000
    #: (id, score) of the training points; a loaded model finds them anew.
    scored: DataFrame | None = None

    def _points(self, rows: DataFrame) -> DataFrame:
        """(id, x): scaled rows with the hash of their values."""
        scaled = self.scaler.transform(rows)
        return scaled.select("event_index", F.array(*[F.col(c) + 0.0 for c in self.features]).alias("x")).withColumn("id", F.xxhash64("x"))

    def _cells(self, points: DataFrame):
        """Cells of the training points: the function that places rows, the least and greatest corners by cell."""
        total = points.count()
        sample = np.array([r["x"] for r in points.orderBy("id").select("x").limit(self.cut_rows).collect()])
        nodes: list[list] = []

        def grow(rows: np.ndarray, wanted: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at])
            if wanted > 1 and len(rows) > 1:
                d = int(np.argmax(sample[rows].max(0) - sample[rows].min(0)))
                cut = float(np.median(sample[rows, d]))
                left = sample[rows, d] < cut
                if left.any() and not left.all():
                    nodes[at] = [d, cut, grow(rows[left], wanted // 2), grow(rows[~left], wanted - wanted // 2)]
            return at

        grow(np.arange(len(sample)), max(1, total // self.cell))

        self.nodes = [[int(d), float(c), int(a), int(b)] for d, c, a, b in nodes]
        place = _placer(self.nodes)
        placed = points.withColumn("cell", place("x"))
        n = range(len(self.features))
        boxes = placed.groupBy("cell").agg(F.array(*[F.min(F.get("x", F.lit(i))) for i in n]).alias("low"), F.array(*[F.max(F.get("x", F.lit(i))) for i in n]).alias("high")).orderBy("cell").collect()  # one row per cell
        return place, [r["cell"] for r in boxes], np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])

    def _nearest(self, asked: DataFrame) -> DataFrame:
        """(id, hits): the ``k + 1`` nearest training points (d, id, n) of each point in ``asked`` (id, x), nearest first."""
        place, cells, low, high = self.cells
        most, numbers = self.k + 1, np.array(cells)
        hit = "array<struct<d:double,id:bigint,n:bigint>>"

        def best(x: np.ndarray, held: pd.DataFrame) -> list[list[dict]]:
            if not len(held):
                return [[] for _ in x]
            y, ids, counts = np.stack(held["x"].to_list()), held["id"].to_numpy(), held["n"].to_numpy()
            out = []
            for a in range(0, len(x), 256):
                d = np.sqrt(sum((x[a : a + 256, i, None] - y[None, :, i]) ** 2 for i in range(y.shape[1])))
                edge = np.partition(d, min(most, len(y)) - 1, 1)[:, min(most, len(y)) - 1]
                for row, far in zip(d, edge, strict=True):
                    near = np.flatnonzero(row <= far)
                    near = near[np.lexsort((ids[near], row[near]))][:most]
                    out.append([{"d": far, "id": i, "n": n} for far, i, n in zip(row[near].tolist(), ids[near].tolist(), counts[near].tolist(), strict=True)])
            return out

        def first(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(some):
                return pd.DataFrame(columns=["id", "x", "hits", "others"], dtype=object)
            x = np.stack(some["x"].to_list())
            hits, others = best(x, held), []
            for v, found in zip(x, hits, strict=True):
                reach = found[-1]["d"] if len(found) == most else np.inf
                gap = np.sqrt((np.maximum(np.maximum(low - v, v - high), 0) ** 2).sum(1))
                others.append(numbers[(gap <= reach * (1 + 1e-9)) & (numbers != some["cell"].iloc[0])].tolist())
            return pd.DataFrame({"id": some["id"], "x": some["x"], "hits": hits, "others": others})

        def second(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(some):
                return pd.DataFrame(columns=["id", "hits"], dtype=object)
            return pd.DataFrame({"id": some["id"], "hits": best(np.stack(some["x"].to_list()), held)})

        held = self.points.select(*[F.col(c).alias(c) for c in ("id", "x", "n")], place("x").alias("cell")).groupBy("cell")
        own = asked.select(*[F.col(c).alias(c) for c in ("id", "x")], place("x").alias("cell")).groupBy("cell").cogroup(held).applyInPandas(first, f"id bigint, x array<double>, hits {hit}, others array<int>").persist()
        beyond = own.select("id", "x", F.explode("others").alias("cell")).groupBy("cell").cogroup(held).applyInPandas(second, f"id bigint, hits {hit}")
        both = own.select("id", "hits").unionByName(beyond).groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        return both.select("id", F.slice(F.array_sort("hits"), 1, most).alias("hits"))

    def _taken(self, hits: DataFrame, skip_self: bool) -> DataFrame:
        """(id, d, at, last): each of the ``k`` nearest rows by its distance and point; equal rows count each."""
        def repeated(h: Column) -> Column:
            n = h["n"] - ((h["id"] == F.col("id")) & F.lit(skip_self)).cast("int")
            return F.array_repeat(h, F.least(n, F.lit(self.k)).cast("int"))

        rows = hits.withColumn("taken", F.slice(F.flatten(F.transform("hits", repeated)), 1, self.k))
        return rows.select("id", F.explode("taken").alias("h"), F.array_max("taken.d").alias("last")).select("id", F.col("h")["d"].alias("d"), F.col("h")["id"].alias("at"), "last")

    def _tables(self) -> tuple[DataFrame, object]:
        """Training points by cell with the points of other cells that any of theirs may have as a neighbour, and the function that finds neighbours.

        A leaf of a cell is some points that lie together. Its points' nearest
        in the cell bound how far others can be; the leaf's box asks other
        cells for their points within that, so few boxes travel, and each
        point that another cell needs goes there once.
        """
        place, cells, low, high = self.cells
        k, most, numbers = self.k, self.k + 1, np.array(cells)

        def gap(x, a, b):
            return np.sqrt((np.maximum(np.maximum(a - x, x - b), 0) ** 2).sum(-1))

        def leaves(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
            out, todo = [], [rows]
            while todo:
                some = todo.pop()
                spread = np.ptp(x[some], axis=0)
                if len(some) <= 3 * most or not spread.any():
                    out += [some[i : i + 256] for i in range(0, len(some), 256)]
                    continue
                order = some[np.argsort(x[some, int(spread.argmax())], kind="stable")]
                todo += [order[: len(order) // 2], order[len(order) // 2 :]]
            return out

        def nearest(x: np.ndarray, ids: np.ndarray, own: np.ndarray):
            """For each leaf of the own points: its rows, the places and distances of their ``most`` nearest by (distance, id), padded with -1."""
            by_id = np.argsort(ids, kind="stable")
            sorted_x = x[by_id]
            for leaf in leaves(x, np.flatnonzero(own)):
                q = x[leaf]
                d = np.sqrt(sum((q[:, i, None] - q[None, :, i]) ** 2 for i in range(x.shape[1])))
                far = np.partition(d, most - 1, 1)[:, most - 1].max() if len(leaf) >= most else np.inf
                some = np.flatnonzero(gap(sorted_x, q.min(0), q.max(0)) <= far * (1 + 1e-9))
                d = np.sqrt(sum((q[:, i, None] - sorted_x[None, some, i]) ** 2 for i in range(x.shape[1])))
                edge = np.partition(d, min(most, len(some)) - 1, 1)[:, min(most, len(some)) - 1]
                row, col = np.nonzero(d <= edge[:, None])
                order = np.lexsort((col, d[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, col, rank = row[rank < most], col[rank < most], rank[rank < most]
                at, dist = np.full((len(leaf), most), -1), np.zeros((len(leaf), most))
                at[row, rank], dist[row, rank] = by_id[some[col]], d[row, col]
                yield leaf, at, dist

        def taken(n, at, leaf, skip_self: bool) -> np.ndarray:
            """How many rows of each hit are among the ``k`` nearest."""
            rows = np.where(at >= 0, n[at] - (skip_self & (at == leaf[:, None])), 0)
            return np.clip(k - (np.cumsum(rows, 1) - rows), 0, rows)

        def read(table: pa.Table):
            x = table.column("x").combine_chunks()
            return np.asarray(x.values).reshape(len(x), -1), table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("own").combine_chunks().to_numpy(zero_copy_only=False)

        def ask(table: pa.Table) -> pa.Table:
            x, ids, _, own = read(table)
            here, out = table.column("cell")[0].as_py(), []
            for leaf, at, dist in nearest(x, ids, own):
                far = dist[:, -1].max() if (at >= 0).all() else np.inf
                a, b = x[leaf].min(0), x[leaf].max(0)
                apart = np.sqrt((np.maximum(np.maximum(low - b, a - high), 0) ** 2).sum(1))
                out += [(int(c), here, a, b, far * (1 + 1e-9)) for c in numbers[(apart <= far * (1 + 1e-9)) & (numbers != here)]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.table({"cell": pa.array(columns[0], pa.int32()), "asker": pa.array(columns[1], pa.int32()), "a": pa.array([v.tolist() for v in columns[2]], pa.list_(pa.float64())), "b": pa.array([v.tolist() for v in columns[3]], pa.list_(pa.float64())), "far": pa.array(columns[4], pa.float64())})

        def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
            empty = pa.table({"cell": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.int64())})
            if not len(asked) or not len(held):
                return empty
            x = np.asarray(held.column("x").combine_chunks().values).reshape(len(held), -1)
            a, b = (np.asarray(asked.column(c).combine_chunks().values).reshape(len(asked), -1) for c in "ab")
            askers, far, out = asked.column("asker").to_numpy(), asked.column("far").to_numpy(), [empty]
            for asker in np.unique(askers):
                wanted = np.zeros(len(x), bool)
                for i in np.flatnonzero(askers == asker):
                    wanted |= gap(x, a[i], b[i]) <= far[i]
                rows = held.select(["id", "x", "n"]).take(pa.array(np.flatnonzero(wanted)))
                out.append(pa.table({"cell": pa.array(np.full(len(rows), asker), pa.int32()), **{c: rows.column(c) for c in rows.column_names}}))
            return pa.concat_tables(out)

        own = self.points.select(place("x").alias("cell"), "id", "x", "n", F.lit(True).alias("own"))
        asked = own.groupBy("cell").applyInArrow(ask, "cell int, asker int, a array<double>, b array<double>, far double")
        guests = asked.groupBy("cell").cogroup(self.points.select(place("x").alias("cell"), "id", "x", "n").groupBy("cell")).applyInArrow(answer, "cell int, id bigint, x array<double>, n bigint")
        both = own.unionByName(guests.withColumn("own", F.lit(False))).persist()

        def over(what: str, known: DataFrame | None = None) -> DataFrame:
            """(id, value): the reach, density or score of every training point, from what is known of neighbours."""

            def values(table: pa.Table) -> pa.Table:
                x, ids, n, mine = read(table)
                reach = None if what == "reach" else table.column("reach").to_numpy()
                density = table.column("density").to_numpy() if what == "score" else None
                out = np.full(len(x), np.nan)
                for leaf, at, dist in nearest(x, ids, mine):
                    rows = taken(n, at, leaf, what != "score")
                    total = rows.sum(1)
                    if what == "reach":
                        out[leaf] = np.where(total > 0, np.where(rows > 0, dist, 0).max(1), np.nan)
                        continue
                    total = np.maximum(total, 1)
                    mean = (np.maximum(dist, reach[at]) * rows).sum(1) / total + 1e-10
                    out[leaf] = 1 / mean if what == "density" else 1.5 - (density[at] * rows).sum(1) / total * mean
                kept = np.flatnonzero(mine & ~np.isnan(out))
                return pa.table({"id": pa.array(ids[kept]), what: pa.array(out[kept])})

            rows = both if known is None else both.join(known.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).drop("__id")
            return rows.groupBy("cell").applyInArrow(values, f"id bigint, {what} double")

        return both, over

    def fit(self, df: DataFrame, features: list[str]) -> LocalOutlierFactor:
        self.features = list(features)
        rows = numeric(df, self.features)
        self.scaler.fit(rows, self.features)
        if self.most:
            rows = rows.orderBy(F.xxhash64(F.lit(self.seed), "event_index"), "event_index").limit(self.most)
        self.points = self._points(rows).groupBy("id", "x").agg(F.count("*").alias("n")).persist()
        self.cells = self._cells(self.points)
        both, over = self._tables()
        reach = over("reach").persist()
        density = over("density", reach)
        known = reach.join(density, "id").persist()
        self.known = known.withColumnRenamed("id", "at")
        self.scored = over("score", known).persist()
        scores = self.scored.join(self.points.select("id", "n"), "id") if not self.most else self.score(df).withColumn("n", F.lit(1))
        self.offset = float(scores.agg(F.percentile("score", self.contamination, F.col("n"))).first()[0])
        both.unpersist()
        reach.unpersist()
        return self

    def _factor(self, hits: DataFrame) -> DataFrame:
        near = self._taken(hits, False).join(self.known, "at").groupBy("id")
        own = 1.0 / (F.avg(F.greatest("d", "reach")) + 1e-10)
        return near.agg((1.5 - F.avg("density") / own).alias("score"))

    def score(self, df: DataFrame) -> DataFrame:
        """(event_index, score): minus the outlier factor, plus 1.5."""
        rows = self._points(numeric(df, self.features))
        if self.scored is None:
            asked = rows.select("id", "x").dropDuplicates(["id"])
            return rows.select("event_index", "id").join(self._factor(self._nearest(asked)), "id").select("event_index", "score")
        # training points have their scores already; only others are searched for
        seen = rows.select("event_index", "id", "x").join(self.scored.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
        new = seen.where("__id IS NULL")
        old = seen.where("__id IS NOT NULL").select("event_index", "score")
        asked = new.select("id", "x").dropDuplicates(["id"]).persist()
        if asked.isEmpty():
            return old
        return old.unionByName(new.select("event_index", "id").join(self._factor(self._nearest(asked)), "id").select("event_index", "score"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", F.when(F.col("score") < self.offset, -1).otherwise(1))

    def explain(self, df: DataFrame, k: int = 5) -> DataFrame:
        return explained(df, self.features, self.scaler, k)

    def state(self) -> tuple[dict, dict[str, DataFrame]]:
        _, cells, low, high = self.cells
        raw = {"k": self.k, "features": self.features, "centre": self.scaler.centre, "width": self.scaler.width, "offset": self.offset, "nodes": self.nodes, "cells": cells, "low": low.tolist(), "high": high.tolist()}
        return raw, {"points": self.points, "known": self.known}

    @classmethod
    def restore(cls, raw: dict, table) -> LocalOutlierFactor:
        out = cls(k=raw["k"], features=raw["features"], scaler=Scaler(centre=raw["centre"], width=raw["width"]), offset=raw["offset"])
        out.nodes, out.points, out.known = raw["nodes"], table("points"), table("known")
        out.cells = (_placer(out.nodes), raw["cells"], np.array(raw["low"]), np.array(raw["high"]))
        return out


@register("ensemble")
@dataclass
class Ensemble:
    """Members' scores by their training range, combined by mean, median or ``max`` (the most anomalous, thus the least)."""

    members: list = field(default_factory=lambda: [IsolationForest(), LocalOutlierFactor()])
    strategy: str = "mean"
    contamination: float = 0.05
    ranges: list[tuple[float, float]] = field(default_factory=list)
    offset: float = 0.0

    def fit(self, df: DataFrame, features: list[str]) -> Ensemble:
        self.ranges, scores = [], []
        for m in self.members:
            m.fit(df, features)
            scores.append(m.score(df).persist())
            low, high = scores[-1].agg(F.min("score"), F.max("score")).first()
            self.ranges.append((float(low), float(high)))
        self.offset = float(self._combined(scores).agg(F.percentile("score", self.contamination)).first()[0])
        for x in scores:
            x.unpersist()
        return self

    def score(self, df: DataFrame) -> DataFrame:
        return self._combined([m.score(df) for m in self.members])

    def _combined(self, scores: list[DataFrame]) -> DataFrame:
        """(event_index, score) from the scores of the members."""
        out = None
        for i, (found, (low, high)) in enumerate(zip(scores, self.ranges, strict=True)):
            scaled = F.least(F.greatest((F.col("score") - low) / max(high - low, 1e-12), F.lit(0.0)), F.lit(1.0))
            part = found.select("event_index", scaled.alias(f"m{i}"))
            out = part if out is None else out.join(part, "event_index")
        values = F.array_sort(F.array(*[F.col(f"m{i}") for i in range(len(self.members))]))
        n = len(self.members)
        if self.strategy == "max":
            one = F.get(values, F.lit(0))
        elif self.strategy == "median":
            one = F.get(values, F.lit(n // 2)) if n % 2 else (F.get(values, F.lit(n // 2 - 1)) + F.get(values, F.lit(n // 2))) / 2
        else:
            one = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
        return out.select("event_index", one.alias("score"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", F.when(F.col("score") < self.offset, -1).otherwise(1))

    def explain(self, df: DataFrame, k: int = 5) -> DataFrame:
        """(event_index, top): the ``k`` features with the largest mean |z| over the members that name them."""
        named = None
        for m in self.members:
            part = m.explain(df, k).select("event_index", F.inline("top"))
            named = part if named is None else named.unionByName(part)
        means = named.groupBy("event_index", "feature").agg(F.first("value").alias("value"), F.avg("z").alias("z"))
        order = F.struct((-F.abs("z")).alias("order"), "feature", "value", "z")
        tops = means.groupBy("event_index").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("t"))
        return tops.select("event_index", F.transform("t", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["z"].alias("z"))).alias("top"))

    def state(self) -> tuple[dict, dict[str, DataFrame]]:
        raw, tables = [], {}
        for i, m in enumerate(self.members):
            own, held = m.state()
            raw.append({"kind": kind_of(m), "state": own})
            tables |= {f"{i}-{n}": t for n, t in held.items()}
        return {"members": raw, "strategy": self.strategy, "ranges": self.ranges, "offset": self.offset}, tables

    @classmethod
    def restore(cls, raw: dict, table) -> Ensemble:
        members = [REGISTRY[m["kind"]].restore(m["state"], lambda n, i=i: table(f"{i}-{n}")) for i, m in enumerate(raw["members"])]
        return cls(members=members, strategy=raw["strategy"], ranges=[tuple(r) for r in raw["ranges"]], offset=raw["offset"])


def explained(df: DataFrame, features: list[str], scaler: Scaler, k: int) -> DataFrame:
    """(event_index, top): the ``k`` features of each row that lie farthest from the training mean."""
    return numeric(df, features).select("event_index", explain(features, scaler, k).alias("top"))


def kind_of(model) -> str:
    return next(name for name, cls in REGISTRY.items() if type(model) is cls)


def save(model, spark: SparkSession, path: str) -> None:
    """Write a fitted detector below ``path``: one JSON line, and its tables. What is there already is an error."""
    raw, tables = model.state()
    spark.createDataFrame([(json.dumps({"kind": kind_of(model), "state": raw}),)], "value string").coalesce(1).write.text(f"{path}/model")
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str):
    """The detector that ``save`` wrote."""
    raw = json.loads(spark.read.text(f"{path}/model").first()[0])
    return REGISTRY[raw["kind"]].restore(raw["state"], lambda name: spark.read.parquet(f"{path}/{name}"))


def triage_features(df: DataFrame) -> DataFrame:
    """Nine columns that a triage model reads off a scored event."""
    return df.select(
        "event_index",
        F.col("score").alias("f_score"),
        (F.col("score") - F.col("threshold")).alias("f_excess"),
        F.col("nll").alias("f_nll"),
        F.col("jsd").alias("f_jsd"),
        F.hour("timestamp").cast("double").alias("f_hour"),
        F.weekday("timestamp").cast("double").alias("f_day"),
        F.coalesce(F.col("success").cast("double"), F.lit(0.0)).alias("f_success"),
        F.coalesce(F.col("mfa_used").cast("double"), F.lit(0.0)).alias("f_mfa"),
        F.length(F.coalesce("user_agent", F.lit(""))).cast("double").alias("f_agent"),
    )


TRIAGE = ("f_score", "f_excess", "f_nll", "f_jsd", "f_hour", "f_day", "f_success", "f_mfa", "f_agent")


def triage(features: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """(event_index, fp_probability, confidence) of a logistic triage model over the nine columns; confidence is twice the distance from one half."""
    z = sum((F.col(c) * float(weights.get(c, 0.0)) for c in TRIAGE), F.lit(float(bias)))
    p = 1 / (1 + F.exp(-z))
    return features.select("event_index", p.alias("fp_probability"), (F.abs(p - 0.5) * 2).alias("confidence"))


def onnx_triage(features: DataFrame, path: str) -> DataFrame:
    """The same from an ONNX model file of nine inputs and the probability as its last output; needs onnxruntime on the executors."""

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        x = np.column_stack([c.to_numpy(np.float32) for c in columns])
        out = np.asarray(session.run(None, {session.get_inputs()[0].name: x})[-1])
        return pd.Series(out.reshape(len(x), -1)[:, -1].astype(float))

    p = predict(*[F.col(c) for c in TRIAGE])
    return features.select("event_index", p.alias("fp_probability")).withColumn("confidence", F.abs(F.col("fp_probability") - 0.5) * 2)


def inspect(text: str) -> dict:
    """What a saved forest holds: features, trees, nodes, threshold."""
    raw = json.loads(text)
    return {"features": raw["features"], "trees": len(raw["forest"]), "nodes": sum(len(t["feature"]) for t in raw["forest"]), "threshold": raw["offset"]}


def topology_lifetimes(df: DataFrame, features: list[str], most: int = 2000, seed: int = 42) -> list[float]:
    """Lifetimes of the zeroth persistent homology of a bounded sample under the range-scaled city-block distance: its spanning tree's edges."""
    rows = numeric(df, features).orderBy(F.xxhash64(F.lit(seed), "event_index")).limit(most).toPandas()[features].to_numpy(float)
    spread = np.where(np.ptp(rows, axis=0) > 0, np.ptp(rows, axis=0), 1.0) if len(rows) else 1.0
    x = rows / spread
    if len(x) < 2:
        return []
    best = np.abs(x - x[0]).mean(1)
    done = np.zeros(len(x), bool)
    done[0] = True
    out = []
    for _ in range(len(x) - 1):
        i = int(np.where(done, np.inf, best).argmin())
        out.append(float(best[i]))
        done[i] = True
        best = np.minimum(best, np.abs(x - x[i]).mean(1))
    return sorted(out)
