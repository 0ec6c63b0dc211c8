"""Approximate nearest neighbours by balanced posting lists.

Vectors are put into lists around centroids. The centroids come from balanced
halvings of a bounded sample; a graph over them, searched best-first in memory,
finds the nearest ones. Squared distances to centroids are compared as their
excess over the nearest, in units of the mean centroid's excess, because in
many dimensions all of them share a large common part. A vector near a boundary
is put into every list whose excess is small. A query reads the lists up to an
excess that is fitted so that sampled queries find TARGET of their neighbours;
their number has no limit and grows with the lists. Vectors read are scored
exactly. Inner products become distances by one added coordinate that gives all
vectors the same length. Lists next to each other travel in bundles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._shared import materialise, remove, ship

#: Vectors that the centroids are fitted on at most: those of the smallest hashes.
SAMPLE = 40_000
#: Vectors to a list, about, and the most lists; beyond, lists grow. Bundles of lists are scored in chunks.
LIST_SIZE, MOST_LISTS, CHUNK = 128, 8192, 4096
DEGREE, BEAM = 24, 96
#: Replicas: the excess up to which a boundary vector is repeated, and how often at most.
REPLICA_EXCESS, MOST_REPLICAS = 0.05, 4
#: Pruning: how many lists a query reads at least, the share of neighbours that fitting queries must find, how many fit, and their neighbours.
LEAST_PROBES, TARGET, FITTING, NEIGHBOURS = 24, 0.97, 256, 20
#: Lists to a bundle: a query that reads one of them reads all.
BUNDLE = 16
#: Candidates that a scoring task holds before it cuts them down to the best of each query.
HELD = 1 << 21


@dataclass(frozen=True)
class Index:
    """Centroids (with the added coordinate), the neighbour graph over them, entry points, and the common length."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    length: float
    prune: float = np.inf

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each row of ``x`` to all centroids."""
        return np.maximum((x * x).sum(1)[:, None] + (self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T, 0)

    def common(self, x: np.ndarray) -> np.ndarray:
        """The mean squared distance of each row of ``x`` to the centroids."""
        return (x * x).sum(1) + (self.centroids**2).sum(1).mean() - 2 * x @ self.centroids.mean(0)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of about the ``k`` nearest centroids to each row of ``x``, nearest first, by best-first search of the graph."""
        n, m = len(x), len(self.centroids)
        k = min(k, m)
        beam = min(max(BEAM, k), m)
        rows = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entries[:beam], (n, min(beam, len(self.entries)))).copy()
        seen = np.zeros((n, m + 1), bool)
        seen[rows, ids] = True
        seen[:, m] = True
        dist = ((self.centroids[ids] - x[:, None]) ** 2).sum(2)
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.concatenate([ids, np.full((n, pad), m)], 1)
            dist = np.concatenate([dist, np.full((n, pad), np.inf, np.float32)], 1)
        open_ = np.isfinite(dist)
        padded = np.concatenate([self.centroids, np.full((1, self.centroids.shape[1]), np.inf, np.float32)])
        while True:
            score = np.where(open_, dist, np.inf)
            best = score.argmin(1)
            live = np.flatnonzero(np.isfinite(score[np.arange(n), best]))
            if not len(live):
                break
            open_[live, best[live]] = False
            near = self.graph[ids[live, best[live]]]
            near = np.where(seen[live[:, None], near], m, near)
            seen[live[:, None], near] = True
            far = ((padded[near] - x[live, None]) ** 2).sum(2)
            all_ids = np.concatenate([ids[live], near], 1)
            all_dist = np.concatenate([dist[live], far], 1)
            all_open = np.concatenate([open_[live], np.isfinite(far)], 1)
            keep = np.argpartition(all_dist, beam - 1, 1)[:, :beam]
            r = np.arange(len(live))[:, None]
            ids[live], dist[live], open_[live] = all_ids[r, keep], all_dist[r, keep], all_open[r, keep]
        order = np.lexsort((ids, dist), axis=1)[:, :k]
        return ids[rows, order], np.sqrt(dist[rows, order])

    def replicas(self, x: np.ndarray) -> list[list[int]]:
        """The lists that each vector is put into."""
        lists, dist = self.nearest(x, MOST_REPLICAS)
        squares = dist**2
        first = squares[:, :1]
        within = squares - first <= REPLICA_EXCESS * (self.common(x)[:, None] - first)
        within[:, 0] = True
        return [[c for c, ok in zip(a, b, strict=True) if ok and c < len(self.centroids)] for a, b in zip(lists.tolist(), within.tolist(), strict=True)]

    def excess(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids less the least, 1 at their mean; the LEAST_PROBES nearest count as 0."""
        squares = self.squares(x)
        first = squares.min(1, keepdims=True)
        out = (squares - first) / np.maximum(squares.mean(1, keepdims=True) - first, 1e-12)
        if out.shape[1] <= LEAST_PROBES:
            return np.zeros_like(out)
        return np.where(out <= np.partition(out, LEAST_PROBES - 1, 1)[:, LEAST_PROBES - 1 : LEAST_PROBES], 0, out)

    def probes(self, x: np.ndarray) -> list[list[int]]:
        """The lists that each query reads."""
        return [np.flatnonzero(row).tolist() for row in self.excess(x) <= self.prune]


def _halved(x: np.ndarray, n_lists: int) -> np.ndarray:
    """Means of ``n_lists`` equal parts of ``x``: each part is halved at the median along the line through two means."""
    rng = np.random.default_rng(7)
    parts, out = [(np.arange(len(x)), n_lists)], []
    while parts:
        rows, k = parts.pop()
        if k <= 1 or len(rows) < 2:
            out.append(x[rows].mean(0))
            continue
        own = x[rows]
        two = own[rng.choice(len(rows), 2, replace=False)].astype(np.float64)
        for _ in range(4):
            side = ((own - two[0]) ** 2).sum(1) > ((own - two[1]) ** 2).sum(1)
            if side.all() or not side.any():
                break
            two = np.stack([own[~side].mean(0), own[side].mean(0)])
        left = k // 2
        cut = min(max(1, len(rows) * left // k), len(rows) - 1)
        order = np.argsort(own @ (two[1] - two[0]), kind="stable")
        parts += [(rows[order[:cut]], left), (rows[order[cut:]], k - left)]
    return np.asarray(out, np.float32)


def build(sample: np.ndarray, n_vectors: int, length: float) -> Index:
    """An index over ``n_vectors`` vectors from a sample of them; its size is bounded by MOST_LISTS."""
    n_lists = int(np.clip(min(n_vectors // LIST_SIZE, len(sample) // 4), 1, MOST_LISTS))
    shell = Index(np.zeros((0, sample.shape[1] + 1), np.float32), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), length)
    centroids = _halved(shell.lifted(sample), n_lists)
    m = len(centroids)
    degree = min(DEGREE, m - 1)
    graph = np.full((m, max(1, degree) + 4), m)
    norms = (centroids**2).sum(1)
    rng = np.random.default_rng(11)
    for a in range(0, m, 1024):
        d = norms[None, :] - 2 * centroids[a : a + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if degree:
            graph[a : a + 1024, :degree] = np.argpartition(d, degree - 1, 1)[:, :degree]
        graph[a : a + 1024, -4:] = rng.integers(0, m, (len(d), 4))  # long edges keep the graph in one piece
    entries = rng.permutation(m)[: min(m, BEAM // 2)]
    index = Index(centroids, graph, entries, length)
    return replace(index, prune=_fitted_prune(index, sample))


def _fitted_prune(index: Index, sample: np.ndarray) -> float:
    """The excess up to which sampled queries find TARGET of their neighbours in the sample.

    Neighbours in a sample are farther than those in the whole table, which
    lie in nearer lists, and replicas aren't counted, so the excess errs to the
    large side.
    """
    if len(index.centroids) <= LEAST_PROBES:
        return np.inf
    rng = np.random.default_rng(13)
    needed = []
    for a in np.array_split(rng.permutation(len(sample))[:FITTING], 8):
        scores = sample[a] @ sample.T
        scores[np.arange(len(a)), a] = -np.inf
        k = min(NEIGHBOURS, len(sample) - 1)
        near = np.argpartition(-scores, k - 1, 1)[:, :k]
        excess = index.excess(_asking(sample[a]))
        home = np.concatenate([index.squares(index.lifted(sample[some])).argmin(1) for some in near])
        needed.append(np.take_along_axis(excess, home.reshape(near.shape), 1).ravel())
    return float(np.quantile(np.concatenate(needed), TARGET, method="higher"))


def _asking(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def vectors(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    """(vec_id, name, v): the usable vectors in double precision, named by their value.

    A vector takes part if it isn't null, has the length that most vectors have
    (the smaller of two as common), holds finite numbers only and isn't all
    zeros.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    given = rows.select(F.col(key).alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(usable)
    lengths = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    given = given.where(F.size("v") == (lengths[0]["n"] if lengths else 0))
    return given.select("vec_id", F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string")))).alias("name"), "v")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by inner product, itself left out, ties to smaller ids.

    Vectors that are null, zero, of an odd length or hold null or non-finite
    numbers take no part on either side; null keys don't either. Equal vectors
    are scored once, with their ``k + 1`` smallest ids, more of which no result
    can need. Repeated rows of one id are one candidate, or one query; an id with
    several vectors stands for that of the smallest hash. Fewer candidates give
    fewer ranks; empty tables give an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    one = lambda x: x.groupBy("vec_id").agg(F.min(F.struct("name", "v")).alias("x")).select("vec_id", "x.name", "x.v")
    given, given_path = materialise(one(vectors(rows, key, embedding)), "vectors")
    asked, asked_path = materialise(one(vectors(queries, key, embedding)).withColumnRenamed("vec_id", "query_id"), "queries")
    first = Window.partitionBy("name").orderBy("vec_id")
    few = given.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k + 1)
    distinct = few.groupBy("name").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    distinct, distinct_path = materialise(distinct, "distinct")
    stats = distinct.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats[0]:
        return spark.createDataFrame([], schema)
    sample = distinct.orderBy(F.xxhash64("name"), "name").select("v").limit(SAMPLE).toPandas()
    index = build(np.array(sample["v"].tolist()), stats[0], float(np.sqrt(stats[1])))

    def posted(batches: Iterable[pa.RecordBatch], probes: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("v"))
                lists = index.probes(_asking(x)) if probes else index.replicas(index.lifted(x))
                lists = [sorted({c // BUNDLE for c in s}) for s in lists]
                lengths = [len(s) for s in lists]
                take = pa.array(np.repeat(np.arange(len(x)), lengths))
                yield pa.RecordBatch.from_arrays([pa.array([c for s in lists for c in s], pa.int32()), *[part.column(c).take(take) for c in ("name", "ids", "v")]], ["list", "name", "ids", "v"])

    kind = "list int, name string, ids array<long>, v array<double>"
    lists = distinct.select("name", "ids", "v").mapInArrow(lambda b: posted(b, False), kind)
    lists, lists_path = materialise(lists, "lists")
    chunks = lists.groupBy(F.col("list").alias("l")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks, chunks_path = materialise(chunks, "chunks")
    right = F.broadcast(chunks)  # one row per bundle, of which there are MOST_LISTS / BUNDLE at most
    held = lists.join(right, F.col("list") == F.col("l")).select("list", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("side"), "name", "ids", "v")
    unique = asked.groupBy("name").agg(F.first("v").alias("v")).select("name", F.array().cast("array<long>").alias("ids"), "v")
    reads = unique.mapInArrow(lambda b: posted(b, True), kind).join(right, F.col("list") == F.col("l"))
    reads = reads.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), "name", "ids", "v")
    together = held.unionByName(reads).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "side", "name")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of all that the task's lists hold for each query: (name, ids, scores)."""
        at, blocks, block, least = None, [], None, None
        asking: dict[str, int] = {}
        copies: dict[int, list[int]] = {}
        kept, held = [], 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _best(*[np.concatenate(x) for x in zip(*kept, strict=True)], k + 1)

        def results() -> Iterator[pa.RecordBatch]:
            q, ids, scores = best()
            names = list(asking)
            cuts = np.flatnonzero(np.diff(q)) + 1
            for group in np.array_split(np.arange(len(cuts) + 1), -(-(len(cuts) + 1) // 512)):
                out = ([], [], [])
                for g in group.tolist():
                    a, z = cuts[g - 1] if g else 0, cuts[g] if g < len(cuts) else len(q)
                    rows = [(i, x) for c, x in zip(ids[a:z].tolist(), scores[a:z].tolist(), strict=True) for i in copies.get(c, (c,))]
                    for column, value in zip(out, (names[q[a]], *zip(*rows, strict=True)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], ["name", "ids", "scores"])

        for batch in batches:
            mark = np.stack([batch.column(c).to_numpy() for c in ("list", "chunk", "side")], 1)
            cuts = np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mark)], strict=True):
                here, side = tuple(mark[a, :2]), mark[a, 2]
                if here != at:
                    at, blocks, block, least = here, [], None, []
                part = batch.slice(a, z - a)
                if side == 0:
                    blocks.append(_matrix(part.column("v")))
                    for ids in part.column("ids").to_pylist():
                        least.append(ids[0])
                        if len(ids) > 1:
                            copies[ids[0]] = ids
                    continue
                if not blocks:
                    continue
                if block is None:
                    block, least = np.concatenate(blocks), np.array(least)
                for b in range(0, z - a, 512):
                    some = part.slice(b, 512)
                    scores = _matrix(some.column("v")) @ block.T
                    edge = np.partition(scores, -min(k + 1, len(block)), 1)[:, -min(k + 1, len(block)), None]
                    row, column = np.nonzero(scores >= edge)  # ties at the edge included
                    q = np.array([asking.setdefault(n, len(asking)) for n in some.column("name").to_pylist()])
                    kept.append((q[row], least[column], scores[row, column]))
                    held += len(row)
                if held > HELD:
                    kept = [best()]
                    held = len(kept[0][0])
                    if held > HELD // 2:
                        yield from results()
                        kept, held = [], 0
                        asking.clear()
        if kept:
            yield from results()

    found = together.mapInArrow(scored, "name string, ids array<long>, scores array<double>")
    hits = found.select("name", F.inline(F.arrays_zip(F.col("ids").alias("i"), F.col("scores").alias("s")))).groupBy("name", "i").agg(F.max("s").alias("s"))
    place = Window.partitionBy("name").orderBy(F.desc("s"), "i")
    hits = hits.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1).withColumnRenamed("name", "n")
    own = asked.select("query_id", "name").join(hits, F.col("name") == F.col("n")).where("i <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "i"))
    ranked = own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("i").alias("vec_id"), F.col("s").alias("score"))
    out, _ = materialise(ranked, "neighbours")
    remove(spark, given_path, asked_path, distinct_path, lists_path, chunks_path)
    return out


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best of each query, best first, ties to smaller ids; an id that occurs twice counts once."""
    order = np.lexsort((-scores, ids, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, bool)
    q, ids, scores = q[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    begin = np.searchsorted(q, q)
    near = np.arange(len(q)) - begin < most
    return q[near], ids[near], scores[near]


def query(rows: DataFrame) -> DataFrame:
    return search(rows.select("vec_id", "embedding"), rows.where("vec_id % 20 = 0"))
