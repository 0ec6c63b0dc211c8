"""Reusable window patterns: order, novelty, prior and sliding counts, gap sessions, greedy bursts.

Rows of a key follow the strict order (time, event_index), however many share
a time. Counts over all earlier rows, or those of a span of time, are running
sums of entries and exits over (key, time bucket) with the sums of earlier
buckets carried, so they are linear in the rows and a busy key is cut into
pieces of bounded time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: str | Column = "timestamp") -> Column:
    return F.unix_micros(ts)


def with_order(df: DataFrame, key: str, name: str = "ord", ts: str = "timestamp", index: str = "event_index") -> DataFrame:
    """``df`` with the place, from 1, of each row within its ``key``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(ts, index)).cast("long"))


def before(key: str, order: str = "ord"):
    """The strictly earlier rows of a key."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def attach_all(df: DataFrame, parts: list[tuple[DataFrame, dict]], index: str = "event_index") -> DataFrame:
    """``df`` with the columns of all parts, each one row per ``index`` at most; rows that a part doesn't have get its missing values."""
    out, joined = [F.col(c) for c in df.columns], df
    for i, (part, missing) in enumerate(parts):
        names = [c for c in part.columns if c != index]
        joined = joined.join(part.select(F.col(index).alias(f"__at{i}"), *names), F.col(index) == F.col(f"__at{i}"), "left")
        out += [F.coalesce(F.col(n), F.lit(missing[n])).alias(n) if n in missing else F.col(n) for n in names]
    return joined.select(*out)


def attach(df: DataFrame, part: DataFrame, index: str = "event_index", **missing) -> DataFrame:
    """``df`` with the columns of one part."""
    return attach_all(df, [(part, missing)], index)


def prior_sums(rows: DataFrame, key: str, bucket: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (name, column), the column's sum over the strictly earlier rows of the key.

    Rows are sorted within (key, bucket); buckets rise with the order, and
    one row per key and bucket carries the sums of earlier ones.
    """
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__ck").orderBy("__cb").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("__ck"), F.col(bucket).alias("__cb")).agg(*[F.sum(c).alias(f"__c_{n}") for n, c in sums.items()])
    carried = totals.select("__ck", "__cb", *[F.coalesce(F.sum(f"__c_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in sums])
    here = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = here.join(carried, (F.col(key) == F.col("__ck")) & (F.col(bucket) == F.col("__cb")))
    return joined.withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in sums}).drop("__ck", "__cb", *[f"__c_{n}" for n in sums])


def stacked(df: DataFrame, keys: dict[str, Column], *columns: str) -> DataFrame:
    """A row for each of several keys that a row has, with ``columns``, ``kind`` and ``key`` (kind, bar, value): one pass serves all of them."""
    entries = F.array(*[F.when(k.isNotNull(), F.struct(F.lit(n).alias("kind"), F.concat(F.lit(f"{n}|"), k.cast("string")).alias("key"))) for n, k in keys.items()])
    return df.select(*columns, F.inline(F.filter(entries, lambda x: x.isNotNull())))


def prior_values(df: DataFrame, key: Column, value: Column, name: str, index: str = "event_index", ts: str = "timestamp") -> DataFrame:
    """(index, ``name``, ``name``_new, __key): how many different values strictly earlier rows of the key had, and 1 if this row's is new.

    Rows with a null key aren't in the result; a null value is never new.
    """
    rows = df.select(F.col(index), key.alias("__key"), value.alias("__value"), micros(ts).alias("__us")).where("__key IS NOT NULL")
    own = Window.partitionBy("__key", "__value").orderBy("__us", index)
    rows = rows.withColumn(f"{name}_new", F.when(F.col("__value").isNotNull() & (F.row_number().over(own) == 1), 1).otherwise(0))
    rows = rows.withColumn("__bucket", F.floor(F.col("__us") / DAY).cast("long"))
    return prior_sums(rows, "__key", "__bucket", ["__us", index], {name: f"{name}_new"}).select(index, name, f"{name}_new", "__key")


def sliding(df: DataFrame, key: Column, spans: dict[str, int], who: Column | None = None, weight: Column | None = None, first: tuple[str, ...] = (), time: Column | None = None, index: str = "event_index", ts: str = "timestamp", with_row: bool = False) -> DataFrame:
    """What strictly earlier rows of the key amount to within spans of microseconds, limits included: (index, columns by span).

    For each span ``x``: ``x`` counts rows, or sums their 0/1 ``weight``; with
    ``who``, ``x_others`` counts different values of it other than the row's
    own and ``x_all`` all of them; for spans in ``first``, ``x_first`` is the
    earliest row's time. Times may be coarsened by ``time`` (whole seconds,
    say). Rows with a null key aren't in the result. ``with_row`` adds the
    row's own ``__key``, ``__us`` and ``__w``.

    Each row enters when it happens and leaves a span after it. A value of
    ``who`` is there from its first row until a span after the last of a
    chain of its rows without longer gaps, so chains' ends are counted, not
    sets kept. As rows leave in the order in which they came, the earliest one
    left is that whose number is the count of those gone.
    """
    if weight is not None and (who is not None or first):
        raise ValueError("values and first times are those of all rows")
    rows = df.select(F.col(index), key.alias("__key"), (time if time is not None else micros(ts)).alias("__t"), micros(ts).alias("__us"), (who if who is not None else F.lit(None).cast("string")).alias("__who"), (weight.cast("int") if weight is not None else F.lit(1)).alias("__w")).where("__key IS NOT NULL")
    names, longest = list(spans), max(spans.values())
    if who is not None:
        own = Window.partitionBy("__key", "__who").orderBy("__us", index)
        rows = rows.withColumns({"__gap": F.col("__t") - F.lag("__t").over(own), "__next": F.lead("__t").over(own) - F.col("__t")})

    def deltas(at: Column, leaves: str | None) -> Column:
        fields = [at.alias("__at"), F.lit(0 if leaves is None else 1).alias("__exit")]
        for x in names:
            on = leaves is None or leaves == x
            sign = 1 if leaves is None else -1
            fields.append((sign * F.col("__w") if on else F.lit(0)).alias(f"__n_{x}"))
            if who is not None:
                gap = F.col("__gap" if leaves is None else "__next")
                fields.append((F.when(gap <= spans[x], 0).otherwise(sign) if on else F.lit(0)).alias(f"__u_{x}"))
            if x in first:
                fields.append(F.lit(1 if leaves == x else 0).alias(f"__x_{x}"))
        return F.struct(*fields)

    moved = F.array(deltas(F.col("__t"), None), *[deltas(F.col("__t") + spans[x], x) for x in names])
    placed = rows.withColumn("__d", F.explode(moved)).select(index, "__key", "__t", "__us", "__w", *(["__gap"] if who is not None else []), "__d.*")
    placed = placed.withColumn("__bucket", F.floor(F.col("__at") / longest).cast("long"))
    sums = {x: f"__n_{x}" for x in names}
    if who is not None:
        sums |= {f"{x}_all": f"__u_{x}" for x in names}
    sums |= {f"__gone_{x}": f"__x_{x}" for x in first}
    if first:
        sums["__number"] = "__come"
        placed = placed.withColumn("__come", 1 - F.col("__exit"))
    counted = prior_sums(placed, "__key", "__bucket", ["__at", "__exit", "__us", index], sums).where("__exit = 0")
    for x in first:
        left = counted.select(F.col("__key").alias("__fk"), F.col("__number").alias("__fn"), F.col("__t").alias(f"{x}_first"))
        counted = counted.join(left, (F.col("__key") == F.col("__fk")) & (F.col(f"__gone_{x}") == F.col("__fn")) & (F.col(x) > 0), "left").drop("__fk", "__fn")
    if who is not None:
        counted = counted.withColumns({f"{x}_others": F.col(f"{x}_all") - F.when(F.col("__gap") <= spans[x], 1).otherwise(0) for x in names})
    out = [c for x in names for c in (x, f"{x}_all", f"{x}_others", f"{x}_first") if c in counted.columns]
    return counted.select(index, *out, *(("__key", "__us", "__w") if with_row else ()))


def slot(within: int) -> int:
    """Places that a microsecond has in an order key over two spans of ``within``."""
    return 1 << max(2, 62 - (2 * within).bit_length())


def onward(key: str | list[str], within: int, order: str = "ord"):
    """A row of ``ordered_buckets`` and the later ones within so many microseconds, the limit included."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order).rangeBetween(0, within * slot(within) + slot(within) // 2 - 1)


def backward(key: list[str], within: int, order: str = "ord"):
    """A row of backward ``ordered_buckets`` and the earlier ones within so many microseconds, the limit included."""
    return Window.partitionBy(*key).orderBy(order).rangeBetween(-within * slot(within) - slot(within) // 2 + 1, 0)


def first_seen(key: str, value: str, order: str = "ord") -> Column:
    """1 on the first row of a key with a non-null value, else 0."""
    w = Window.partitionBy(key, value).orderBy(order)
    return F.when(F.col(value).isNotNull() & (F.row_number().over(w) == 1), 1).otherwise(0)


def prior_distinct(df: DataFrame, key: str, value: str, name: str, order: str = "ord") -> DataFrame:
    """``name``: how many different values strictly earlier rows of the key had; ``name``_new: 1 if this row's value is new.

    For keys whose rows fit into a task, like a user's, in the order that ``df`` has; else see ``prior_values``.
    """
    df = df.withColumn(f"{name}_new", first_seen(key, value, order))
    return df.withColumn(name, F.coalesce(F.sum(f"{name}_new").over(before(key, order)), F.lit(0)))


def last_before(key: str, value: str, order: str = "ord") -> Column:
    """The latest non-null value of strictly earlier rows."""
    return F.last(value, ignorenulls=True).over(before(key, order))


def gap_sessions(df: DataFrame, key: str, gap: int, name: str, ts: str = "timestamp", index: str = "event_index") -> DataFrame:
    """``name``: the number from 0 of each row's session within its key; a step of more than ``gap`` microseconds starts one."""
    w = Window.partitionBy(key).orderBy(ts, index)
    new = F.coalesce((micros(ts) - F.lag(micros(ts)).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn(name, F.sum(new).over(w))


def bucketed(df: DataFrame, within: int, ts: str = "timestamp", look_back: bool = False) -> DataFrame:
    """Rows with ``bucket`` and ``anchor``: each row stands in its time bucket as an anchor and in the one before as context.

    A forward frame of ``within`` microseconds of an anchor lies in its bucket,
    so (key, bucket) can be a partition: a busy key is cut into pieces of
    bounded time, not left to one task. With ``look_back`` the context goes to
    the bucket after, for frames that look back.
    """
    own = F.floor(micros(ts) / within).cast("long")
    other = own + 1 if look_back else own - 1
    both = F.array(F.struct(own.alias("bucket"), F.lit(True).alias("anchor")), F.struct(other.alias("bucket"), F.lit(False).alias("anchor")))
    return df.withColumn("__b", F.explode(both)).withColumn("bucket", F.col("__b.bucket")).withColumn("anchor", F.col("__b.anchor")).drop("__b")


def ordered_buckets(df: DataFrame, key: str, within: int, name: str = "ord", ts: str = "timestamp", index: str = "event_index", look_back: bool = False) -> DataFrame:
    """``bucketed`` rows with their order key, all of it over the one partitioning by (key, bucket).

    An order key is a row's time since its bucket began times ``slot`` plus its
    place among rows at its time, so RANGE frames follow the strict order.
    Millions of rows of a key may share a microsecond; more raise an error.
    """
    placed = bucketed(df, within, ts, look_back)
    rows = Window.partitionBy(key, "bucket").orderBy(ts, index)
    times = Window.partitionBy(key, "bucket").orderBy(ts)
    tie = (F.row_number().over(rows) - F.rank().over(times)).cast("long")
    began = (F.col("bucket") - int(look_back)) * within
    place = F.when(F.col("__tie") < slot(within) // 2, F.col("__tie")).otherwise(F.raise_error(F.lit("too many rows of one key at one time")).cast("long"))
    return placed.withColumn("__tie", tie).withColumn(name, (micros(ts) - began) * slot(within) + place).drop("__tie")


#: Windows of time to a coarse bucket, over which chains of bursts are numbered.
COARSE = 4096


def chains(candidates: DataFrame, keys: list[str], within: int, ts: str = "timestamp") -> DataFrame:
    """``candidates`` with ``__chain``: the time at which their chain began; a chain ends where the next candidate is further than ``within``.

    Starts are found in time buckets, and the latest start before a row in
    coarse buckets with a carry from earlier ones, so that no window runs over
    all candidates of a key.
    """
    near = Window.partitionBy(*keys, "bucket").orderBy("__us").rangeBetween(-within, -1)
    rows = bucketed(candidates.withColumn("__us", micros(ts)), within, ts, look_back=True)
    rows = rows.withColumn("__start", F.when(F.count(F.lit(1)).over(near) == 0, F.col("__us"))).where("anchor").drop("bucket", "anchor")
    rows = rows.withColumn("__part", F.floor(F.col("__us") / (within * COARSE)).cast("long"))
    names = [f"__c_{k}" for k in keys]
    ends = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__part").alias("__p")).agg(F.max("__start").alias("__m"))
    earlier = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.max("__m").over(earlier)).drop("__m")
    here = Window.partitionBy(*keys, "__part").orderBy("__us").rangeBetween(Window.unboundedPreceding, 0)
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)] + [F.col("__part") == F.col("__p")]
    joined = rows.withColumn("__here", F.max("__start").over(here)).join(ends, on)
    return joined.withColumn("__chain", F.coalesce("__here", "__carry")).drop("__us", "__start", "__part", "__p", "__here", "__carry", *names)


def greedy_bursts(candidates: DataFrame, keys: list[str], within: int, ts: str = "timestamp", order: str = "event_index") -> DataFrame:
    """The candidates that a scan by (time, ``order``) would emit which, after each burst, skips all rows up to its end.

    A candidate is a row from which the window of ``within`` microseconds
    qualifies; whether it does is independent of the scan, so only times and
    ``order``, which names rows, are scanned: chain by chain, as a stream that
    jumps from burst to burst and holds one batch.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, free = None, 0
        for batch in batches:
            t, of = batch.column("t").to_numpy(), batch.column("chain").to_pylist()
            cuts = [k for k in range(1, len(of)) if of[k] != of[k - 1]]
            taken = []
            for a, z in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if z > a and of[a] != chain:
                    chain, free = of[a], int(t[a]) - 1
                at = a + int(np.searchsorted(t[a:z], free, "right"))
                while at < z:
                    taken.append(at)
                    free = int(t[at]) + within
                    at = a + int(np.searchsorted(t[a:z], free, "right"))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(taken, pa.int64())) for c in ("k", "o")], ["k", "o"])

    rows = chains(candidates.select(*keys, ts, order), keys, within, ts)
    rows = rows.select(F.to_json(F.struct(*keys, "__chain")).alias("chain"), F.xxhash64(*keys).alias("k"), micros(ts).alias("t"), F.col(order).cast("long").alias("o"))
    taken = rows.repartition("chain").sortWithinPartitions("chain", "t", "o").mapInArrow(scan, "k long, o long")
    taken = taken.select(F.col("k").alias("__k"), F.col("o").alias("__o"))
    return candidates.join(taken, (F.xxhash64(*keys) == F.col("__k")) & (F.col(order) == F.col("__o")), "left_semi")


#: Windows to a bucket in which rows are counted, and starts to a row in which they are scanned.
WINDOWS, STARTS = 8, 512


def window_bursts(events: DataFrame, key: Column, within: int, qualifies: Callable[[dict], np.ndarray], aggregates: dict[str, Column], sums: dict[str, Column] | None = None, crowd: tuple[int, int] | None = None, columns: tuple[str, ...] = (), who: str = "user_id", index: str = "event_index", ts: str = "timestamp") -> DataFrame:
    """(__key, ``index``, ``timestamp``, aggregates) of the bursts of ``burst_starts``."""
    placed, taken = burst_starts(events, key, within, qualifies, sums, crowd, columns, who, index, ts)
    return burst_sets(placed, taken, within, aggregates, index, ts)


def burst_sets(placed: DataFrame, taken: DataFrame, within: int, aggregates: dict[str, Column], index: str = "event_index", ts: str = "timestamp", also: tuple[str, ...] = ()) -> DataFrame:
    """(__key, ``index``, ``timestamp``, ``also``, aggregates): ``aggregates`` over the rows of each start in ``taken``, with ``also`` of its columns.

    A burst lies in the bucket in which it starts and the rows added to it, so
    the buckets that counted starts are read again, without another shuffle.
    """
    # All columns are asked for by a condition that always holds and can't be moved: rows pruned earlier would be shuffled anew.
    asis = placed.where((F.spark_partition_id() >= 0) | (F.hash(*placed.columns) == 0))
    inside = (F.col("__t") <= F.col("__from") + within) & ((F.col("__t") > F.col("__from")) | ((F.col("__t") == F.col("__from")) & (F.col("__o") >= F.col("__first"))))
    joined = asis.join(taken, (F.col("__key") == F.col("__k")) & (F.col("__part") == F.col("__p")) & inside)
    sets = joined.groupBy("__key", "__part", "__first", "__from", *also).agg(*[c.alias(n) for n, c in aggregates.items()])
    return sets.select("__key", F.col("__first").alias(index), F.timestamp_micros("__from").alias(ts), *also, *aggregates)


def burst_starts(events: DataFrame, key: Column, within: int, qualifies: Callable[[dict], np.ndarray], sums: dict[str, Column] | None = None, crowd: tuple[int, int] | None = None, columns: tuple[str, ...] = (), who: str = "user_id", index: str = "event_index", ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows in buckets, with ``columns``, and (__k, __p, __from, __first): key, bucket, time and ``index`` of the bursts that a scan by (time, ``index``) finds which skips all rows up to a burst's end.

    A burst starts at a row from which the rows of its key within so many
    microseconds qualify: ``qualifies`` gets arrays by start of ``n`` rows,
    different ``who`` (not null), 0/1 ``sums``, the ``span`` up to the last
    row's time, and with ``crowd`` (microseconds, rows) whether more rows than
    that lie so close together. Rows with a null key take no part.

    Counts of all starts are running sums over a bucket of some windows and the
    one after; a value is counted from the row after its last one, or where
    its window begins, to its row. Only starts that a scan can reach leave a
    bucket: it enters within the first window and jumps from there. They
    travel as bytes of their steps, all lowest ones first, which compress.
    Bursts don't overlap, so each row is aggregated at most once, and no row
    carries the values of its window.
    """
    sums = sums or {}
    names, wide, longest = list(sums), WINDOWS * within, STARTS
    rows = events.select(key.alias("__key"), micros(ts).alias("__t"), F.col(index).cast("long").alias("__o"), F.col(who).alias("__who"), *[F.coalesce(c, F.lit(False)).alias(f"__s_{n}") for n, c in sums.items()], *columns).where("__key IS NOT NULL")
    own = F.floor(F.col("__t") / wide).cast("long")
    parts = F.when(F.pmod("__t", F.lit(wide)) < within, F.array(own, own - 1)).otherwise(F.array(own))
    placed = rows.select("__key", F.explode(parts).alias("__part"), "__t", "__o", "__who", *[f"__s_{n}" for n in names], *columns).repartition("__key", "__part")

    def planes(x: np.ndarray) -> bytes:
        return np.diff(x, prepend=0).astype("<i8").view("u1").reshape(-1, 8).T.tobytes()

    def from_planes(x: bytes) -> np.ndarray:
        return np.cumsum(np.frombuffer(x, "u1").reshape(8, -1).T.copy().view("<i8").ravel())

    def reachable(at: np.ndarray, group: np.ndarray, offset: np.ndarray) -> np.ndarray:
        late = offset >= within
        late[1:] &= (group[1:] != group[:-1]) | (offset[:-1] < within)
        seen, after = np.zeros(len(at), bool), np.searchsorted(at, at + within, "right")
        new = np.flatnonzero((offset < within) | late)
        while len(new):
            seen[new] = True
            to = after[new]
            onto = to < len(at)
            new = np.unique(to[onto][group[to[onto]] == group[new[onto]]])
        return seen

    def starts(table: pa.Table) -> pa.RecordBatch:
        whole = table.combine_chunks()
        keys = whole.column("__key").combine_chunks().dictionary_encode()
        codes, part, t, o = keys.indices.to_numpy(), whole.column("__part").to_numpy(), whole.column("__t").to_numpy(), whole.column("__o").to_numpy()
        m = len(t)
        opens = np.r_[True, (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])]
        group = np.cumsum(opens) - 1
        at = group * (2 * wide + 2 * within) + (t - part * wide)
        end, i = np.searchsorted(at, at + within, "right"), np.arange(m)
        found = {"n": end - i, "span": at[end - 1] - at}
        values = whole.column("__who").combine_chunks().dictionary_encode().indices
        known = ~np.asarray(values.is_null())
        pair = group * (m + 1) + values.fill_null(0).to_numpy()
        order = np.flatnonzero(known)
        order = order[np.argsort(pair[order], kind="stable")]
        before = np.full(m, -1)
        again = np.flatnonzero(pair[order][1:] == pair[order][:-1])
        before[order[again + 1]] = order[again]
        began = np.maximum(np.searchsorted(at, at - within, "left"), before + 1)
        found["users"] = np.cumsum(np.bincount(began[known], minlength=m + 1) - np.bincount(i[known] + 1, minlength=m + 1))[:m]
        for n in names:
            run = np.r_[0, np.cumsum(np.asarray(whole.column(f"__s_{n}")).astype(np.int64))]
            found[n] = run[end] - run[i]
        if crowd:
            short, cap = crowd
            late = np.full(m, np.iinfo(np.int64).max)
            if m > cap:
                close = (at[cap:] - at[: m - cap] <= short) & (group[cap:] == group[: m - cap])
                late[: m - cap][close] = at[cap:][close]
            found["crowded"] = np.minimum.accumulate(late[::-1])[::-1] <= at + within
        takes = np.flatnonzero((t - part * wide < wide) & qualifies(found))
        takes = takes[np.r_[True, at[takes][1:] != at[takes][:-1]]] if len(takes) else takes
        takes = takes[reachable(at[takes], group[takes], (t - part * wide)[takes])]
        place = np.arange(len(takes)) - np.searchsorted(group[takes], group[takes], "left")
        first = np.flatnonzero(place % longest == 0)
        ends = np.r_[first, len(takes)]
        lists = [pa.array([planes(x[takes[a:z]]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (t, o)]
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(codes[takes][first])).cast(pa.string()), pa.array(t[takes][first], pa.int64()), *lists], ["k", "t0", "t", "o"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, p = batch.column("__key"), batch.column("__part").to_numpy()
            same = np.asarray(pa.compute.equal(k, k[-1]).fill_null(False)) & (p == p[-1])
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut == 0 and held and (held[-1].column("__key")[-1].as_py(), held[-1].column("__part")[-1].as_py()) != (k[0].as_py(), int(p[0])):
                yield starts(pa.Table.from_batches(held))
                held = []
            if cut:
                yield starts(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield starts(pa.Table.from_batches(held))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, 0
        for batch in batches:
            keys, times, places = [], [], []
            for k, t, o in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "o")), strict=True):
                t, o = from_planes(t), from_planes(o)
                if k != key:
                    key, free = k, int(t[0]) - 1
                at = int(np.searchsorted(t, free, "right"))
                while at < len(t):
                    keys.append(k)
                    times.append(int(t[at]))
                    places.append(int(o[at]))
                    free = times[-1] + within
                    at = int(np.searchsorted(t, free, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64()), pa.array(places, pa.int64())], ["__k", "__from", "__first"])

    candidates = placed.sortWithinPartitions("__key", "__part", "__t", "__o").mapInArrow(count, "k string, t0 long, t binary, o binary")
    taken = candidates.repartition("k").sortWithinPartitions("k", "t0").mapInArrow(scan, "__k string, __from long, __first long")
    return placed, taken.select("__k", F.floor(F.col("__from") / wide).cast("long").alias("__p"), "__from", "__first")
