"""Mixing sources to target weights: fixed-length blocks, drawn shards, permuted indices, one join by index.

The words of a source, documents one after another, are packed into blocks of
``block`` words. The output is as many slots, of one block each, in shards of
``shard_slots``. First, how many slots each source has in each shard is drawn:
multinomial counts conditioned on the sources' quotas, so that no source drifts
from its target and no document exceeds its share. Then the counts are spelled
out into slots: a shard's slots are permuted among its sources, and a source's
slots, numbered through all shards, are mapped by a permutation of its own for
each pass to block indices. A permutation is computed per index, nothing is
sorted or gathered for it. Joining blocks by (source, index) yields the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._shared import fresh, materialise, n_words, running

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block; a source's taken words miss its target by about one block at most.
BLOCK = 64
#: Slots of an output shard, and of a source that one task draws at a time.
SHARD_SLOTS, CHUNK = 4096, 16_384
ROUNDS = 24
SEED = 20240229
#: Documents that one bucket of a source's order holds, about.
BUCKET_ROWS = 1_000


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The place of ``index`` in a pseudorandom permutation of [0, n), fixed by ``key``: a swap-or-not shuffle.

    Each round pairs x with (k - x) mod n and swaps the pair or not by a hash
    bit, so it is its own inverse, and any n works without walking cycles.
    """
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if not inverse else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)  # the inner one keeps the difference from overflowing
        bit = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``target``: words that each source is to give.

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``most`` times its source's size and the excess is
    shared again by weight. Sorted by size for its weight, capped sources come
    first; each is capped while the rest's share exceeds its cap.
    One row per source runs through the two windows.
    """
    everything = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("__place", F.row_number().over(everything) - 1).withColumn(
        "__weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    )
    by_ratio = Window.partitionBy().orderBy((F.col("source_size") / F.col("__weight")).asc(), F.col("__place").asc())
    all_rows = Window.partitionBy()
    cap = most * F.col("source_size")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    shares = (
        placed.withColumn("__left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("__per", F.col("__left") / F.sum("__weight").over(onward))
        .withColumn("__capped", cap <= F.col("__per") * F.col("__weight"))
        .withColumn("__level", F.max(F.when(~F.col("__capped"), F.col("__per"))).over(all_rows))
    )
    # the first source that isn't capped has the level that holds for all others: later ones see the same or less
    return shares.select(
        "source", "source_size", F.when(F.col("__capped"), cap.cast("double")).otherwise(F.col("__level") * F.col("__weight")).alias("target")
    )


def plan(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(placed, sources): each document's first word in its source's order, and each source's blocks and slots.

    ``placed`` has source, size, bucket keys, ``start``, and every column of
    ``docs`` but the text; ``sources`` has source, source_size, target,
    n_blocks, n_slots and ``first_slot``.
    """
    rest = [c for c in docs.columns if c not in (text, source)]
    sized = docs.select(F.col(source).alias("source"), *[F.col(c).alias(f"in_{c}") for c in rest], n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("__text"))
    sized, _ = materialise(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__docs"))
    sources = targets(per_source.drop("__docs"), weights, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    sources = sources.withColumn("n_blocks", blocks)
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), most * F.col("n_blocks"))).otherwise(0)
    sources = sources.withColumn("n_slots", slots.cast("long"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(order), F.lit(0)))
    sources, _ = materialise(sources, "mix-sources")
    # order within a source: by bucket of a hash, then by row within the bucket; buckets get offsets from their sums
    rows = sized.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keys = [f"in_{c}" for c in rest if c == "doc_id"] + ["__text"]
    sized = sized.withColumn("__bucket", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(buckets)))
    sums = running(sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__n")), "source", "__bucket", "__n", "__before")
    offsets = sums.select(F.col("source").alias("__source"), F.col("__bucket").alias("__b"), "__before")
    within = Window.partitionBy("source", "__bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["__source"]) & (placed["__bucket"] == offsets["__b"]), "left")
    return placed.withColumn("start", F.col("__within") + F.col("__before")).drop("__within", "__before", "__source", "__b", "__bucket", "__text"), sources


def draws(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, source, n): how many slots of each output shard each source has drawn.

    All slots are in an urn, each marked with its source, and shards draw
    ``shard_slots`` of them without putting any back: multinomial counts given
    that every source ends at its quota. The urn is a permutation, so draws of
    all sources run side by side. Ranges are cut into chunks that are dealt out
    before they are spelled out, so that a large source doesn't fall to one task.
    """
    total = F.lit(max(1, sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]))
    # a fixed number of partitions: chunks are a few bytes each, which AQE would put into one task
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = sources.where(F.col("n_slots") > 0).select("source", "n_slots", "first_slot")
    chunks = some.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1, F.lit(CHUNK)))).repartition(tasks, "source", "from")
    marked = chunks.withColumn("mark", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, F.col("n_slots")) - 1)))
    drawn = permuted(F.col("first_slot") + F.col("mark"), total, F.lit(seed))
    return marked.select(F.floor(drawn / shard_slots).alias("shard"), "source").groupBy("shard", "source").agg(F.count("*").alias("n"))


def slot_table(sources: DataFrame, drawn: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Every slot of the output: (shard, slot, source, number within the source, pass, block), from the drawn counts.

    ``slot`` counts through all shards, each of which has ``shard_slots`` but the last.
    """
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = running(drawn, "source", "shard", "n", "from").withColumnRenamed("source", "__source")
    named = numbered.join(sources.select("source", "n_blocks"), F.col("__source").eqNullSafe(F.col("source"))).drop("__source").repartition(tasks, "shard")
    own = Window.partitionBy("shard")
    inside = own.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumns({"__at": F.coalesce(F.sum("n").over(inside), F.lit(0)), "__all": F.sum("n").over(own)})
    each = placed.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.withColumn("number", F.col("from") + F.col("__k")).withColumn("pass", F.floor(F.col("number") / F.col("n_blocks")))
    slot = F.col("shard") * shard_slots + permuted(F.col("__at") + F.col("__k"), F.col("__all"), F.xxhash64(F.lit(seed + 1), "shard"))
    block = permuted(F.pmod("number", "n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(seed), "source", "pass"))
    return each.select("shard", slot.alias("slot"), "source", "number", "pass", block.alias("block"))


def fragments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each document's share of each block: its columns with ``block`` and ``words``."""
    last = F.col("start") + F.col("size")
    some = placed.where(F.col("size") > 0)
    cut = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((last - 1) / block))))
    return cut.withColumn("words", F.least(last, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block))


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Each document with ``size``, ``source_size``, ``target`` (its source's), ``taken``, ``first_slot``, ``last_slot`` and ``n_uses``.

    ``taken`` is the words that the mix takes, repeats counted; the slots are
    the first and last of the output that hold words of the document, null if
    none does, and ``n_uses`` is how many do. Columns of ``docs`` other than
    text and source come back with the prefix ``in_``. A null text has no
    words, a null source is a source of its own, texts without words are taken
    0 times, repeated rows count apiece (which of two equal rows comes first
    doesn't matter to the multiset of results), an empty table gives an empty
    result. No block is taken more than ``most`` times, so no document exceeds
    that. The same rows give the same mix.
    """
    placed, sources = plan(docs, text, source, weights, most, block, seed)
    (uid,) = fresh(placed, "__row")
    placed, _ = materialise(placed.withColumn(uid, F.monotonically_increasing_id()), "mix-placed")
    drawn, _ = materialise(draws(sources, shard_slots, seed), "mix-draws")
    slots = slot_table(sources, drawn, shard_slots, seed).select(F.col("source").alias("__source"), F.col("block").alias("__block"), "slot")
    cut = fragments(placed.select(uid, "source", "size", "start"), block)
    # sizes of what comes from the slots are estimated from the few source rows, so the join is told to shuffle
    joined = cut.join(slots.hint("merge"), cut["source"].eqNullSafe(F.col("__source")) & (cut["block"] == F.col("__block")))
    taken = joined.groupBy(F.col(uid).alias("__uid")).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("n_uses"))
    small = sources.select(F.col("source").alias("__source"), "source_size", "target")
    out = placed.join(taken, F.col(uid) == F.col("__uid"), "left").join(small, F.col("source").eqNullSafe(F.col("__source")), "left")
    return out.withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long"), "n_uses": F.coalesce("n_uses", F.lit(0))}).drop(uid, "__uid", "__source", "start")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as whole documents, with the columns of ``docs``: each row as often as the mix takes its words.

    A row of ``size`` words of which ``taken`` are taken comes taken / size
    times, the fraction rounded up or down by a hash of its key, so that sums
    stay near the targets. Rows of one key, text and source share what they
    are given. Null and empty texts have no words to take and don't come; a
    null key or source is a value like any other; an empty table stays empty.
    """
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    mixed = mix(docs.select(F.col(key).alias("key"), h.alias("hash"), F.col(text).alias("text"), F.col(source).alias("source")))
    share = mixed.groupBy("in_key", "in_hash", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("taken > 0")
    k, t, s, n = fresh(docs, "key_", "hash_", "source_", "times_")
    whole = F.col("taken") / F.col("size")
    lucky = F.pmod(F.xxhash64("in_key", "in_hash", F.lit(SEED)), F.lit(1 << 20)) < (whole - F.floor(whole)) * (1 << 20)
    share = share.select(F.col("in_key").alias(k), F.col("in_hash").alias(t), F.col("source").alias(s), (F.floor(whole) + lucky.cast("long")).cast("int").alias(n)).where(F.col(n) > 0)
    joined = docs.join(share.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(k)) & (h == F.col(t)) & F.col(source).eqNullSafe(F.col(s)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select(F.col("in_doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "last_slot", "n_uses")
