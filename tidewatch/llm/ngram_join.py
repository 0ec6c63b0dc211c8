"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Equal texts are one class and are compared once. Different texts that share a
band hash stand in one bucket. Each text has a home, the largest bucket that it
shares, and homes are dealt into blocks of bounded size. Two blocks are compared
if some bucket holds members of both, so each pair of texts that shares a bucket
is compared, once, however many buckets it shares; texts that are only linked
through chains of others aren't. A task compares one pair of blocks by the exact
intersections of their n-gram sets, as products of incidence matrices, and
returns per member its links and a spanning forest, never the pairs. A block
travels as one row. No bucket is capped. N-grams are told apart by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._bytes import PRIME, SPACE, hash_runs, mixed, runs, text_bytes
from tidewatch.llm._shared import fresh, materialise, remove, ship
from tidewatch.llm.bpe import slices
from tidewatch.llm.components import connected_components

WIDTH, SIMILARITY = 5, 0.8
#: Chance that a pair at exactly SIMILARITY shares a band, and the most hash functions spent on it.
RECALL, MOST_HASHES = 0.9999, 192
#: Members and n-grams that a block holds, about.
BLOCK_MEMBERS, BLOCK_NGRAMS = 128, 400_000
#: Dropped rows up to which they are broadcast.
BROADCAST_ROWS = 500_000


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows to a band, thus the fewest false candidates, that reach ``recall`` within ``most`` hashes."""
    best = None
    for rows in range(1, 33):
        miss = 1 - similarity**rows
        bands = 1 if miss <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(miss)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, first word of each text and the end), words being runs of non-space bytes."""
    data, bounds = text_bytes(column)
    starts, ends, first = runs(~SPACE[data], bounds)
    return hash_runs(data, starts, ends), first


def ngrams(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all word n-grams, first of each text and the end); a text of fewer words is one n-gram, one without words has none."""
    hashes, first = word_hashes(column)
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(counts)])
    grams = np.zeros(int(start[-1]), np.uint64)
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * PRIME + hashes[k : len(hashes) - width + 1 + k]
        owner = np.repeat(np.arange(len(n)), counts)
        source = np.arange(len(grams)) - start[owner] + first[owner]
        full = n[owner] >= width
        grams[full] = rolled[source[full]]
    for i in np.flatnonzero((n > 0) & (n < width)):
        x = np.uint64(int(n[i]))
        for h in hashes[first[i] : first[i + 1]]:
            x = np.uint64((int(x) * int(PRIME) + int(h)) & (1 << 64) - 1)
        grams[start[i]] = x
    return mixed(grams), start


def minhashes(grams: np.ndarray, start: np.ndarray, n_hashes: int) -> np.ndarray:
    """The least value of each hash function over each text's n-grams, one row per text."""
    rng = np.random.default_rng(1234567)
    flip = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)
    factor = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32) | np.uint32(1)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(start) - 1, n_hashes), np.uint32(0xFFFFFFFF), np.uint32)
    for i in range(len(start) - 1):
        for a in range(start[i], start[i + 1], 256):
            part = high[a : min(a + 256, start[i + 1]), None]
            np.minimum(out[i], ((part ^ flip) * factor).min(0), out=out[i])
    return out


def band_hashes(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * PRIME, (len(mins), bands)).copy()
    values = mins.reshape(len(mins), bands, rows).astype(np.uint64)
    for k in range(rows):
        x = mixed(x * PRIME + values[:, :, k])
    return x.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, bands: int, rows: int, width: int) -> DataFrame:
    """(doc, body, n_grams, bands): the text's md5 and the hashes of its bands, for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                grams, start = ngrams(part.column("text"), width)
                values = band_hashes(minhashes(grams, start, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * bands, pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("body"), pa.array(np.diff(start)), lists], ["doc", "body", "n_grams", "bands"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows_in = docs.select(F.col(key).alias("doc"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, f"doc {kind}, body string, n_grams long, bands array<long>")


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many elements each pair of sorted sets shares: products of incidence matrices over elements of two sets or more."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    place = np.cumsum(new) - 1
    shared = np.bincount(place)[place] > 1 if len(place) else new
    place, owner = place[shared], owner[shared]
    if len(place):
        place = np.cumsum(np.concatenate([[True], place[1:] != place[:-1]])) - 1
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [low, low + columns])
        m = np.zeros((n, columns), np.float32)
        m[owner[a:b], place[a:b] - low] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``similarity`` or more; none with itself."""
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    union = size[:, None] + size[None, :] - both
    found = (both >= similarity * union - 1e-9) & (both > 0)
    np.fill_diagonal(found, False)
    return found


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block, (block, bodies, grams), from sorted rows; repeated rows of one text are one member."""
    name, bodies, grams = None, [], []

    def row() -> pa.RecordBatch:
        columns = [pa.array([name], pa.int64()), pa.array([bodies], pa.list_(pa.string())), pa.array([grams], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "bodies", "grams"])

    for batch in batches:
        for block, body, data in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), batch.column("grams"), strict=True):
            if block != name:
                if bodies:
                    yield row()
                name, bodies, grams = block, [], []
            if not bodies or bodies[-1] != body:
                bodies.append(body)
                grams.append(data.as_py())
    if bodies:
        yield row()


def _links(members: list[str], found: np.ndarray) -> list[tuple[str, str, int]]:
    """(member, least member joined to it, its links) of those that have any."""
    order = np.argsort(np.array(members, dtype=object), kind="stable")
    label = np.empty(len(members), np.int64)
    label[order] = np.arange(len(members))
    while True:
        least = np.minimum(label, np.where(found, label[None, :], len(members)).min(1))
        if (least == label).all():
            break
        label = least
    return [(members[k], members[order[label[k]]], n) for k, n in enumerate(found.sum(1).tolist()) if n]


def _inside(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The links within each block."""
    for batch in batches:
        for bodies, grams in zip(batch.column("bodies").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            if len(bodies) > 1 and (out := _links(bodies, linked([np.frombuffer(x, np.uint64) for x in grams], similarity))):
                yield _batch(out)


def _across(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The links between the two blocks of each pair, whose rows stand together."""
    before = None
    for batch in batches:
        for k in range(batch.num_rows):
            name, bodies, grams = (batch.column("i")[k].as_py(), batch.column("j")[k].as_py()), batch.column("bodies")[k].as_py(), batch.column("grams")[k].as_py()
            if before is None or before[0] != name:
                before = (name, bodies, grams)
                continue
            found = linked([np.frombuffer(x, np.uint64) for x in before[2] + grams], similarity)
            found[: len(before[1]), : len(before[1])] = False
            found[len(before[1]) :, len(before[1]) :] = False
            if out := _links(before[1] + bodies, found):
                yield _batch(out)
            before = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n, pa.int64())], ["a", "b", "n"])


def blocks(texts: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(placed, pairs, scratch tables): (body, rep, block) of each text that shares a bucket, and the pairs of different blocks (block < other) to compare, each once.

    ``texts`` has body, rep, n_grams and the band hashes.
    """
    spread = texts.select("body", F.explode("bands").alias("bucket"))
    counted = spread.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select(F.col("bucket").alias("b"), "c")
    # the joins shuffle at every size: what they move follows the input, with no jump where a side outgrows a broadcast
    shared, shared_path = materialise(spread.join(counted.hint("merge"), F.col("bucket") == F.col("b")).select("body", "bucket", "c"), "shared")
    homes = shared.groupBy("body").agg(F.max(F.struct("c", "bucket"))["bucket"].alias("home")).select(F.col("body").alias("body_"), "home")
    homed, homed_path = materialise(texts.select("body", "rep", "n_grams").join(homes, F.col("body") == F.col("body_")).drop("body_"), "homes")
    need = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_grams") / BLOCK_NGRAMS))
    sizes = homed.groupBy(F.col("home").alias("h")).agg(need.alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("body"), F.col("parts")))
    placed, placed_path = materialise(homed.join(sizes, F.col("home") == F.col("h")).select("body", "rep", block.alias("block")), "placed")
    at = placed.select(F.col("body").alias("body_"), "block")
    present = shared.select("body", "bucket").join(at.hint("merge"), F.col("body") == F.col("body_")).select("bucket", "block").distinct()
    present, present_path = materialise(present, "present")
    lone = present.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"))
    several = present.join(lone, F.col("bucket") == F.col("b"), "left_semi")
    other = several.select(F.col("bucket").alias("b"), F.col("block").alias("other"))
    across = several.join(other, (F.col("bucket") == F.col("b")) & (F.col("block") < F.col("other"))).select("block", "other")
    pairs, pairs_path = materialise(across.distinct(), "pairs")
    return placed, pairs, [shared_path, homed_path, placed_path, present_path, pairs_path]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """(doc, body, copy_of, class_id, n_links) for each row of ``docs``.

    ``copy_of`` is the smallest key with the same text, ``class_id`` the
    smallest key that links of similar texts lead to, ``n_links`` the number of
    different texts whose n-gram sets have a Jaccard similarity of
    ``similarity`` or more with this one. Null texts and texts without words
    have no n-grams and link to nothing: each is its own class. Texts of fewer
    words than ``width`` count as one n-gram. Repeated rows come back apiece. A
    null key stands for no document: it never names a class, and its row has
    null classes unless another row has its text. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    bands, rows = banding(similarity, recall)
    signed, signed_path = materialise(signatures(docs, key, text, bands, rows, width), "signatures")
    texts = signed.where("n_grams > 0").groupBy("body").agg(F.min("doc").alias("rep"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).where("rep IS NOT NULL")
    texts, texts_path = materialise(texts, "texts")
    placed, pairs, scratch = blocks(texts)
    members = placed.select(F.col("rep").alias("rep_"), F.col("body").alias("body_"), "block")
    bodies = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    bodies = bodies.join(members.hint("shuffle_hash"), (F.col("rep") == F.col("rep_")) & (F.md5("text") == F.col("body_"))).select(F.col("body_").alias("body"), "text", "block")

    def grams_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                grams, start = ngrams(part.column("text"), width)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("body"), part.column("block"), pa.array(sets, pa.binary())], ["body", "block", "grams"])

    sets = bodies.mapInArrow(grams_of, "body string, block long, grams binary")
    packed = sets.repartition("block").sortWithinPartitions("block", "body").mapInArrow(_packed, "block long, bodies array<string>, grams array<binary>")
    packed, packed_path = materialise(packed, "packed")
    both = pairs.select(F.col("block").alias("i"), F.col("other").alias("j"))
    partners = both.select(F.col("i").alias("of"), "i", "j").unionByName(both.select(F.col("j").alias("of"), "i", "j"))
    together = packed.join(partners.hint("shuffle_hash"), F.col("block") == F.col("of")).select("i", "j", "bodies", "grams")
    together = together.repartition("i", "j").sortWithinPartitions("i", "j")
    schema = "a string, b string, n long"
    verified = packed.mapInArrow(lambda it: _inside(it, similarity), schema).unionByName(together.mapInArrow(lambda it: _across(it, similarity), schema))
    verified, verified_path = materialise(verified, "verified")
    links = verified.groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("n_links"))
    joined = connected_components(verified.select("a", "b")).select(F.col("node").alias("inside"), "component")
    named = texts.select(F.col("body").alias("body_"), "rep").join(joined, F.col("body_") == F.col("inside"))
    named, named_path = materialise(named.select("body_", "rep", "component"), "components")
    least = named.groupBy(F.col("component").alias("whole")).agg(F.min("rep").alias("class_of"))
    linked_ = named.join(least, F.col("component") == F.col("whole")).join(links, F.col("body_") == F.col("linked")).select(F.col("body_").alias("inside"), "class_of", "n_links")
    by_text = texts.select(F.col("body").alias("body_"), "rep").join(linked_, F.col("body_") == F.col("inside"), "left")
    out = signed.select("doc", "body", "n_grams").join(by_text, (F.col("body") == F.col("body_")) & (F.col("n_grams") > 0), "left")
    out = out.select("doc", "body", F.coalesce("rep", "doc").alias("copy_of"), F.coalesce("class_of", "rep", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out, _ = materialise(out, "classes")
    remove(spark, texts_path, packed_path, verified_path, named_path, signed_path, *scratch)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of the smallest key, with the columns of ``docs``; of repeated rows of one key and text one stays.

    Rows with a null key stay, whether another row has their text or not: they
    can't be told apart. Null texts and texts without words are like no other,
    so they stay; an empty table stays empty.
    """
    marked = classes(docs, key, text)
    dropped = marked.where("doc IS NOT NULL AND doc <> class_id").select("doc", "body").distinct()
    k, b, n = fresh(docs, "key_", "body_", "copy_")
    dropped = dropped.select(F.col("doc").alias(k), F.col("body").alias(b))
    body = F.md5(F.coalesce(F.col(text), F.lit("")))
    few = dropped.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(dropped) if few else dropped, (F.col(key) == F.col(k)) & (body == F.col(b)), "left_anti")
    stay = marked.where("doc IS NOT NULL AND doc = class_id")
    if stay.count() > stay.select("doc", "body").distinct().count():
        from pyspark.sql import Window

        one = Window.partitionBy(F.col(key), body).orderBy(F.lit(0))
        kept = kept.withColumn(n, F.row_number().over(one)).where((F.col(n) == 1) | F.col(key).isNull()).drop(n)
    return kept


def query(docs: DataFrame) -> DataFrame:
    out = classes(docs.select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "copy_of", "class_id", "n_links")
