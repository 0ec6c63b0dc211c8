import math
import os
import struct
import zlib
from collections import defaultdict


import xxhash
from tidewatch.llm import kd_shards


def test_shards(docs, empty, clashing):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for frame in (docs, clashing):
        rows = kd_shards.query(frame).collect()
        assert len(rows) == docs.count()
        slots = {}
        for r in rows:
            assert any(r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) for t in texts[r["doc_id"]])
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(8))
    assert kd_shards.query(empty).count() == 0


def test_sizes_are_near_equal_and_copies_together(spark, prose):
    rows = [(i, prose(50 + i % 37, i % 700), f"s{i % 9}", "en", i % 90) for i in range(2000)]
    out = kd_shards.query(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).collect()
    sums, where = {}, {}
    for r in out:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(sums) == 8
    assert max(sums.values()) < 1.03 * min(sums.values())
    assert sum(len(s) > 1 for s in where.values()) <= 7


def test_heavy_group_is_split_for_bytes(spark):
    rows = [(i, "the same text", "s", "en", 5) for i in range(3000)] + [(9000 + i, f"text number {i}", "s", "en", 5) for i in range(3000)]
    out = kd_shards.query(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).collect()
    sums = [0] * 8
    for r in out:
        sums[r["shard"]] += r["size"]
    assert max(sums) < 1.05 * min(sums)


def test_target_bytes(docs):
    assert kd_shards.shard(docs, target_bytes=200_000).select("shard").distinct().count() >= 3


def brute(docs, n_leaves, dims):
    """Shard of each document by recursive splits in memory, from the definitions alone."""
    rows = [{**r.asDict(), "text": r["text"] or ""} for r in docs.collect()]
    for d in dims:
        values = [r[d] for r in rows if r[d] is not None]
        if values and isinstance(values[0], str):
            skip = len(os.path.commonprefix([min(values).encode(), max(values).encode()]))
            for r in rows:
                r[d] = None if r[d] is None else int.from_bytes(r[d].encode()[skip : skip + 6].ljust(6, b"\0"), "big")
    groups = defaultdict(list)
    for r in rows:
        r["size"] = len(r["text"].encode()) + 1
        groups[r["text"]].append(r)
    total = sum(r["size"] for r in rows)
    piece_bytes = max(1.0, kd_shards.TOLERANCE * total / n_leaves)
    for text, own in groups.items():
        pieces = min(math.ceil(len(own) * own[0]["size"] / piece_bytes), 1 << kd_shards.PIECE_BITS)
        for i, d in enumerate(dims):
            known = [r[d] for r in rows if r[d] is not None]
            least = min((r[d] for r in own if r[d] is not None), default=None)
            flat = not known or min(known) == max(known) or least is None
            at = 0 if flat else math.floor((least - min(known)) / (max(known) - min(known)) * kd_shards.GRID)
            for r in own:
                signed = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
                piece = (signed - (1 << 64) if signed >> 63 else signed) % pieces
                r[f"key{i}"] = (at, zlib.crc32(text.encode()), piece)
    out = {}

    def split(own, first, leaves):
        if leaves == 1 or not own:
            out.update({r["doc_id"]: first for r in own})
            return
        widths = [max(r[f"key{i}"][0] for r in own) - min(r[f"key{i}"][0] for r in own) for i in range(len(dims))]
        key = f"key{widths.index(max(widths))}"
        # rows of one key in every dimension go the same way
        weights = defaultdict(int)
        for r in own:
            weights[r[key]] += r["size"]
        goal, before, bound = sum(weights.values()) * (leaves // 2) / leaves, 0, None
        for k in sorted(weights):
            if before + weights[k] >= goal:
                rest = goal - before
                bound = (k, rest > weights[k] - rest)
                break
            before += weights[k]
        left = [r for r in own if r[key] < bound[0] or (r[key] == bound[0] and bound[1])]
        right = [r for r in own if not (r[key] < bound[0] or (r[key] == bound[0] and bound[1]))]
        split(left, first, leaves // 2)
        split(right, first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, n_leaves)
    return out


def test_tree_equals_a_brute_force_tree(spark, prose):
    names = [f"https://host-{i % 11:02d}.example/" for i in range(400)]
    rows = [(i, prose(20 + i * i % 83, i % 330), names[i] if i % 17 else None, ("en", "de", "fr")[i % 3], None if i % 29 == 0 else i * 7 % 191) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    for n_leaves, dims in ((8, ("source", "lang", "n_chars")), (5, ("n_chars", "source")), (7, ("source",))):
        got = {r["doc_id"]: r["shard"] for r in kd_shards.shard(frame, n_leaves=n_leaves, dims=dims).collect()}
        assert got == brute(frame, n_leaves, dims)


def test_strings_that_begin_alike_spread(spark, prose):
    rows = [(i, prose(30, i), f"https://www.source-{i % 16:02d}", "en", 5) for i in range(320)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = kd_shards.query(frame).join(frame.select("doc_id", "source"), "doc_id").select("source", "shard").distinct().collect()
    assert len(out) <= 16 + 8  # each shard holds neighbouring sources
