import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tidewatch.llm import mixing
from tidewatch.llm._shared import running


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, target = {}, {}
    while True:
        rest = [s for s in names if s not in capped]
        left, total = sum(sizes.values()) - sum(capped.values()), sum(weight[s] for s in rest)
        target = {s: left * weight[s] / total for s in rest}
        over = {s: 3 * sizes[s] for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return capped | target
        capped |= over


def test_targets_and_taken(docs):
    rows = mixing.query(docs).collect()
    assert len(rows) == docs.count()
    by_source, where = defaultdict(int), {}
    texts = {(r["doc_id"], r["source"]): r["text"] for r in docs.collect()}
    for (doc, source), text in texts.items():
        where[doc] = source
    for r in docs.collect():
        by_source[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, got = brute_targets(by_source), defaultdict(int)
    for r in rows:
        source = where[r["doc_id"]]
        assert r["source_size"] == by_source[source]
        assert abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        got[source] += r["taken"]
    for s, t in want.items():
        assert abs(got[s] - t) <= 2 * mixing.BLOCK


def test_reruns_agree_whatever_the_partitioning(docs):
    key = lambda df: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in df.collect())
    assert key(mixing.query(docs)) == key(mixing.query(docs.repartition(7, "n_chars")))


def test_permutation_is_one_and_inverts(spark):
    for n in (1, 2, 7, 100, 1031):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), F.lit(5), inverse=True))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] for r in rows)


def parts(docs, shard_slots=64):
    placed, sources = mixing.plan(docs.select("doc_id", "text", "source"))
    drawn = mixing.draws(sources, shard_slots)
    return placed, sources, drawn, mixing.slot_table(sources, drawn, shard_slots)


def test_slots_are_dealt_once(docs):
    _, sources, drawn, slots = parts(docs)
    n = sources.agg(F.sum("n_slots")).first()[0]
    rows = slots.collect()
    assert sorted(r["slot"] for r in rows) == list(range(n))
    assert all(r["shard"] == r["slot"] // 64 for r in rows)
    assert Counter((r["shard"], r["source"]) for r in rows) == {(r["shard"], r["source"]): r["n"] for r in drawn.collect()}
    for s in sources.collect():  # each pass takes every block of the source once, the last one some of them
        own = [r for r in rows if r["source"] == s["source"]]
        assert sorted(r["number"] for r in own) == list(range(s["n_slots"]))
        seen = Counter((r["pass"], r["block"]) for r in own)
        assert all(c == 1 for c in seen.values()) and all(0 <= b < s["n_blocks"] for _, b in seen)


def test_drawn_counts_vary_like_draws_without_replacement(spark):
    sources = spark.createDataFrame([("a", 40_000, 0), ("b", 20_000, 40_000), ("c", 4_000, 60_000)], "source string, n_slots long, first_slot long")
    total, size = 64_000, 64
    rows = mixing.draws(sources, size).collect()
    for name, quota in (("a", 40_000), ("b", 20_000), ("c", 4_000)):
        counts = [r["n"] for r in rows if r["source"] == name] + [0] * (total // size - sum(r["source"] == name for r in rows))
        share = quota / total
        mean, var = sum(counts) / len(counts), sum((c - size * share) ** 2 for c in counts) / len(counts)
        want = size * share * (1 - share) * (total - size) / (total - 1)
        assert mean == size * share and 0.8 * want < var < 1.25 * want


def test_result_equals_a_brute_force_block_mix(docs):
    placed, sources, _, slots = parts(docs, mixing.SHARD_SLOTS)
    rows, by_source = placed.collect(), defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    words = defaultdict(list)  # the documents of each word of a source, in order
    for s, own in by_source.items():
        for r in sorted(own, key=lambda r: (r["start"], r["size"])):
            assert r["start"] == len(words[s])
            words[s] += [(r["in_doc_id"], r["size"])] * r["size"]
    taken, uses = defaultdict(int), defaultdict(set)
    for r in slots.collect():
        held = words[r["source"]][r["block"] * mixing.BLOCK : (r["block"] + 1) * mixing.BLOCK]
        for d in held:
            taken[d, r["source"]] += 1
            uses[d, r["source"]].add(r["slot"])
    got, want = defaultdict(int), {}
    where = {r["in_doc_id"]: r["source"] for r in rows}
    for r in mixing.query(docs).collect():
        k = ((r["doc_id"], r["size"]), where[r["doc_id"]])
        got[k] += r["taken"]
        if r["doc_id"] != 301:  # a repeated row shares its key
            own = uses.get(k, set())
            assert (r["first_slot"], r["last_slot"], r["n_uses"]) == (min(own, default=None), max(own, default=None), len(own))
    want = {k: taken.get(k, 0) for k in got}
    assert got == want


def test_another_draw_gives_another_mix(docs, monkeypatch):
    mixed = lambda: {r["in_doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(docs.select("doc_id", "text", "source"), shard_slots=64).collect()}
    one = mixed()
    in_order = lambda index, n, key, inverse=False: index.cast("long")
    real = mixing.permuted
    monkeypatch.setattr(mixing, "draws", lambda s, n, seed: _drawn_in_order(s, n, seed, monkeypatch, in_order, real))
    two = mixed()
    assert sum(one[k] != two[k] for k in one) > len(one) / 2
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}  # quotas don't depend on the draw


def _drawn_in_order(sources, shard_slots, seed, monkeypatch, in_order, real, draws=mixing.draws):
    """Shards filled source after source: no draw at all."""
    monkeypatch.setattr(mixing, "permuted", in_order)
    out = draws(sources, shard_slots, seed)
    monkeypatch.setattr(mixing, "permuted", real)
    return out


def test_running_sums(spark):
    rows = [(s, i, (i * 7 + len(s or "")) % 11) for s in ("a", "b", None) for i in range(0, 50, 1 + len(s or ""))]
    got = running(spark.createDataFrame(rows, "g string, at long, v long"), "g", "at", "v", "before", span=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["before"] == sum(v for g, at, v in rows if g == r["g"] and at < r["at"])


def test_edges(empty, clashing, docs):
    assert mixing.query(empty).count() == 0
    out = mixing.repeated(clashing)
    assert out.columns == clashing.columns
    assert out.count() > 0
    assert mixing.repeated(empty).count() == 0
