import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from tidewatch.llm import ngram_join


def brute(rows, width=5, similarity=0.8):
    """(class, links) by key, from all pairs of texts that share an n-gram."""
    first = {}
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(t or "", k)
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for t, k in first.items()}
    sets = {k: {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for k, w in words.items() if w}
    inverted = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            inverted[g].append(k)
    shared = Counter(p for ks in inverted.values() for p in combinations(sorted(ks), 2))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for (a, b), n in shared.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (find(first[t or ""]), links[first[t or ""]]) if first[t or ""] in sets else (k, 0) for k, t in rows if k is not None}


def test_classes_match_brute_force(docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    for frame in (docs, clashing):
        out = ngram_join.query(frame).collect()
        assert len(out) == len(rows)
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out if r["doc_id"] is not None} == want
    assert want[101][0] == 100 and want[102] == (100, 1)


def test_a_large_group_of_near_copies_is_linked_in_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 8)
    base = prose(150, 4).split()
    rows = [(i, " ".join(base[: i % 140] + [f"changed{i}"] + base[i % 140 + 1 :])) for i in range(90)] + [(1000, prose(150, 8))]
    out = ngram_join.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == brute(rows)
    assert all(r["class_id"] == 0 for r in out if r["doc_id"] < 1000)


def test_one_of_each_class_stays(docs, empty, clashing):
    kept = sorted((r["doc_id"] for r in ngram_join.keep_one(clashing).collect()), key=str)
    assert ngram_join.keep_one(clashing).columns == clashing.columns
    want = {c for c, _ in brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    assert {k for k in kept if k is not None} == want
    assert Counter(kept)[301] == 1 and None in kept
    assert ngram_join.keep_one(empty).count() == 0
    assert ngram_join.query(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert bands * rows <= ngram_join.MOST_HASHES


def test_minhash_estimates_similarity(prose):
    a = prose(400, 1).split()
    b = a[:380] + [f"z{i}" for i in range(20)]
    grams, start = ngram_join.ngrams(pa.array([" ".join(a), " ".join(b), None, "", "one two"]))
    assert list(np.diff(start)) == [396, 396, 0, 0, 1]
    mins = ngram_join.minhashes(grams, start, 192)
    x, y = set(grams[start[0] : start[1]].tolist()), set(grams[start[1] : start[2]].tolist())
    assert abs((mins[0] == mins[1]).mean() - len(x & y) / len(x | y)) < 0.12


def test_chains_are_compared_along_their_links_only(spark, monkeypatch):
    """Texts that slide over one long text: neighbours share buckets, far ones only a chain of others."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 4)
    long = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(long[10 * i : 10 * i + 120])) for i in range(380)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.query(frame).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == brute(rows)
    bands, per = ngram_join.banding()
    signed = ngram_join.signatures(frame, "doc_id", "text", bands, per, 5)
    placed, pairs, _ = ngram_join.blocks(signed.withColumnRenamed("doc", "rep"))
    n = placed.select("block").distinct().count()
    assert pairs.count() < n * 12 < n * (n - 1) / 2


def test_two_texts_under_one_key_are_both_compared(spark, prose):
    base, other = prose(200, 31), prose(200, 32)
    near = lambda t: t.replace(t.split()[100], "changed", 1)
    rows = [(1, base), (1, other), (2, near(base)), (3, near(other)), (3, near(other))]
    out = ngram_join.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_links"] == 1 for r in out) and len(out) == 5
    assert sorted((r["doc_id"], r["class_id"]) for r in out) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]


def test_long_words_don_t_collide():
    def thue_morse(n, x):
        return "".join(x[bin(i).count("1") & 1] for i in range(n))

    texts = [thue_morse(n, x) for n in (8, 64, 1024, 4096) for x in ("ab", "ba")] + ["ab" * k for k in range(1, 60)]
    grams, start = ngram_join.ngrams(pa.array(texts + texts))
    assert len(set(grams.tolist())) == len(texts) and (np.diff(start) == 1).all()
    assert (grams[: len(texts)] == grams[len(texts) :]).all()
