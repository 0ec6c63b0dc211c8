import numpy as np
from tidewatch.llm import ann


def truth(ids, x, q, k):
    scores = x @ x[q]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return [int(ids[i]) for i in order]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.round(centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16)), 4)
    x[100:200] = x[100]  # a group of equal vectors
    ids = rng.permutation(8000)[:4000]
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out = {}
    for r in ann.query(df).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    at = {int(i): k for k, i in enumerate(ids)}
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        found = sorted(out[int(q)])
        assert [f[0] for f in found] == list(range(1, 21))
        assert int(q) not in [f[1] for f in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - x[at[v]] @ x[at[int(q)]]) < 1e-9 for _, v, s in found)
        want = truth(ids, x, at[int(q)], 20)
        hits += len(set(want) & {f[1] for f in found})
        total += 20
    assert hits / total >= 0.9


def test_tasks_that_hand_over_their_candidates_often_agree(spark, monkeypatch):
    x = np.round(3 * np.random.default_rng(3).normal(size=(3000, 6)))  # many ties and copies, all products exact
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    want = sorted(tuple(r) for r in ann.search(df, asked, 7).collect())
    monkeypatch.setattr(ann, "HELD", 50)
    assert sorted(tuple(r) for r in ann.search(df, asked, 7).collect()) == want
    names = [(q, v) for q, _, v, _ in want]
    assert len(set(names)) == len(names) == 7 * 150
    if len(ann.build(x, len(x), 99.0).centroids) <= ann.LEAST_PROBES:  # all lists are read
        for q in range(0, 3000, 20):
            assert [v for a, _, v, _ in want if a == q] == truth(np.arange(3000), x, q, 7)


def test_best_of_each_query():
    rng = np.random.default_rng(4)
    q, ids = rng.integers(0, 9, 500), rng.integers(0, 40, 500)
    scores = np.round(rng.normal(size=500), 1)
    got = list(zip(*[a.tolist() for a in ann._best(q, ids, scores, 5)], strict=True))
    for one in range(9):
        top = {}
        for a, i, s in zip(q, ids, scores, strict=True):
            if a == one:
                top[i] = max(top.get(i, -9), s)
        assert [(i, s) for a, i, s in got if a == one] == sorted(top.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_an_id_with_two_vectors_is_one_query_and_one_candidate(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.5]), (2, [0.5, 1.0])]
    got = ann.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(0, 1), (0, 2)] and {r["vec_id"] for r in got} == {1, 2}


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, name string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.query(df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.query(df.where("false")).count() == 0


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    index = ann.build(x, 60_000, float(np.sqrt((x * x).sum(1).max())))
    q = index.lifted(x[:200])
    lists, dist = index.nearest(q, 10)
    exact = np.argsort(((index.centroids[None] - q[:, None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(lists, exact, strict=True)]) >= 9
    assert (np.diff(dist, axis=1) >= 0).all()


def unit(n, seed=9, width=64):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def test_recall_holds_with_many_lists():
    x = unit(40_000)
    index = ann.build(x[:20_000], len(x), 1.0)
    assert len(index.centroids) > 300
    asked = np.arange(100)
    scores = x[asked] @ x.T
    scores[asked, asked] = -2
    near = np.argsort(-scores, 1)[:, :20]
    homes = index.replicas(index.lifted(x[near.ravel()]))
    reads = index.probes(np.concatenate([x[asked], np.zeros((100, 1))], 1).astype(np.float32))
    hits = [bool(set(home) & set(reads[i // 20])) for i, home in enumerate(homes)]
    assert np.mean(hits) >= 0.9


def test_replicas_and_pruning_act_on_spread_vectors():
    x = unit(20_000)
    index = ann.build(x, len(x), 1.0)
    copies = [len(lists) for lists in index.replicas(index.lifted(x[:2000]))]
    assert 1.1 < np.mean(copies) < ann.MOST_REPLICAS and min(copies) == 1
    reads = [len(lists) for lists in index.probes(np.concatenate([x[:200], np.zeros((200, 1))], 1).astype(np.float32))]
    assert np.isfinite(index.prune) and ann.LEAST_PROBES <= min(reads) and max(reads) < len(index.centroids)
