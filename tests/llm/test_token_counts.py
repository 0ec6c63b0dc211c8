from collections import defaultdict

import public_tokenizers as public
import tiktoken
from tidewatch.llm import bpe, token_counts
from tidewatch.llm._shared import scratch_path

VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def brute(docs):
    encoders = {v: tiktoken.Encoding(v, pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path(f"{v}.tiktoken")), special_tokens={}) for v in VERSIONS}
    rows, least, out = docs.collect(), {}, defaultdict(lambda: [0, 0])
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(least.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    for r in rows:
        t = r["text"] or ""
        if r["doc_id"] is not None and r["doc_id"] > least[t]:
            continue
        v = VERSIONS[r["lang"] != "en"]
        out[(r["source"], r["lang"], v)][0] += 1
        out[(r["source"], r["lang"], v)][1] += len(encoders[v].encode_ordinary(t))
    return {k: tuple(v) for k, v in out.items()}


def test_totals_match_a_recount(docs, empty, clashing):
    want = brute(docs)
    for frame in (docs, clashing):
        assert {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in token_counts.query(frame).collect()} == want
    assert token_counts.query(empty).count() == 0


def test_batches_commit_once(spark):
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    change = spark.createDataFrame([("s", "en", "v", 2, 30), (None, None, "v", 1, 4)], token_counts.SCHEMA)
    back = spark.createDataFrame([("s", "en", "v", -2, -30)], token_counts.SCHEMA)
    state = lambda: {(r["source"], r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert rollup.commit("one", change) and state() == {("s", 2, 30), (None, 1, 4)}
    assert not rollup.commit("one", change) and state() == {("s", 2, 30), (None, 1, 4)}
    rollup.fold()
    assert state() == {("s", 2, 30), (None, 1, 4)}
    assert rollup.commit("two", back) and state() == {(None, 1, 4)}
    assert not rollup.commit("two", back)
    rollup.fold()
    assert state() == {(None, 1, 4)}


def state(rollup):
    return {(r["source"], r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def rows(spark, docs, tokens, source="s"):
    return spark.createDataFrame([(source, "en", "v", docs, tokens)], token_counts.SCHEMA)


def test_any_batch_name_counts_once(spark):
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup-names"))
    names = ["2024|01", "2024/01", "a b", "", ".", "..", "é" * 400, "2024", "01"]
    for name in names:
        assert rollup.commit(name, rows(spark, 1, 10))
    assert state(rollup) == {("s", len(names), 10 * len(names))}
    rollup.fold()
    assert state(rollup) == {("s", len(names), 10 * len(names))}
    assert not any(rollup.commit(name, rows(spark, 1, 10)) for name in names)
    assert state(rollup) == {("s", len(names), 10 * len(names))}


def test_commit_during_a_fold(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup-race"))
    rollup.commit("one", rows(spark, 1, 30))
    real = rollup._sum

    def slow(*args):
        rollup.commit("two", rows(spark, 1, 30))  # another writer, after the fold has read the batches
        return real(*args)

    monkeypatch.setattr(rollup, "_sum", slow)
    rollup.fold()
    monkeypatch.undo()
    assert state(rollup) == {("s", 2, 60)}
    rollup.fold()
    assert state(rollup) == {("s", 2, 60)}


def test_two_writers_of_one_batch(spark, monkeypatch):
    path = scratch_path(spark, "rollup-writers")
    one, two = token_counts.Rollup(spark, path), token_counts.Rollup(spark, path)
    seen = [{}]  # the second writer looks before the first has committed
    real = two._committed
    monkeypatch.setattr(two, "_committed", lambda: seen.pop() if seen else real())
    first = one.commit("batch", rows(spark, 1, 30))
    assert first
    two.commit("batch", rows(spark, 1, 30))
    assert len(one._names("commits")) == 2 and state(one) == {("s", 1, 30)}
    one.fold()
    assert state(one) == {("s", 1, 30)} and not one.commit("batch", rows(spark, 1, 30))


def test_lost_writers_leave_nothing_behind(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup-lost"))
    rollup.commit("one", rows(spark, 1, 30))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(rollup, "_mark", lost)
    for act in (lambda: rollup.commit("two", rows(spark, 1, 5)), rollup.fold):
        try:
            act()
        except RuntimeError:
            pass
    monkeypatch.undo()
    assert state(rollup) == {("s", 1, 30)}  # neither the batch nor the snapshot counts
    assert rollup.commit("two", rows(spark, 1, 5))
    rollup.fold()
    assert state(rollup) == {("s", 2, 35)}


def test_thousands_of_batches(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rollup = token_counts.Rollup(spark, f"file://{tmp_path}")
    (tmp_path / "commits").mkdir()
    table = pa.table({"source": ["s"], "lang": ["en"], "version": ["v"], "docs": pa.array([1], pa.int64()), "tokens": pa.array([7], pa.int64())})
    for i in range(3_000):
        (tmp_path / "data" / f"d{i}").mkdir(parents=True)
        pq.write_table(table, tmp_path / "data" / f"d{i}" / "part-0.parquet")
        (tmp_path / "commits" / f"{rollup._key(f'b{i}')}.d{i}").touch()
    rollup.fold()
    assert state(rollup) == {("s", 3_000, 21_000)}
    assert not rollup.commit("b77", rows(spark, 1, 7)) and rollup.commit("new", rows(spark, 1, 7))
    assert state(rollup) == {("s", 3_001, 21_007)}


def test_second_version_is_counted_only_where_it_is_needed(docs):
    from pyspark.sql import functions as F

    versions = {v: public.path(f"{v}.tiktoken") for v in VERSIONS}
    some = token_counts.count_tokens(docs.where("doc_id < 10 or lang = 'fr'"), versions, public.PATTERN, {VERSIONS[1]: F.col("lang") == "fr"}).collect()
    assert all((r["counts"][1] is None) == (r["lang"] != "fr") and r["counts"][0] is not None for r in some)
