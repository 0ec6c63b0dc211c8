import re

from tidewatch.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_counts_match_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.query(docs).collect():
        want = brute(texts[r["doc_id"]])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got[:4] == want[:4]
        if want[4] is not None:
            assert got[4] == want[4]
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_long_text_of_repeats_takes_the_sorting_path(spark):
    text = " ".join(f"w{i % 500}" for i in range(5000))
    (r,) = quality.query(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (5000, 5000, True)


def test_edges(docs, empty, clashing):
    assert quality.query(empty).count() == 0
    kept = quality.keep(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in quality.keep(docs).collect())
    assert {200, 201, 202, 203, 300}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert {5, 20, 100, 400} <= {r["doc_id"] for r in kept.collect()}


def test_no_user_functions_in_the_plan(docs):
    plan = quality.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
