import math
import random

import pyarrow as pa
from pyspark.sql import functions as F
from tidewatch.llm import language

SYLLABLES = {"en": ("th", "ing", "er", "wh", "sh", "and"), "de": ("sch", "ung", "ein", "ich", "ver", "zu"), "fr": ("eau", "oui", "ç", "é", "que", "aux")}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_short_texts(spark):
    rows = [(i, text(lang, 60, i), lang, f"s{i % 3}", 0) for i in range(100) for lang in SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    fresh = [(1000 + i, text(lang, 12, 1000 + i), "h.example.org", lang) for i in range(60) for lang in SYLLABLES]
    out = language.identify(spark.createDataFrame(fresh, "doc_id long, body string, host string, truth string"), model, "body", "host").collect()
    assert sum(r["verdict"]["language"] == r["truth"] for r in out) / len(out) > 0.97


def test_evidence_decides_where_the_text_cannot(spark):
    rows = [(i, text(lang, 60, i), lang) for i in range(60) for lang in SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    many = [(i, text("de", 40, i), "a.b.de", None, None) for i in range(50)]
    pages = many + [(100, "123 456", "a.b.de", None, None), (101, "123 456", "x.y.org", "fr", None), (102, "123 456", "x.y.org", None, "en"), (103, None, "a.b.de", "de", "de"), (104, "123 456", "c.b.de", None, None)]
    out = language.identify(spark.createDataFrame(pages, "doc_id long, body string, host string, declared string, suffix string"), model, "body", "host", "declared", "suffix")
    got = {r["doc_id"]: r["verdict"] for r in out.collect()}
    assert got[100]["language"] == "de" and got[101]["language"] == "fr" and got[102]["language"] == "en"
    assert got[104]["language"] == "de"  # its domain speaks for an unseen host
    assert got[103]["language"] is None and not got[103]["kept"]


def test_keep(docs, empty, clashing):
    kept = language.keep(clashing)
    assert kept.columns == clashing.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 10, 100, 400} <= ids and {200, 201}.isdisjoint(ids)
    assert ids == {r["doc_id"] for r in language.keep(docs).collect()}
    assert language.keep(empty).count() == 0


def test_rare_labels_have_models(spark):
    rows = [(i, text("en", 20, i), "en") for i in range(6000)] + [(10_000 + i, text("fr", 20, i), "fr") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(df, rows=20).languages == ("en", "fr")


def test_languages_without_a_model_are_rejected(spark):
    rows = [(i, text(lang, 60, i), lang) for i in range(60) for lang in SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pages = [(i, text("en", 40, i), "h.org", "en") for i in range(50)] + [(100, "Жуки живут в тёмном лесу у реки " * 3, "h.org", "en")]
    out = language.identify(spark.createDataFrame(pages, "doc_id long, body string, host string, declared string"), model, "body", "host", "declared")
    got = {r["doc_id"]: r["verdict"] for r in out.collect()}
    assert got[100]["language"] is None and not got[100]["kept"] and all(got[i]["kept"] for i in range(50))


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_posteriors_equal_a_brute_force_fusion(spark):
    rows = [(i, text(lang, 60, i), lang) for i in range(60) for lang in SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names = model.languages
    rng = random.Random(4)
    hosts = ["a.b.de", "c.b.de", "x.org", "y.x.org", "solo", None]
    pages = [(i, text(rng.choice(names), rng.randint(1, 6), i) if i % 11 else rng.choice(["", None, "ab"]), rng.choice(hosts), rng.choice([None, None, "fr", "xx"]), rng.choice([None, None, "en"])) for i in range(150)]
    schema = "doc_id long, body string, host string, declared string, suffix string"
    got = {r["doc_id"]: r["verdict"] for r in language.identify(spark.createDataFrame(pages, schema), model, "body", "host", "declared", "suffix").collect()}
    logs = language.likelihoods(pa.array([p[1] for p in pages]), model).tolist()
    n, own = len(names), [softmax(x) for x in logs]
    domain = lambda h: ".".join(h.split(".")[-2:])
    counted = [(p[2], q) for p, q in zip(pages, own, strict=True) if p[2] is not None]
    total = lambda some: [sum(q[i] for q in some) for i in range(n)]
    everything = total([q for _, q in counted])
    for p, x, mine in zip(pages, logs, own, strict=True):
        evidence = list(x)
        if p[2] is not None:
            near, wide = [q for h, q in counted if h == p[2]], [q for h, q in counted if domain(h) == domain(p[2])]
            for i in range(n):
                top = (everything[i] + 1) / (len(counted) + n)
                middle = (total(wide)[i] + language.SHRINK * top) / (len(wide) + language.SHRINK)
                evidence[i] += math.log((total(near)[i] - mine[i] + language.SHRINK * middle + 1e-6) / (len(near) - 1 + language.SHRINK))
        for said, right in ((p[3], language.DECLARED), (p[4], language.SUFFIX)):
            if said in names:
                for i, name in enumerate(names):
                    evidence[i] += math.log(right if name == said else (1 - right) / (n - 1))
        want = softmax(evidence)
        assert max(abs(a - b) for a, b in zip(got[p[0]]["all"], want, strict=True)) < 1e-9
        assert abs(got[p[0]]["posterior"] - max(want)) < 1e-6
        readable = any(x)
        assert got[p[0]]["kept"] == (readable and max(want) >= language.LEAST_POSTERIOR)
        assert got[p[0]]["language"] == (names[want.index(max(want))] if readable else None)


def test_a_label_is_no_evidence_for_its_own_row(spark):
    rows = [(i, text(lang, 60, i), lang, f"s{i % 3}", 0) for i in range(80) for lang in SYLLABLES]
    rows += [(10_000 + i, text("en", 60, 5000 + i), "de", "s1", 0) for i in range(5)] + [(20_000, text("fr", 60, 9), None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in language.keep(docs).collect()}
    assert kept == {r[0] for r in rows if r[0] < 10_000 or r[0] == 20_000}  # texts that contradict their labels go
    assert {r["lang"] for r in language.keep(docs, wanted=("en",)).where("lang IS NOT NULL").collect()} == {"en"}


def test_documents_and_pages(spark, clashing, empty):
    pages = spark.createDataFrame(
        [
            (1, "http://a.de/x", "<html lang='fr'><script>the and of</script><p>123 456</p></html>"),
            (2, None, None),
            (3, "http://a.de/y", "<script " * 3000),
            (4, "http://a.de/z", None),
            (4, "http://a.de/z", None),
        ],
        "page_id long, url string, html string",
    )
    out = language.query(spark, clashing, pages).collect()
    assert sum(r["kind"] == "page" for r in out) == 5 and sum(r["kind"] == "document" for r in out) == clashing.count()
    got = {r["page_id"]: r for r in out if r["kind"] == "page"}
    assert got[1]["declared"] == "fr" and got[2]["language"] is None and got[3]["language"] is None
    assert language.query(spark, empty, pages.where("false")).count() == 0
    assert language.query(spark, empty, pages).where("kept").count() == 0  # no labels, no models


def test_markup(spark):
    rows = [
        ("<p>a<!-- b -->c</p><style>d</style><script src=x>e</script>f", "a c f"),
        ("a<script>b", "a"),
        ("a<!-- b", "a"),
        ("a <b", "a"),
        ("x < y", "x"),
    ]
    frame = spark.createDataFrame(rows, "html string, want string").select("want", language.visible_text(F.col("html")).alias("got"))
    for r in frame.collect():
        assert " ".join(r["got"].split()) == r["want"]
    tags = [("<HTML class=x LANG=\"De-AT\">", "de"), ("<html xml:lang='en'>", None), ("<html>", None), ("<p lang=fr>", None), ("<html lang=es>", "es")]
    frame = spark.createDataFrame(tags, "html string, want string").select("want", language.declared_language(F.col("html")).alias("got"))
    assert all(r["got"] == r["want"] for r in frame.collect())
    hosts = [("a.co.uk", "en"), ("X.DE", "de"), ("a.org", None), (None, None)]
    frame = spark.createDataFrame(hosts, "h string, want string").select("want", language.suffix_language(F.col("h")).alias("got"))
    assert all(r["got"] == r["want"] for r in frame.collect())


def test_clashing_names_stay(spark):
    rows = [(i, text(lang, 60, i), lang) for i in range(60) for lang in SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pages = spark.createDataFrame([(1, text("en", 40, 1), "h.org", "mine", "mine", "mine", "mine")], "doc_id long, body string, host string, logs string, verdict string, host_ string, prior_ string")
    (r,) = language.identify(pages, model, "body", "host").collect()
    assert r["logs"] == r["verdict"] == r["host_"] == r["prior_"] == "mine" and r["verdict_"]["language"] == "en"


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = language.fit_folds(docs)
    rows = docs.select("lang", "text", language.fold_of(F.col("doc_id")).alias("fold"), F.lit("h").alias("host"))
    out = language.identify(rows, models, "text", "host", fold="fold").collect()
    right = sum(r["verdict"]["language"] == r["lang"] for r in out)
    assert right / len(out) > 0.97
