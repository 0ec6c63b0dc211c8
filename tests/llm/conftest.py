import random

import pytest

WORDS = "the of and to in that is was river stone light cold table window garden paper simple quiet letter morning story market engine bridge forest yellow".split()


@pytest.fixture(scope="session")
def prose():
    """A function (n words, seed) -> a text of ordinary words in lines."""

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        words = [rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.4 else "") for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))

    return make


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Small documents with every awkward case: nulls, empty and long texts, copies, near copies, repeated rows, null keys."""
    rows = [(i, prose(60 + 7 * i, i), "en", f"s{i % 4}", 10 * i) for i in range(40)]
    base = prose(300, 999)
    near = base.split(" ")
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s1", 1), (102, " ".join(["other", *near[1:]]), "en", "s2", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, "  \n\t ", "en", "s0", 0), (203, "two words", "de", "s3", 9)]
    rows += [(300, "same same same " * 40, "en", "s1", 5), (301, prose(70, 5), "en", "s1", 5), (301, prose(70, 5), "en", "s1", 5), (None, prose(80, 6), "en", "s2", 5)]
    rows += [(400, prose(60_000, 77), "en", "s0", 5), (401, "x" * 300_000, "en", "s0", 5), (402, "Ünïcödé ça été naïve Łódź Жук 中文 😀 é J̌ İ Σς. A,b. " * 20, "fr", "s1", 3)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("stats", "quality", "__key", "__text", "rep", "body", "node", "shard", "slot", "size", "keys", "logs_", "verdict_", "host_", "prior_", "__row", "taken", "target", "copy_", "key_", "body_")
    return docs.select("*", *[F.lit("mine").alias(n) for n in names])
