"""Language identification by Bayesian evidence fusion.

The log posterior of a language adds four pieces of evidence: the text's
likelihood under hashed byte-trigram models, tempered to a bounded number of
effective trigrams; the language that markup or metadata declares; the language
that the address suffix suggests; and a host prior. Priors are smoothed along
host, registered domain and all hosts: each level's counts of text-only
posteriors, grouped sums, are shrunk towards the level above, without the row's
own part.

A labelled row is never judged by a model that its own text and label went
into: models are fitted on two halves of the sample, and each half is judged by
the other's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm._shared import fresh, let, materialise, remove, ship
from tidewatch.llm.bpe import slices

#: Labelled rows that the models are fitted on, chosen by a hash of their keys: so many of all, and so many of each label at least if it has them.
SAMPLE_ROWS, LABEL_ROWS = 2000, 100
BUCKETS = 1 << 16
#: Trigrams that each language's counts are scaled to.
TOTAL = 1_000_000.0
#: Trigrams that a text counts for at most, and the share of each: neighbouring trigrams repeat one another.
EFFECTIVE, TEMPER = 400, 0.25
#: How often a declaration and a suffix name the true language.
DECLARED, SUFFIX = 0.90, 0.80
#: Rows that a prior level is worth to the level below it.
SHRINK = 10.0
LEAST_POSTERIOR = 0.5
#: Posterior of another language from which a text contradicts its label.
CONTRADICTION = 0.9
#: Odds against a text in a language without a model; its trigrams are letters at random, or anything, in equal shares.
UNKNOWN_ODDS = 1000.0
#: Country suffixes of addresses and the languages that they suggest.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}
#: Hosts up to which their table is broadcast; beyond, the join is by shuffle.
BROADCAST_HOSTS = 50_000


@dataclass(frozen=True)
class Model:
    """``table[l, trigram]``: log probabilities by language; ``unknown[trigram]``: those of a language without a model."""

    languages: tuple[str, ...]
    table: np.ndarray
    unknown: np.ndarray


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes over all texts, first, end): a text's trigrams are codes[first:end]; none for null or under three bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    b = _LOWER[data].astype(np.uint32)
    if len(b) < 3:
        codes = np.zeros(0, np.uint32)
    else:
        codes = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> 16
    first = offsets[:-1] - offsets[0]
    return codes, first, np.maximum(first, offsets[1:] - offsets[0] - 2)


def _sample(labelled: DataFrame, text: str, label: str, key: str, rows: int) -> pd.DataFrame:
    """(label, text, fold): the ``rows`` labelled rows of the smallest key hashes and LABEL_ROWS of each label."""
    usable = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    named = usable.select(F.col(key).alias("k"), F.col(label).alias("l"), F.xxhash64(key).alias("h"))
    own = Window.partitionBy("l").orderBy("h", "k")  # Spark keeps the first LABEL_ROWS of each task before the shuffle
    floor = named.withColumn("r", F.row_number().over(own)).where(F.col("r") <= LABEL_ROWS).select("k", "l")
    chosen = named.orderBy("h", "k").limit(rows).select("k", "l").unionByName(floor).distinct()
    found = usable.join(F.broadcast(chosen), (F.col(key) == F.col("k")) & (F.col(label) == F.col("l")), "left_semi")
    return found.select(F.col(label).alias("label"), F.col(text).alias("text"), fold_of(F.col(key)).alias("fold")).toPandas()


def fold_of(key: Column) -> Column:
    """The half, 0 or 1, that a row belongs to."""
    return F.coalesce(F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(2)).cast("int"), F.lit(0))


def _model(sample: pd.DataFrame, languages: tuple[str, ...]) -> Model:
    table = np.zeros((len(languages), BUCKETS), np.float32)
    letters = np.zeros(256)
    for i, language in enumerate(languages):
        texts = sample["text"][sample["label"] == language].tolist()
        codes, first, end = trigrams(pa.array(texts, pa.large_string()))
        counts = sum((np.bincount(codes[a:z], minlength=BUCKETS) for a, z in zip(first, end, strict=True)), np.zeros(BUCKETS))
        # brought to one total, so that a trigram that no language has speaks for none of them
        scaled = counts * (TOTAL / max(counts.sum(), 1.0)) + 0.5
        table[i] = np.log(scaled / (TOTAL + 0.5 * BUCKETS))
        own_letters = np.bincount(_LOWER[np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)], minlength=256)
        letters += own_letters / max(own_letters.sum(), 1)
    return Model(languages, table, _at_random(letters / max(letters.sum(), 1e-12)))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Trigram models of the labelled languages, for texts that aren't among the labelled rows."""
    return fit_folds(labelled, text, label, key, rows)[2]


def fit_folds(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> tuple[Model, Model, Model]:
    """Models for the rows of fold 0 and of fold 1, each fitted on the other fold, and one for other texts, fitted on both.

    All have the same languages; one that the other fold doesn't have is fitted on all its rows.
    """
    sample = _sample(labelled, text, label, key, rows)
    languages = tuple(sorted(sample["label"].unique()))
    folds = []
    for fold in (0, 1):
        other = sample["fold"] != fold
        lost = ~sample["label"].isin(sample["label"][other].unique())
        folds.append(_model(sample[other | lost], languages))
    return (*folds, _model(sample, languages))


def _at_random(letters: np.ndarray) -> np.ndarray:
    """Log probabilities of trigrams whose bytes are drawn one by one, mixed in equal shares with any trigram."""
    used = np.flatnonzero(letters).astype(np.uint32)
    share = letters[used]
    total = np.zeros(BUCKETS)
    for a, p in zip(used, share, strict=True):
        codes = (((a << np.uint32(16)) | (used[:, None] << np.uint32(8)) | used[None, :]) * np.uint32(2654435761)) >> np.uint32(16)
        total += p * np.bincount(codes.ravel(), (share[:, None] * share[None, :]).ravel(), BUCKETS)
    return np.log(0.5 * total + 0.5 / BUCKETS).astype(np.float32)


def likelihoods(column: pa.Array, model: Model) -> np.ndarray:
    """Tempered log likelihoods, one row per text; zeros where there is nothing to read or the language has no model."""
    codes, first, end = trigrams(column)
    n = (end - first).astype(np.float64)
    scale = TEMPER * np.minimum(n, EFFECTIVE) / np.maximum(n, 1)
    out = np.zeros((len(first), len(model.languages)))
    for i in range(len(model.languages)):
        sums = np.concatenate([[0.0], np.cumsum(model.table[i][codes], dtype=np.float64)])
        out[:, i] = (sums[np.minimum(end, len(codes))] - sums[np.minimum(first, len(codes))]) * scale
    if len(model.languages):
        sums = np.concatenate([[0.0], np.cumsum(model.unknown[codes], dtype=np.float64)])
        unknown = (sums[np.minimum(end, len(codes))] - sums[np.minimum(first, len(codes))]) * scale
        out[unknown > out.max(1) + np.log(UNKNOWN_ODDS)] = 0.0
    return out


def _floats(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def scored(df: DataFrame, models: tuple[Model, ...], text: str, out: str, fold: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with the array ``out`` of tempered log likelihoods, the text dropped unless ``keep_text``.

    The column ``fold``, which is dropped, names the model of each row; without it there is one model.
    """
    ship(df.sparkSession)
    names = [c for c in df.columns if c != fold and (keep_text or c != text)]

    def values(part: pa.RecordBatch) -> np.ndarray:
        texts = part.column(text)
        if fold is None:
            return likelihoods(texts, models[0])
        own = part.column(fold).to_numpy()
        result = np.zeros((len(own), len(models[0].languages)))
        for i in np.unique(own).tolist():
            at = np.flatnonzero(own == i)
            result[at] = likelihoods(texts.take(pa.array(at)), models[i])
        return result

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], _floats(values(part))], [*names, out])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names], f"`{out}` array<double>"])
    return df.mapInArrow(run, fields)


def _softmax(logs: Column) -> Column:
    powers = let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(p, lambda x: x / total)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _vote(value: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log likelihoods of a named language: ``right`` for it, the rest shared; nothing if it is null or unknown."""
    n = len(languages)
    flat = F.array(*[F.lit(0.0)] * n)
    if n < 2:
        return flat
    hit, miss = float(np.log(right)), float(np.log((1 - right) / (n - 1)))
    return F.when(value.isin(*languages), F.array(*[F.when(value == x, hit).otherwise(miss) for x in languages])).otherwise(flat)


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a host of one label is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_language(host: Column) -> Column:
    suffix = F.lower(F.substring_index(host, ".", -1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), suffix)


def host_priors(rows: DataFrame, host: str, logs: str, n: int) -> DataFrame:
    """(host_, n_host, c_host, prior): text-only posteriors summed by host, and the smoothed domain prior above it.

    ``rows`` has a host and text likelihoods. Sums are combined before the
    shuffle, so a host with a third of all rows is one small row per task.
    """
    rows = rows.where(F.col(host).isNotNull()).select(F.col(host).alias("host_"), _softmax(F.col(logs)).alias("p"))
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(n)]
    hosts = rows.groupBy("host_").agg(F.count("*").alias("n_host"), *sums)
    add = [F.sum(f"c{i}").alias(f"d{i}") for i in range(n)]
    domains = hosts.groupBy(domain_of(F.col("host_")).alias("domain_")).agg(F.sum("n_host").alias("n_domain"), *add)
    whole = domains.agg(F.sum("n_domain").alias("n_all"), *[F.sum(f"d{i}").alias(f"a{i}") for i in range(n)])
    level = domains.crossJoin(F.broadcast(whole))  # the right side is one row of sums
    prior = F.array(*[(F.col(f"d{i}") + SHRINK * (F.col(f"a{i}") + 1.0) / (F.col("n_all") + n)) / (F.col("n_domain") + SHRINK) for i in range(n)])
    domains = level.select("domain_", prior.alias("prior"))
    joined = hosts.join(domains, domain_of(F.col("host_")) == F.col("domain_"))
    return joined.select("host_", "n_host", F.array(*[F.col(f"c{i}") for i in range(n)]).alias("c_host"), "prior")


def fused(rows: DataFrame, priors: DataFrame, languages: tuple[str, ...], host: str, declared: str | None, suffix: str | None, logs: str, out: str) -> DataFrame:
    """``rows`` with the struct ``out``: language, posterior, all (posteriors of all languages), kept. ``priors`` is a table, not a plan to run."""
    n = len(languages)
    if not n:
        return rows.withColumn(out, F.struct(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.array().cast("array<double>").alias("all"), F.lit(False).alias("kept")))
    at, prior = fresh(rows, "host_", "prior_")
    right = priors.select(F.col("host_").alias(at), F.struct("n_host", "c_host", "prior").alias(prior))
    joined = rows.join(right if priors.count() > BROADCAST_HOSTS else F.broadcast(right), F.col(host) == F.col(at), "left")
    known = F.col(prior)

    def log_prior(own: Column) -> Column:
        rest = lambda i: F.get(known["c_host"], i) - F.get(own, i) + SHRINK * F.get(known["prior"], i) + 1e-6
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.log(rest(i) / (known["n_host"] - 1 + SHRINK)))

    shrunk = F.when(known.isNotNull(), let(_softmax(F.col(logs)), log_prior))
    flat = F.array(*[F.lit(0.0)] * n)
    evidence = [F.col(logs), F.coalesce(shrunk, flat)]
    if declared:
        evidence.append(_vote(F.col(declared), languages, DECLARED))
    if suffix:
        evidence.append(_vote(F.col(suffix), languages, SUFFIX))
    names = F.array(*[F.lit(x) for x in languages])
    read = F.exists(logs, lambda x: x != 0)

    def judged(posterior: Column) -> Column:
        language = lambda best: F.element_at(names, F.array_position(posterior, best).cast("int"))
        return let(F.array_max(posterior), lambda best: F.struct(F.when(read, language(best)).alias("language"), F.round(best, 6).alias("posterior"), posterior.alias("all"), (read & (best >= LEAST_POSTERIOR)).alias("kept")))

    return joined.withColumn(out, let(_softmax(reduce(_plus, evidence)), judged)).drop(at, prior)


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags; one that isn't closed reaches to the end, so each character is read once."""
    return F.regexp_replace(html, r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)", " ")


def declared_language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.nullif(found, F.lit(""))


def identify(rows: DataFrame, models: Model | tuple[Model, ...], text: str, host: str, declared: str | None = None, suffix: str | None = None, fold: str | None = None) -> DataFrame:
    """``rows`` without the text and ``fold``, with ``verdict`` (language, posterior, all, kept).

    Null or unreadable texts (under three bytes) and texts in a language without
    a model get no language and aren't kept; null hosts, declarations and
    suffixes add no evidence; repeated rows are judged alike; an empty table
    gives an empty result. If ``rows`` has a ``verdict``, the new one gets an
    underscore. ``fold`` names the model of each row.
    """
    models = models if isinstance(models, tuple) else (models,)
    logs, verdict = fresh(rows, "logs", "verdict")
    languages = models[0].languages
    done, _ = materialise(scored(rows, models, text, logs, fold, keep_text=False), "language")
    priors, _ = materialise(host_priors(done, host, logs, max(1, len(languages))), "priors")
    return fused(done, priors, languages, host, declared, suffix, logs, verdict).drop(logs)


def contradicts(verdict: Column, label: Column, languages: tuple[str, ...]) -> Column:
    """Whether the text speaks for another language than its label; labels that are null or have no model can't be contradicted."""
    return F.coalesce(label.isin(*languages) & (verdict["language"] != label) & (verdict["posterior"] >= CONTRADICTION), F.lit(False))


def keep(docs: DataFrame, wanted: tuple[str, ...] | None = None, text: str = "text", label: str = "lang", host: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents whose text is in a ``wanted`` language (any that has a model, if None) and doesn't contradict its label, with the columns of ``docs``.

    Labels are what models learn from, so they are no evidence here: a text is
    judged by the other fold's model and its source's prior alone. Texts that
    are null, unreadable or in no language with a model go. A null label has
    nothing to contradict; a null key is in fold 0; a null source has no prior;
    repeated rows stay or go together. Without any label nothing is known and
    all rows stay; an empty table stays empty. Texts are read twice, once for
    the priors of their sources and once to be judged, which needs no shuffle
    of texts.
    """
    models = fit_folds(docs, text, label, key)
    languages = models[0].languages
    if not languages:
        return docs
    logs, verdict, shadow, fold = fresh(docs, "logs_", "verdict_", "host_key_", "fold_")
    own = fold_of(F.col(key))
    counted, counted_path = materialise(scored(docs.select(F.col(host).alias("host"), F.col(text).alias("body"), own.alias("fold")), models, "body", "logs", "fold", keep_text=False), "language")
    priors, _ = materialise(host_priors(counted, "host", "logs", len(languages)), "priors")
    remove(docs.sparkSession, counted_path)
    again = scored(docs.withColumn(fold, own), models, text, logs, fold).withColumn(shadow, F.col(host))
    judged = fused(again, priors, languages, shadow, None, None, logs, verdict)
    good = F.col(verdict)["kept"] & ~contradicts(F.col(verdict), F.col(label), languages)
    if wanted is not None:
        good = good & F.col(verdict)["language"].isin(*wanted)
    return judged.where(good).select(*docs.columns)


def query(spark: SparkSession, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document (its source as the host, its label only to compare) and every page (markup, address suffix, host).

    Null texts, markup, addresses and labels add no evidence; ``label`` is the
    document's own, ``contradicted`` whether its text speaks against it.
    """
    from tidewatch.llm.url_filter import host_of

    models = fit_folds(docs)
    none = F.lit(None).cast("string")
    rows = docs.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), F.col("text").alias("body"), F.col("source").alias("host"), none.alias("declared"), none.alias("suffix"), F.col("lang").alias("label"), fold_of(F.col("doc_id")).alias("fold"))
    address = F.nullif(host_of(F.col("url")), F.lit(""))
    seen = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", visible_text(F.col("html")).alias("body"), address.alias("host"), declared_language(F.col("html")).alias("declared"), suffix_language(address).alias("suffix"), none.alias("label"), F.lit(2).alias("fold"))
    out = identify(rows.unionByName(seen), models, "body", "host", "declared", "suffix", "fold")
    v = F.col("verdict")
    return out.select("kind", "doc_id", "page_id", "declared", "label", v["language"].alias("language"), v["posterior"].alias("posterior"), v["kept"].alias("kept"), contradicts(v, F.col("label"), models[0].languages).alias("contradicted"))
