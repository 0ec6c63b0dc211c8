"""Token counts kept by deltas: signed inserts, deletes and revisions add up to totals by source, language and tokenizer version.

A batch is a table of signed changes. It is summed by group, written, and
committed by an empty file named after it: a batch that is replayed, by the same
or another writer, changes nothing. Totals are sums over committed batches;
folding writes them as one snapshot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._shared import _fs, materialise, remove, scratch_path, ship
from tidewatch.llm.bpe import WINDOW, read_ranks, slices

GROUPS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"


@lru_cache(4)
def _tokenizer(path: str, pattern: str):
    import regex
    import tiktoken

    cut = regex.compile(r"(?<=\S)(?= \p{L})")
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary

    def count(text: str) -> int:
        total = at = 0
        while at < len(text):  # windows end where no match of the pattern crosses
            found = cut.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = found.start() if found else len(text)
            total += len(encode(text[at:end]))
            at = end
        return total

    return count


def count_tokens(docs: DataFrame, versions: dict[str, str], pattern: str, only: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc, source, lang, body, counts): each whole text's md5 and its count by tokenizer version (name to vocabulary file).

    A null text has no tokens. ``only`` may say by version which rows need its
    count; the others have null there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_tokenizer(path, pattern) for path in versions.values()]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True)
                counts = [[count(t or "") if need else None for count, need in zip(own, wanted, strict=True)] for t, wanted in rows]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc", "source", "lang", "body")], pa.array(counts, pa.list_(pa.int64()))], ["doc", "source", "lang", "body", "counts"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    wanted = F.array(*[F.coalesce((only or {}).get(v, F.lit(True)), F.lit(False)) for v in versions])
    rows = docs.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"), wanted.alias("wanted"))
    return rows.mapInArrow(run, f"doc {kind}, source string, lang string, body string, counts array<long>")


def signed(rows: DataFrame, sign: int, version, tokens) -> DataFrame:
    """Changes that add (+1) or take away (-1) documents with ``tokens`` under ``version``."""
    return rows.select("source", "lang", version.alias("version"), F.lit(sign).cast("long").alias("docs"), (sign * tokens).cast("long").alias("tokens"))


def inserts(rows: DataFrame, version, tokens) -> DataFrame:
    return signed(rows, 1, version, tokens)


def deletes(rows: DataFrame, version, tokens) -> DataFrame:
    return signed(rows, -1, version, tokens)


def revisions(rows: DataFrame, old_version, old_tokens, new_version, new_tokens) -> DataFrame:
    """A revised count takes the old one away and adds the new one."""
    return deletes(rows, old_version, old_tokens).unionByName(inserts(rows, new_version, new_tokens))


class Rollup:
    """Totals below a folder that all executors share.

    ``data`` holds a table of summed changes for each written batch. A batch is
    committed by one empty file in ``commits``, named by the hash of the batch's
    name and its table: it is there or it isn't, and has nothing that a lost
    writer could leave half done. Of several such files for one batch, which
    writers at the same time can leave, the first by name counts. A snapshot is
    a table of totals and a table of the batches in it, valid once its own empty
    file stands in ``snapshots``. Whatever snapshot is read, each committed
    batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _names(self, kind: str) -> list[str]:
        fs, folder = _fs(self.spark, f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _mark(self, kind: str, name: str) -> None:
        fs, p = _fs(self.spark, f"{self.path}/{kind}/{name}")
        fs.create(p, True).close()

    @staticmethod
    def _key(batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()

    def _committed(self) -> dict[str, str]:
        """The table of each committed batch, by the hash of its name."""
        out: dict[str, str] = {}
        for name in self._names("commits"):
            key, _, data = name.partition(".")
            out.setdefault(key, data)
        return out

    def _state(self) -> tuple[str | None, dict[str, str]]:
        """(latest snapshot, the committed batches that it doesn't hold), all from one reading."""
        snapshots = self._names("snapshots")
        committed = self._committed()
        if not snapshots:
            return None, committed
        last = snapshots[-1]
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/data/{last}/batches").collect()  # one short row per batch
        for r in held:
            committed.pop(r["batch"], None)
        return last, committed

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of signed changes once; False, and no change, if ``batch`` was committed before.

        A batch may have any name that isn't null.
        """
        key = self._key(batch)
        if key in self._committed():
            return False
        name = uuid.uuid4().hex
        summed = changes.groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.where("docs <> 0 OR tokens <> 0").coalesce(1).write.parquet(f"{self.path}/data/{name}")
        self._mark("commits", f"{key}.{name}")
        return self._committed()[key] == name

    def _sum(self, snapshot: str | None, batches: dict[str, str]) -> DataFrame:
        """One scan over all tables, however many there are."""
        paths = [f"{self.path}/data/{snapshot}/totals"] * bool(snapshot) + [f"{self.path}/data/{n}" for n in sorted(batches.values())]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        summed = self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches; groups that came to nothing are left out."""
        return self._sum(*self._state())

    def fold(self) -> None:
        """Write the totals as a snapshot, so that reads don't grow with the number of batches.

        The snapshot holds exactly the batches of one reading: what is
        committed meanwhile stays outside it and counts from its own table.
        """
        snapshot, batches = self._state()
        number = 1 + int(snapshot.partition("-")[0]) if snapshot else 0
        name = f"{number:012d}-{uuid.uuid4().hex}"
        self._sum(snapshot, batches).coalesce(1).write.parquet(f"{self.path}/data/{name}/totals")
        held = self.spark.createDataFrame([(k,) for k in sorted(batches)], "batch string")
        if snapshot:
            held = held.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/data/{snapshot}/batches"))
        held.coalesce(1).write.parquet(f"{self.path}/data/{name}/batches")
        self._mark("snapshots", name)


def maintain(docs: DataFrame, versions: dict[str, str], pattern: str, path: str | None = None) -> Rollup:
    """A rollup of ``docs`` that has seen all kinds of change.

    All documents are inserted under the first version; those not in English
    are revised to the second; copies of a text with a smaller doc_id are
    deleted; the revision is sent again, which changes nothing. Null sources,
    languages and texts are groups and empty texts like any other; a null
    doc_id is never a copy to delete; repeated rows count apiece; an empty
    table leaves no totals; other columns are ignored.
    """
    spark = docs.sparkSession
    first, second = (F.lit(v) for v in versions)
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    counted, counted_path = materialise(count_tokens(docs, versions, pattern, {list(versions)[1]: foreign}), "counts")
    rollup = Rollup(spark, path or scratch_path(spark, "rollup"))
    revised = revisions(counted.where(foreign), first, F.get("counts", F.lit(0)), second, F.get("counts", F.lit(1)))
    rollup.commit("1-load", inserts(counted, first, F.get("counts", F.lit(0))))
    rollup.commit("2-revision", revised)
    kept = counted.groupBy(F.col("body").alias("b")).agg(F.min("doc").alias("kept"))
    kept, kept_path = materialise(kept, "kept")  # a table, so that AQE can split the rows of a large group in the join
    copies = counted.join(kept, F.col("body") == F.col("b")).where("doc > kept")
    now = F.when(foreign, second).otherwise(first)
    tokens = F.when(foreign, F.get("counts", F.lit(1))).otherwise(F.get("counts", F.lit(0)))
    rollup.commit("3-copies", deletes(copies, now, tokens))
    rollup.fold()
    rollup.commit("2-revision", revised)
    remove(spark, counted_path, kept_path)
    return rollup


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    versions = {"byte_bpe_50k": public.path("byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": public.path("byte_bpe_multi_50k.tiktoken")}
    return maintain(docs.select("doc_id", "text", "source", "lang"), versions, public.PATTERN).totals()
