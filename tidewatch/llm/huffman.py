"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

A file is a Parquet container of blocks. A block holds whole documents in
ascending key order and can be read alone: their keys and lengths, the bit
offsets of every ``STRIDE``-th id as 16-bit steps, and the code bits, most
significant bit first. The code is canonical, so the code book is only the
lengths, kept in a table beside the blocks. Decoding looks up ``limit`` bits at
a time in a table and runs from all checkpoints of a block at once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._bytes import equal_runs, hash_runs, runs, text_bytes
from tidewatch.llm._shared import materialise, remove, scratch_path, ship
from tidewatch.llm.bpe import slices

#: Longest code in bits; the decoding table has two to this power entries.
LIMIT = 18
#: Ids between checkpoints: at LIMIT bits each their span fits 16 bits.
STRIDE = 128
#: Ids after which a block is closed, at the end of a document.
BLOCK_IDS = 1 << 19
END_ID = 2
#: Words, and bytes of them, after which a worker starts its table anew.
WORDS, WORD_BYTES = 1_500_000, 48 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total size with none above ``limit`` (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, row = [], weights
    is_item = np.ones(n, bool)
    for _ in range(limit):
        levels.append(is_item)
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        row, is_item = both[at], at < n
    take = 2 * (n - 1)
    ranks = np.zeros(n, np.int64)
    for flags in reversed(levels):
        items = int(flags[:take].sum())
        ranks[:items] += 1
        take = 2 * (take - items)
    lengths[order] = ranks
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: ids by (length, id) get rising codes."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if not len(order):
        return codes
    top = int(lengths[order].max())
    steps = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
    left = np.concatenate([[np.uint64(0)], np.cumsum(steps)[:-1]])
    codes[order] = left >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return codes


class Book:
    """Both directions of a canonical code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes = canonical_codes(lengths)
        self.top = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        repeat = 1 << (self.top - lengths[order].astype(np.int64))
        self.symbol_at = np.zeros(1 << self.top, np.uint32)
        self.length_at = np.ones(1 << self.top, np.uint8)
        filled = int(repeat.sum())
        self.symbol_at[:filled] = np.repeat(order, repeat)
        self.length_at[:filled] = np.repeat(lengths[order], repeat)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, int]:
        """(steps between checkpoints as unsigned 16-bit integers, code bits, number of bits)."""
        long = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(long)
        bits = int(ends[-1]) if len(ends) else 0
        at = ends - long
        marks = at[::STRIDE]
        steps = np.diff(marks, prepend=0).astype("<u2").tobytes()
        n_words = (bits + 31) // 32 + 1
        place = at >> 5
        value = self.codes[ids] << (64 - long - (at & 31)).astype(np.uint64)
        out = np.bincount(place, (value >> np.uint64(32)).astype(np.float64), n_words)
        low = np.bincount(place + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)[:n_words]
        return steps, (out + low).astype(np.uint64).astype(">u4").tobytes()[: (bits + 7) // 8], bits

    def decode(self, steps: bytes, payload: bytes, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        at = np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64))
        padded = payload + bytes(-len(payload) % 4 + 4 * (STRIDE * self.top // 32 + 3))
        words = np.frombuffer(padded, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.empty((STRIDE, len(at)), np.uint32)
        base, mask = np.int64(64 - self.top), np.uint64((1 << self.top) - 1)
        for k in range(min(STRIDE, n)):
            seen = ((pairs[at >> 5] >> (base - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[k] = self.symbol_at[seen]
            at = at + self.length_at[seen]
            if k + 1 == n - (len(at) - 1) * STRIDE:  # the last run ends here: leave it in place
                at[-1] = 0
        return out.T.ravel()[:n]


class Encoder:
    """Ids of whole texts by a tokenizer file of the word-end kind, through a table of words.

    The file's pre-tokens never cross a blank or a line feed, and its
    normalisation (composition, then lower case) acts on each character between
    them alone, so a text's ids are its words' ids one after another. In texts
    without characters from U+0300 on, which hold nothing to compose, A to Z
    are lower-cased, and a full stop or comma between a letter or digit and a
    blank is a word of its own. Words are found and hashed as numpy arrays; the
    tokenizers library encodes each new one: those of letters only in one text,
    cut apart after ids that end a word, all others one by one. Hashes only find
    words: each occurrence is compared with its word's bytes, and words that
    share a hash with another one are kept in a table by their bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.n_ids <= 1 << 16 else "<u4"
        self.ends_word = np.zeros(self.n_ids, bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.odd: dict[bytes, int] = {}
        self.begin = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, self.kind)
        self.bytes_begin = np.zeros(1025, np.int64)
        self.bytes = np.zeros(4096, np.uint8)
        self.n_words = self.n_used = 0

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words and append their ids to the table."""
        texts = [w.decode() for w in words]
        plain = [k for k, w in enumerate(texts) if w.isalpha()]
        rest = range(len(texts))
        coded: list = [None] * len(texts)
        if plain:
            ids = np.asarray(self.tokenizer.encode(" ".join([texts[k] for k in plain]), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain):  # each word was one pre-token
                for k, a, z in zip(plain, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    coded[k] = ids[a:z]
                rest = [k for k, x in enumerate(coded) if x is None]
        if rest:
            for k, x in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                coded[k] = np.asarray(x.ids, self.kind)
        counts = np.array([len(x) for x in coded], np.int64)
        own = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        n, m = self.n_words + len(counts), self.n_used + int(counts.sum())
        used = int(self.bytes_begin[self.n_words])
        if n >= len(self.begin):
            self.begin, self.count, self.bytes_begin = np.resize(self.begin, 2 * n), np.resize(self.count, 2 * n), np.resize(self.bytes_begin, 2 * n + 1)
        if m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * m)
        if used + len(own) > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * (used + len(own)))
        self.begin[self.n_words : n] = self.n_used + np.cumsum(counts) - counts
        self.count[self.n_words : n] = counts
        self.ids[self.n_used : m] = np.concatenate(coded)
        self.bytes_begin[self.n_words + 1 : n + 1] = used + np.cumsum(sizes)
        self.bytes[used : used + len(own)] = own
        self.n_words, self.n_used = n, m

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the table of each word, learnt if it is new."""
        hashes, some, which = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        named = hashes.tolist()
        slots = np.array([self.place.get(h, -1) for h in named], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = self.n_words
            self._learn([data[a:b].tobytes() for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)])
            slots[new] = np.arange(first, self.n_words)
            self.place.update((named[k], s) for k, s in zip(new.tolist(), slots[new].tolist(), strict=True))
        out = slots[which]
        own = slice(0, int(self.bytes_begin[self.n_words]))
        other = np.flatnonzero(~equal_runs(data, starts, ends, self.bytes[own], self.bytes_begin[out], self.bytes_begin[out + 1]))
        if len(other):  # words that share a hash with another word
            words = [data[starts[i] : ends[i]].tobytes() for i in other.tolist()]
            unknown = list(dict.fromkeys(w for w in words if w not in self.odd))
            if unknown:
                first = self.n_words
                self._learn(unknown)
                self.odd.update(zip(unknown, range(first, self.n_words), strict=True))
            out[other] = [self.odd[w] for w in words]
        return out

    def _prepared(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes lower-cased, and the places of stops and commas that are words of their own, in texts that allow both."""
        high = np.concatenate([[0], np.cumsum(data >= 0xCC, dtype=np.int64)])
        plain_text = high[bounds[1:]] == high[bounds[:-1]]
        if not plain_text.all():
            allowed = np.repeat(plain_text, np.diff(bounds))
            lowered = np.where(allowed, _LOWER[data], data)
        else:
            allowed, lowered = None, _LOWER[data]
        at = np.flatnonzero((data == 0x2E) | (data == 0x2C))
        at = at[at > 1]
        if len(at):
            ended = np.zeros(len(data) + 1, bool)
            ended[bounds] = True
            begun = ended[at] | ended[at - 1]  # a text begins here or one byte before
            last, before = data[at - 1], data[at - 2]
            letter = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
            following = np.where(at + 1 < len(data), data[np.minimum(at + 1, len(data) - 1)], 0x20)
            blank = (following == 0x20) | (following == 0x0A) | ended[at + 1]
            fits = letter & blank & ~begun
            if allowed is not None:
                fits &= allowed[at]
            at = at[fits]
        return lowered, at

    def encode_all(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """The ids of each text of an Arrow column and ``end_id`` after them, as integers of ``kind``."""
        if self.n_words > WORDS or self.bytes_begin[self.n_words] > WORD_BYTES:
            self._forget()
        raw, bounds = text_bytes(texts)
        data, stops = self._prepared(raw, bounds)
        starts, ends, first = runs((raw != 0x20) & (raw != 0x0A), bounds, stops)
        word = self._places(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        counts = self.count[word]
        stop = np.cumsum(counts)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.repeat(self.begin[word] - (stop - counts), counts) + np.arange(total)]
        at = np.concatenate([[0], stop])[first]
        packed, wide, last = ids.tobytes(), ids.itemsize, np.asarray([end_id], self.kind).tobytes()
        return [packed[a * wide : b * wide] + last for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def _book(lengths: bytes) -> Book:
    return Book(np.frombuffer(lengths, np.uint8))


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): each whole text's ids and ``end_id``; 16-bit integers if the vocabulary fits, else 32-bit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        wide = int(own.kind[-1])
        for batch in batches:
            for part in slices(batch, "__text", 1 << 21):
                ids = own.encode_all(part.column("__text"), end_id)
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array([len(x) // wide for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["__key", "n_tokens", "ids"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("__key", key)


def count_ids(tokens: DataFrame, n_ids: int, kind: str) -> np.ndarray:
    """How often each id occurs: summed within tasks, then by id; one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                data = b"".join(x or b"" for x in part.column(0).to_pylist())
                total += np.bincount(np.frombuffer(data, kind), minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(n_ids, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_files(tokens: DataFrame, path: str, n_ids: int, kind: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write ids, in ascending ``key`` order (nulls first, then by ids), to ``path``/blocks with their code book in ``path``/book."""
    spark = tokens.sparkSession
    counts = count_ids(tokens, n_ids, kind)
    lengths = code_lengths(counts, limit).tobytes()
    book = [(int(i), int(n)) for i, n in enumerate(lengths) if n]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/book")
    stored = tokens.schema[key].dataType
    to_arrow = pa.int64() if stored.simpleString() == "bigint" else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, block, first = _book(lengths), TaskContext.get().partitionId(), 0, 0
        keys, sizes, datas, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            steps, payload, bits = own.encode(np.frombuffer(b"".join(datas), kind))
            row = [[part], [block], [first], [n], [keys], [np.asarray(sizes, "<i8").tobytes()], [bits], [steps], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(to_arrow or pa.infer_type(keys)), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], NAMES)

        for batch in batches:
            for k, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys.append(k)
                sizes.append(size)
                datas.append(data.as_buffer())
                n += size
                if n >= BLOCK_IDS:
                    yield close()
                    block, first = block + 1, first + n
                    keys, sizes, datas, n = [], [], [], 0
        if keys:
            yield close()

    schema = f"part int, block int, first long, n long, keys array<{stored.simpleString()}>, sizes binary, bits long, steps binary, payload binary"
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.select(key, "n_tokens", "ids").repartitionByRange(n_parts, key, "n_tokens").sortWithinPartitions(key, "n_tokens", "ids")
    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


NAMES = ["part", "block", "first", "n", "keys", "sizes", "bits", "steps", "payload"]


def read_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the
    unsigned crc32 of its ids as little-endian unsigned 32-bit integers, which
    ``ids`` holds. One row per written partition reaches the driver.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.zeros(1, np.uint8)
    book = spark.read.parquet(f"{path}/book").collect()
    if book:
        lengths = np.zeros(max(r["id"] for r in book) + 1, np.uint8)
        lengths[[r["id"] for r in book]] = [r["length"] for r in book]
    packed = lengths.tobytes()
    before, so_far = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        before[r["part"]], so_far = so_far, so_far + r["n"]
    stored = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _book(packed)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, first, n, steps, payload = (row.column(c)[0].as_py() for c in ("part", "first", "n", "steps", "payload"))
                sizes = np.frombuffer(row.column("sizes")[0].as_py(), "<i8")
                ids = own.decode(steps, payload, n).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                view = memoryview(ids)
                crcs = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                keys = row.column("keys")[0].values
                out = [keys, pa.array(before[part] + first + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["__key", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    ship(spark)
    schema = f"__key {stored}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("part", "first", "n", "keys", "sizes", "steps", "payload").mapInArrow(run, schema).withColumnRenamed("__key", key)


def write_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the files below ``path``.

    A null text counts as empty: its document has the end id only. Documents of
    equal keys stand next to each other, ordered by their ids, repeated rows
    apiece; null keys come first; an empty table gives files without blocks;
    other columns are ignored. A document lies whole in one block.
    """
    own = encoder(tokenizer)
    tokens, scratch = materialise(tokenise(docs, tokenizer, end_id, key, text), "tokens")
    write_files(tokens, path, own.n_ids, own.kind, key=key)
    remove(docs.sparkSession, scratch)


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = scratch_path(docs.sparkSession, "huffman")
    write_documents(docs.select("doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), path)
    return read_files(docs.sparkSession, path, with_ids=False)
