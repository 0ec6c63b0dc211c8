"""Byte-level BPE through sentencepiece: a model written straight from the vocabulary, nothing trained.

Each byte is mapped to one character, each vocabulary entry becomes a piece of
those characters, scored by its negative rank: sentencepiece then merges the
best-scored neighbours, leftmost first, which are the merges of lowest rank.
The normalisation is the identity. Texts are split by the pre-token pattern,
each pre-token is encoded apart, and pieces map back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._shared import ship, trim

#: Characters above Latin-1: none is white space or sentencepiece's own space mark.
SHIFT = 0x100
#: Pre-tokens that a worker keeps encoded: the first that it meets, among which are the frequent ones; and the longest that it keeps.
CACHE, CACHED_CHARS = 30_000, 32
#: Characters of a text that are split into pre-tokens at a time.
WINDOW = 1 << 20


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: varint, length-delimited or 32-bit float by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


_CHARACTERS = "".join(chr(b + SHIFT) for b in range(256))


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHARACTERS)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a byte-level vocabulary: piece i has rank i, the unknown piece comes last."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, mapped(t).encode()) + _field(2, -float(i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids as little-endian unsigned 32-bit integers, and back to bytes. Native order is used, so a big-endian host is refused."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed in native order, which must be little-endian 32-bit here")
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self.pattern, self.cut = regex.compile(pattern), regex.compile(r"(?<=\S)(?= \p{L})")
        self.bytes_of = [bytes(ord(c) - SHIFT for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.kept: dict[str, bytes] = {}

    def encode_tokens(self, tokens: list[str]) -> dict[str, bytes]:
        """Each pre-token's ids: its rank if it is an entry of the vocabulary, else by the model, all of them in one call."""
        data = [t.encode() for t in tokens]
        whole = [self.ranks.get(d) for d in data]
        rest = [k for k, r in enumerate(whole) if r is None]
        out = {tokens[k]: array("I", [r]).tobytes() for k, r in enumerate(whole) if r is not None}
        for k, ids in zip(rest, self.model.encode([mapped(data[k]) for k in rest], num_threads=1), strict=True):
            out[tokens[k]] = array("I", ids).tobytes()
        return out

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Windows of pre-tokens. A window ends before a single space between a non-space and a letter: no match of the pattern crosses it."""
        at = 0
        while at < len(text):
            found = self.cut.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = found.start() if found else len(text)
            yield self.pattern.findall(text, at, end)
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the pre-tokens of all of them that are new are encoded together."""
        split = [list(self.pre_tokens(t)) for t in texts]
        seen: set[str] = set()
        for windows in split:
            for tokens in windows:
                seen.update(tokens)
        kept = self.kept
        table = {t: kept[t] for t in seen.intersection(kept)}
        new = self.encode_tokens(list(seen.difference(kept)))
        table |= new
        if len(kept) < CACHE:
            kept.update((t, x) for t, x in new.items() if len(t) <= CACHED_CHARS)
        get = table.__getitem__
        return [b"".join([b"".join(map(get, tokens)) for tokens in windows]) for windows in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> Iterator[bytes]:
        table = self.bytes_of
        whole = np.frombuffer(ids, "<u4")
        for i in range(0, len(whole), WINDOW):
            yield b"".join([table[x] for x in whole[i : i + WINDOW].tolist()])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
    trim()


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(key, n_tokens, ids, exact[, decoded]): each whole text's ids (little-endian unsigned 32-bit), whether they decode to its bytes, and those bytes.

    A null text counts as empty and has no ids; repeated rows come back apiece;
    an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 19):
                texts = part.column("__text").to_pylist()
                ids = own.encode_all([t or "" for t in texts])
                back = [b"".join(own.decode(x)) for x in ids]
                exact = [b == (t or "").encode() for b, t in zip(back, texts, strict=True)]
                columns = [part.column("__key"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(exact)]
                if decoded:
                    columns.append(pa.array(back, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["__key", "n_tokens", "ids", "exact", "decoded"][: len(columns)])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"__key {kind}, n_tokens long, ids binary, exact boolean" + ", decoded binary" * decoded
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, schema).withColumnRenamed("__key", key)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, hashed in the workers so that only digests leave them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 19):
                counts, ids_sha, decoded_sha = [], [], []
                for ids in own.encode_all([t or "" for t in part.column("__text").to_pylist()]):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    h = hashlib.sha256()
                    for x in own.decode(ids):
                        h.update(x)
                    decoded_sha.append(h.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["__key", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("__key", key)


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
