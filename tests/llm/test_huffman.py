import heapq
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
from tidewatch.llm import huffman
from tidewatch.llm._shared import scratch_path
from tokenizers import Tokenizer

PATH = public.path("word_bpe_49k.json")


def test_code_is_optimal_complete_and_bounded():
    rng = np.random.default_rng(0)
    for limit in (12, 18, 40):
        counts = np.bincount(np.minimum(rng.zipf(1.4, 50_000), 3000) - 1, minlength=3500)
        lengths = huffman.code_lengths(counts, limit)
        assert abs((0.5 ** lengths[lengths > 0].astype(float)).sum() - 1) < 1e-9
        assert lengths.max() <= limit
        if limit == 40:
            heap = [int(c) for c in counts if c]
            heapq.heapify(heap)
            total = 0
            while len(heap) > 1:
                x = heapq.heappop(heap) + heapq.heappop(heap)
                total += x
                heapq.heappush(heap, x)
            assert int((lengths.astype(int) * counts).sum()) == total


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 5000):
        ids = (np.minimum(rng.zipf(1.3, n), 400) - 1).astype(np.uint16)
        book = huffman.Book(huffman.code_lengths(np.bincount(ids, minlength=400)))
        steps, payload, bits = book.encode(ids)
        assert len(payload) == (bits + 7) // 8
        assert (book.decode(steps, payload, n) == ids).all()


def test_encoder_equals_the_library(docs):
    tokenizer, own = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    texts = [r["text"] or "" for r in docs.collect()] + ["hi<|endoftext|>x", "a.b, c. d", "3. 4,5 é. É, ÉÉ.", "..,. don't I'M", "x́. J̌."]
    for text, ids in zip(texts, own.encode_all(pa.array(texts), 2), strict=True):
        assert list(np.frombuffer(ids, own.kind)) == tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_files(docs, empty, clashing, spark):
    tokenizer = Tokenizer.from_file(PATH)
    path = scratch_path(spark, "test-huffman")
    huffman.write_documents(clashing, PATH, path)
    rows = sorted(huffman.read_files(spark, path).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want, start = {}, 0
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(np.asarray(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    for r in rows:
        assert (r["start"], r["ids_crc32"], r["n_tokens"]) == (start, zlib.crc32(r["ids"]), len(r["ids"]) // 4)
        assert bytes(r["ids"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    assert huffman.query(empty).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_are_told_apart_by_their_bytes(docs, monkeypatch):
    tokenizer, own = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    texts = [" ".join(thue_morse(n, x) for x in ("ab", "ba", "12", "21")) for n in (1024, 2048, 4096)] + [r["text"] or "" for r in docs.collect()]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [list(np.frombuffer(x, own.kind)) for x in own.encode_all(pa.array(texts), 2)] == want
    real = huffman.hash_runs
    monkeypatch.setattr(huffman, "hash_runs", lambda *a: real(*a) & np.uint64(31))  # nearly all words collide
    poor = huffman.Encoder(PATH)
    for _ in range(2):
        assert [list(np.frombuffer(x, own.kind)) for x in poor.encode_all(pa.array(texts), 2)] == want
    assert len(poor.place) <= 32 < len(poor.odd)


def test_a_full_table_starts_anew(docs, monkeypatch):
    own = huffman.Encoder(PATH)
    texts = pa.array([r["text"] or "" for r in docs.collect()])
    want = own.encode_all(texts, 2)
    monkeypatch.setattr(huffman, "WORDS", 10)
    assert own.encode_all(texts, 2) == want
    monkeypatch.setattr(huffman, "WORDS", 1 << 30)
    monkeypatch.setattr(huffman, "WORD_BYTES", 10)
    assert own.encode_all(texts, 2) == want
