import hashlib
import random
import struct

import public_tokenizers as public
import tiktoken
from tidewatch.llm import bpe

PATH = public.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_model_agrees_with_ranks_on_awkward_texts():
    own, other = bpe.Codec(PATH, public.PATTERN), reference()
    rng = random.Random(1)
    pool = "aàßЖ中😀 \n\t'sdrevmlt 0912 _-!? ̀"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 200))) for _ in range(800)] + ["a" * 20000, "<|endoftext|> x", "", " " * 3000 + "x", "ab " * 700_000]
    for t in texts:
        ids = own.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == other.encode_ordinary(t)
        assert b"".join(own.decode(ids)) == t.encode()


def test_query(docs, empty, clashing):
    other = reference()
    want = {}
    for r in docs.collect():
        ids = other.encode_ordinary(r["text"] or "")
        want.setdefault(r["doc_id"], []).append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    for frame in (docs, clashing):
        rows = bpe.query(frame).collect()
        assert len(rows) == docs.count()
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in want[r["doc_id"]] for r in rows)
    assert bpe.query(empty).count() == 0
    assert bpe.encode_documents(docs, PATH, public.PATTERN).where("not exact").count() == 0
