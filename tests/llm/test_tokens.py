"""Token counts and ids against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from tracelens.llm import bpe
from tracelens.llm.bpe import Codec, Utf8Stream, encode_documents
from tracelens.llm.textnum import buffer
from tracelens.llm.token_counts import count_tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "the", " ", "  ", "\n", "é", "日", "🎉", "1", "!!", "aaaa", "ing", "'s", "　", "́", "<|endoftext|>", "࢏", "\U00032000"]


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=300):
    rnd = random.Random(6)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + [None, "", "a" * 3000, "ab" * 2000, "日本" * 900, " " * 500 + "x", "word " * 60_000]


def test_ids(spark):
    own, rows = library(), [(i, t) for i, t in enumerate(texts())] + [(None, "x y"), (1, "x y")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids"), RANKS, with_ids=True).collect()
    for (i, t), r in zip(rows, got, strict=True):
        ids = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        assert (r.doc_id, r.n_tokens, r.ids, r.ids_sha256) == (i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_streaming_decode():
    codec = Codec(RANKS)
    for t in texts(100):
        assert all("".join(codec.decode(codec.encode(t or ""), step)) == (t or "") for step in (1, 3, 64))
    m = Utf8Stream()
    assert [m.feed(b"\xf0\x9f"), m.feed(b"\x8e"), m.feed(b"\x89a\xc3"), m.close()] == ["", "", "🎉a", "�"]


def test_work_on_new_words():
    """Moves are those of the vocabulary: once met, new words make few new ones. A word that comes again in another place is not encoded again."""
    rnd, parts = random.Random(8), ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    words = [" " + "".join(rnd.choices(parts, k=rnd.randint(2, 6))) for _ in range(12_000)]
    fst, made, read = Codec(RANKS).fst, [], []
    move = fst._move
    fst._move = lambda *a: made.append(1) or move(*a)
    for w in words[:8_000]:
        fst.encode(w.encode())
    before = len(made)
    for w in words[8_000:]:
        fst.encode(w.encode())
    assert len(made) - before < 1_000
    codec = Codec(RANKS)
    encode = codec.fst.encode
    codec.fst.encode = lambda data: read.append(data) or encode(data)
    texts = ["".join(words[:2_000]), None, "", "x" + "".join(words[:2_000][::-1]) + " ha!!", "".join(words[1_000:3_000])]
    got = list(codec.encode_all(*buffer(pa.array(texts))))
    assert got == [np.array(library().encode_ordinary(t or ""), "<u4").tobytes() for t in texts]
    assert len(read) == len(set(read))


def test_kept_pieces(monkeypatch):
    """Caches that are full all the time, and blocks of few bytes, change nothing."""
    for name, n in (("PIECES", 3), ("WORDS", 2), ("MOVES", 5), ("AT_ONCE", 40), ("READ", 7)):
        monkeypatch.setattr(bpe, name, n)
    rows = [t for t in texts(100) if len(t or "") < 5_000]
    got = list(Codec(RANKS).encode_all(*buffer(pa.array(rows))))
    assert got == [np.array(library().encode_ordinary(t or ""), "<u4").tobytes() for t in rows]


def test_counts(spark):
    own, rows = Tokenizer.from_file(JSON), [(i, t) for i, t in enumerate(texts())] + [(None, "x y"), (1, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as piece")
    for frequent in (3, 65_536):
        got = count_tokens(df, JSON, frequent=frequent).collect()
        want = [(i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
        assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(df, JSON).count() == 0 and encode_documents(df, RANKS).count() == 0
