"""Each stage of the pipeline against brute force, on its own input."""

import base64
import hashlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import tiktoken
from test_decontaminate import smith_waterman, words
from test_jaccard_join import brute as components
from test_windows import brute as removed

from tracelens.llm.quality_classifier import classify
from tracelens.session import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and P.queries()["pipeline"] is P.run
    frames = [docs]
    for _, stage in P.STAGES[:-1]:
        frames.append(materialize(stage(spark, frames[-1], SF)))
        assert frames[-1].dtypes == docs.dtypes
    at = [rows(f) for f in frames]
    score = rows(classify(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(at[1]) == {d for d in at[0] if score[d].predicted == 1}
    texts = [(d, r.text) for d, r in at[1].items()]
    assert set(at[2]) == {d for d, _, c in components(texts, 5, 80) if d == c}
    assert {r.doc_id for r in P.near_duplicates(spark, frames[1], SF, 3, 90).collect()} == {d for d, _, c in components(texts) if d == c}
    want = {d: (n, gone, sha) for d, n, gone, _, sha in removed([(d, r.text) for d, r in at[2].items()], 50, False)}
    assert set(at[3]) == {d for d, (n, gone, _) in want.items() if gone < n or not gone}
    for d, r in at[3].items():
        if want[d][1] == 0:
            assert r == at[2][d]
        elif len(at[2][d].text.encode()) - want[d][1] == len(r.text.encode()):
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[d][2] and r.n_chars == len(r.text)
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in items]
    for d, r in at[3].items():
        w = words(r.text)
        own = {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
        near = [i for i, g in zip(items, grams, strict=True) if len(g & own) * 4 > len(g)]
        if len(w) < 1500:
            assert (d in at[4]) == all(smith_waterman(i, w) < 0.5 for i in near)
    last = rows(P.STAGES[-1][1](spark, frames[-1], SF))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, r in at[4].items():
        ids = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
        assert last[d].ids == ids and last[d].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_defined_cases(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c " * 30, "en", "s", 5), (3, "a b c d", "en", "s", 7), (3, "a b c d", "en", "s", 7), (4, "x" * 200_000, "en", "s", 9)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(data)


def test_one_row_of_an_id_in_a_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["other"])
    texts = [(7, " ".join(words)), (7, " ".join(words)), (7, near), (9, near), (7, ""), (7, ""), (8, None), (8, "alone here"), (None, near), (None, near)]
    odd = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in texts], docs.schema)
    got = sorted((r.doc_id, r.text) for r in P.near_duplicates(spark, odd, SF).where("doc_id IS NOT NULL").collect() if r.text is not None)
    assert [g for g in got if g[0] != 7] == [(8, "alone here")] and [t == "" for i, t in got if i == 7] in ([True, False],)
    every = P.near_duplicates(spark, odd, SF)
    assert every.where("doc_id IS NULL").count() == 2 and every.where("doc_id = 8").count() == 2 and every.columns == docs.columns


def test_cut_texts_keep_nulls_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "the same passage of many more than fifty bytes stands here " * 2
    odd = spark.createDataFrame([(1, text, "en", "s", 5), (2, "x" + text, "de", "t", 6), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, text, "en", "s", 1)], docs.schema)
    got = {r.doc_id: (r.text, r.lang, r.n_chars) for r in P.repeated_text(spark, odd, SF).collect()}
    assert got == {1: (text, "en", 5), 2: ("x", "de", 1), 3: (None, "en", None), 4: ("", "en", 0)}
