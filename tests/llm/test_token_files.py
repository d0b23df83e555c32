"""Token files against the library, and what their metadata lets a reader skip."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from test_tokens import JSON, texts
from tokenizers import Tokenizer

from tracelens.llm.token_files import Encoder, file_starts, find_documents, read_tokens, stored_tokens, token_digests, write_tokens

GAPS = [" ", "  ", "   ", "\n", " \n", "\n ", "\n \n", "\t", " ", "   ", " 　", "\x1c", " \x1c ", "\u0085 ", "   ", ""]
WORDS = ["the", "don't", "x1", "42", "!?", "é", "日本", "<|endoftext|>", "a<|endoftext|>", "'s", "́"]


def odd_texts(n=1500):
    rnd = random.Random(2)
    return ["".join(rnd.choice(GAPS) + rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))) + rnd.choice(GAPS) for _ in range(n)]


def test_pieces_give_the_library_s_ids():
    library, all_ = Tokenizer.from_file(JSON), odd_texts() + [t or "" for t in texts()]
    for kept, size in ((150_000, 200), (20, 7), (0, 1)):
        own = Encoder(JSON, kept)
        for i in range(0, len(all_), size):
            part = [t.encode() for t in all_[i:i + size]]
            ids, n = own.encode(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(t) for t in part]))
            for t, got in zip(part, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                assert got.tolist() == library.encode(t.decode(), add_special_tokens=False).ids, repr(t)


def test_recurring_pieces_stay():
    own, learned = Encoder(JSON, 20), []
    learn = own._learn
    own._learn = lambda pieces: (learned.extend(pieces), learn(pieces))
    library = Tokenizer.from_file(JSON)
    for i in range(40):
        text = " the house is" * (i % 4 != 0) + "".join(f" odd{chr(97 + i % 26)}{i}{w}" for w in ("x", "y", "z", "q"))
        ids, _ = own.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert learned.count(b" house") == 1


def test_line_ends_and_signs_part_pieces():
    own, library = Encoder(JSON), Tokenizer.from_file(JSON)
    for text in ("über.\nDas, und so.\n\nMehr.\r\nño,\n x.\n'll a.b,c ...,\u2028.\n", "a.\n", "\n.a", "it's.\n's", "\u00e9.\u00d7 \u00f7x \u00c3."):
        data = text.encode()
        ids, _ = own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert {b"\nDas", b".", b", und"} & own.number.keys() == {b"\nDas", b"."}


def expected(rows):
    library, start, out = Tokenizer.from_file(JSON), 0, []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests_of_the_files(spark, tmp_path):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts())] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as file", "2 as ids").repartition(5)
    path = str(tmp_path / "t")
    write_tokens(df, P.path("byte_bpe_50k.json"), path, file_bytes=20_000)
    assert file_starts(spark, path).count() > 3
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert sorted(map(tuple, token_digests(spark, path).collect()), key=lambda r: r[1]) == expected(order)


def test_repeated_rows_and_ids(spark):
    rows = [(5, "one two")] * 300 + [(5, "three")] * 5 + [(1, "first")]
    got = sorted(map(tuple, stored_tokens(spark.createDataFrame(rows, "doc_id long, text string"), JSON).collect()), key=lambda r: r[1])
    assert got[0] == expected([(1, "first")])[0] and len(got) == 306
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and sorted(r[2] for r in got) == sorted(r[2] for r in expected(rows))
    assert stored_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0


def test_format_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20_000).selectExpr("id * 3 as doc_id", "concat('word ', id % 10) as text")
    write_tokens(df, JSON, path, file_bytes=1 << 30)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    file = next(f for f in (tmp_path / "t").iterdir() if f.suffix == ".orc")
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000
    footer = reader.rows().readStripeFooter(reader.getStripes()[0])
    kinds = [(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()]
    assert ("BLOOM_FILTER_UTF8", 2) in kinds and ("ROW_INDEX", 2) in kinds
    assert {footer.getColumns(i).getKind().toString() for i in (2, 3, 4)} == {"DIRECT_V2"}  # integer run-length encoding
    found = find_documents(spark, path, [9, 10, 59_997])
    assert sorted(r.doc_id for r in found.collect()) == [9, 59_997]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()
    # of 20 groups of 1,000 rows two hold these ids; 10 lies in the range of a group, and only its Bloom filter tells that it isn't there
    assert rows_read(found) == 2000
    none = find_documents(spark, path, [10])
    assert none.collect() == [] and rows_read(none) == 0
    assert read_tokens(spark, path).where("doc_id = 10").count() == 0


def rows_read(df):
    """What the scan of a collected query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()
