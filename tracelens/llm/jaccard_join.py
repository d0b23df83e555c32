"""N-gram Jaccard join with grouped prefixes, and its connected components.

A document's set is its distinct 3-word shingles (A-Z lower-cased; the whole sequence when it has
fewer words) as 64-bit hashes. Two sets of Jaccard similarity t or more share a token among their
first ``n - ceil(t n) + 1`` tokens in any common order; the order here is rare first, by a count
table over all documents whose size follows the corpus up to 2**24 counters (its bound as a broadcast).

1. Equal sets are one *class*; classes with equal size and prefix are one *group*.
2. Per prefix token, every group meets the token's *pivot*, the group with the fewest rarer tokens
   before it (in a family of near copies the one with the fewest edits). Size and position filters drop group pairs,
   members are expanded, and parity bitmaps of about n bits drop pairs that differ in too many tokens (each differing
   token flips one bit, so no link is lost). A member is verified on whole sets with the nearest of its pivots. This
   links a family without all its pairs.
3. Then members under one token that aren't in one component yet are compared: cells of equal
   token, component, size and position are filtered in pairs, passing pairs are expanded, filtered by bitmap and verified.
   Pairs inside a component can't change the result, so nothing is lost and nothing is squared.

Defined cases: texts that are null or have no words have an empty set and stand alone; a null id
is linked with nothing and its component is null; rows of one id are separate nodes; repeated rows give a row
each; other columns are left out and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .chunks import array_of
from .graph import components
from .textnum import LOWER, U64, blocks, flat, mix, rolling, span_hashes, word_spans

SHINGLE, THRESHOLD = 3, 90  # words; per cent
SLICE = 1 << 16


def shingle_sets(column, k: int = SHINGLE):
    """Sorted distinct shingle hashes of each text of a column, one array at a time."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        part = LOWER[data[offsets[i]:offsets[j]]]
        starts, ends, first = word_spans(part, offsets[i:j + 1] - offsets[i])
        words = span_hashes(part, starts, ends)
        every = rolling(words, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(every[a:b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(rolling(words[a:b], b - a) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def _fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(mix(s)) + U64(len(s)) * U64(0x9E3779B97F4A7C15) + s.sum(dtype=U64)]))[0].astype(np.int64)) if len(s) else 0


def token_levels(docs: DataFrame, counters: int, k: int) -> np.ndarray:
    """How frequent the shingles of each counter are, in quarters of a doubling, over all documents."""
    def count(batches):
        table = np.zeros(counters, np.int64)
        for batch in batches:
            held, size = [], 0
            for s in shingle_sets(batch.column(0), k):
                held.append((s & U64(counters - 1)).astype(np.int64))
                size += len(s)
                if size > 1 << 20:
                    table += np.bincount(np.concatenate(held), minlength=counters)
                    held, size = [], 0
            if held:
                table += np.bincount(np.concatenate(held), minlength=counters)
        n = max(1, counters // SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in np.split(table.astype(np.uint32), n)], pa.binary())], ["slice", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(min(counters, SLICE), np.int64)
        for x in rows["counts"]:
            total += array_of(x, np.uint32)
        level = np.minimum(255, 4 * np.log2(total + 1.0)).astype(np.uint8)
        return pa.table({"slice": rows["slice"][:1], "levels": pa.array([level.tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, levels binary").collect()
    out = np.zeros(counters, np.uint8)
    for r in found:
        level = np.frombuffer(bytes(r["levels"]), np.uint8)
        out[r["slice"] * SLICE:r["slice"] * SLICE + len(level)] = level
    return out


def _least_common(n: str, m: str, t: int) -> F.Column:
    """The least intersection of sets of these sizes that link: 100 i >= t (n + m - i)."""
    return F.ceil(F.expr(f"({t} * (CAST({n} AS BIGINT) + {m})) / CAST(100 + {t} AS DOUBLE) - 1e-9"))


def _may_link(a: str, b: str, t: int) -> F.Column:
    """Size and position filters for two prefixes that share a token; positions count from 0.

    At the first token that two linked sets share, all they share stands there or after it. So a pair that fails
    under a later token still passes under its first one if it can link.
    """
    bound = F.expr(f"least({a}n - {a}pos, {b}n - {b}pos)")
    sizes = F.expr(f"100 * least({a}n, {b}n) >= {t} * greatest({a}n, {b}n)")
    return sizes & (bound >= _least_common(f"{a}n", f"{b}n", t))


def parity_bits(s: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of 2**floor(log2 n) bits, 64 at least."""
    size = 1 << max(6, len(s).bit_length() - 1)
    return np.packbits((np.bincount(((s >> U64(20)) & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens that only one of two sets has."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):  # a longer bitmap folds onto itself
        p = p.reshape(2, -1)[0] ^ p.reshape(2, -1)[1]
    while len(q) > len(p):
        q = q.reshape(2, -1)[0] ^ q.reshape(2, -1)[1]
    return int(np.bitwise_count(p ^ q).sum())


def _near(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) of nodes whose bitmaps leave a link possible, with their least difference."""
    def test(batches):
        for batch in batches:
            found = np.array([least_difference(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], np.int64)
            both = batch.column("an").to_numpy() + batch.column("bn").to_numpy()
            keep = pa.array(found <= both - 2 * np.ceil(t * both / (100 + t) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(found).filter(keep)], ["a", "b", "apart"])

    x = classes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("bits").alias("x"))
    y = classes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "an", "bn", "x", "y").mapInArrow(test, "a long, b long, apart long")


FILTER_BITS = 27


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that may be among ids, by a Bloom filter of at most 2**27 bits; others stay where they are."""
    size = 1 << min(FILTER_BITS, max(10, (16 * max(1, ids.count())).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    words = ids.select(place.alias("place")).selectExpr("CAST(place DIV 64 AS INT) AS word", "shiftleft(1L, CAST(place % 64 AS INT)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**21 rows
    table = np.zeros(size // 64 + 1, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63)) & 1
            yield batch.select(["id", "text"]).filter(pa.array(hit == 1))

    return docs.where("id IS NOT NULL").select("id", "text", place.alias("place")).mapInArrow(run, "id long, text string")


def _verify(docs: DataFrame, pairs: DataFrame, homes: DataFrame, k: int, t: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link; homes: a document of each node."""
    def sets(out: list[str]):
        def run(batches):
            for batch in batches:
                node = batch.column("node").to_numpy(zero_copy_only=False)
                keep, found = [], []
                for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                    if _fingerprint(s) == node[i]:
                        keep.append(i)
                        found.append(s.tobytes())
                kept = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in out], pa.array(found, pa.binary())], [*out, "tokens"])
        return run

    def overlap(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = array_of(x, U64), array_of(y, U64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(100 * common >= t * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    # the pairs are a written table, so that they are cheap to read again
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    docs = _only(docs, ends.join(homes, "node").select(F.col("home").alias("id")).distinct())
    left = pairs.join(homes.select(F.col("node").alias("a"), F.col("home").alias("id")), "a")
    right = pairs.select(F.col("b").alias("node")).distinct().join(homes.select("node", F.col("home").alias("id")), "node")
    x = docs.join(left, "id").select("a", "b", F.col("a").alias("node"), "text").mapInArrow(sets(["a", "b"]), "a long, b long, tokens binary").withColumnRenamed("tokens", "x")
    y = docs.join(right, "id").select("node", "text").mapInArrow(sets(["node"]), "node long, tokens binary").select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return x.join(y, "b").select("a", "b", "x", "y").mapInArrow(overlap, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, t: int = THRESHOLD, with_text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; links are pairs with 100 |A and B| >= t |A or B|.

    ``with_text_hash`` adds ``text_hash``, xxhash64 of the text, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    counters = 1 << int(min(24, max(16, math.ceil(math.log2(size / 2048 + 1)))))
    shared = spark.sparkContext.broadcast(token_levels(docs, counters, k))

    def sketch(batches):
        level = shared.value
        for batch in batches:
            n, node, prefix, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                p = len(s) - (-(-t * len(s) // 100)) + 1 if len(s) else 0
                rank = level[(s & U64(len(level) - 1)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[:p]  # sets are sorted, so ties follow the hash
                n.append(len(s))
                node.append(_fingerprint(s))
                prefix.append(s[order].tobytes())
                bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), *batch.columns[2:]],
                                             ["id", "n", "node", "prefix", "bits", *batch.schema.names[2:]])

    text_hash = ["text_hash"] if with_text_hash else []
    rows = docs.select("id", "text", F.xxhash64("text").alias("text_hash")) if with_text_hash else docs
    sketches = materialize(rows.mapInArrow(sketch, "id long, n long, node long, prefix binary, bits binary" + (", text_hash long" if with_text_hash else "")))
    classes = materialize(sketches.where("n > 0 AND id IS NOT NULL").groupBy("node", "n", "prefix", "bits").agg(F.min("id").alias("home")))
    groups = classes.groupBy("n", "prefix").agg(F.min("node").alias("gid"))

    def tokens(batches):
        for batch in batches:
            own = [array_of(x, np.int64) for x in batch.column("prefix")]
            size = np.array([len(x) for x in own], np.int64)
            at = np.repeat(np.arange(len(own)), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), batch.column("gid").take(pa.array(at)), batch.column("n").take(pa.array(at)),
                 pa.array((np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32))], ["token", "gid", "n", "pos"])

    entries = groups.mapInArrow(tokens, "token long, gid long, n long, pos int")
    # most tokens have one group: they are counted in the shortest rows, and pivots are looked for among the others
    several = entries.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    shared_entries = materialize(entries.join(several, "token", "left_semi"))
    pivots = shared_entries.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("p")).select(
        "token", F.col("p.gid").alias("p_gid"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))

    members = classes.join(groups.withColumnRenamed("n", "gn").withColumnRenamed("prefix", "gp"), (F.col("n") == F.col("gn")) & (F.col("prefix") == F.col("gp"))).select("gid", "node", "n")
    members = materialize(members)
    homes = classes.select("node", "home")
    # every group with its tokens' pivots, and every member with its group's first member
    meet = shared_entries.join(pivots, "token").where("gid <> p_gid").withColumnsRenamed({"n": "a_n", "pos": "a_pos", "p_n": "b_n", "p_pos": "b_pos"}).where(_may_link("a_", "b_", t)).select("gid", "p_gid").distinct()
    star = meet.join(members, "gid").select(F.col("node").alias("a"), F.col("p_gid").alias("b")).unionByName(
        members.where("gid <> node").select(F.col("node").alias("a"), F.col("gid").alias("b"))).distinct()
    nearest = _near(star, classes, t).groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    links = materialize(_verify(docs, materialize(nearest), homes, k, t))
    labels = materialize(components(links))

    # members that share a token but no component yet
    wide = members.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1")
    inner = members.join(wide, "gid").select(F.col("gid").alias("token"), "node", "n", F.lit(0).alias("pos"), F.lit(True).alias("own"))
    spread = shared_entries.select("token", "gid", "pos").join(members, "gid").select("token", "node", "n", "pos", F.lit(False).alias("own"))
    placed = spread.unionByName(inner).join(labels, "node", "left").select("token", "own", "node", "n", "pos", F.coalesce("label", "node").alias("comp"))
    placed = materialize(placed)
    open_tokens = placed.groupBy("token", "own").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "own")
    cells = materialize(placed.join(open_tokens, ["token", "own"]).groupBy("token", "own", "comp", "n", "pos").agg(F.min("node").alias("one")).drop("one"))
    a, b = (cells.select("token", "own", *[F.col(c).alias(f"{s}_{c}") for c in ("comp", "n", "pos")]) for s in "ab")
    met = a.join(b, ["token", "own"]).where(F.expr("a_comp < b_comp") & _may_link("a_", "b_", t))
    left = placed.select("token", "own", F.col("comp").alias("a_comp"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("node").alias("a"))
    right = placed.select("token", "own", F.col("comp").alias("b_comp"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), F.col("node").alias("b"))
    rest = met.join(left, ["token", "own", "a_comp", "a_n", "a_pos"]).join(right, ["token", "own", "b_comp", "b_n", "b_pos"]).select("a", "b").distinct()
    rest = materialize(_near(rest, classes, t).select("a", "b"))
    more = materialize(_verify(docs, rest, homes, k, t))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    least = labels.join(homes, "node").groupBy("label").agg(F.min("home").alias("component"))
    component = labels.join(least, "label").select("node", "component")
    known = materialize(classes.join(component, "node", "left").select("node", F.coalesce("component", "home").alias("component")))
    return sketches.join(known, "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"), *text_hash)
