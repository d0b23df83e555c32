"""Permutation and bootstrap as grouping keys.

A replicate is one more grouping column, so replicates and strata spread over the
cluster. Random order is a function of (seed, replicate, unit), see ``functions.draws`` for labels and
``digest`` for draws with replacement: any engine and any partitioning gives the same.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.draws import P, chosen, redraws, unit_numbers, with_draw
from ..operators.skew import HOT_ROWS, average_ranks, has_large, positions, quantile, ranged
from ..session import materialize
from .evaluate import auc, average_precision

for _module in (draws, sys.modules[__name__]):  # tasks need no installed package
    cloudpickle.register_pickle_by_value(_module)


def digest(seed: int, rep: str, unit: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(rep).cast("string"), F.col(unit).cast("string")))


def replicated(df: DataFrame, reps: int, start: int = 0) -> DataFrame:
    """Every row once per replicate, by explode: no join."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(start), F.lit(start + reps - 1))))


def shuffle_labels(df: DataFrame, strata: str, label: str, unit: str, reps: int, seed: int = 42, start: int = 0,
                   limit: int = HOT_ROWS) -> DataFrame:
    """Labels permuted within strata, once per replicate, as column ``shuffled``.

    Rows are ordered by draw within (replicate, stratum); the first n+ of them get the
    positive label, n+ being the stratum's number of positives. For strata beyond ``limit``
    rows, whole buckets of draws before and after the cut are labelled from their counts and
    only the bucket that holds the cut is sorted.
    """
    first, second = unit_numbers(unit)
    totals = df.groupBy(strata).agg(F.sum(F.col(label)).cast("long").alias("_pos"), F.count(F.lit(1)).alias("_size"))
    keyed = df.join(totals, strata).withColumn("_u1", first).withColumn("_u2", second)
    rows = with_draw(replicated(keyed, reps, start), seed, "rep", "_u1", "_u2", "_h").drop("_u1", "_u2")
    if not has_large(df, [strata], limit):
        order = Window.partitionBy("rep", strata).orderBy("_h", unit)
        return rows.withColumn("shuffled", (F.row_number().over(order) <= F.col("_pos")).cast("int")).drop("_h", "_pos", "_size")
    # draws are uniform, so equal ranges of them are even
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_size") * 4 / limit)).cast("long")
    rows = rows.withColumn("_b", F.floor(F.col("_h") * buckets / F.lit(P)).cast("long"))
    counts = rows.groupBy("rep", strata, "_b").agg(F.count(F.lit(1)).alias("_k"), F.first("_pos").alias("_p"))
    before = F.sum("_k").over(Window.partitionBy("rep", strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("rep", strata, "_b", (F.col("_p") - F.coalesce(before, F.lit(0))).alias("_left"), "_k")
    rows = rows.join(placed, ["rep", strata, "_b"])
    whole = F.when(F.col("_left") >= F.col("_k"), 1).when(F.col("_left") <= 0, 0)
    order = Window.partitionBy("rep", strata, "_b").orderBy("_h", unit)
    cut = rows.where(whole.isNull()).withColumn("shuffled", (F.row_number().over(order) <= F.col("_left")).cast("int"))
    out = rows.where(whole.isNotNull()).withColumn("shuffled", whole).unionByName(cut)
    return out.drop("_h", "_pos", "_size", "_b", "_left", "_k")


#: Replicates that one task draws for one stratum, and cells (replicates x rows) that it holds at once.
REPS_AT_ONCE, CELLS = 500, 2_000_000


def shuffled_sums(df: DataFrame, strata: str, xs: list[str], label: str, unit: str, reps: int, seed: int = 42,
                  limit: int = HOT_ROWS, at_once: int = REPS_AT_ONCE) -> DataFrame:
    """Per (rep, stratum): rows ``n``, positives ``n1``, and for each x its sum over the shuffled positives (``s1``) and over all (``s``), as arrays.

    The labels are those of ``shuffle_labels``, drawn once for all x. A task has one stratum and a chunk of
    replicates, so rows are shuffled once per chunk and not once per replicate; strata beyond ``limit`` rows go the
    way of ``shuffle_labels`` and add up before the shuffle.
    """
    sizes = df.groupBy(strata).agg(F.count(F.lit(1)).alias("_size"))
    first, second = unit_numbers(unit)
    rows = df.join(sizes, strata).select(
        F.col(strata).cast("string").alias("stratum"), F.array(*[F.col(x).cast("double") for x in xs]).alias("x"), F.col(label).cast("int").alias("y"),
        first.alias("u1"), second.alias("u2"), F.col(unit).alias("unit"), (F.col("_size") <= limit).alias("_fits"))

    def draw(key, table):
        table = table.take(pc.sort_indices(table["unit"]))
        n, width = table.num_rows, len(xs)
        values, positives = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, width), int(pc.sum(table["y"]).as_py() or 0)
        u1, u2 = table["u1"].to_numpy(), table["u2"].to_numpy()
        begin = key[1].as_py() * at_once
        ids = np.arange(begin, min(begin + at_once, reps))
        step = max(1, CELLS // max(n, 1))
        sums = np.concatenate([chosen(seed, ids[i:i + step], u1, u2, positives).astype(float) @ values for i in range(0, len(ids), step)])
        m = len(ids)
        return pa.table({"rep": pa.array(ids, pa.int32()), "stratum": pa.array([key[0].as_py()] * m, pa.string()), "n": pa.array([n] * m, pa.int64()),
                         "n1": pa.array([positives] * m, pa.int64()), "s1": pa.array(sums.tolist(), pa.list_(pa.float64())),
                         "s": pa.array([values.sum(axis=0).tolist()] * m, pa.list_(pa.float64()))})

    chunks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // at_once)))
    small = rows.where("_fits").withColumn("chunk", chunks).groupBy("stratum", "chunk").applyInArrow(
        draw, "rep int, stratum string, n long, n1 long, s1 array<double>, s array<double>")
    if not has_large(df, [strata], limit):
        return small
    wide = rows.where("NOT _fits").drop("_fits", "u1", "u2")
    mixed = shuffle_labels(wide, "stratum", "y", "unit", reps, seed, 0, limit)
    one, each = F.col("shuffled") == 1, range(len(xs))
    large = mixed.groupBy("rep", "stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(one).alias("n1"), F.array(*[F.coalesce(F.sum(F.when(one, F.col("x")[i])), F.lit(0.0)) for i in each]).alias("s1"),
        F.array(*[F.sum(F.col("x")[i]) for i in each]).alias("s"))
    return small.unionByName(large)


def two_class_strata(df: DataFrame, strata: str, label: str) -> DataFrame:
    """Rows of strata that hold both labels."""
    ok = df.groupBy(strata).agg((F.min(label) < F.max(label)).alias("_ok")).where("_ok").select(strata)
    return df.join(ok, strata, "left_semi")


def weighted_difference(df: DataFrame, keys: list[str], strata: str, x: str, label: str) -> DataFrame:
    """Sum over strata of (n_s / N) (mean of positives - mean of negatives)."""
    mean = lambda v: F.avg(F.when(F.col(label) == v, F.col(x)))
    per = df.groupBy(*keys, strata).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.coalesce(mean(1) - mean(0), F.lit(0.0)).alias("_d"))
    return per.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_d")) / F.sum("_n")).alias("statistic"))


def permutation_null(df: DataFrame, strata: str, xs: list[str], label: str, unit: str, reps: int, seed: int = 42, limit: int = HOT_ROWS) -> DataFrame:
    """(rep, feature, statistic) over rows in which no x is null."""
    usable = two_class_strata(df.dropna(subset=xs), strata, label).select(strata, *xs, label, unit)
    sums = shuffled_sums(usable, strata, xs, label, unit, reps, seed, limit)
    cells = sums.select("rep", "n", "n1", F.posexplode(F.arrays_zip("s1", "s")).alias("i", "v"))
    gap = F.coalesce(F.try_divide("v.s1", F.col("n1")) - F.try_divide(F.col("v.s") - F.col("v.s1"), F.col("n") - F.col("n1")), F.lit(0.0))
    per = cells.groupBy("rep", "i").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("statistic"))
    return per.select("rep", F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("i") + 1).alias("feature"), "statistic")


def permutation_tests(df: DataFrame, strata: str, xs: list[str], label: str, unit: str, reps: int, seed: int = 42) -> DataFrame:
    """Per feature: the observed weighted difference and its two-sided p = (hits + 1) / (reps + 1).

    Features without nulls share one draw of labels; a feature with nulls is drawn over its own rows.
    """
    gaps = df.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in xs]).first()
    whole = [x for x in xs if not gaps[x]]
    out = None
    for group in ([whole] if whole else []) + [[x] for x in xs if gaps[x]]:
        usable = two_class_strata(df.dropna(subset=group), strata, label)
        long = usable.select(strata, label, *[F.col(x).cast("double").alias(x) for x in group]).unpivot([strata, label], group, "feature", "_x")
        seen = weighted_difference(long, ["feature"], strata, "_x", label).withColumnRenamed("statistic", "observed")
        both = permutation_null(df, strata, group, label, unit, reps, seed).join(F.broadcast(seen), "feature")  # a row a feature
        hits = F.count_if(F.abs(F.round("statistic", 12)) >= F.abs(F.round("observed", 12)))
        part = both.groupBy("feature", "observed").agg(F.count(F.lit(1)).alias("permutations"), ((hits + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_test(df: DataFrame, strata: str, x: str, label: str, unit: str, reps: int, seed: int = 42) -> DataFrame:
    """The same for one feature."""
    return permutation_tests(df, strata, [x], label, unit, reps, seed).drop("feature")


def shuffle_auc_test(preds: DataFrame, strata: str, score: str, label: str, unit: str, reps: int, seed: int = 42) -> DataFrame:
    """AUC of fixed scores under labels shuffled within strata; one-sided p without correction.

    Scores don't change, so their ranks are taken once and a replicate is a sum of the ranks of its positives.
    """
    seen = auc(preds, [], score, label).select(F.col("auc").alias("observed"))
    ranks = average_ranks(preds.select(score, F.lit(1).alias("_one")), [], score, "_one").select(score, "rnk")
    ranked = preds.select(strata, score, label, unit).join(ranks, score)
    sums = shuffled_sums(ranked, strata, ["rnk"], label, unit, reps, seed)
    per = sums.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("s1")[0]).alias("r"))
    value = F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, (F.col("n1") * (F.col("n") - F.col("n1"))).cast("double"))
    null = per.select("rep", value.alias("auc")).where(F.col("auc").isNotNull())
    both = null.crossJoin(F.broadcast(seen))  # one row
    return both.groupBy("observed").agg(
        F.count(F.lit(1)).alias("permutations"), F.avg("auc").alias("mean_null"), F.stddev_pop("auc").alias("sd_null"),
        F.avg((F.round("auc", 12) >= F.round("observed", 12)).cast("double")).alias("p"))


def numbered(df: DataFrame, unit: str) -> DataFrame:
    """Add ``position`` from 0 in digest order of the unit; large tables are numbered in parts."""
    h = df.withColumn("_g", F.lit(0)).withColumn("_h", F.md5(F.col(unit).cast("string")))
    lead = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    out = positions(h, "_g", lead, ["_h", unit])
    return out.withColumn("position", F.col("seq") - 1).drop("_g", "_h", "seq", "n")


#: Rows of (position, score, label) that a task holds whole, and replicates that it then redraws; clusters whose counts it holds for REPS_OF_PART
#: replicates; cells of a part of the scores.
WHOLE_ROWS, REPS_OF_WHOLE, MOST_CLUSTERS, REPS_OF_PART, PART_ROWS = 4_000_000, 50, 8_192, 250, 200_000


def _levels(s) -> tuple[np.ndarray, np.ndarray]:
    """The order of an Arrow column of doubles as Spark has it (null, numbers, NaN) and where each distinct value begins in it."""
    here, v = s.is_valid().to_numpy(zero_copy_only=False), s.fill_null(0.0).to_numpy(zero_copy_only=False)
    order = np.lexsort((v, here))
    here, v = here[order], v[order]
    new = (here[1:] != here[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
    return order, np.flatnonzero(np.concatenate(([True], new)))


def bootstrap_auc(preds: DataFrame, score: str, label: str, unit: str, reps: int, seed: int = 42, whole: int = WHOLE_ROWS, at_once: int = REPS_OF_WHOLE) -> DataFrame:
    """Per-replicate AUC of as many draws with replacement as there are predictions.

    Draws are counted per (replicate, prediction) and weight the predictions. Up to ``whole`` predictions, a task
    has all of them and ``at_once`` replicates, so draws are not shuffled; larger tables count draws by grouping.
    """
    placed = materialize(numbered(preds.select(unit, score, label), unit))
    n = placed.count()
    if n > whole:
        draw = F.conv(F.substring(digest(seed, "rep", "position"), 1, 8), 16, 10).cast("long") % F.lit(n)
        drawn = replicated(placed.select("position"), reps).select("rep", draw.alias("position"))
        counted = drawn.groupBy("rep", "position").agg(F.count(F.lit(1)).alias("_k"))
        rows = counted.join(placed.select("position", score, label), "position")
        return auc(rows, ["rep"], score, label, weight="_k").where(F.col("auc").isNotNull())

    def tally(key, table):
        table = table.combine_chunks()
        order, starts = _levels(table["s"].combine_chunks())
        at, y = table["position"].to_numpy()[order], table["y"].to_numpy(zero_copy_only=False)[order]
        ids = np.arange(key[0].as_py() * at_once, min((key[0].as_py() + 1) * at_once, reps))
        values = []
        for count in redraws(seed, ids, n):
            k = count[at]
            pos, all_ = np.add.reduceat(k * y, starts), np.add.reduceat(k, starts)
            neg = all_ - pos
            pairs = int(pos.sum()) * int(neg.sum())
            values.append(float((pos * (np.cumsum(neg) - neg / 2)).sum()) / pairs if pairs else None)
        return pa.table({"rep": pa.array(ids, pa.int32()), "n": pa.array([n] * len(ids), pa.int64()), "auc": pa.array(values, pa.float64())})

    chunks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // at_once)))
    rows = placed.select("position", F.col(score).cast("double").alias("s"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("y"), chunks.alias("chunk"))
    return rows.groupBy("chunk").applyInArrow(tally, "rep int, n long, auc double").where(F.col("auc").isNotNull())


def bootstrap_interval(replicates: DataFrame, value: str = "auc") -> DataFrame:
    stats = replicates.agg(F.count(value).alias("replicates"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"))
    q = quantile(replicates, [], value, [0.025, 0.975]).select(F.col("q0").alias("low"), F.col("q1").alias("high"))
    return stats.crossJoin(F.broadcast(q))  # one row each


def block_bootstrap_mean(df: DataFrame, cluster: str, value: str, reps: int, seed: int = 42) -> DataFrame:
    """Bootstrap of a mean that redraws whole clusters; only per-cluster sums are replicated.

    Cluster i of replicate r is drawn as often as the clusters whose digest points at it.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).cast("double").alias("_s"), F.count(value).alias("_c"))
    placed = numbered(sums, cluster).withColumnRenamed("position", "_i")
    k = placed.agg(F.count(F.lit(1)).alias("_m"))
    sized = placed.crossJoin(F.broadcast(k))  # one row
    draw = F.conv(F.substring(digest(seed, "rep", "_i"), 1, 8), 16, 10).cast("long") % F.col("_m")
    drawn = replicated(sized.select("_i", "_m"), reps).select("rep", draw.alias("_i"))
    both = drawn.groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("_k")).join(placed, "_i")
    return both.groupBy("rep").agg((F.sum(F.col("_k") * F.col("_s")) / F.sum(F.col("_k") * F.col("_c"))).alias("mean"))


def _redrawn(preds: DataFrame, cluster: str, score: str, label: str, reps: int, seed: int) -> DataFrame:
    """(rep, _k, cluster, score, label): the rows of each drawn cluster with how often it was drawn."""
    placed = materialize(numbered(preds.select(cluster).distinct(), cluster).withColumnRenamed("position", "_i"))
    m = placed.count()
    draw = F.conv(F.substring(digest(seed, "rep", "_i"), 1, 8), 16, 10).cast("long") % F.lit(m)
    drawn = replicated(placed.select("_i"), reps).select("rep", draw.alias("_i")).groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("_k"))
    return drawn.join(placed, "_i").join(preds.select(cluster, score, label), cluster)


def _redrawn_sums(preds: DataFrame, cluster: str, score: Column, label: str, reps: int, seed: int, of_part, limit: int, at_once: int) -> DataFrame | None:
    """(rep, a, pos, neg): sums over the distinct values of ``score``, lowest first, when whole clusters are redrawn; none for too many clusters.

    Counts per (value, cluster) are laid out by ranges of the value. A task has one range and ``at_once`` replicates: it redraws the
    clusters, weights its counts and begins with what the ranges before it add up to, so no row is shuffled per replicate. ``of_part`` takes weighted
    positives and negatives (replicates x values) and their sums before each value.
    """
    placed = materialize(numbered(preds.select(cluster).distinct(), cluster).withColumnRenamed("position", "_i"))
    m = placed.count()
    if not 0 < m <= MOST_CLUSTERS:
        return None
    one = F.coalesce(F.col(label) == 1, F.lit(False))
    cells = preds.groupBy(cluster, score.cast("double").alias("_s")).agg(F.count_if(one).alias("p"), F.count_if(~one).alias("q"))
    cut = ranged(cells.join(placed, cluster).select("_i", "_s", "p", "q"), [], ["_s"], limit)
    each = cut.groupBy("_part", "_i").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas()  # at most parts x clusters
    parts = sorted(each["_part"].unique())
    totals = np.zeros((len(parts) + 1, 2, m))
    np.add.at(totals, (np.searchsorted(parts, each["_part"]) + 1, 0, each["_i"]), each["p"])
    np.add.at(totals, (np.searchsorted(parts, each["_part"]) + 1, 1, each["_i"]), each["q"])
    before = dict(zip(map(int, parts), np.cumsum(totals, axis=0)))

    def tally(key, table):
        table = table.combine_chunks()
        order, starts = _levels(table["_s"].combine_chunks())
        at, p, q = (table[c].to_numpy()[order] for c in ("_i", "p", "q"))
        ids = np.arange(key[1].as_py() * at_once, min((key[1].as_py() + 1) * at_once, reps))
        counts = np.stack(list(redraws(seed, ids, m))).astype(float)
        early = [counts @ b for b in before[key[0].as_py()]]
        step, sums = max(1, CELLS // len(at)), []
        for i in range(0, len(ids), step):
            k = counts[i:i + step].take(at, axis=1)
            pos, neg = np.add.reduceat(k * p, starts, axis=1), np.add.reduceat(k * q, starts, axis=1)
            a = of_part(pos, neg, np.cumsum(pos, axis=1) - pos + early[0][i:i + step, None], np.cumsum(neg, axis=1) - neg + early[1][i:i + step, None])
            sums.append(np.stack((a.sum(axis=1), pos.sum(axis=1), neg.sum(axis=1))))
        a, pos, neg = np.concatenate(sums, axis=1)
        return pa.table({"rep": pa.array(ids, pa.int32()), "a": pa.array(a), "pos": pa.array(pos), "neg": pa.array(neg)})

    chunks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // at_once)))
    tallied = cut.select("_part", chunks.alias("chunk"), "_i", "_s", "p", "q").groupBy("_part", "chunk").applyInArrow(tally, "rep int, a double, pos double, neg double")
    return tallied.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("a", "pos", "neg")])


def block_bootstrap_auc(preds: DataFrame, cluster: str, score: str, label: str, reps: int, seed: int = 42, limit: int = PART_ROWS, at_once: int = REPS_OF_PART) -> DataFrame:
    """AUC per replicate when whole clusters are redrawn; a cluster's rows count as often as it was drawn."""
    sums = _redrawn_sums(preds, cluster, F.col(score), label, reps, seed, lambda pos, neg, pos_before, neg_before: pos * (neg_before + neg / 2), limit, at_once)
    if sums is None:
        return auc(_redrawn(preds, cluster, score, label, reps, seed), ["rep"], score, label, weight="_k").where(F.col("auc").isNotNull())
    out = sums.select("rep", (F.col("pos") + F.col("neg")).cast("long").alias("n"), F.try_divide(F.col("a"), F.col("pos") * F.col("neg")).alias("auc"))
    return out.where(F.col("auc").isNotNull())


def block_bootstrap_precision(preds: DataFrame, cluster: str, score: str, label: str, reps: int, seed: int = 42, limit: int = PART_ROWS, at_once: int = REPS_OF_PART) -> DataFrame:
    """The same for average precision, from weighted running counts per replicate, highest score first."""

    def of_part(pos, neg, pos_before, neg_before):
        hits = pos_before + pos
        return pos * hits / np.maximum(hits + neg_before + neg, 1)

    sums = _redrawn_sums(preds, cluster, -F.col(score), label, reps, seed, of_part, limit, at_once)
    if sums is None:
        rows = _redrawn(preds, cluster, score, label, reps, seed)
        return average_precision(rows, ["rep"], score, label, weight="_k").where(F.col("average_precision").isNotNull())
    out = sums.select("rep", F.try_divide("a", "pos").alias("average_precision"))
    return out.where(F.col("average_precision").isNotNull())
