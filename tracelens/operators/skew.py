"""Ordering work inside groups of any size.

A window over a whole group puts that group into one task. A count per group, over
nothing but the key columns, decides: when every group fits (``limit`` rows), plain
windows are used. Otherwise each larger group is cut into parts that follow the sort
order, so that a task never sorts more than a part, and what earlier parts contribute is
added from one row per part. The list of larger groups is broadcast: it has at most
rows / limit entries. Results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOT_ROWS = 1_000_000
MOST_PARTS = 4_096


def has_large(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> bool:
    """Whether any group holds more than ``limit`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return not counts.where(F.col("_rows") > limit).isEmpty()


def _decide(df: DataFrame, keys: list[str], limit: int, large: bool | None) -> bool:
    return has_large(df, keys, limit) if large is None else large


def split_large(df: DataFrame, keys: list[str], order: Column, limit: int) -> DataFrame:
    """Add ``_part``, which never decreases as the number ``order`` grows, and ``_cut``.

    Parts end at quantiles of ``order`` inside each larger group, so outliers don't matter; about twice as many
    parts are made as would just fit. Rows of one value stay together.
    """
    order = order.cast("double")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    most = counts.agg(F.max("_rows")).first()[0] or 0
    parts = int(min(MOST_PARTS, max(2, -(-most // limit) * 2)))
    hot = counts.where(F.col("_rows") > limit).drop("_rows")
    inside = df.join(F.broadcast(hot), keys, "left_semi") if keys else df
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = inside.where(order.isNotNull()).groupBy(*keys).agg(F.percentile_approx(order, at, F.lit(max(10_000, 20 * parts))).alias("_cuts"))
    if not keys and most <= limit:
        cuts = cuts.where(F.lit(False))
    joined = df.join(F.broadcast(cuts), keys, "left") if keys else df.join(F.broadcast(cuts), how="left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < order)), F.lit(0)).cast("long")
    part = F.when(order.isNull() | F.col("_cuts").isNull(), F.lit(0).cast("long")).otherwise(part)
    return joined.withColumn("_part", part).withColumn("_cut", F.col("_cuts").isNotNull()).drop("_cuts")


def cumulative(df: DataFrame, keys: list[str], value: str, weight: str, limit: int = HOT_ROWS,
               large: bool | None = None) -> DataFrame:
    """One row per distinct value: its weight ``w`` and the running weight ``cum`` up to it."""
    large = _decide(df, keys, limit, large)
    vals = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    if not large:
        upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return vals.withColumn("cum", F.sum("w").over(upto))
    cut = split_large(vals, keys, F.col(value), limit)
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = cut.withColumn("_in", F.sum("w").over(inside))
    per_part = cut.where("_cut").groupBy(*keys, "_part").agg(F.sum("w").alias("_pw"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select(*keys, "_part", F.sum("_pw").over(earlier).alias("_before"))
    out = run.join(before, [*keys, "_part"], "left")
    return out.select(*keys, value, "w", (F.coalesce("_before", F.lit(0)) + F.col("_in")).alias("cum"))


def running(df: DataFrame, keys: list[str], value: str, sums: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Add ``cum_<c>`` for each column of ``sums``: its total up to and with the row's value; values are distinct in a group."""
    if not has_large(df, keys, limit):
        upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in sums])
    cut = split_large(df, keys, F.col(value), limit)
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = cut.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_p_{c}") for c in sums])
    before = per_part.select(*keys, "_part", *[F.coalesce(F.sum(f"_p_{c}").over(earlier), F.lit(0)).alias(f"_p_{c}") for c in sums])
    both = cut.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums]).join(before, [*keys, "_part"])
    return both.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_p_{c}")).alias(f"cum_{c}") for c in sums])


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str, limit: int = HOT_ROWS,
                  large: bool | None = None) -> DataFrame:
    """One row per distinct value with the mean rank of its ties (``rnk``)."""
    run = cumulative(df, keys, value, weight, limit, large)
    mid = F.col("cum") - F.col("w") + (F.col("w") + 1) / 2
    return run.select(*keys, value, "w", mid.cast("double").alias("rnk"))


def quantile(df: DataFrame, keys: list[str], value: str, probs: list[float], limit: int = HOT_ROWS,
             large: bool | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as columns ``q0``, ``q1``, …"""
    ones = df.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).alias("_one"))
    run = cumulative(ones, keys, value, "_one", limit, _decide(df, keys, limit, large))
    totals = run.groupBy(*keys).agg(F.max("cum").alias("_n"))
    both = run.join(totals, keys) if keys else run.crossJoin(F.broadcast(totals))  # one row
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for name, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("cum") - F.col("w") <= at) & (at < F.col("cum"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}{i}"))
        picks.append(F.max(h - F.floor(h)).alias(f"_f{i}"))
    agg = both.groupBy(*keys).agg(*picks)
    cols = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
        for i in range(len(probs))
    ]
    return agg.select(*keys, *cols)


def ranged(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """Rows in order of (keys, order) over parts of about ``limit / 2`` rows, with ``_part`` and ``_at``, the place in it.

    Parts end where a sample of whole sort keys says, so rows of one leading value are cut by the columns behind it.
    """
    parts = 2 * -(-df.count() // limit) + 1
    laid = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(laid.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))


def positions(df: DataFrame, run: str, lead: Column, order: list, limit: int = HOT_ROWS,
              large: bool | None = None) -> DataFrame:
    """Number the rows of each run: ``seq`` from 1 in ``order``, and the run length ``n``.

    ``lead`` is the leading sort column as a number. Runs larger than ``limit`` are laid out in order over many tasks and
    numbered from one row a part.
    """
    if not _decide(df, [run], limit, large):
        whole = Window.partitionBy(run)
        return df.withColumn("seq", F.row_number().over(whole.orderBy(*order)).cast("long")).withColumn(
            "n", F.count(F.lit(1)).over(whole))
    cut = ranged(df, [run], order, limit)
    per_part = cut.groupBy(run, "_part").agg(F.count(F.lit(1)).alias("_pw"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = per_part.select(
        F.col(run).alias("_r"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_pw").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_pw").over(Window.partitionBy(run)).alias("n"))
    out = cut.join(known, F.col(run).eqNullSafe(F.col("_r")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("seq", (F.col("_at") - F.col("_first") + 1 + F.col("_before")).cast("long")).select(*df.columns, "seq", "n")


def chunked(df: DataFrame, run: str, before: int = 0, after: int = 0, limit: int = HOT_ROWS,
            seq: str = "seq", large: bool | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_halo`` so that windows over (run, _chunk) see enough neighbours.

    Runs longer than ``limit`` are cut every ``limit`` rows; the ``before``/``after`` rows
    next to a cut are repeated in the other chunk with ``_halo`` set. Drop those after
    the window.
    """
    if not _decide(df, [run], limit, large):
        return df.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_halo", F.lit(False))
    at = F.col(seq) - 1
    home, inside = F.floor(at / limit).cast("long"), at % limit
    owner = lambda chunk, halo: F.struct(chunk.alias("c"), F.lit(halo).alias("h"))
    nobody = owner(F.lit(None).cast("long"), True)
    owners = F.array(
        owner(home, False),
        F.when(inside >= limit - before, owner(home + 1, True)).otherwise(nobody),
        F.when((inside < after) & (home > 0), owner(home - 1, True)).otherwise(nobody))
    wide = df.withColumn("_o", F.explode(F.filter(owners, lambda o: o["c"].isNotNull())))
    return wide.withColumn("_chunk", F.col("_o.c")).withColumn("_halo", F.col("_o.h")).drop("_o")


def carried(df: DataFrame, keys: list[str], value: Column, agg, out: str, later: bool = False,
            large: bool = True) -> DataFrame:
    """Add ``out``: ``agg`` of ``value`` over all earlier (or later) chunks; null where there are none.

    ``df`` must come from ``chunked``. One row per chunk crosses the shuffle.
    """
    if not large:
        return df.withColumn(out, F.when(F.lit(False), value))
    per_chunk = df.where(~F.col("_halo")).groupBy(*keys, "_chunk").agg(agg(value).alias("_v"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_chunk") if later else F.asc("_chunk"))
    over = order.rowsBetween(Window.unboundedPreceding, -1)
    known = per_chunk.select(*keys, "_chunk", agg("_v").over(over).alias(out)).where(F.col(out).isNotNull())
    return df.join(known, [*keys, "_chunk"], "left")
