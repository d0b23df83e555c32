"""Keeping run and call tables: replacing, backfilling, merging, fetching, exporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024


def with_bucket(df: DataFrame, run: str = "run_id", buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("run_bucket", F.pmod(F.xxhash64(F.col(run).cast("string")), F.lit(buckets)).cast("int"))


def replace_runs(path: str, new: DataFrame, run: str = "run_id", buckets: int = BUCKETS, replaced: DataFrame | None = None) -> None:
    """Replace all rows of the runs in ``new``; only the partitions of those runs are rewritten.

    ``replaced`` lists the runs that were parsed again, those without a row in ``new`` among them: their old
    rows go. Untouched runs that share a partition are kept: their rows are read, joined out of the
    replaced set and written back with the new ones in one partition overwrite. Partitions that
    become empty are removed.
    """
    from ..session import materialize
    spark = new.sparkSession
    fresh = materialize(with_bucket(new, run, buckets))
    gone = fresh.select(run, "run_bucket").distinct()
    if replaced is not None:
        gone = gone.unionByName(with_bucket(replaced.select(run), run, buckets)).distinct()
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    emptied = []
    if old is not None:
        touched = gone.select("run_bucket").distinct()
        kept = old.join(F.broadcast(touched), "run_bucket", "left_semi")  # at most ``buckets`` rows
        kept = kept.join(gone.select(run).distinct(), run, "left_anti")
        fresh = fresh.unionByName(materialize(kept), allowMissingColumns=True)
        emptied = [r[0] for r in touched.join(fresh.select("run_bucket").distinct(), "run_bucket", "left_anti").collect()]  # at most ``buckets``
    (fresh.repartition("run_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_bucket").parquet(path))
    for bucket in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def count_changes(before: DataFrame, after: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows per run before and after a reparse."""
    b = before.groupBy(run).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(run).agg(F.count(F.lit(1)).alias("after"))
    both = b.join(a, run, "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("changed", F.col("before") != F.col("after"))


def backfill(table: DataFrame, core: list[str], recompute, run: str = "run_id") -> DataFrame:
    """Recompute every run that has a row with a null core feature; keep the other runs as they are."""
    missing = F.lit(False)
    for c in core:
        missing = missing | F.col(c).isNull()
    dirty = table.where(missing).select(run).distinct()
    redone = recompute(table.join(dirty, run, "left_semi"))
    return table.join(dirty, run, "left_anti").unionByName(redone)


def first_source_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of record lists; for a repeated key the earliest list's record stays."""
    ranked = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "_source")]
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*rest), "_source").alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_manifest(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Task records from JSON-lines files, the first file winning."""
    return first_source_wins([spark.read.schema(schema).json(p) for p in paths], "task_id")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as one aggregation instead of a window."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_outcomes(runs: DataFrame, resolved: DataFrame, unresolved: DataFrame, run_map: DataFrame,
                   order: list[str]) -> DataFrame:
    """Set ``success`` of the evaluated run of each task, or of its latest run when none is mapped."""
    judged = resolved.select("task_id", F.lit(1).alias("_new")).unionByName(
        unresolved.select("task_id", F.lit(0).alias("_new"))).groupBy("task_id").agg(F.max("_new").alias("_new"))
    mapped = judged.join(run_map.select("task_id", F.col("run_id").alias("_mapped")), "task_id", "left")
    newest = runs.groupBy("task_id").agg(F.max_by("run_id", F.struct(*order)).alias("_newest"))
    goals = mapped.join(newest, "task_id").select(F.coalesce("_mapped", "_newest").alias("run_id"), "_new")
    return runs.join(goals, "run_id", "left").withColumn("success", F.coalesce("_new", "success")).drop("_new")


def fetch_calls(calls: DataFrame, runs: DataFrame | None = None, labelled: Column | None = None,
                tasks: DataFrame | None = None) -> DataFrame:
    """Calls in run order, optionally of some tasks or with labels only."""
    out = calls if runs is None else calls.join(runs, "run_id")
    if labelled is not None:
        out = out.where(labelled)
    if tasks is not None:
        out = out.join(tasks, "task_id", "left_semi")
    return out.orderBy("run_id", "seq")


def export(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def markdown(df: DataFrame) -> DataFrame:
    """Result rows as lines of a markdown table, header first; ``line_no`` keeps their order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame(
        [(-2, "| " + " | ".join(df.columns) + " |"), (-1, "| " + " | ".join(["---"] * len(df.columns)) + " |")], "line_no long, line string")
    return head.unionByName(df.select(F.monotonically_increasing_id().alias("line_no"), cells.alias("line")))
