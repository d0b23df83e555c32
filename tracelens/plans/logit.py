"""Logistic models for many folds, feature masks and label versions at once.

One pass over the rows gives gradient and Hessian of every model: rows stay where they
are, tasks sum small matrices with numpy and Spark adds them up. Only those sums, of
size models x features^2, reach the driver, where the Newton step is a batched solve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators.skew import HOT_ROWS, running
from ..session import materialize
from .association import to_long, with_pvalue
from .evaluate import auc


def _by_value() -> None:
    """Ship this module's functions inside the closures, so executors need no installed package."""
    import sys

    from ..functions import draws
    from . import versions
    for module in (sys.modules[__name__], draws, versions):
        cloudpickle.register_pickle_by_value(module)


#: Folds whose models share one pass over the rows.
FOLD_BLOCK = 256


def fold_of(df: DataFrame, task: str, folds: int | None = None) -> DataFrame:
    """Add ``fold``: one per task, however many there are, or tasks hashed to ``folds`` folds when that is given."""
    if folds is None:
        listed = df.select(task).distinct().withColumn("fold", F.dense_rank().over(Window.orderBy(task)) - 1)  # one row per task
        return df.join(listed, task)
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(task).cast("string")), F.lit(folds)).cast("int"))


def _moments(df: DataFrame, features: list[str], middle: list[float]) -> pd.DataFrame:
    """Per fold: rows, sums and sums of squares of the features less ``middle``. A row a fold."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f, m in zip(features, middle):
        x = F.col(f) - F.lit(m)
        aggs += [F.sum(x).alias(f"s_{f}"), F.sum(x * x).alias(f"q_{f}")]
    return df.groupBy("fold").agg(*aggs).orderBy("fold").toPandas()


def training_scale(df: DataFrame, features: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Mean and population sd of every fold's training rows: totals minus the fold's own, about the mean of all rows."""
    middle = [float(v or 0.0) for v in df.agg(*[F.avg(f) for f in features]).first()]
    m = _moments(df, features, middle)
    n = m["n"].sum() - m["n"].to_numpy(float)
    s, q = (np.column_stack([m[f"{k}_{f}"].sum() - m[f"{k}_{f}"].to_numpy(float) for f in features]) for k in "sq")
    n1 = np.maximum(n, 1)[:, None]
    mean = np.array(middle) + s / n1
    sd = np.sqrt(np.maximum(q / n1 - (s / n1) ** 2, 0.0))
    sd = np.where(sd < 1e-10 * np.maximum(np.abs(mean), 1.0), 1.0, sd)
    return m["fold"].tolist(), n, mean, sd


def newton(df: DataFrame, features: list[str], labels: list[str], folds: list[int], mean: np.ndarray, sd: np.ndarray,
           mask: np.ndarray, penalty: float = 1.0, rounds: int = 60, tol: float = 1e-8):
    """L2 logistic models, one per (fold, label version), each without its fold's rows.

    ``mask`` is (fold, label, feature); the intercept is not penalised. A step that lowers a model's likelihood is halved.
    Returns coefficients on the standardised features, log-likelihood and Hessian at them, and whether the steps
    came to rest: they don't where classes can be separated and nothing is penalised, and the maximum is at infinity.
    """
    _by_value()
    k, r, p = len(folds), len(labels), len(features)
    fold_ids = np.array(folds)
    keep = np.concatenate([np.ones((k, r, 1)), mask], axis=2)
    ridge = np.concatenate([np.zeros((k, r, 1)), np.full((k, r, p), penalty)], axis=2)
    size = p + 1
    best, step = np.zeros((k, r, size)), np.zeros((k, r, size))
    goal, loglik, hess = np.full((k, r), -np.inf), np.zeros((k, r)), np.zeros((k, r, size, size))
    at_rest, open_ = np.zeros((k, r), bool), np.ones((k, r), bool)

    for _ in range(rounds):
        now = best + step

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h, ll = np.zeros((k, r, size)), np.zeros((k, r, size, size)), np.zeros((k, r))
            for b in batches:
                x, y = b[features].to_numpy(float), b[labels].to_numpy(float)
                fold = b["fold"].to_numpy()
                for i in range(k):
                    own = fold != fold_ids[i]
                    if not own.any():
                        continue
                    z = np.column_stack([np.ones(own.sum()), (x[own] - mean[i]) / sd[i]])
                    eta = z @ now[i].T
                    small = np.exp(-np.abs(eta))
                    prob = np.where(eta >= 0, 1, small) / (1 + small)
                    g[i] += (y[own] - prob).T @ z
                    w = prob * (1 - prob)
                    h[i] += (w.T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)).reshape(r, size, size)
                    ll[i] += (y[own] * eta - np.maximum(eta, 0) - np.log1p(small)).sum(axis=0)
            out = np.concatenate([ll[..., None], g, h.reshape(k, r, -1)], axis=2).reshape(k * r, -1)
            yield pd.DataFrame({"model": np.arange(k * r), "v": list(out)})

        parts = df.select("fold", *features, *labels).mapInPandas(sums, "model int, v array<double>")
        width = 1 + size + size * size
        total = parts.groupBy("model").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v")).collect()
        all_v = np.zeros((k * r, width))
        for row in total:
            all_v[row["model"]] = row["v"]
        all_v = all_v.reshape(k, r, width)
        ll, grad, h = all_v[..., 0], all_v[..., 1:1 + size], all_v[..., 1 + size:].reshape(k, r, size, size)
        value = ll - (ridge * now ** 2).sum(axis=2) / 2
        good = open_ & (value >= goal - 1e-12 * (1 + np.abs(value)))
        gain = np.where(good, value - np.where(good, goal, 0), 0)
        best[good], loglik[good], hess[good], goal[good] = now[good], ll[good], h[good], value[good]
        full = h + np.einsum("kra,ab->krab", ridge, np.eye(size))
        full = full * keep[..., :, None] * keep[..., None, :] + np.einsum("kra,ab->krab", 1 - keep + 1e-12, np.eye(size))
        newer = np.linalg.solve(full, ((grad - ridge * now) * keep)[..., None])[..., 0]
        step = np.where(good[..., None], newer, step / 2) * open_[..., None]
        longest = np.abs(step).max(axis=2)
        rest = open_ & (longest < tol)
        stuck = good & (gain < 1e-12 * (1 + np.abs(value))) & (longest > 1e-3)
        at_rest |= rest
        open_ &= ~rest & ~stuck
        step = step * open_[..., None]
        if not open_.any():
            break
    return best, loglik, hess, at_rest


def fit(df: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> dict:
    """One standardised model on all rows without nulls: coefficients with the intercept first, and whether it converged."""
    one = df.dropna(subset=[*features, label]).withColumn("fold", F.lit(0))
    m = one.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = np.array([[m[f"m_{f}"] for f in features]], float)
    sd = np.array([[m[f"s_{f}"] or 1.0 for f in features]], float)
    mask = np.ones((1, 1, len(features)))
    beta, ll, hess, ok = newton(one, features, [label], [-1], mean, sd, mask, penalty)
    return {"beta": beta[0, 0], "loglik": float(ll[0, 0]), "hessian": hess[0, 0], "converged": bool(ok[0, 0]), "mean": mean[0], "sd": sd[0]}


def predict(df: DataFrame, features: list[str], labels: list[str], folds: list[int], mean, sd, beta, base, single, one_class: str = "skip") -> DataFrame:
    """Out-of-fold scores in long form: the row's columns, label version ``rep``, ``y`` and ``score``.

    A training set with one class gives no score (``skip``) or its rate (``rate``).
    """
    _by_value()
    ids = [c for c in df.columns if c not in features and c not in labels]
    at = {f: i for i, f in enumerate(folds)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = b["fold"].map(at).to_numpy()
            z = (b[features].to_numpy(float) - mean[i]) / sd[i]
            eta = np.einsum("np,nrp->nr", z, beta[i][..., 1:]) + beta[i][..., 0]
            prob = np.where(single[i], base[i], 1 / (1 + np.exp(-np.clip(eta, -700, 700))))
            for r, name in enumerate(labels):
                out = b[ids].assign(rep=r, y=b[name].to_numpy(int), score=prob[:, r])
                yield out[~single[i][:, r]] if one_class == "skip" else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in ids)
    return df.mapInPandas(score, f"{schema}, rep int, y int, score double")


def _select(df: DataFrame, features: list[str], labels: list[str], folds: list[int], strata: str, focal: list[str],
            rho: float, p: float, min_n: int, limit: int) -> np.ndarray:
    """Which features each fold keeps, from correlations within focal strata of its training rows.

    Ranks without a fold come from one table of counts by (stratum, feature, value, fold): a value's rank among
    the others is its rank among all less what the fold has below it. Between two values of a fold that is one
    number, so sums of ranks, of their squares and of their products with labels are differences of running sums
    over all values: no row is repeated per fold.
    """
    keys, count = ["stratum", "feature"], range(len(labels))
    here = df.where(F.col(strata).isin(focal)).select("fold", F.col(strata).cast("string").alias("stratum"), *features, *labels)
    long = to_long(here, ["fold", "stratum", *labels], features).where("x IS NOT NULL")
    cells = materialize(long.groupBy(*keys, "x", "fold").agg(F.count(F.lit(1)).cast("double").alias("c"), *[F.sum(y).cast("double").alias(f"y{i}") for i, y in enumerate(labels)]))
    all_ = cells.groupBy(*keys, "x").agg(F.sum("c").alias("c"), *[F.sum(f"y{i}").alias(f"y{i}") for i in count])
    at = running(all_, keys, "x", ["c"], limit).withColumn("b", F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2)
    weighted = {"c": F.col("c"), "cb": F.col("c") * F.col("b"), "cbb": F.col("c") * F.col("b") * F.col("b")}
    weighted |= {f"y{i}": F.col(f"y{i}") for i in count} | {f"y{i}b": F.col(f"y{i}") * F.col("b") for i in count}
    names = list(weighted)
    sums = at.select(*keys, "x", "b", *[v.alias(k) for k, v in weighted.items()])
    sums = materialize(running(sums, keys, "x", names, limit))
    totals = sums.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    # a fold's values in order: what the fold has below, and the running sums of all rows below each
    own = cells.select(*keys, "fold", "x", F.col("c").alias("fc"), *[F.col(f"y{i}").alias(f"fy{i}") for i in count]).join(sums, [*keys, "x"])
    order = Window.partitionBy(*keys, "fold").orderBy("x")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("below", F.coalesce(F.sum("fc").over(before), F.lit(0.0)))
    for c in names:
        own = own.withColumn(f"gap_{c}", F.col(f"cum_{c}") - F.col(c) - F.coalesce(F.lag(f"cum_{c}").over(order), F.lit(0.0)))
    c0, r0 = F.col("c") - F.col("fc"), F.col("b") - F.col("below") - F.col("fc") / 2
    n0 = F.col("below")
    of_y = lambda i, gap, m: gap(f"y{i}b") - m * gap(f"y{i}")
    gap = lambda c: F.col(f"gap_{c}")
    part = own.groupBy(*keys, "fold").agg(
        F.sum("fc").alias("m"), *[F.max(f"cum_{c}").alias(f"last_{c}") for c in names],
        F.sum(gap("cb") - n0 * gap("c") + c0 * r0).alias("r"), F.sum(gap("cbb") - 2 * n0 * gap("cb") + n0 * n0 * gap("c") + c0 * r0 * r0).alias("rr"),
        *[F.sum(f"fy{i}").alias(f"fy{i}") for i in count], *[F.sum(of_y(i, gap, n0) + (F.col(f"y{i}") - F.col(f"fy{i}")) * r0).alias(f"ry{i}") for i in count])
    tail, m = lambda c: F.col(f"t_{c}") - F.coalesce(F.col(f"last_{c}"), F.lit(0.0)), F.coalesce(F.col("m"), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    each = totals.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds])))  # a row a (stratum, feature, fold)
    done = each.join(part, [*keys, "fold"], "left").select(
        "feature", "fold", (F.col("t_c") - m).alias("n"), (zero("r") + tail("cb") - m * tail("c")).alias("r"),
        (zero("rr") + tail("cbb") - 2 * m * tail("cb") + m * m * tail("c")).alias("rr"),
        F.posexplode(F.array(*[F.struct((F.col(f"t_y{i}") - zero(f"fy{i}")).alias("y"), (zero(f"ry{i}") + of_y(i, tail, m)).alias("ry")) for i in count])).alias("rep", "s"))
    vr, vy = F.col("n") * F.col("rr") - F.col("r") ** 2, F.col("n") * F.col("s.y") - F.col("s.y") ** 2
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("n") * F.col("s.ry") - F.col("r") * F.col("s.y"), F.sqrt(vr * vy))))
    found = done.where((vr > 1e-12 * F.col("n") * F.col("rr")) & (vy > 0) & (F.col("n") >= min_n)).select("fold", "feature", "rep", "n", value.alias("rho"))
    hits = with_pvalue(found.where(F.abs("rho") > rho)).where(F.col("p") < p).select("fold", "rep", "feature").distinct().toPandas()
    mask = np.zeros((len(folds), len(labels), len(features)))
    place = {f: i for i, f in enumerate(folds)}
    mask[hits["fold"].map(place).to_numpy(int), hits["rep"].to_numpy(int), hits["feature"].map(features.index).to_numpy(int)] = 1
    mask[mask.sum(axis=2) == 0] = 1  # nothing passes: use all features
    return mask


def cross_validate(df: DataFrame, features: list[str], labels: list[str], task: str, folds: int | None = None, penalty: float = 1.0,
                   select_in: tuple[str, list[str]] | None = None, rho: float = 0.15, p: float = 0.10, min_n: int = 5,
                   limit: int = HOT_ROWS, one_class: str = "skip") -> tuple[DataFrame, dict[str, float]]:
    """Leave-task-out predictions for each label version, and each feature's selection share.

    Every task is left out by itself, in blocks of folds per pass; with ``folds`` tasks are hashed to that
    many folds, a task never split. Nothing depends on the number of tasks. ``select_in`` = (stratum column,
    focal strata) turns on feature selection inside each fold. A training set with one class is skipped, or
    predicts its rate with ``one_class="rate"``. Rows with a null feature or label are left out.
    """
    df = df.dropna(subset=[*features, *labels])
    keep = [task] + ([select_in[0]] if select_in else [])
    cast = [F.col(f).cast("double").alias(f) for f in features]
    base = fold_of(df, task, folds)
    unit = [c for c in df.columns if c not in features and c not in labels and c not in keep]
    rows = materialize(base.select(*unit, *keep, "fold", *cast, *[F.col(c).cast("int").alias(c) for c in labels]))
    ids, n, mean, sd = training_scale(rows, features)
    pos = rows.groupBy("fold").agg(*[F.sum(c).alias(c) for c in labels]).orderBy("fold").toPandas()
    rate = np.column_stack([pos[c].sum() - pos[c].to_numpy(float) for c in labels]) / np.maximum(n, 1)[:, None]
    single = (rate <= 0) | (rate >= 1)
    mask = np.ones((len(ids), len(labels), len(features)))
    if select_in:
        mask = _select(rows, features, labels, ids, select_in[0], select_in[1], rho, p, min_n, limit)
    preds = None
    for i in range(0, len(ids), FOLD_BLOCK):
        at = slice(i, i + FOLD_BLOCK)
        beta, *_ = newton(rows, features, labels, ids[at], mean[at], sd[at], mask[at], penalty)
        own = rows if len(ids) <= FOLD_BLOCK else rows.where(F.col("fold").isin(ids[at]))
        part = predict(own, features, labels, ids[at], mean[at], sd[at], beta, rate[at], single[at], one_class)
        preds = part if preds is None else preds.unionByName(part)
    share = {f: float(mask[:, 0, j].mean()) for j, f in enumerate(features)}
    return preds, share


def shuffled_versions(df: DataFrame, strata: str, label: str, unit: str, reps: int, seed: int = 123, start: int = 0) -> tuple[DataFrame, list[str]]:
    """Label permutations within strata as extra columns ``y0`` (the labels) and ``y1`` … (shuffles from ``start``)."""
    from .resample import shuffle_labels
    names = [f"y{i + 1}" for i in range(reps)]
    mixed = shuffle_labels(df.select(strata, label, unit), strata, label, unit, reps, seed, start)
    wide = mixed.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("rep", "shuffled"))).alias("_v"))
    return df.withColumn("y0", F.col(label)).join(wide.select(unit, *[F.col("_v")[F.lit(start + i).cast(dict(mixed.dtypes)["rep"])].alias(c) for i, c in enumerate(names)]), unit), ["y0", *names]


#: Label versions that share the passes of one cross-validation; rows of a table that tasks hold whole; cells (versions x rows) of a task.
VERSIONS_AT_ONCE, TABLE_ROWS, CELLS = 50, 1_000_000, 4_000_000


def permuted_auc(df: DataFrame, features: list[str], label: str, task: str, strata: str, unit: str, reps: int,
                 select_in: tuple[str, list[str]] | None = None, at_once: int = VERSIONS_AT_ONCE, seed: int = 123, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(rep, auc): the AUC of the whole cross-validation with the labels (rep 0) and with labels shuffled within strata.

    Every shuffle selects features and fits anew in each fold. A table of at most ``table_rows`` runs is broadcast
    packed, and tasks own blocks of label versions; a larger one stays distributed and versions share passes over its rows,
    ``at_once`` of them. Neither changes a result. Rows with nulls are left out.
    """
    named = list(dict.fromkeys([unit, task, strata, label, *features] + ([select_in[0]] if select_in else [])))
    whole = df.select(*named).dropna()
    if whole.limit(table_rows + 1).count() <= table_rows:
        return materialize(_by_version(whole, features, label, task, strata, unit, reps, select_in, seed))
    found = []  # a number a version
    for start in range(0, reps, at_once):
        many = min(at_once, reps - start)
        wide, names = shuffled_versions(whole, strata, label, unit, many, seed, start)
        used = names if start == 0 else names[1:]
        keep = [c for c in wide.columns if c not in names and c != label]
        p, _ = cross_validate(wide.select(*keep, *used), features, used, task, select_in=select_in)
        first = 0 if start == 0 else start + 1
        scored = p.select("rep", F.round("score", 12).alias("score"), "y")
        found += [(r["rep"] + first, r["auc"]) for r in auc(scored, ["rep"], "score", "y").select("rep", "auc").collect()]
    return df.sparkSession.createDataFrame(found, "rep int, auc double")


def _codes(names: pa.ChunkedArray) -> np.ndarray:
    """The place of each name among the distinct ones in order."""
    found = names.combine_chunks().dictionary_encode()
    found = found if isinstance(found, pa.DictionaryArray) else found.combine_chunks()
    distinct = found.dictionary.to_pylist()
    place = np.empty(len(distinct), np.int64)
    place[sorted(range(len(distinct)), key=distinct.__getitem__)] = np.arange(len(distinct))
    return place[found.indices.to_numpy(zero_copy_only=False)]


def _by_version(df: DataFrame, features: list[str], label: str, task: str, strata: str, unit: str, reps: int, select_in: tuple[str, list[str]] | None,
                seed: int, penalty: float = 1.0, rho: float = 0.15, p: float = 0.10, min_n: int = 5) -> DataFrame:
    from ..functions.draws import unit_numbers
    from .versions import Table
    _by_value()
    first, second = unit_numbers(unit)
    focal = F.lit(-1)
    for i, s in enumerate(select_in[1] if select_in else []):
        focal = F.when(F.col(select_in[0]) == s, i).otherwise(focal)
    columns = [f"x{i}" for i in range(len(features))]
    rows = df.select(F.col(unit).alias("unit"), F.col(task).cast("string").alias("task"), F.col(strata).cast("string").alias("stratum"), F.col(label).cast("int").alias("y"),
                     first.alias("u1"), second.alias("u2"), focal.alias("focal"), *[F.col(f).cast("double").alias(c) for f, c in zip(features, columns)])
    t = rows.orderBy("unit").drop("unit").toArrow()  # at most table_rows rows of a few numbers, and never a Python object a row
    spark = df.sparkSession
    x = np.empty((t.num_rows, len(features)))
    for i, c in enumerate(columns):
        x[:, i] = t[c].to_numpy()
    table = spark.sparkContext.broadcast(Table(
        x, t["y"].to_numpy(), _codes(t["task"]), _codes(t["stratum"]), t["u1"].to_numpy(), t["u2"].to_numpy(), t["focal"].to_numpy() if select_in else None))
    block = max(1, min(VERSIONS_AT_ONCE, CELLS // max(len(x), 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["id"]:
                versions = np.arange(first * block, min((first + 1) * block, reps + 1))
                yield pd.DataFrame({"rep": versions.astype(np.int32), "auc": pd.array(table.value.aucs(seed, versions, penalty, rho, p, min_n), "Float64")})

    blocks = -(-(reps + 1) // block)
    return spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "rep int, auc double")


def stratum_logit(df: DataFrame, features: list[str], strata: str, label: str, top: int = 3) -> list[tuple]:
    """Per feature, label ~ standardised feature + stratum dummies in the largest strata.

    The null model and all feature models are label versions with different masks, so they
    share every pass. Rows (feature, n, coef, wald, lr, converged); ``stratum_logit_table`` adds tails. Where a feature
    separates the classes the maximum is at infinity: such a row has no tests and ``converged`` is false.
    """
    counts = df.groupBy(strata).count().orderBy(F.desc("count"), strata).limit(top).collect()
    names = [r[strata] for r in counts]
    dummies = [f"_d{i}" for i in range(1, len(names))]
    rows = df.where(F.col(strata).isin(names)).dropna(subset=features)
    for d, s in zip(dummies, names[1:]):
        rows = rows.withColumn(d, (F.col(strata) == s).cast("double"))
    versions = [f"_y{j}" for j in range(len(features) + 1)]
    cols = [*features, *dummies]
    rows = materialize(rows.select(
        F.lit(0).alias("fold"), *[F.col(c).cast("double").alias(c) for c in cols], *[F.col(label).cast("int").alias(v) for v in versions]))
    m = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    mean = np.array([[m[f"m_{c}"] for c in cols]], float)
    sd = np.array([[m[f"s_{c}"] or 1.0 for c in cols]], float)
    mask = np.zeros((1, len(versions), len(cols)))
    mask[0, :, len(features):] = 1
    for j in range(len(features)):
        mask[0, j + 1, j] = float(m[f"s_{features[j]}"] > 0)
    beta, ll, hess, ok = newton(rows, cols, versions, [-1], mean, sd, mask, penalty=0.0)
    unit = np.sqrt(m["n"] / (m["n"] - 1))
    out = []
    for j, f in enumerate(features):
        if not mask[0, j + 1, j]:
            continue
        if not (ok[0, j + 1] and ok[0, 0]):
            out.append((f, int(m["n"]), None, None, None, False))
            continue
        used = [0, j + 1, *range(len(features) + 1, len(cols) + 1)]
        se = np.sqrt(np.linalg.inv(hess[0, j + 1][np.ix_(used, used)])[1, 1])
        b = beta[0, j + 1, j + 1]
        out.append((f, int(m["n"]), float(b * unit), float(b / se), float(max(2 * (ll[0, j + 1] - ll[0, 0]), 0.0)), True))
    return out


def stratum_logit_table(df: DataFrame, features: list[str], strata: str, label: str, top: int = 3) -> DataFrame:
    rows = stratum_logit(df, features, strata, label, top)
    out = df.sparkSession.createDataFrame(rows, "feature string, n long, coef double, wald double, lr double, converged boolean")
    return out.withColumn("p", special.normal_pvalue("wald")).withColumn("lr_p", special.chi2_1df_pvalue("lr"))


#: Logarithms of the least and greatest variance ratio looked at; points of a pass; passes.
RATIOS, POINTS, PASSES = (-14.0, 8.0), 64, 5


def random_intercept(df: DataFrame, features: list[str], strata: str, label: str) -> DataFrame:
    """ML linear model label ~ feature with a random intercept per stratum, and its LR test.

    The likelihood needs six sums per (feature, stratum). The variance ratio that maximises it is bracketed for all
    features at once, in Spark over those sums, until the bracket is below 1e-6 of its logarithm; ``border`` tells that the best ratio is 0 or
    the largest looked at.
    """
    long = to_long(df.select(strata, F.col(label).cast("double").alias("_y"), *features), [strata, "_y"], features).where("x is not null")
    scale = long.groupBy("feature").agg(F.avg("x").alias("_mx"), F.stddev_pop("x").alias("_sx")).where("_sx > 1e-10")
    std = long.join(F.broadcast(scale), "feature").withColumn("x", (F.col("x") - F.col("_mx")) / F.col("_sx"))
    x, y = F.col("x"), F.col("_y")
    sums = materialize(std.groupBy("feature", strata).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.max("_sx").alias("_sx")))

    def profile(grid: DataFrame) -> DataFrame:
        """Log-likelihoods of both models at each variance ratio g (stratum variance / residual variance)."""
        j = sums.join(grid, "feature")
        s = F.col("g") / (1 + F.col("n") * F.col("g"))
        a = j.groupBy("feature", "g").agg(
            F.sum("n").alias("N"), F.sum(F.log(1 + F.col("n") * F.col("g"))).alias("ld"), F.max("_sx").alias("_sx"),
            F.sum(F.col("n") - s * F.col("n") ** 2).alias("a00"), F.sum(F.col("sx") - s * F.col("n") * F.col("sx")).alias("a01"),
            F.sum(F.col("sxx") - s * F.col("sx") ** 2).alias("a11"), F.sum(F.col("sy") - s * F.col("n") * F.col("sy")).alias("b0"),
            F.sum(F.col("sxy") - s * F.col("sx") * F.col("sy")).alias("b1"), F.sum(F.col("syy") - s * F.col("sy") ** 2).alias("c"))
        det = F.col("a00") * F.col("a11") - F.col("a01") ** 2
        b = (F.col("a00") * F.col("b1") - F.col("a01") * F.col("b0")) / det
        b_0 = (F.col("a11") * F.col("b0") - F.col("a01") * F.col("b1")) / det
        rss1 = F.col("c") - b_0 * F.col("b0") - b * F.col("b1")
        rss0 = F.col("c") - F.col("b0") ** 2 / F.col("a00")
        ll = lambda rss: -F.col("N") / 2 * (F.log(2 * F.pi() * F.greatest(rss, F.lit(1e-300)) / F.col("N")) + 1) - F.col("ld") / 2
        se = F.sqrt(rss1 / F.col("N") * F.col("a00") / det)
        return a.select("feature", "g", F.col("N").cast("long").alias("n"), "_sx", b.alias("b"), se.alias("se"), ll(rss1).alias("ll1"), ll(rss0).alias("ll0"))

    # each pass keeps the points next to the best one, a thirty-second of the bracket
    low, high = RATIOS
    spread = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda i: F.exp(F.col(a) + (F.col(b) - F.col(a)) * i / POINTS))
    bracket = sums.select("feature").distinct().select("feature", *[F.lit(v).alias(c) for c, v in (("a1", low), ("b1", high), ("a0", low), ("b0", high))])
    for step in range(PASSES):
        grid = bracket.select("feature", F.explode(F.array_distinct(F.concat(spread("a1", "b1"), spread("a0", "b0")))).alias("g"))
        best = profile(grid).groupBy("feature").agg(F.max_by("g", "ll1").alias("g1"), F.max_by("g", "ll0").alias("g0"))
        width = (high - low) / POINTS * (2 / POINTS) ** step
        around = [(F.greatest(F.lit(low), F.log(g) - width).alias(f"a{i}"), F.least(F.lit(high), F.log(g) + width).alias(f"b{i}")) for i, g in ((1, "g1"), (0, "g0"))]
        bracket = materialize(best.select("feature", *around[0], *around[1]))
    middle = lambda i: F.exp((F.col(f"a{i}") + F.col(f"b{i}")) / 2)
    grid = bracket.select("feature", F.explode(F.array(F.lit(0.0), middle(1), middle(0), F.exp(F.lit(high)))).alias("g"))
    top = profile(grid).groupBy("feature").agg(
        F.max_by(F.struct("n", "b", "se", "g", "_sx"), "ll1").alias("m"), F.max("ll1").alias("ll1"), F.max("ll0").alias("ll0"))
    out = top.select("feature", F.col("m.n").alias("n"), (F.col("m.b") / F.col("m._sx")).alias("coef"), (F.col("m.se") / F.col("m._sx")).alias("se"),
                     F.col("m.g").alias("ratio"), ((F.col("m.g") == 0) | (F.col("m.g") >= F.exp(F.lit(high)))).alias("border"), F.greatest(2 * (F.col("ll1") - F.col("ll0")), F.lit(0.0)).alias("lr"))
    return out.withColumn("z", F.col("coef") / F.col("se")).withColumn("p", special.normal_pvalue("z")).withColumn("lr_p", special.chi2_1df_pvalue("lr"))
