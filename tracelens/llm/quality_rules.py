"""Quality rules: a decision list learned by sequential covering.

Each round grows one conjunction of thresholds that covers rejected documents (greatest gain first), prunes
it on rows it wasn't grown on, keeps it if it is precise there, and goes on with the documents that
it doesn't cover. The list becomes one ordered Spark conditional expression over the statistics.
Rules are learned from at most ``TRAIN_ROWS`` labelled rows outside the held-out part.

Defined cases: null and empty texts have zero counts and fail the base rule; without labelled rows of both
kinds no rule is learned and the base rule alone decides; repeated rows and ids give a row each; other columns are
left out and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_ids
from .statistics import COUNTS, SHARES, statistics
from .textnum import blocks, flat

TRAIN_ROWS = 50_000
CUTS, CONDITIONS, RULES = 32, 4, 12
PRECISION = 0.9


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.value if self.above else x <= self.value

    def sql(self) -> F.Column:
        return F.col(self.column) > self.value if self.above else F.col(self.column) <= self.value


Rule = tuple[Condition, ...]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts and the shares of each whole text."""
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            parts = [statistics(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in blocks(offsets)]
            columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            columns += [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.float64()) for c in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(len(extra))], *columns], ["doc_id", *extra, *COUNTS, *SHARES])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *extra)
    kinds = dict(slim.dtypes)
    schema = ", ".join(["doc_id long", *[f"{c} {kinds[c]}" for c in extra], *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in SHARES]])
    return slim.mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.column])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1]))
            # middles between neighbours, so that the threshold isn't a value of the data
            order = np.unique(v)
            at = np.minimum(np.searchsorted(order, cuts, "right"), len(order) - 1)
            cuts = np.unique((cuts + order[at]) / 2)
            under = v[:, None] <= cuts[None, :]
            for above in (False, True):
                hit = ~under if above else under
                p, n = (hit & b[:, None]).sum(0), (hit & ~b[:, None]).sum(0)
                g = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Condition(name, above, float(cuts[i])), float(g[i])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x[best.column])
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _covered(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most: int = RULES, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules; a document that one of them covers is rejected."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    rng = np.random.default_rng(3)
    misses = 0
    while len(rules) < most and misses < 3 and bad[left].any() and (~bad[left]).any():
        shuffled = rng.permutation(left)
        grow, prune = shuffled[: -(-2 * len(left) // 3)], shuffled[-(-2 * len(left) // 3):]
        if not bad[grow].any() or not len(prune):
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        part = {k: v[prune] for k, v in x.items()}
        while len(rule) > 1 and _worth(rule[:-1], part, bad[prune]) >= _worth(rule, part, bad[prune]):
            rule = rule[:-1]
        if not rule or _worth(rule, part, bad[prune]) < 2 * precision - 1:
            misses += 1
            continue
        rules.append(rule)
        left = left[~_covered(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def as_expression(rules: list[Rule]) -> F.Column:
    """1 where the first rule that holds rejects, else 0, as one ordered conditional."""
    out = None
    for rule in rules:
        test = rule[0].sql()
        for c in rule[1:]:
            test = test & c.sql()
        out = F.when(test, 1) if out is None else out.when(test, 1)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from the statistics of labelled documents that pass the base rule."""
    chosen = training_ids(labels, most)
    rows = docs.withColumnRenamed(id_col, "id").join(F.broadcast(chosen), "id").select(F.col("id"), F.col(f"`{text_col}`").alias("text"), F.col("label"))
    got = text_statistics(rows, "id", "text", ("label",)).where(~base_failed()).select("doc_id", "label", *SHARES).toArrow().sort_by("doc_id")
    x = {c: got[c].to_numpy() for c in SHARES}
    return learn(x, got["label"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row."""
    rejected = as_expression(learn_rules(docs.select(id_col, text_col), labels, id_col, text_col, most))
    return text_statistics(docs, id_col, text_col).select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & (rejected == 0)).alias("kept"))
