"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), which takes time in
proportion to the features that a text has. The words of the whole text (A-Z lower-cased) fall into
``BUCKETS`` hashed features whose counts are scaled to length one; statistics and metadata are
standardised. Labels, language, source and id are no inputs. The model is fitted on at most ``TRAIN_ROWS``
labelled rows outside the held-out part; every document is scored.

Defined cases: null and empty texts have no words and zero statistics and get a score like others; a
null metadata value counts as the training mean; without labelled rows of both kinds the score is the share of
label 1 (0.5 without any); repeated rows and ids give a row each; other columns are ignored and
may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import array_of
from .labelled import held_out, training_ids
from .statistics import SHARES, lower_words, statistics
from .textnum import U64, blocks, flat

BUCKETS, FACTORS = 1 << 15, 8
TRAIN_ROWS = 12_000
ROUNDS, BATCH, RATE, DECAY = 6, 64, 0.08, 1e-5
KEEP = 0.7


def features(column):
    """Per block of texts: structure statistics, and (first, bucket, value) of hashed words."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        stats = statistics(part, at)
        words, first = lower_words(part, at)
        n = j - i
        key = np.sort((np.repeat(np.arange(n), np.diff(first)) << 20) | (words % U64(BUCKETS)).astype(np.int64))
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key))).astype(np.float64)
        key = key[new]
        row = key >> 20
        norm = np.sqrt(np.bincount(row, count * count, n))
        yield np.stack([stats[s] for s in SHARES], 1), np.searchsorted(row, np.arange(n + 1)), (key & 0xFFFFF).astype(np.int32), (count / norm[row]).astype(np.float32)


class Machine:
    """A fitted factorisation machine; ``score`` takes features as above and metadata columns."""

    def __init__(self, dense: int):
        rng = np.random.default_rng(7)
        self.size = BUCKETS + dense
        self.bias = 0.0
        self.weight = np.zeros(self.size, np.float32)
        self.factor = rng.normal(0, 0.01, (self.size, FACTORS)).astype(np.float32)
        self.mean, self.scale = np.zeros(dense), np.ones(dense)
        self.constant: float | None = None

    def _dense(self, dense: np.ndarray) -> np.ndarray:
        filled = np.where(np.isfinite(dense), dense, self.mean)
        return np.clip((filled - self.mean) / self.scale, -4, 4).astype(np.float32) / np.float32(np.sqrt(dense.shape[1]))

    def _parts(self, dense, first, bucket, value):
        """One list of features per row: its words, then the dense ones."""
        n, d = dense.shape
        size = np.diff(first)
        at = first + np.arange(n + 1) * d
        idx, x = np.empty(int(at[-1]), np.int32), np.empty(int(at[-1]), np.float32)
        tail = (at[1:, None] - d + np.arange(d)).ravel()
        words = np.ones(len(idx), bool)
        words[tail] = False
        idx[words], x[words] = bucket, value
        idx[tail], x[tail] = np.tile(np.arange(BUCKETS, BUCKETS + d), n), dense.ravel()
        return np.repeat(np.arange(n), size + d), at, idx, x

    def _margin(self, at, idx, x):
        vx = self.factor[idx] * x[:, None]
        total = np.add.reduceat(vx, at[:-1], axis=0)
        square = np.add.reduceat((vx * vx).sum(1), at[:-1])
        linear = np.add.reduceat(self.weight[idx] * x, at[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(1) - square), vx, total

    def score(self, dense, first, bucket, value) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(dense), self.constant)
        _, at, idx, x = self._parts(self._dense(dense), first, bucket, value)
        margin = self._margin(at, idx, x)[0] if len(dense) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple], labels: np.ndarray) -> None:
        """rows: (dense, bucket, value) of each labelled document."""
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        dense = np.stack([r[0] for r in rows])
        self.mean = np.nan_to_num(np.nanmean(np.where(np.isfinite(dense), dense, np.nan), 0))
        self.scale = np.maximum(np.nan_to_num(np.nanstd(np.where(np.isfinite(dense), dense, np.nan), 0)), 1e-6)
        dense = self._dense(dense)
        rng = np.random.default_rng(11)
        sums = [np.full_like(self.weight, 1e-6), np.full_like(self.factor, 1e-6), 1e-6]
        for _ in range(ROUNDS):
            for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
                first = np.concatenate(([0], np.cumsum([len(rows[i][1]) for i in part])))
                row, at, idx, x = self._parts(dense[part], first, np.concatenate([rows[i][1] for i in part]), np.concatenate([rows[i][2] for i in part]))
                margin, vx, total = self._margin(at, idx, x)
                slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)).astype(np.float32)[row]
                used, inverse = np.unique(idx, return_inverse=True)
                g = slope * x
                gw = np.bincount(inverse, g, len(used)).astype(np.float32) + DECAY * self.weight[used]
                gv = np.zeros((len(used), FACTORS), np.float32)
                np.add.at(gv, inverse, g[:, None] * (total[row] - vx))
                gv += DECAY * self.factor[used]
                gb = float(slope[at[:-1]].sum())
                sums[0][used] += gw * gw
                sums[1][used] += gv * gv
                sums[2] += gb * gb
                self.weight[used] -= RATE * gw / np.sqrt(sums[0][used])
                self.factor[used] -= RATE * gv / np.sqrt(sums[1][used])
                self.bias -= RATE * gb / np.sqrt(sums[2])


def _slim(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       *[F.log1p(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"meta_{i}") for i, c in enumerate(metadata)])


def _meta(batch: pa.RecordBatch, skip: int) -> np.ndarray:
    columns = [batch.column(i).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(skip, batch.num_columns)]
    return np.stack(columns, 1) if columns else np.zeros((batch.num_rows, 0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",),
        most: int = TRAIN_ROWS) -> Machine:
    """Fit on the labelled rows' features, which Spark makes and packs; at most ``most`` rows come to the driver."""
    def pack(batches):
        for batch in batches:
            meta, at = _meta(batch, 3), 0
            for dense, first, bucket, value in features(batch.column("text")):
                n = len(dense)
                dense = np.concatenate([dense, meta[at:at + n]], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, n), batch.column("label").slice(at, n), pa.array([d.tobytes() for d in dense], pa.binary()),
                     pa.array([bucket[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                     pa.array([value[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "label", "dense", "bucket", "value"])
                at += n

    chosen = training_ids(labels, most)
    rows = _slim(docs, id_col, text_col, metadata).join(F.broadcast(chosen), "id").select("id", "label", "text", *[f"meta_{i}" for i in range(len(metadata))])
    packed = rows.mapInArrow(pack, "id long, label int, dense binary, bucket binary, value binary").toArrow().sort_by("id")
    found = [(array_of(d, np.float64), array_of(b, np.int32), array_of(v, np.float32)) for d, b, v in
             zip(packed["dense"].to_pylist(), packed["bucket"].to_pylist(), packed["value"].to_pylist(), strict=True)]
    machine = Machine(len(SHARES) + len(metadata))
    machine.fit(found, np.array(packed["label"].to_pylist(), np.float32))
    return machine


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",),
             keep: float = KEEP, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, metadata, most))

    def score(batches):
        for batch in batches:
            meta, at, out = _meta(batch, 2), 0, []
            for dense, first, bucket, value in features(batch.column("text")):
                out.append(shared.value.score(np.concatenate([dense, meta[at:at + len(dense)]], 1), first, bucket, value))
                at += len(dense)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return _slim(docs, id_col, text_col, metadata).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",),
              keep: float = KEEP, most: int = TRAIN_ROWS) -> DataFrame:
    """The documents, with all their columns, that score ``keep`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, metadata, most))

    def run(batches):
        for batch in batches:
            meta = [np.log1p(np.maximum(batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), 0)) for c in metadata]
            meta, at, good = np.stack(meta, 1) if meta else np.zeros((batch.num_rows, 0)), 0, []
            for dense, first, bucket, value in features(batch.column(text_col)):
                good.append(shared.value.score(np.concatenate([dense, meta[at:at + len(dense)]], 1), first, bucket, value) >= keep)
                at += len(dense)
            yield batch.filter(pa.array(np.concatenate(good) if good else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
