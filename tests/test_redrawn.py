"""Bootstraps: redrawing in a task against grouping by (replicate, row), and the ranges of scores against one range."""

import random

import pytest
from pyspark.sql import functions as F

from tracelens.plans import resample as R


@pytest.fixture(scope="module")
def preds(spark):
    rnd = random.Random(8)
    rows = [(i, f"t{rnd.randrange(9)}", float("nan") if i % 61 == 0 else rnd.randrange(40) / 40, int(rnd.random() < 0.7)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, task string, score double, y int").cache()


def result(df, value):
    return {r.rep: r[value] for r in df.collect()}


def test_rows_redrawn_in_a_task(preds):
    got = result(R.bootstrap_auc(preds, "score", "y", "id", 30, at_once=7), "auc")
    want = result(R.bootstrap_auc(preds, "score", "y", "id", 30, whole=0), "auc")
    assert len(got) == 30 and got == pytest.approx(want, abs=1e-12)
    plan = R.bootstrap_auc(preds, "score", "y", "id", 30)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "md5" not in plan  # no row a draw


@pytest.mark.parametrize("limit,at_once", [(200_000, 250), (60, 7)])
def test_clusters_redrawn_by_ranges_of_scores(preds, monkeypatch, limit, at_once):
    auc = result(R.block_bootstrap_auc(preds, "task", "score", "y", 30, limit=limit, at_once=at_once), "auc")
    ap = result(R.block_bootstrap_precision(preds, "task", "score", "y", 30, limit=limit, at_once=at_once), "average_precision")
    monkeypatch.setattr(R, "MOST_CLUSTERS", 0)
    assert len(auc) == 30 and auc == pytest.approx(result(R.block_bootstrap_auc(preds, "task", "score", "y", 30), "auc"), abs=1e-12)
    assert len(ap) == 30 and ap == pytest.approx(result(R.block_bootstrap_precision(preds, "task", "score", "y", 30), "average_precision"), abs=1e-12)


def test_one_class_and_no_rows(preds):
    assert R.bootstrap_auc(preds.where("y = 1"), "score", "y", "id", 3).count() == 0
    assert R.block_bootstrap_auc(preds.where("y = 1"), "task", "score", "y", 3).count() == 0
    assert R.block_bootstrap_precision(preds.where(F.lit(False)), "task", "score", "y", 3).count() == 0
    assert R.bootstrap_auc(preds.where(F.lit(False)), "score", "y", "id", 3).count() == 0
