"""Fits side by side, the churn model choice, k-means starts."""
import pytest
from pyspark.sql import functions as F

from ledgerlens import catalog as C
from ledgerlens.models import churn, fitting, segmentation
from tests.conftest import SF_SMALL


def test_jobs_side_by_side_keep_their_order_and_raise():
    assert fitting.side_by_side([lambda i=i: i * i for i in range(20)], 3) == [i * i for i in range(20)]

    def fails():
        raise ValueError("this one")
    with pytest.raises(ValueError, match="this one"):
        fitting.side_by_side([lambda: 1, fails, lambda: 2])


def test_model_choice_and_its_metrics(spark, monkeypatch):
    monkeypatch.setitem(churn.GBT_PARAMS, "maxIter", 5)
    feats = C._features(spark, SF_SMALL)
    choice = churn.train_churn_model(feats, folds=3)
    rows = {r.model: r for r in choice.metrics.collect()}
    assert set(rows) == {"lr", "gbt"} and [k for k, r in rows.items() if r.chosen] == [choice.kind]
    assert rows[choice.kind].cv_auc == max(r.cv_auc for r in rows.values())
    held_out = feats.join(churn.stratified_split(feats.select("customer_id", F.col("churn").cast("double").alias("label"))), "customer_id").filter("is_test")
    assert choice.predictions.count() == 2 * held_out.count()
    for r in churn.check_choice(choice).collect():
        assert r.auc_again and r.f1_again and r.counts_again and r.chosen_is_best and r.holdout == held_out.count()
    # metrics that are not those of the predictions do not pass
    bad = churn.ChurnChoice(choice.model, choice.kind, choice.metrics.withColumn("tp", F.col("tp") + 1).withColumn("auc", F.lit(0.123)), choice.predictions)
    assert not any(r.auc_again or r.counts_again for r in churn.check_choice(bad).collect())


def test_more_starts_are_never_worse(spark):
    data, _ = segmentation._prepared(C._features(spark, SF_SMALL), segmentation.BASE_FEATURES)
    data = data.persist()
    costs = [segmentation._best_start(data, 4, 42, n).summary.trainingCost for n in (1, 4)]
    assert costs[1] <= costs[0] + 1e-9
    sweep = segmentation.silhouette_k_sweep(C._features(spark, SF_SMALL), k_values=(2, 3), n_init=2).collect()
    assert [r.k for r in sweep] == [2, 3] and sweep[0].inertia > sweep[1].inertia
    data.unpersist()
