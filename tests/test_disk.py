"""What steps leave on disk: shuffle files and states of steps that are over."""
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.llm import substring
from ledgerlens.models import recommend as REC


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = {}
    while files.hasNext():
        f = files.next()
        if f.getName().startswith("shuffle_"):
            found[f.getName()] = f.length()
    return found


@pytest.fixture()
def purchases(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.randrange(1, 4), 1000 + u, 2000 + i) for u in range(60) for i in rng.sample(range(90), 12)]
    return spark.createDataFrame(rows, "user_idx int, item_idx int, purchases int, customer_id long, product_id long").persist()


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = spark.range(0, 100_000, 1, 4).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count("*").alias("n"))
    found = session.written_once(made, "made")
    assert set(shuffle_files(spark)) <= set(before)
    assert found.agg(F.sum("n"), F.count("*")).first() == (100_000, 50_000)
    assert made.count() == 50_000       # what was written can be computed again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_fit_keeps_the_files_of_few_rounds(spark, purchases, monkeypatch):
    monkeypatch.setattr(session, "COLLECT_EVERY", 0.5)
    purchases.count()
    before = shuffle_files(spark)
    model = REC.train_als(purchases)
    for _ in range(20):
        left = {f.split("_")[1] for f in set(shuffle_files(spark)) - set(before)}
        if len(left) <= 10:
            break
        time.sleep(0.5)
    assert len(left) <= 10      # all that the fit made are 20 and more
    assert model.userFactors.count() == 60


def test_recommendations_keep_the_last_state_only(spark, purchases, monkeypatch):
    monkeypatch.setattr(REC, "LEVEL", 30)
    folder = session.ensure_checkpoint_dir(spark)
    states = lambda: {f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("customers-")}
    before, files = states(), shuffle_files(spark)
    found = REC.top_unseen(REC.train_als(purchases), purchases, 5)
    assert len(states() - before) == 1
    bought = {(r.user_idx, r.item_idx) for r in purchases.collect()}
    rows = found.collect()
    assert len(rows) == 60 and all(len(r["items"]) == 5 and not {(r.user_idx, i) for i in r["items"]} & bought for r in rows)


def test_texts_without_a_repeated_span_are_not_shuffled(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(600)) for _ in range(400)]
    texts[7] = texts[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).persist()
    docs.count()
    before = shuffle_files(spark)
    rows = substring.dedup(docs).collect()
    size = sum(n for f, n in shuffle_files(spark).items() if f not in before)
    assert [(r.doc_id, r.n_removed) for r in rows if r.n_removed] == [(7, 600)] and len(rows) == 400
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id != 7)
    assert size < sum(map(len, texts)) / 10
    docs.unpersist()
