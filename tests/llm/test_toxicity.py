import numpy as np

from ledgerlens.llm import queries, toxicity

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.1"


def fitted(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_neighbours_are_exact(spark):
    model = fitted(spark)
    dense = np.zeros((len(model.vectors), len(model.vocab)))
    for i, (terms, values) in enumerate(model.vectors):
        dense[i, terms] = values
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["idiot", "moron scum idiot", ""]
    tried = 0
    for t in texts:
        counts = model.counts(t)
        if counts:
            tried += 1
            terms, q = model.vector(counts)
            cos = dense[:, terms] @ q
            want = sorted(((c, i) for i, c in enumerate(cos) if c > 0), key=lambda x: (-round(x[0], 12), x[1]))[:toxicity.NEIGHBOURS]
            got = model.nearest((terms, q))
            assert [i for _, i in got] == [i for _, i in want]
            assert np.allclose([c for c, _ in got], [c for c, _ in want])
    assert tried >= 10


def test_held_out_accuracy(spark):
    rows = queries.op3_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in got)
    assert hit / sum(r.predicted for r in got) > 0.85
    assert hit / sum(r.toxic for r in got) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_odd_cases(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(clashing(docs), clashing(labels))
    assert toxicity.score(clashing(docs), model).count() == docs.count()
    assert toxicity.score(no_docs(spark), model).count() == 0
    nothing = toxicity.fit(no_docs(spark), labels)
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
