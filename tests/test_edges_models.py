"""Contract edges (empty ranges, orphan shares) and model invariants."""
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens import catalog as C
from ledgerlens.plans import quality as QA
from ledgerlens.plans import reports as R
from ledgerlens.sources.star import load_star
from tests.conftest import SF_SMALL


def test_reports_on_an_empty_range_return_zeros(spark):
    fact = load_star(spark, SF_SMALL).fact_slim
    k = R.kpis(fact, "1990-01-01", "1990-12-31").first().asDict()
    assert k == {"total_customers": 0, "orders": 0, "revenue": 0.0, "aov": 0.0, "churn_rate_pct": 0.0}
    i = R.insights(fact, "1990-01-01", "1990-12-31").first().asDict()
    assert i["total_customers"] == 0 and i["pareto_top20_pct"] == 0.0
    assert R.trend(fact, "1990-01-01", "1990-12-31").count() == 0
    b = R.date_bounds(fact.filter(F.lit(False))).first()
    assert (str(b["min_date"]), str(b["max_date"])) == ("2022-01-01", "2024-12-31")


@pytest.mark.parametrize("missing,warn", [(1, False), (3, True)])
def test_orphan_share_warning(spark, missing, warn):
    fact = spark.createDataFrame([(i,) for i in range(40)], "customer_id long")
    dim = spark.createDataFrame([(i,) for i in range(40 - missing)], "customer_id long")
    r = QA.anti_orphans(fact, dim).first()
    assert r["orphan_keys"] == missing and r["warn"] is warn      # 1/40 = 2.5 %, 3/40 = 7.5 %


def test_validation_raises_on_failure(spark):
    small = {"orders": spark.createDataFrame([(1, None, None, None)],
                                             "order_id long, user_id long, status string, created_at string")}
    res = QA.validate_raw(small)
    row = res.first()
    assert not row["rows_ok"] and not row["nulls_ok"] and not row["passed"]
    with pytest.raises(QA.ValidationError):
        QA.raise_on_failure(res)


def test_kmeans_four_labelled_clusters(spark):
    from ledgerlens.models import segmentation
    feats = C._features(spark, SF_SMALL)
    scored, model, centroids = segmentation.run_kmeans(feats, n_init=2)
    labels = {r["segment"] for r in scored.select("segment").distinct().collect()}
    assert labels <= set(segmentation.CLUSTER_LABELS) and len(centroids) == 4
    assert scored.count() == feats.count()


def test_clv_outputs_are_finite(spark):
    df = C._clv(spark, SF_SMALL).toPandas()
    assert (df["predicted_purchases"] >= 0).all()
    assert df["p_alive"].between(0, 1).all()
    assert all(math.isfinite(x) for x in df["clv_pred"])


def test_recommendations_exclude_bought_products(spark):
    from ledgerlens.models import recommend as REC
    from ledgerlens.plans.features import load_valid_orders
    st = load_star(spark, SF_SMALL)
    m = REC.interaction_matrix(load_valid_orders(st.fact_slim)).persist()
    recs = REC.recommend(REC.train_als(m), m, n=5)
    assert recs.join(m, ["customer_id", "product_id"], "inner").count() == 0
    per_user = recs.groupBy("customer_id").count().agg(F.max("count")).first()[0]
    assert per_user == 5


def test_churn_probabilities_in_unit_interval(spark):
    from ledgerlens.models import churn
    feats = C._features(spark, SF_SMALL)
    choice = churn.train_churn_model(feats, kinds=("lr",), folds=3)
    p = churn.predict_churn_risk(choice.model, feats)
    stats = p.agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0.0 <= stats[0] <= stats[1] <= 1.0
    m = choice.metrics.first()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] > 0 and 0.0 <= m["auc"] <= 1.0


def _mini_fact(spark, rows):
    import decimal
    return spark.createDataFrame(
        [(o, c, p, dt, decimal.Decimal(str(v)), s) for o, c, p, dt, v, s in rows],
        "order_id long, customer_id long, product_id long, order_date date, sale_price decimal(18,2), status string")


def test_null_status_is_not_revenue_but_is_reported(spark):
    import datetime as dt
    d = dt.date(2024, 1, 10)
    fact = _mini_fact(spark, [(1, 1, 1, d, 10.0, "Complete"), (2, 1, 1, d, 5.0, None), (3, 2, 2, d, 7.0, "Returned")])
    k = R.kpis(fact, "2024-01-01", "2024-01-31").first()
    assert (k["orders"], k["revenue"]) == (1, 10.0)
    sb = {r["status"]: (r["cnt"], r["revenue"]) for r in R.status_breakdown(fact, "2024-01-01", "2024-01-31").collect()}
    assert sb == {"Complete": (1, 10.0), "Unknown": (1, 5.0), "Returned": (1, 7.0)}


def test_top_products_ties_broken_by_product_id(spark):
    import datetime as dt
    d = dt.date(2024, 1, 10)
    fact = _mini_fact(spark, [(1, 1, 9, d, 5.0, "Complete"), (2, 1, 3, d, 5.0, "Complete"), (3, 1, 7, d, 5.0, "Complete")])
    products = spark.createDataFrame([(3, "c", "x", "b"), (7, "g", "x", "b"), (9, "i", "x", "b")],
                                     "product_id long, name string, category string, brand string")
    got = [r["product_id"] for r in R.top_products(fact, products, "2024-01-01", "2024-01-31", limit=2).collect()]
    assert got == [3, 7]


def test_overlap_in_blocks_equals_one_block(spark):
    from ledgerlens.operators.overlap import overlap_top_k
    st = load_star(spark, SF_SMALL)
    q, e = st.tables.benchmark, st.tables.documents
    a = overlap_top_k(q, e, "item_id", "text", "doc_id", "text", k=2)
    b = overlap_top_k(q, e, "item_id", "text", "doc_id", "text", k=2, block_tokens=100)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 0


def _differenced(ll, point, data, weights, step=1e-4):
    """Mean log likelihood, gradient and Hessian at a point, by differences."""
    import numpy as np
    f = lambda p: float(np.average(ll(p, *data), weights=weights))
    n, eye = len(point), np.diag(np.asarray(point) * step)
    h = [2 * eye[i, i] for i in range(n)]
    gradient = [(f(point + eye[i]) - f(point - eye[i])) / h[i] for i in range(n)]
    hessian = [[(f(point + eye[i] + eye[j]) - f(point + eye[i] - eye[j]) - f(point - eye[i] + eye[j]) + f(point - eye[i] - eye[j])) / (h[i] * h[j])
                for j in range(n)] for i in range(n)]
    return f(point), np.array(gradient), np.array(hessian)


def test_clv_likelihoods_and_derivatives(spark):
    import numpy as np
    from ledgerlens.models import clv
    summary = clv.clv_summary(C._orders(spark, SF_SMALL))
    spent = clv.gg_training_set(summary)
    cases = [(summary, ["frequency", "recency", "T"], clv._bgnbd_terms, clv._bgnbd_ll, [[0.5, 2.0, 0.8, 1.5], [0.7, 9.0, 0.4, 2.5]]),
             (spent, ["frequency", "monetary_value"], clv._gg_terms, clv._gg_ll, [[2.0, 3.0, 50.0], [6.0, 4.0, 15.0]])]
    for df, cols, terms, ll, points in cases:
        g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("w"))
        local = g.toPandas()
        at = clv._evaluator(g, cols, terms, len(points[0]))
        for point in map(np.array, points):
            want = _differenced(ll, point, [local[c].to_numpy(float) for c in cols], local["w"])
            for got, expected in zip(at(point), want):
                assert np.allclose(got, expected, rtol=2e-4, atol=1e-6 * np.abs(expected).max())


def test_digamma_and_trigamma():
    import numpy as np
    from ledgerlens.functions.special import digamma, gammaln, trigamma
    euler = 0.5772156649015329
    assert np.allclose(digamma(np.array([1.0, 2.0, 0.5])), [-euler, 1 - euler, -euler - 2 * np.log(2)], rtol=1e-13)
    assert np.allclose(trigamma(np.array([1.0, 2.0, 0.5])), [np.pi ** 2 / 6, np.pi ** 2 / 6 - 1, np.pi ** 2 / 2], rtol=1e-13)
    x = np.array([1e-3, 0.2, 3.3, 11.9, 12.0, 40.0, 1e6])
    assert np.allclose(digamma(x + 1) - digamma(x), 1 / x, rtol=1e-9)
    assert np.allclose((gammaln(x * 1.0001) - gammaln(x * 0.9999)) / (x * 0.0002), digamma(x), rtol=1e-4, atol=1e-6)


def test_bgnbd_fit_recovers_simulated_customers(spark):
    import numpy as np
    from ledgerlens.models import clv
    rng = np.random.default_rng(11)
    r, alpha, a, b, n = 2.0, 40.0, 1.2, 3.0, 4000
    rate, drop, t_end = rng.gamma(r, 1 / alpha, n), rng.beta(a, b, n), rng.integers(200, 400, n)
    rows = []
    for lam, p, end in zip(rate, drop, t_end):
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > end:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        rows.append((float(x), float(round(last)), float(end)))
    summary = spark.createDataFrame(rows, "frequency double, recency double, T double")
    fit = clv.fit_bgnbd(summary)
    mean_rate, mean_drop = fit.params["r"] / fit.params["alpha"], fit.params["a"] / (fit.params["a"] + fit.params["b"])
    assert abs(mean_rate - r / alpha) < 0.2 * r / alpha and abs(mean_drop - a / (a + b)) < 0.1
    # the optimum of the penalised likelihood: no single parameter can be moved to advantage
    g = summary.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("w"))
    scale = clv.LARGEST_TIME / 399
    x, tx, t, w = (g.toPandas()[c].to_numpy(float) for c in ("frequency", "recency", "T", "w"))
    def objective(p):
        q = np.array([p[0], p[1] * scale, p[2], p[3]])
        return -np.average(clv._bgnbd_ll(q, x, tx * scale, t * scale), weights=w) + fit.penalizer * (q ** 2).sum()
    best = np.array([fit.params[k] for k in ("r", "alpha", "a", "b")])
    for i in range(4):
        for f in (0.97, 1.03):
            moved = best.copy()
            moved[i] *= f
            assert objective(moved) > objective(best)


def test_hyp2f1_against_closed_forms():
    import numpy as np
    from ledgerlens.functions.special import hyp2f1
    z = np.array([0.0, 0.3, 0.9, 0.999, 0.9999])
    assert np.allclose(hyp2f1(1.0, 1.0, 2.0, z[1:]), -np.log1p(-z[1:]) / z[1:], rtol=1e-9)
    assert np.allclose(hyp2f1(3.0, 2.5, 2.5, z[:4]), (1 - z[:4]) ** -3.0, rtol=1e-9)
    with pytest.raises(ValueError):
        hyp2f1(1.0, 1.0, 2.0, 1.0)


def test_churn_split_and_folds_are_stratified(spark):
    from ledgerlens.models import churn
    df = spark.createDataFrame([(i, float(i % 7 == 0)) for i in range(1003)], "customer_id long, label double")
    got = df.join(churn.stratified_split(df), "customer_id").collect()
    for y in (0.0, 1.0):
        rows = [r for r in got if r.label == y]
        assert sum(r.is_test for r in rows) == -(-len(rows) * 20 // 100)
        folds = [sum(r.fold == k for r in rows) for k in range(5)]
        assert max(folds) - min(folds) <= 1
