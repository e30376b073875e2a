"""Model jobs: sanity on generated data whose label depends on the features."""

from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.operators import curves as cv
from riskweave.operators import models as ml
from riskweave.operators import split as sp
from riskweave.sources import generator as gen
from riskweave.sources.tables import read_table
from riskweave.plans import model_plans as mp
from conftest import SF_ORACLE, SF_SMALL


def test_generator_is_deterministic_and_in_range(spark):
    ids = read_table(spark, SF_ORACLE, "events").select("event_id")
    a = gen.synthetic_transactions(ids, "event_id", seed=123)
    b = gen.synthetic_transactions(ids.repartition(7), "event_id", seed=123)
    assert a.exceptAll(b).count() == 0
    r = a.agg(F.min("amount"), F.min("hour"), F.max("hour"), F.min("device_score"), F.max("device_score"),
              F.min("country_risk"), F.max("country_risk"), F.avg("device_score"), F.avg("is_fraud")).first()
    assert r[0] >= 0 and (r[1], r[2]) == (0, 23) and 0 < r[3] < r[4] < 1 and (r[5], r[6]) == (1, 5)
    assert abs(r[7] - 5 / 7) < 0.01          # Beta(5, 2) mean
    assert 0.01 < r[8] < 0.08                # rule-based fraud rate


def test_logistic_regression_beats_random(spark):
    ids = read_table(spark, SF_ORACLE, "events").select("event_id")
    data = gen.synthetic_transactions(ids, "event_id", seed=7).withColumnRenamed("row_id", "transaction_id")
    s = sp.stratified_split(data, "is_fraud", "transaction_id", seed=7)
    train = s.where(F.col("split") == "train")
    stats = fe.fit_feature_stats(train)
    model = ml.fit(fe.engineer(train, stats), "logistic_regression")
    scored = ml.score(model, fe.engineer(s.where(F.col("split") != "train"), stats))
    auc = cv.roc_auc(scored, "fraud_probability", "is_fraud").first()[0]
    assert auc > 0.6


def test_evaluation_tables_agree_with_the_metrics(spark):
    """L07's one row, its report and its curves are of the same scored test split."""
    row = mp.q_l07(spark, SF_SMALL).first()
    report = {r["label"]: r for r in mp.q_l07r(spark, SF_SMALL).collect()}
    assert report["1"]["support"] == row["tp"] + row["fn"] and report["0"]["support"] == row["tn"] + row["fp"]
    assert abs(report["accuracy"]["recall"] - (row["tp"] + row["tn"]) / report["accuracy"]["support"]) < 1e-12
    roc = sorted((r["fpr"], r["tpr"]) for r in mp.q_l07c(spark, SF_SMALL).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert abs(area - row["roc_auc"]) < 1e-9
    pr = sorted(mp.q_l07p(spark, SF_SMALL).collect(), key=lambda r: (r["recall"], r["threshold"] is not None, -(r["threshold"] or 0)))
    step = sum((b["recall"] - a["recall"]) * b["precision"] for a, b in zip(pr, pr[1:]))
    assert abs(step - row["average_precision"]) < 1e-9
