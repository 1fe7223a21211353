import math
import random

import numpy as np
from pyspark.sql import functions as F

from spendlens.operators import ml


def customers(spark, n=400):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        f, m, t = rnd.randint(1, 20), rnd.random() * 1000, rnd.randint(0, 5)
        rows.append((f"c{i:04d}", f, m, t, 5 - t // 2, int(rnd.random() < 1 / (1 + math.exp(.3 * f - t)))))
    return spark.createDataFrame(rows, "customer_id string, frequency long, monetary double, support_tickets int, satisfaction_score int, churn_label int")


def test_saved_pipeline_scores_like_the_fit_and_its_loss_is_at_its_minimum(spark, tmp_path):
    df = customers(spark)
    path = str(tmp_path / "model")
    pred, model, coefs = ml.train_churn(df, path=path)
    w = {r.feature: r.coefficient for r in coefs.collect()}
    split = ml.stratified_split(df, "churn_label", "customer_id").toPandas()
    train, test = split[split.is_train], split[~split.is_train]
    x = train[ml.CHURN_FEATURES].to_numpy(float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / sd
    beta = np.array([w[f] for f in ml.CHURN_FEATURES])
    p = 1 / (1 + np.exp(-(z @ beta + w["intercept"])))
    error = p - train.churn_label.to_numpy()
    # gradient of 0.5 |w|^2 + sum of the losses; the intercept isn't penalised
    assert np.abs(beta + z.T @ error).max() < 1e-3 and abs(error.sum()) < 1e-3
    own = 1 / (1 + np.exp(-(((test[ml.CHURN_FEATURES].to_numpy(float) - mean) / sd) @ beta + w["intercept"])))
    got = {r.customer_id: (r.probability, r.prediction) for r in pred.collect()}
    assert len(got) == len(test)
    assert all(abs(got[c][0] - q) < 1e-9 and got[c][1] == (q > .5) for c, q in zip(test.customer_id, own))
    again = {r.customer_id: r.probability for r in ml.score_churn(df.drop("churn_label"), path).collect()}
    assert len(again) == 400 and all(again[c] == v for c, (v, _) in got.items())


def test_scoring_works_after_an_observation(spark):
    """A fitted model would take its session into the tasks, which an observation makes unserializable."""
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 3
    pred, _, _ = ml.train_churn(customers(spark, 120))
    assert ml.roc_auc(pred).first().roc_auc > 0.5


def test_constant_and_null_features(spark):
    df = customers(spark, 80).withColumn("support_tickets", F.lit(1))
    pred, _, coefs = ml.train_churn(df)
    assert {r.feature: r.coefficient for r in coefs.collect()}["support_tickets"] == 0.0 and pred.count() > 0
