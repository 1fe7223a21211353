"""Models: K-Means customer clusters and the logistic churn classifier, with
their evaluation (classification report, exact ROC AUC) as DataFrame ops.

Scaling uses the population standard deviation (a constant column scales to
0), computed with one aggregate; the statistics are a handful of numbers.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.functions import dbl, half_even, js_round
from spendlens.operators.ranking import with_global_row_number, with_global_running_sum
from spendlens.session import ensure_checkpoint_dir


# ------------------------------------------------------------------ scaling
def scaling_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd per column (2 numbers per feature)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(dbl(c)).alias(f"m_{c}"), F.stddev_pop(dbl(c)).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in cols}


def standardize(df: DataFrame, cols: list[str], stats: dict[str, tuple[float, float]],
                suffix: str = "_z") -> DataFrame:
    out = df
    for c in cols:
        mean, sd = stats[c]
        z = (dbl(c) - F.lit(mean)) / F.lit(sd) if sd > 0 else F.lit(0.0)
        out = out.withColumn(c + suffix, z)
    return out


# ------------------------------------------------------------------ K-Means
RFM_FEATURES = ["recency", "frequency", "monetary"]


def cluster_customers(rfm: DataFrame, k: int = 4, seed: int = 42, max_iter: int = 300, tol: float = 1e-9):
    """K-Means on standardised R, F, M.  Cluster ids are renumbered 0..k-1
    by descending mean spend so they are stable across runs.
    Returns (frame with cluster_label, fitted model); the fit converged if
    ``model.summary.numIter < max_iter``, and then it is a fixed point: each
    centre is its members' mean (to ``tol``), each customer with the nearest."""
    stats = scaling_stats(rfm, RFM_FEATURES)
    z = standardize(rfm, RFM_FEATURES, stats)
    vec = VectorAssembler(inputCols=[c + "_z" for c in RFM_FEATURES], outputCol="features").transform(z)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features",
                   predictionCol="raw_cluster").fit(vec)
    pred = model.transform(vec).drop("features", *[c + "_z" for c in RFM_FEATURES])
    # k rows: a bounded broadcast
    order = (pred.groupBy("raw_cluster").agg(F.avg(dbl("monetary")).alias("m"))
             .select("raw_cluster", (F.row_number().over(Window.orderBy(F.col("m").desc(), "raw_cluster")) - 1)
                     .cast("int").alias("cluster_label")))
    return pred.join(F.broadcast(order), "raw_cluster").drop("raw_cluster"), model


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Per cluster: mean recency, frequency, monetary (2 dp) and size."""
    return (clustered.groupBy("cluster_label")
            .agg(half_even(F.avg(dbl("recency")), 2).alias("recency_mean"),
                 half_even(F.avg(dbl("frequency")), 2).alias("frequency_mean"),
                 half_even(F.avg(dbl("monetary")), 2).alias("monetary_mean"),
                 F.count(F.lit(1)).alias("customers"))
            .orderBy("cluster_label"))


# ------------------------------------------------------- stratified split
def split_quotas(counts: dict, train: float) -> dict:
    """Training rows per class: n - ceil((1 - train) * n) in all, shared by
    class size; the rows left over go to the largest remainders, ties to the
    smaller label."""
    total = sum(counts.values())
    n_train = total - math.ceil(round(1.0 - train, 12) * total)
    quotas = {c: n * n_train // total for c, n in counts.items()} if total else {}
    by_rest = sorted(counts, key=lambda c: (-(counts[c] * n_train % total), c)) if total else []
    for c in by_rest[:n_train - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.7, seed: int = 42,
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``is_train``: per class, the first rows in a seeded hash order up
    to the class's quota go to training.  Exact sizes, distributed (a global
    row number, not one task per class); rows without a label are left out.
    The hash is the MD5 of ``key:seed``, so other engines can draw the same split."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = with_global_row_number(df.filter(F.col(label).isNotNull()).withColumn("__h", h),
                                    [F.col(label).asc(), F.col("__h").asc(), F.col(key).asc()],
                                    "__rn", None, num_partitions)
    counts = {r[0]: r[1] for r in ranked.groupBy(label).count().collect()}  # one row per class
    last, before = F.lit(0), 0
    quotas = split_quotas(counts, train)
    for c in sorted(counts):
        last = F.when(F.col(label) == F.lit(c), F.lit(before + quotas[c])).otherwise(last)
        before += counts[c]
    return ranked.withColumn("is_train", F.col("__rn") <= last).drop("__h", "__rn")


# ------------------------------------------------------ churn classifier
# FIXED VALUES – the feature list.
CHURN_FEATURES = ["frequency", "monetary", "support_tickets", "satisfaction_score"]


def scaling_stage(cols: list[str], stats: dict[str, tuple[float, float]], suffix: str = "_z") -> SQLTransformer:
    """``standardize`` as a pipeline stage that can be saved: the statistics are exact constants of its SQL."""
    z = [f"(CAST(`{c}` AS DOUBLE) - CAST('{m!r}' AS DOUBLE)) / CAST('{s!r}' AS DOUBLE)" if s > 0 else "CAST(0 AS DOUBLE)"
         for c, (m, s) in ((c, stats[c]) for c in cols)]
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS `{c}{suffix}`" for e, c in zip(z, cols)) + " FROM __THIS__")


def save_pipeline(spark: SparkSession, stages: list, path: str | None = None) -> str:
    """Save fitted stages as one pipeline, under the checkpoint folder unless ``path`` is given; returns its path."""
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/spendlens-model-{uuid.uuid4().hex}"
    PipelineModel(stages=stages).write().overwrite().save(path)
    return path


def score_churn(df: DataFrame, path: str) -> DataFrame:
    """``df`` (the raw features) with ``prediction`` and ``probability`` of class 1 by the pipeline saved at ``path``.

    A loaded pipeline holds only what scoring needs; a model that was just
    fitted also drags its training summary (and with it the session) into
    every task."""
    own = df.columns
    scored = PipelineModel.load(path).transform(df)
    return scored.select(*own, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))


def train_churn(df: DataFrame, label: str = "churn_label", key: str = "customer_id",
                features: list[str] | None = None, seed: int = 42, train: float = 0.7,
                max_iter: int = 300, tol: float = 1e-14, path: str | None = None):
    """Logistic regression (L2, C = 1 in the 0.5|w|^2 + C * sum(loss) form,
    i.e. regParam = 1 / n_train) on features standardised with training-set
    statistics.  The loss has one minimum, and ``tol`` is small enough to reach it to about 7 digits.
    The scaling, the assembler and the model are saved as one pipeline (at ``path``, or under the
    checkpoint folder), which is loaded again to score.  Returns (test predictions, model, coefficients frame)."""
    features = features or CHURN_FEATURES
    split = stratified_split(df, label, key, train, seed)
    tr = split.filter("is_train")
    stats = scaling_stats(tr, features)
    n_train = tr.count()
    zcols = [c + "_z" for c in features]
    asm = VectorAssembler(inputCols=zcols, outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n_train, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    scaler = scaling_stage(features, stats)
    model = lr.fit(asm.transform(scaler.transform(tr)).withColumn(label, dbl(label)))
    path = save_pipeline(df.sparkSession, [scaler, asm, model], path)
    pred = score_churn(split.filter(~F.col("is_train")).select(key, F.col(label).cast("int").alias(label), *features), path).drop(*features)
    spark = df.sparkSession
    coefs = spark.createDataFrame(
        [(f, float(w)) for f, w in zip(features, model.coefficients.toArray())] + [("intercept", float(model.intercept))],
        "feature string, coefficient double")
    return pred, model, coefs


# -------------------------------------------------------------- evaluation
def classification_report(pred: DataFrame, label: str = "churn_label", prediction: str = "prediction",
                          classes=(0, 1), digits: int = 6) -> DataFrame:
    """Per class precision, recall, F1 and support; then accuracy, macro and
    support-weighted averages (0 where a ratio has no denominator).  Classes
    that occur neither as label nor as prediction are left out, and so are
    rows whose label or prediction is unknown (NULL).

    One pass: all confusion counts are conditional counts of a single
    aggregate row, and every metric is an expression over that row."""
    t, p = F.col(label), F.col(prediction)
    k = len(classes)
    agg = pred.agg(*[F.count_if((t == a) & (p == b)).alias(f"n_{i}_{j}")
                     for i, a in enumerate(classes) for j, b in enumerate(classes)])
    ratio = lambda a, b: F.coalesce(dbl(a) / F.nullif(dbl(b), F.lit(0.0)), F.lit(0.0))
    n = lambda i, j: F.col(f"n_{i}_{j}")
    per = []
    for i, c in enumerate(classes):
        tp = n(i, i)
        support = sum((n(i, j) for j in range(k)), F.lit(0))
        predicted = sum((n(j, i) for j in range(k)), F.lit(0))
        prec, rec = ratio(tp, predicted), ratio(tp, support)
        per.append({"cls": F.lit(str(c)), "precision": prec, "recall": rec,
                    "f1_score": ratio(F.lit(2.0) * prec * rec, prec + rec), "support": support,
                    "present": (support + predicted) > 0, "tp": tp})
    total = sum((x["support"] for x in per), F.lit(0))
    present = sum((x["present"].cast("int") for x in per), F.lit(0))

    def mean(metric, weighted):
        terms = [F.when(x["present"], x[metric] * (dbl(x["support"]) if weighted else F.lit(1.0)))
                 .otherwise(F.lit(0.0)) for x in per]
        return ratio(sum(terms[1:], terms[0]), total if weighted else present)

    def row(cls, pr, rc, f1, sup, keep=F.lit(True)):
        return F.struct(cls.alias("class"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        sup.cast("long").alias("support"), keep.alias("keep"))

    rows = [row(x["cls"], x["precision"], x["recall"], x["f1_score"], x["support"], x["present"]) for x in per]
    rows.append(row(F.lit("accuracy"), F.lit(None), F.lit(None),
                    ratio(sum((x["tp"] for x in per), F.lit(0)), total), total))
    rows.append(row(F.lit("macro avg"), mean("precision", False), mean("recall", False),
                    mean("f1_score", False), total))
    rows.append(row(F.lit("weighted avg"), mean("precision", True), mean("recall", True),
                    mean("f1_score", True), total))
    out = agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("keep")
    return out.select("class", *[js_round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


def roc_auc(pred: DataFrame, label: str = "churn_label", score: str = "probability",
            num_partitions: int | None = None) -> DataFrame:
    """Exact area under the ROC curve (ties count one half):
    sum over distinct scores of pos(s) * (neg(< s) + neg(s) / 2) / (P * N).
    Scores are grouped first, then one distributed running sum.  NULL where
    one of the classes is empty."""
    levels = pred.groupBy(dbl(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    run = with_global_running_sum(levels, [F.col("s").asc()], "neg", "neg_upto", num_partitions)
    term = dbl("pos") * (dbl("neg_upto") - dbl("neg") + dbl("neg") * F.lit(0.5))
    return run.agg(F.sum(term).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        (F.col("area") / F.nullif(dbl("p") * dbl("n"), F.lit(0.0))).alias("roc_auc"),
        F.col("p").cast("long").alias("positives"), F.col("n").cast("long").alias("negatives"))
