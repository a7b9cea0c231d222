"""Churn and expansion models at table scale (Spark ML).

* features: fixed numeric list -> double; categories -> fixed ordinal codes
  (unknown -> -1); class weight n_neg / n_pos on positives;
* model: GBTClassifier with the original's hyper-parameters (300 trees,
  depth 5, rate 0.05, row and column subsampling 0.8, seed 42). Spark's GBT
  is first-order, XGBoost second-order: numbers differ, gates are compared;
* calibration: 5 folds by seeded hash within each label; per fold a GBT on
  the other folds plus isotonic regression on the held-out fold; the
  calibrated probability is the mean of the five. The six fits (five folds +
  the uncalibrated full model) are submitted concurrently from a thread pool
  (independent Spark jobs, each a long task: ``boosting``), and the fitted models
  are saved under the shared checkpoint folder so scoring jobs load them instead
  of refitting.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import boosting
from tidemark.session import ensure_checkpoint_dir, shared_root, ship_package

# fixed values: GBT hyper-parameters and gates
GBT_PARAMS = dict(maxIter=300, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                  seed=K.RANDOM_SEED)
N_FOLDS = 5
MIN_ROWS_PER_TASK, MAX_ROWS_PER_TASK = 100_000, 2_000_000
# seconds of a tree level: a row in a task of ours, a row in Spark's fit on one core, the jobs of a level of six fits
TASK_ROW_S, JOB_ROW_S, JOB_S = 7e-8, 5e-7, 0.1
CHURN_GATES = {"auc_min": 0.80, "brier_max": 0.15}
EXPANSION_GATES = {"auc_min": 0.75, "brier_max": 0.10}
PROMOTION_AUC = 0.80


def ordinal(col: Column, categories: list[str]) -> Column:
    """Fixed category order (lower case), unknown -> -1."""
    m = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c.lower()), F.lit(float(i)))])
    return F.coalesce(m[F.lower(col)], F.lit(-1.0))


def model_frame(df: DataFrame, numeric: list[str], label: str | None = "label") -> DataFrame:
    cols = [F.col(c).cast("int").cast("double").alias(c) if dict(df.dtypes)[c] == "boolean"
            else F.col(c).cast("double").alias(c) for c in numeric]
    cats = [ordinal(F.col("plan_tier"), K.PLAN_TIERS).alias("plan_tier_code"),
            ordinal(F.col("industry"), K.INDUSTRIES).alias("industry_code")]
    keep = ["customer_id"] + ([F.col(label).cast("double").alias("label")] if label else [])
    out = df.select(*keep, *cols, *cats, F.col("plan_tier").alias("plan_tier_name"), F.col("mrr").alias("mrr_raw"))
    va = VectorAssembler(inputCols=numeric + ["plan_tier_code", "industry_code"], outputCol="features",
                         handleInvalid="keep")
    return va.transform(out)


def with_class_weight(df: DataFrame) -> DataFrame:
    """weight = n_neg / n_pos on positives, 1 on negatives (two counts)."""
    c = df.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    w = (c["n"] - c["p"]) / c["p"] if c["p"] else 1.0
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(w))).otherwise(F.lit(1.0)))


def folds(df: DataFrame, k: int = N_FOLDS, seed: int = K.RANDOM_SEED) -> DataFrame:
    """Stratified folds: the rows of each label in seeded hash order are dealt in
    turn, so every fold has its share of both labels."""
    from tidemark.operators.ranking import global_positions
    h = F.xxhash64(F.col("customer_id"), F.lit(seed))
    placed = global_positions(df.withColumn("_h", h), [F.col("label"), F.col("_h"), F.col("customer_id")])
    first = placed.groupBy("label").agg(F.min("pos").alias("_first"))  # a row per label
    return (placed.join(F.broadcast(first), "label").withColumn("fold", F.pmod(F.col("pos") - F.col("_first"), F.lit(k)))
            .drop("_h", "pos", "_first"))


def _prob(model: GBTClassificationModel, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]) \
        .drop("rawPrediction", "probability", "prediction")


class CalibratedGBT:
    """Five (GBT, isotonic) pairs + an uncalibrated full model."""

    def __init__(self, full: GBTClassificationModel, pairs: list[tuple[GBTClassificationModel, IsotonicRegressionModel]],
                 path: str | None = None):
        self.full, self.pairs, self.path = full, pairs, path

    def predict(self, df: DataFrame, out: str = "probability_calibrated") -> DataFrame:
        cols = []
        cur = df.repartition("customer_id")  # a mart is few files, but 1,500 trees a row are work for all cores
        for i, (g, iso) in enumerate(self.pairs):
            cur = _prob(g, cur, f"_raw{i}")
            cur = iso.setFeaturesCol(f"_raw{i}").setPredictionCol(f"_cal{i}").transform(cur)
            cols.append(F.col(f"_cal{i}"))
        mean = sum(cols) / len(cols)
        cur = cur.withColumn(out, mean).drop(*[f"_raw{i}" for i in range(len(self.pairs))],
                                              *[f"_cal{i}" for i in range(len(self.pairs))])
        return _prob(self.full, cur, "probability_uncalibrated")

    def save(self, path: str) -> None:
        self.full.write().overwrite().save(f"{path}/full")
        for i, (g, iso) in enumerate(self.pairs):
            g.write().overwrite().save(f"{path}/fold{i}/gbt")
            iso.write().overwrite().save(f"{path}/fold{i}/iso")

    @classmethod
    def load(cls, path: str, k: int = N_FOLDS) -> "CalibratedGBT":
        with ThreadPoolExecutor(max_workers=k + 1) as pool:  # each model is a few small jobs
            full = pool.submit(GBTClassificationModel.load, f"{path}/full")
            gbts = [pool.submit(GBTClassificationModel.load, f"{path}/fold{i}/gbt") for i in range(k)]
            isos = [pool.submit(IsotonicRegressionModel.load, f"{path}/fold{i}/iso") for i in range(k)]
            return cls(full.result(), [(g.result(), iso.result()) for g, iso in zip(gbts, isos)], path)


def fit_partitions(rows: int, cores: int, fits: int) -> int:
    """Partitions of the training rows. A level of a tree is a job of two stages, 1,500 of
    them a fit, so the tasks are as many as the cores can take at once from all fits that
    run side by side, twice over; more would only add task starts. Rows bound it on
    either side: no tiny tasks, and none that grows without end."""
    wanted = min(rows // MIN_ROWS_PER_TASK + 1, -(-2 * cores // fits))
    return max(1, wanted, rows // MAX_ROWS_PER_TASK + 1)


def grown_in_tasks(rows: int, cores: int, fits: int) -> bool:
    """Whether a task for each fit is sooner done than Spark's jobs for each tree level, which
    deal the rows to all cores: so it is but on very many cores. Both give the same trees."""
    return rows * TASK_ROW_S <= JOB_S + rows * JOB_ROW_S * fits / cores


def fit_calibrated(train: DataFrame, params: dict | None = None, k: int = N_FOLDS, path: str | None = None) -> CalibratedGBT:
    """The ensemble, which is also saved under ``path`` if that is given."""
    from tidemark.plans.warehouse import drop
    params = params or GBT_PARAMS
    spark = train.sparkSession
    ship_package(spark)
    data = folds(with_class_weight(train)).select("customer_id", "features", "label", "weight", "fold")
    size = data.agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).first()
    cores = spark.sparkContext.defaultParallelism
    n = min(data.rdd.getNumPartitions(), fit_partitions(size["n"], cores, k + 1))
    # cut lineage once; six fits read it concurrently
    data = data.coalesce(n).withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    # without a negative row all weights are 0: left to Spark
    in_tasks = grown_in_tasks(size["n"], cores, k + 1) and (size["least"] or 0) > 0
    ensure_checkpoint_dir(spark)
    root = path or f"{shared_root(spark)}/tidemark-models/fit-{uuid.uuid4().hex}"

    def fit(rows: DataFrame, at: str) -> GBTClassificationModel:
        gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **params)
        if in_tasks:
            return boosting.fit(rows, gbt, at)
        model = gbt.fit(rows)
        if path:
            model.write().overwrite().save(at)
        return model

    def fit_fold(i: int):
        tr, ho = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
        g = fit(tr, f"{root}/fold{i}/gbt")
        scored = _prob(g, ho, "raw")
        iso = IsotonicRegression(featuresCol="raw", labelCol="label", isotonic=True).fit(scored)
        if path:
            iso.write().overwrite().save(f"{root}/fold{i}/iso")
        return g, iso

    try:
        with ThreadPoolExecutor(max_workers=k + 1) as pool:
            full_f = pool.submit(fit, data, f"{root}/full")
            fold_f = [pool.submit(fit_fold, i) for i in range(k)]
            pairs = [f.result() for f in fold_f]
            full = full_f.result()
    finally:
        if not path:
            drop(spark, root)  # the models are in the driver now
    return CalibratedGBT(full, pairs, path)


def model_path(spark: SparkSession, key: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{shared_root(spark)}/tidemark-models/{key}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_FIT_LOCKS: dict[str, threading.Lock] = {}
_FIT_GUARD = threading.Lock()


_LOADED: dict[str, CalibratedGBT] = {}  # by path, which names inputs and code; a model is some 20 MB


def fit_or_load(spark: SparkSession, key: str, train_fn) -> CalibratedGBT:
    """Load the saved ensemble, or fit and save it (one fitter per key even when
    queries run concurrently). Loading takes seconds, so it is done once."""
    path = model_path(spark, key)
    with _FIT_GUARD:
        lock = _FIT_LOCKS.setdefault(path, threading.Lock())
    with lock:
        if not _exists(spark, f"{path}/_DONE"):
            from tidemark.plans.warehouse import publish

            def write(tmp: str) -> None:
                _LOADED[path] = fit_calibrated(train_fn(), path=tmp)
                spark.createDataFrame([(1,)], "done int").write.mode("overwrite").parquet(f"{tmp}/_DONE")

            _LOADED.pop(path, None)
            publish(spark, write, path, marker="_DONE")
            _LOADED[path].path = path
        if path not in _LOADED:
            _LOADED[path] = CalibratedGBT.load(path)
        return _LOADED[path]


def feature_importance(model: CalibratedGBT, names: list[str]) -> DataFrame:
    """Gain-based importances of the full model, ranked (driver holds one
    number per feature)."""
    spark = SparkSession.getActiveSession()
    imp = model.full.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")
