"""Trees grown in tasks are those of Spark's own fit, node by node, in a fixed number of jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import models as MD


def rows(spark, n, parts, seed=1):
    """Coarse values, a column that nearly repeats another and one that is constant: many splits tie."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)) * 3) / 2
    x[:, 4], x[:, 5] = x[:, 3] * 2 + (rng.random(n) < 0.02), 7.0
    y = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) > 1
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(f"c{i:05d}", float(y[i]), 2.713 if y[i] else 1.0, *map(float, x[i])) for i in range(n)],
                               "customer_id string, label double, weight double, " + ", ".join(f"{c} double" for c in names)).coalesce(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).drop(*names)


def nodes(spark, path):
    return spark.read.parquet(f"{path}/data").orderBy("treeID", "nodeData.id").collect()


@pytest.mark.parametrize("n,parts,more", [(700, 1, {}), (700, 3, {}), (40, 1, {}),
                                          (500, 1, dict(featureSubsetStrategy="all", subsamplingRate=1.0, maxDepth=3))])
def test_trees_are_those_of_spark(spark, tmp_path, n, parts, more):
    data = rows(spark, n, parts).withColumn("part", F.spark_partition_id()).checkpoint()
    gbt = GBTClassifier(weightCol="weight", **dict(dict(maxIter=12, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42), **more))
    spark_model, ours = gbt.fit(data), B.fit(data, gbt, str(tmp_path / "fit"))
    for name, m in (("spark", spark_model), ("ours", ours)):
        m.save(str(tmp_path / name))
    assert nodes(spark, tmp_path / "ours") == nodes(spark, tmp_path / "spark")
    assert ours.treeWeights == spark_model.treeWeights and ours.extractParamMap() == spark_model.extractParamMap()
    a, b = ([r[0] for r in m.transform(data).select("probability").collect()] for m in (ours, spark_model))
    assert a == b


def test_blocks_and_mapped_rows_change_no_tree(tmp_path, monkeypatch):
    """More rows than are held in memory, in several blocks, with siblings' sums by difference: the same
    trees but for the rounding of sums."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    table = [(float(v), 2.0 if v else 1.0, list(r)) for r, v in zip(x, x[:, 0] + rng.normal(size=900) > 0.5)]
    thresholds = [np.linspace(-2, 2, 31)] * 4
    spec = dict(thresholds=thresholds, per_node=3, depth=4, trees=5, seed=7, rate=0.8, step=0.1)

    def grow(exact, block, held):
        import pyarrow as pa
        monkeypatch.setattr(B, "ROWS_IN_MEMORY", held)
        batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(t), pa.int32()), pa.array([r[0] for r in t]), pa.array([r[1] for r in t]),
                                               pa.array([r[2] for r in t], pa.list_(pa.float64()))], names=list("pywx")) for t in (table[:250], [], table[250:])]
        parts = B._read(iter(batches), thresholds, str(tmp_path), block)
        assert [b.n for b in parts[0]] == [min(block, 900 - lo) for lo in range(0, 900, block)]
        trees = list(B._boost(parts, dict(spec, exact=exact)))
        numbers = [np.array([[v, g, i, *st] for v, g, i, st in zip(t.value, t.gain, t.impurity, t.stats)]) for t in trees]
        return [(t.feature, t.bin, t.left, t.right, t.count) for t in trees], np.concatenate(numbers)

    whole, cut = grow(True, 1000, 10_000), grow(False, 128, 256)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1], rtol=1e-9, atol=1e-12)
    assert any(tmp_path.iterdir())  # rows were mapped to files


def test_random_numbers_and_exp_are_those_of_the_jvm(spark):
    jvm = spark._jvm
    r = jvm.org.apache.spark.util.random.XORShiftRandom(0)
    for seed in (0, 43, -5, 2 ** 40):
        r.setSeed(seed)
        assert [r.nextDouble() for _ in range(200)] == B.doubles(B.xorshift_start(seed), 200).tolist()
    java = jvm.java.util.Random(44)
    ours = B._JavaRandom(44)
    assert [java.nextLong() for _ in range(20)] == [ours.next_long() for _ in range(20)]
    x = np.concatenate([np.random.default_rng(3).normal(size=300) * 4, [0.0, -0.0, 1e-300, 800.0, -800.0]])
    assert [jvm.java.lang.Math.exp(float(v)) for v in x] == B.exp(x).tolist()


def jobs_so_far(spark):
    sc = spark.sparkContext
    sc.setJobGroup("count-of-jobs", "")
    sc.parallelize([1], 1).count()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return max(sc.statusTracker().getJobIdsForGroup("count-of-jobs"))


def test_a_fit_is_not_a_job_for_each_tree_level(spark):
    data = rows(spark, 600, 2).drop("weight")
    before = jobs_so_far(spark)
    MD.fit_calibrated(data, dict(maxIter=40, maxDepth=4, stepSize=0.3, seed=1), k=2)
    assert jobs_so_far(spark) - before < 150  # three fits of 40 trees of four levels


def test_spark_fits_where_cores_outweigh_the_rows():
    assert MD.grown_in_tasks(50_000, 8, 6) and MD.grown_in_tasks(100_000_000, 8, 6)
    assert MD.grown_in_tasks(1_000_000, 600, 6) and not MD.grown_in_tasks(10_000_000, 600, 6)


def test_one_class_alone_is_fitted_as_ever(spark):
    """Without negative rows every weight is 0."""
    data = rows(spark, 60, 1).drop("weight").withColumn("label", F.lit(1.0))
    model = MD.fit_calibrated(data, dict(maxIter=2, maxDepth=2, seed=1), k=2)
    assert model.predict(data).count() == 60
