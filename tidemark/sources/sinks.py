"""Sinks: prediction history, drift baseline/report files, customer upsert (whole or by bucket)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_predictions(scored: DataFrame, path: str) -> None:
    """Append a timestamped scoring batch, keeping history; partitioned by the
    scoring day so readers prune to the batches they need."""
    scored.withColumn("scored_date", F.to_date("scored_at")).write.mode("append") \
        .partitionBy("scored_date").parquet(path)


def latest_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Most recent batch per customer (max_by: an aggregate, safe for hot keys)."""
    h = spark.read.parquet(path)
    cols = [c for c in h.columns if c != "customer_id"]
    return h.groupBy("customer_id").agg(F.max_by(F.struct(*cols), F.col("scored_at")).alias("r")).select(
        "customer_id", "r.*")


def write_json(df: DataFrame, path: str) -> None:
    """Baseline / report as JSON lines (one row per feature)."""
    df.write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    schema = ("feature string, n long, min double, max double, mean double, std double, "
              "bins array<double>, hist array<double>, sample array<double>")
    return spark.read.schema(schema).json(path)


def upsert_by_key(existing: DataFrame, updates: DataFrame, key: str = "customer_id",
                  updated_col: str | None = None) -> DataFrame:
    """Insert-or-replace by key, latest wins: within ``updates`` the row with the
    greatest ``updated_col`` per key is kept (max_by aggregate), then old rows
    with those keys are removed by an anti join and the new rows appended."""
    if updated_col:
        cols = [c for c in updates.columns if c != key]
        updates = updates.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(updated_col)).alias("r")) \
                         .select(key, "r.*")
    kept = existing.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates.select(*existing.columns))


class BucketedStore:
    """A keyed table in buckets by a hash of the key, upserted in place.

    An upsert reads and rewrites only the buckets its keys fall into: they are found
    first (numbers below ``buckets``), the old rows are read with a partition filter,
    and dynamic partition overwrite replaces those folders alone. Within the updates
    the row with the greatest ``updated_col`` wins (ties: the greatest row); an update
    older than the stored row does not replace it. Rows without a key cannot be
    addressed and are refused."""

    def __init__(self, spark: SparkSession, path: str, key: str = "customer_id", updated_col: str = "updated_at", buckets: int = 64):
        self.spark, self.path, self.key, self.updated_col, self.buckets = spark, path.rstrip("/"), key, updated_col, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_bucket")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key, by an aggregate that combines before the shuffle."""
        rest = [c for c in rows.columns if c not in (self.key, "_bucket")]
        newest = F.max_by(F.struct(*rest), F.struct(F.col(self.updated_col), F.struct(*[c for c in rest if c != self.updated_col])))
        return rows.groupBy("_bucket", self.key).agg(newest.alias("r")).select(self.key, "r.*", "_bucket")

    def upsert(self, updates: DataFrame) -> list[int]:
        """Insert or replace by key; returns the buckets rewritten."""
        if updates.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"updates hold rows without {self.key}")
        new = self._latest(updates.withColumn("_bucket", self._bucket()))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        columns = new.columns
        if self._exists():
            old = self.spark.read.parquet(self.path).where(F.col("_bucket").isin(touched))
            columns = [c for c in old.columns if c != "_bucket"] + ["_bucket"]
            new = self._latest(old.select(columns).unionByName(new.select(columns)))
        # Spark will not overwrite what it reads: the merged buckets are settled first.
        settled = new.select(columns).repartition("_bucket").checkpoint(eager=True)
        settled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        return touched
