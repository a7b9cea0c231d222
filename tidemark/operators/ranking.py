"""Global order statistics without a single-partition window.

``Window.orderBy(...)`` with no partition moves the whole table into one task.
Instead:

* ``global_positions``: range-partition on the sort key (Spark samples the
  bounds), sort inside each partition, number the rows with
  ``monotonically_increasing_id`` (partition and place in it), checkpoint, then
  add each partition's offset. The only thing that reaches the driver is one row
  count per partition.
* ``prefix_sums``: running sums in a sort order the same way, with a window
  inside each range.
* ``average_ranks``: ranks with ties averaged, from the prefix sums of the
  column's value counts (one row per distinct value).

* ``exact_quantiles``: order statistics of groups from the prefix sums of their
  value counts; a group's values are never in one buffer.

They feed NTILE/decile buckets, medians and percentiles, rank-sum tests, two-sample KS, Spearman
correlation and AUC; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _num_partitions(df: DataFrame) -> int:
    from tidemark.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)  # the local numbering pass is checkpointed
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _ranged(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` in sorted ranges with each row's range (_pid) and place in it (_lpos), checkpointed."""
    n = partitions or _num_partitions(df)
    at = F.monotonically_increasing_id()
    return (df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at)
            .withColumn("_pid", F.shiftright("_at", 33).cast("int")).withColumn("_lpos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at").checkpoint(eager=True))


def global_positions(df: DataFrame, order: list[Column], pos_col: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in the total order ``order`` (must be a strict order:
    include an id column as the last key for determinism)."""
    numbered = _ranged(df, order, partitions)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    offsets, acc = [], 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((int(r["_pid"]), acc))
        acc += int(r["n"])
    off = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return (numbered.join(F.broadcast(off), "_pid", "left")
            .withColumn(pos_col, F.col("_lpos") + F.coalesce(F.col("_off"), F.lit(0)))
            .drop("_pid", "_lpos", "_off"))


def average_ranks(df: DataFrame, col: str, rank_col: str | None = None) -> DataFrame:
    """Attach the 1-based average rank of ``col`` (ties share the mean rank)."""
    rank_col = rank_col or f"{col}_rank"
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    table = prefix_sums(counted, [col], ["_cnt"]).select(
        col, (F.col("_cnt_before") + (F.col("_cnt") + 1) / 2.0).alias(rank_col))
    return df.join(table, col, "left")


def prefix_sums(df: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """Add ``<weight>_before``: the sum of ``weight`` over the rows before this one
    in the order of ``order`` (a strict order). Ranges give offsets, a window
    inside each range the rest."""
    ranged = _ranged(df, [F.col(c) for c in order])
    sums = ranged.groupBy("_pid").agg(*[F.sum(w).alias(w) for w in weights]).collect()  # one row per partition
    offsets, acc = [], [0] * len(weights)
    for r in sorted(sums, key=lambda r: r["_pid"]):
        offsets.append((int(r["_pid"]), *acc))
        acc = [a + int(r[w] or 0) for a, w in zip(acc, weights)]
    schema = ", ".join(["_pid int"] + [f"_off{k} long" for k in range(len(weights))])
    off = df.sparkSession.createDataFrame(offsets or [(0, *acc)], schema)
    inside = Window.partitionBy("_pid").orderBy("_lpos").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_in{k}") for k, w in enumerate(weights)])
    out = out.join(F.broadcast(off), "_pid", "left")
    return out.select(*df.columns, *[(F.col(f"_in{k}") + F.coalesce(F.col(f"_off{k}"), F.lit(0))).alias(f"{w}_before")
                                     for k, w in enumerate(weights)])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """keys, n, q0, q1, ...: the exact quantiles of each group, with linear
    interpolation between the two order statistics around p * (n - 1). Nulls are left out.

    Values are counted (combined on the map side, so a repeated value is one row),
    counts become ranks by prefix sums over sorted ranges, and a quantile is the
    value whose ranks hold the wanted one: only aggregates per group remain."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = prefix_sums(counted, [*keys, "_v"], ["_cnt"])
    groups = ranked.groupBy(*keys).agg(F.sum("_cnt").alias("n"), F.min("_cnt_before").alias("_first"))
    if keys:
        rows = _join_groups(ranked, groups, keys)
    else:
        one = groups.first()  # one row
        rows = ranked.withColumn("n", F.lit(one["n"] or 0)).withColumn("_first", F.lit(one["_first"] or 0))
    at = F.col("_cnt_before") - F.col("_first")  # rank of the value's first row
    aggs, out = [F.max("n").alias("n")], []
    for k, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.max(F.when((at <= rank) & (rank < at + F.col("_cnt")), F.col("_v"))).alias(f"_{side}{k}"))
        lo, hi, place = F.col(f"_lo{k}"), F.col(f"_hi{k}"), F.lit(float(p)) * (F.col("n") - 1)
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(f"q{k}"))
    return rows.groupBy(*keys).agg(*aggs).select(*keys, "n", *out)


def _join_groups(ranked: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Give every value its group's row; null keys are groups too."""
    renamed = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return ranked.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))])


def ntile_from_position(pos: Column, n_rows: Column, buckets: int) -> Column:
    """NTILE(buckets) for a 0-based position among n rows (first n % b buckets get one extra)."""
    q = F.floor(n_rows / buckets)
    r = n_rows % buckets
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1)) + 1).otherwise(F.floor((pos - big) / q) + r + 1).cast("long")
