import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as DR
from tidemark.sources import raw, sinks


def test_csv_load_typed_and_not_null(spark):
    d = tempfile.mkdtemp(prefix="tidemark-csv-")
    with open(os.path.join(d, "customers.csv"), "w") as f:
        f.write("customer_id,industry,plan_tier,signup_date,mrr,churn_date,upgrade_date\n")
        f.write("c1,FinTech,starter,2026-02-12,500.00,,\n")
        f.write("c2,HealthTech,growth,2025-01-01,2000.00,2026-01-15,\n")
    t = raw.load_csv_tables(spark, d, ["customers"])["customers"]
    rows = {r["customer_id"]: r for r in t.collect()}
    assert rows["c1"]["churn_date"] is None and rows["c2"]["churn_date"] == dt.date(2026, 1, 15)
    assert str(rows["c2"]["mrr"]) == "2000.00"
    with open(os.path.join(d, "customers.csv"), "a") as f:
        f.write("c3,,starter,2025-01-01,1.00,,\n")
    with pytest.raises(raw.NotNullViolation):
        raw.load_csv_tables(spark, d, ["customers"])
    with pytest.raises(FileNotFoundError):
        raw.load_csv_tables(spark, d, ["usage_events"])


def test_append_predictions_keeps_history(spark):
    d = tempfile.mkdtemp(prefix="tidemark-pred-")
    b1 = spark.createDataFrame([("c1", 0.2, "2026-03-01T10:00:00"), ("c2", 0.7, "2026-03-01T10:00:00")],
                               "customer_id string, churn_probability double, scored_at string")
    b2 = spark.createDataFrame([("c1", 0.4, "2026-03-02T10:00:00")],
                               "customer_id string, churn_probability double, scored_at string")
    sinks.append_predictions(b1, d)
    sinks.append_predictions(b2, d)
    assert spark.read.parquet(d).count() == 3
    latest = {r["customer_id"]: r["churn_probability"] for r in sinks.latest_predictions(spark, d).collect()}
    assert latest == {"c1": 0.4, "c2": 0.7}


def test_upsert_latest_wins(spark):
    old = spark.createDataFrame([("c1", 100, 1), ("c2", 200, 1)], "customer_id string, mrr int, v int")
    new = spark.createDataFrame([("c2", 250, 2), ("c2", 260, 3), ("c3", 300, 1)], "customer_id string, mrr int, v int")
    got = {r["customer_id"]: r["mrr"] for r in sinks.upsert_by_key(old, new, "customer_id", "v").collect()}
    assert got == {"c1": 100, "c2": 260, "c3": 300}


def test_baseline_json_roundtrip(spark):
    df = spark.createDataFrame([(f"c{i}", float(i % 13)) for i in range(200)], "customer_id string, mrr double")
    base = DR.baseline(df, ["mrr"])
    d = tempfile.mkdtemp(prefix="tidemark-base-")
    sinks.write_json(base, d)
    back = sinks.read_baseline(spark, d).collect()[0]
    assert len(back["bins"]) == 11 and len(back["hist"]) == 10 and abs(sum(back["hist"]) - 1) < 1e-9


def test_publish_keeps_first_complete_copy(spark):
    from tidemark.plans.warehouse import publish
    root = tempfile.mkdtemp(prefix="tidemark-pub-")
    final = os.path.join(root, "t")
    publish(spark, lambda p: spark.range(3).write.parquet(p), final)
    publish(spark, lambda p: spark.range(5).write.parquet(p), final)  # loser: dropped, not nested
    assert spark.read.parquet(final).count() == 3
    assert sorted(os.listdir(root)) == ["t"]
    assert not [d for d in os.listdir(final) if ".tmp-" in d]


def _files(path):
    return {b: sorted((f, os.stat(os.path.join(path, b, f)).st_mtime_ns) for f in os.listdir(os.path.join(path, b))) for b in os.listdir(path) if b.startswith("_bucket=")}


def test_bucketed_upsert_rewrites_touched_buckets_only(spark):
    schema = "customer_id string, mrr int, updated_at int"
    store = sinks.BucketedStore(spark, os.path.join(tempfile.mkdtemp(prefix="tidemark-buckets-"), "t"), buckets=8)
    assert store.upsert(spark.createDataFrame([], schema)) == []
    store.upsert(spark.createDataFrame([(f"c{k}", k, 1) for k in range(200)], schema))
    before = _files(store.path)
    touched = store.upsert(spark.createDataFrame([("c7", 1000, 2), ("c7", 1001, 3), ("c7", 1001, 3), ("new", 5, 1), ("c8", 0, 0)], schema))
    after = _files(store.path)
    assert {int(b.split("=")[1]) for b in after if before.get(b) != after[b]} == set(touched) and len(touched) <= 3
    got = {r["customer_id"]: (r["mrr"], r["updated_at"]) for r in store.read().collect()}
    want = {f"c{k}": (k, 1) for k in range(200)} | {"c7": (1001, 3), "new": (5, 1)}  # the older row of c8 loses
    assert got == want and store.read().count() == len(want)
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(None, 1, 1)], schema))


def test_report_json_roundtrip(spark):
    train = spark.createDataFrame([(f"c{i}", float(i % 13)) for i in range(200)], "customer_id string, mrr double")
    prod = spark.createDataFrame([(f"c{i}", float(i % 13 + 4)) for i in range(150)], "customer_id string, mrr double")
    report = DR.drift_report(DR.psi(DR.baseline(train, ["mrr"]), prod, ["mrr"]), DR.ks(train, prod, ["mrr"]), dt.date(2001, 8, 1))
    d = tempfile.mkdtemp(prefix="tidemark-report-")
    sinks.write_json(report, d)
    back, want = spark.read.json(d).first(), report.first()
    assert (back["feature"], back["psi"], back["ks_stat"], back["has_drift"], back["drifted_features"]) == (
        want["feature"], want["psi"], want["ks_stat"], want["has_drift"], want["drifted_features"])
