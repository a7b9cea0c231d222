"""Stored tables: full URIs, half-written copies, changed inputs, shared folder."""

import os
import shutil

import pytest

from tidemark import session as S
from tidemark.plans import warehouse as W
from tests.conftest import SF0001


def test_uri_paths_are_kept(spark):
    assert W.qualified(spark, f"file://{SF0001}") == W.qualified(spark, SF0001) == f"file:{SF0001}"
    assert W.qualified(spark, "file:///a/b/") == "file:/a/b"
    w = W.Warehouse(spark, f"file://{SF0001}", materialize=False)
    assert w.customers.limit(1).count() == 1


def test_half_written_table_is_replaced(spark, tmp_path):
    final = str(tmp_path / "t")
    spark.range(3).write.parquet(final)
    os.remove(f"{final}/_SUCCESS")
    W.publish(spark, lambda p: spark.range(7).write.parquet(p), final)
    assert spark.read.parquet(final).count() == 7
    W.publish(spark, lambda p: spark.range(9).write.parquet(p), final)  # a complete copy wins
    assert spark.read.parquet(final).count() == 7 and os.listdir(tmp_path) == ["t"]


def test_fingerprint_sees_nested_files(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src / "t.parquet" / "day=1")
    f = src / "t.parquet" / "day=1" / "part-0.parquet"
    f.write_bytes(b"abc")
    before = W.input_fingerprint(spark, str(src))
    f.write_bytes(b"abcd")
    assert W.input_fingerprint(spark, str(src)) != before
    shutil.rmtree(src / "t.parquet" / "day=1")
    assert W.input_fingerprint(spark, str(src)) == ""


def test_no_local_folder_off_local_mode():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError):
        S.shared_root(Session())
    Session.sparkContext.master = "local[4]"
    assert S.shared_root(Session())
