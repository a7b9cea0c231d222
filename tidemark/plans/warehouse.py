"""Raw tables, staging views and marts for one data directory and one ``as_of``.

Raw tables and marts are *tables* (materialised once, like the original's
warehouse tables and dbt table models); staging stays lazy. Materialisation
writes parquet under the shared folder named by ``spark.checkpoint.dir``,
which also cuts lineage, so an executor lost later re-reads files instead of
recomputing the adapter joins.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession

from tidemark import session as S
from tidemark.functions import constants as K
from tidemark.operators import features, risk, staging
from tidemark.sources import adapter

_LOCK = threading.Lock()
_CACHE: dict[tuple, "Warehouse"] = {}
LAYOUT_VERSION = "5"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _fs_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate results."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI: whatever store it is in, and however it is spelled."""
    p, fs = _fs(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def publish(spark: SparkSession, write_to, final: str, marker: str = "_SUCCESS") -> None:
    """Write into a private temporary path, then rename it into place. If another
    process published first, its complete copy (one with ``marker``) is kept and
    ours is dropped; a folder without the marker is a broken copy and is replaced."""
    import uuid
    tmp = f"{final}.tmp-{uuid.uuid4().hex}"
    write_to(tmp)
    src, fs = _fs(spark, tmp)
    dst, _ = _fs(spark, final)
    fs.mkdirs(dst.getParent())
    done, _ = _fs(spark, f"{final}/{marker}")
    if fs.exists(dst) and not fs.exists(done):
        fs.delete(dst, True)
    # renaming onto an existing directory would nest the copy inside it: keep the winner's
    if fs.exists(dst) or not fs.rename(src, dst):
        fs.delete(src, True)
        if not fs.exists(done):
            raise RuntimeError(f"{final} could not be published")


_CODE_FILES = ["operators/cohort.py", "sources/adapter.py", "sources/driver_tables.py", "operators/staging.py", "operators/features.py",
               "operators/risk.py", "functions/constants.py", "functions/columns.py", "plans/warehouse.py"]


def code_fingerprint(files: list[str] = _CODE_FILES) -> str:
    """Hash of the code that defines the stored tables: changed logic gets new tables."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in files:
        with open(os.path.join(root, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:12]


def input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Paths, sizes and modification times of all input files, however deep: a
    changed input gets new tables."""
    p, fs = _fs(spark, sf_dir)
    parts = []
    if fs.exists(p):
        files = fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            parts.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
    return "|".join(sorted(parts))


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.date = K.ORDERS_AS_OF,
                 materialize: bool = True):
        self.spark = spark
        self.sf_dir = qualified(spark, sf_dir)
        self.as_of = as_of
        self.materialize = materialize
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._locks_guard = threading.Lock()
        key = (f"{self.sf_dir}|{as_of.isoformat()}|{LAYOUT_VERSION}|{code_fingerprint()}|"
               f"{input_fingerprint(spark, self.sf_dir)}")
        self.key = hashlib.sha1(key.encode()).hexdigest()[:16]
        self._root = None
        if materialize:
            S.ensure_checkpoint_dir(spark)
            self._root = f"{S.shared_root(spark)}/tidemark-warehouse/{self.key}"

    # -- materialisation ---------------------------------------------------
    def _table(self, name: str, build) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        with self._locks_guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:  # one builder per table even when levels run concurrently
            if name in self._tables:
                return self._tables[name]
            if not self.materialize:
                df = build()
            else:
                path = f"{self._root}/{name}"
                if not _fs_exists(self.spark, f"{path}/_SUCCESS"):
                    publish(self.spark, lambda tmp: build().write.mode("overwrite").parquet(tmp), path)
                df = self.spark.read.parquet(path)
            self._tables[name] = df
            return df

    # -- raw tables ----------------------------------------------------------
    @property
    def customers(self) -> DataFrame:
        return self._table("customers", lambda: adapter.customers(self.spark, self.sf_dir, self.as_of))

    @property
    def usage_events(self) -> DataFrame:
        return self._table("usage_events",
                           lambda: adapter.usage_events(self.spark, self.sf_dir, self.customers, self.as_of))

    @property
    def support_tickets(self) -> DataFrame:
        return self._table("support_tickets",
                           lambda: adapter.support_tickets(self.spark, self.sf_dir, self.customers, self.as_of))

    @property
    def gtm_opportunities(self) -> DataFrame:
        return self._table("gtm_opportunities",
                           lambda: adapter.gtm_opportunities(self.spark, self.sf_dir, self.customers, self.as_of))

    @property
    def risk_signals(self) -> DataFrame:
        return self._table("risk_signals",
                           lambda: adapter.risk_signals(self.spark, self.sf_dir, self.customers))

    @property
    def expansion_outreach_log(self) -> DataFrame:
        return self._table("expansion_outreach_log",
                           lambda: adapter.expansion_outreach_log(self.spark, self.sf_dir, self.customers,
                                                                  self.as_of))

    # -- staging (lazy views) -------------------------------------------------
    def stg_customers(self) -> DataFrame:
        return staging.stg_customers(self.customers, self.as_of)

    def stg_usage_events(self) -> DataFrame:
        return staging.stg_usage_events(self.usage_events)

    def stg_support_tickets(self) -> DataFrame:
        return staging.stg_support_tickets(self.support_tickets, self.customers)

    def stg_gtm_opportunities(self) -> DataFrame:
        return staging.stg_gtm_opportunities(self.gtm_opportunities, self.customers)

    def stg_risk_signals(self) -> DataFrame:
        return staging.stg_risk_signals(self.risk_signals)

    def stg_expansion_outreach(self) -> DataFrame:
        return staging.stg_expansion_outreach(self.expansion_outreach_log, self.as_of)

    # -- marts (tables) --------------------------------------------------------
    @property
    def churn_features(self) -> DataFrame:
        return self._table("mart_customer_churn_features", lambda: features.mart_churn_features(
            self.stg_customers(), self.event_days, self.stg_support_tickets(), self.as_of))

    @property
    def event_days(self) -> DataFrame:
        """Usage events summed per customer, day and type; ordered by day, so that a
        date filter skips files and row groups."""
        return self._table("event_days", lambda: features.event_days(self.stg_usage_events()).repartitionByRange("day")
                           .sortWithinPartitions("day", "customer_id"))

    @property
    def risk_scores(self) -> DataFrame:
        return self._table("mart_customer_risk_scores", lambda: risk.mart_risk_scores(self.churn_features))

    @property
    def expansion_features(self) -> DataFrame:
        return self._table("mart_customer_expansion_features", lambda: features.mart_expansion_features(
            self.stg_customers(), self.churn_features, self.event_days, self.stg_support_tickets(),
            self.stg_gtm_opportunities(), self.stg_expansion_outreach(), self.as_of))

    @property
    def propensity_quadrant(self) -> DataFrame:
        return self._table("mart_propensity_quadrant",
                           lambda: risk.quadrant_mart(self.risk_scores, self.expansion_features))

    @property
    def train_churn_pit(self) -> DataFrame:
        """Point-in-time churn training set (obs_date = churn date or as_of)."""
        return self._table("train_churn_pit", lambda: features.train_churn_pit(
            self.customers, self.event_days, self.support_tickets, self.as_of))

    @property
    def train_expansion_pit(self) -> DataFrame:
        return self._table("train_expansion_pit", lambda: features.train_expansion_pit(
            self.customers, self.event_days, self.support_tickets, self.gtm_opportunities, self.as_of))

    @property
    def eda_features(self) -> DataFrame:
        from tidemark.operators import cohort
        return self._table("eda_features", lambda: cohort.feat_eda_all(self.customers, self.event_days, self.support_tickets, self.as_of))

    RAW_TABLES = ["customers", "usage_events", "support_tickets", "gtm_opportunities", "risk_signals",
                  "expansion_outreach_log"]
    MARTS = ["churn_features", "risk_scores", "expansion_features", "propensity_quadrant"]
    TRAINING_SETS = ["train_churn_pit", "train_expansion_pit"]
    # dependency levels: tables inside a level are independent Spark jobs
    LEVELS = [["customers"],
              ["usage_events", "support_tickets", "gtm_opportunities", "risk_signals", "expansion_outreach_log"],
              ["event_days"],
              ["churn_features", "train_churn_pit", "train_expansion_pit", "eda_features"],
              ["risk_scores", "expansion_features"],
              ["propensity_quadrant"]]

    def build_all(self, parallelism: int = 4) -> None:
        """Materialise every table, level by level; within a level the builds are
        submitted concurrently (independent jobs share the cluster, like a dbt
        run with several threads)."""
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for level in self.LEVELS:
                list(pool.map(lambda n: getattr(self, n), level))


def warehouse(spark: SparkSession, sf_dir: str, as_of: _dt.date = K.ORDERS_AS_OF,
              materialize: bool = True) -> Warehouse:
    """Memoised per (session, directory, as_of)."""
    key = (spark._jsparkSession.sessionUUID(), qualified(spark, sf_dir), as_of, materialize)
    with _LOCK:
        wh = _CACHE.get(key)
        if wh is None:
            wh = Warehouse(spark, sf_dir, as_of, materialize)
            _CACHE[key] = wh
        return wh
