"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import apply_query_settings, shared_root


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on (UTC, AQE, package on the workers);
    Arrow batches by bytes, since rows may be very long texts."""
    apply_query_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns
    of the input, whatever they are called, cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fold(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(mod))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, and every executor sees the files."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, null kept as None."""
    return column.cast(pa.binary()).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` at most (one row
    may be longer): bounds the memory of what is derived from a batch. The parts
    are copies: some Arrow string kernels misread slices that do not begin at 0."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        step = max(1, int(n * max_bytes / max(b.nbytes, 1)))
        for i in range(0, n, step):
            yield b if step >= n else b.take(pa.array(np.arange(i, min(i + step, n))))


def words_of_batch(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-case A-Z and split on ASCII white space. Returns (row offsets,
    distinct words, index of each word occurrence); null and empty rows have no words."""
    import pyarrow.compute as pc
    col = pc.fill_null(column, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(col))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    enc = flat.dictionary_encode()
    idx = np.asarray(enc.indices).astype(np.int64)
    empty = np.asarray(pc.equal(enc.dictionary, ""))
    if empty.any():  # blanks at either end of a text
        keep = ~empty[idx]
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, idx = before[offsets], idx[keep]
    return offsets, enc.dictionary, idx


def crc_fold_py(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod
