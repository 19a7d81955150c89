"""Shared helpers: table access, the shared scratch folder, folds and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into numpy arrays at once.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a local master
    (tests) uses a temporary folder and a cluster uses the warehouse.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if conf.get("spark.master", "local").startswith("local[") or conf.get("spark.master") == "local":
            base = f"file://{tempfile.gettempdir()}/annalist-scratch"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/annalist-scratch"
    return base.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage.

    The copy survives the loss of any executor, and later stages see one fixed
    set of rows however often they are retried.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) == 0


def bounded_ids(ids: DataFrame, column: str, bound: int, salt: int = 0) -> DataFrame:
    """At most ``bound`` distinct ids, the same ones on every run: least by hash, then by id."""
    order = F.xxhash64(F.lit(salt), F.col(column))
    return ids.where(F.col(column).isNotNull()).select(column).distinct().orderBy(order, column).limit(bound)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about ``size`` bytes of text, or ``SLICE_BYTES``; one text is never cut."""
    size = size or SLICE_BYTES
    for batch in batches:
        texts = batch.column(column)
        if batch.num_rows == 0:
            continue
        ends = offsets_of(texts)[1:]
        at, start = 0, int(offsets_of(texts)[0])
        while at < batch.num_rows:
            to = at + 1
            while to < batch.num_rows and ends[to] - start <= size:
                to += max(1, min(batch.num_rows - to, 64)) if ends[min(batch.num_rows - 1, to + 63)] - start <= size else 1
            yield batch.slice(at, to - at)
            start, at = int(ends[to - 1]), to


def offsets_of(texts: pa.Array):
    """The offsets of a string array into its data buffer, nulls as empty."""
    import numpy as np

    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    size = np.dtype(width).itemsize
    return np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * size).astype(np.int64)


def utf8_of(texts: pa.Array):
    """(bytes as uint8, offsets from 0) of a string array; a null text is empty."""
    import numpy as np

    texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
