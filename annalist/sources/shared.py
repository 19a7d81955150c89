"""The folder that driver and executors share for checkpoints and stream output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one; a temporary folder on a local master; else the warehouse."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if conf.get("spark.master", "").startswith(("local[", "local*")) or conf.get("spark.master") == "local":
        return f"file://{tempfile.gettempdir()}/annalist-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/annalist-shared"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told_once(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose ``key`` no other row has, the others, or none where there are none)."""
    again = keep(rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("_again")))
    if not again.limit(1).count():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
