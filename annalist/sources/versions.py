"""Tables that are replaced all at once: each run writes a version of its own, and one small file says which one holds.

A run writes all tables of a version into a folder that no other run uses, and
then the marker ``_versions/<number>``, by a create that fails if another run
has taken the number.  Readers take the greatest marker.  A run that is killed
leaves a folder without a marker, which no reader sees; running it again gives
a new one.  Nothing is rewritten in place, so readers of the version before go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def markers(spark: SparkSession, base: str) -> dict[int, str]:
    """Folder of each version that was published."""
    fs, path = _fs(spark, base)
    if not fs.exists(path(f"{base}/_versions")):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(path(f"{base}/_versions"))]
    return {int(n.split("-", 1)[0]): n.split("-", 1)[1] for n in names if n[:1].isdigit()}


def stage(tables: Mapping[str, DataFrame], base: str) -> str:
    """Write the tables of a version that no reader sees yet; its folder."""
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{base}/{folder}/{name}")
    return folder


def commit(spark: SparkSession, base: str, folder: str) -> int:
    """Make a staged version the one that holds."""
    fs, path = _fs(spark, base)
    while True:
        number = max(markers(spark, base), default=0) + 1
        claim = path(f"{base}/_claims/{number}")
        if fs.createNewFile(claim):  # one run alone gets a number
            fs.create(path(f"{base}/_versions/{number:012d}-{folder}"), False).close()
            return number
        if number in markers(spark, base):
            continue
        # claimed by a run that has not marked it: it may have been killed in between, so the number is passed over
        while not fs.createNewFile(path(f"{base}/_claims/{(number := number + 1)}")):
            pass
        fs.create(path(f"{base}/_versions/{number:012d}-{folder}"), False).close()
        return number


def publish(tables: Mapping[str, DataFrame], base: str) -> int:
    """Replace all tables below ``base`` at once."""
    spark = next(iter(tables.values())).sparkSession
    return commit(spark, base, stage(tables, base))


def read(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the version that holds, or of a given one."""
    found = markers(spark, base)
    if not found:
        raise FileNotFoundError(f"no version below {base}")
    return spark.read.parquet(f"{base}/{found[version or max(found)]}/{name}")


def expire(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Remove all versions but the last ``keep``, and what killed runs have left; the folders removed.

    Only for times at which no run is writing.
    """
    fs, path = _fs(spark, base)
    found = markers(spark, base)
    stay = {found[v] for v in sorted(found)[-keep:]}
    gone = []
    for f in fs.listStatus(path(base)):
        name = f.getPath().getName()
        if f.isDirectory() and not name.startswith("_") and name not in stay:
            fs.delete(f.getPath(), True)
            gone.append(name)
    for v in sorted(found)[:-keep]:
        fs.delete(path(f"{base}/_versions/{v:012d}-{found[v]}"), False)
    return gone
