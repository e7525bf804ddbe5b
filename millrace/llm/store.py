"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SEEN: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's ``spark.checkpoint.dir``, deleted when the driver ends. Only in local
    mode, where driver and executors are one, that setting may be missing (as in tests): then a folder of our own."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    folder = f"{own.rstrip('/')}/millrace-{app}"
    if (app, folder) not in _SEEN:
        _SEEN.add((app, folder))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read again: later stages neither recompute nor lose it with an executor,
    and the planner knows its size, so that joins broadcast it only when that size allows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table from ``materialize`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the input does not have, so that extra columns cannot clash with ours."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with over 1/HOT_PARTS of all rows counts as hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 500


def meet(rows: DataFrame, found: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has one row for each key and in ``size`` how many of all ``total`` rows
    have it at most. No key's rows land in one task: the keys that could crowd one are fewer than HOT_PARTS, which
    bounds their broadcast; the others hold at most 1/HOT_PARTS of the rows each."""
    hot = F.col(size) > total / HOT_PARTS
    crowded, others = found.where(hot).drop(size), found.where(~hot).drop(size)
    apart = rows.join(F.broadcast(crowded.select(key)), key, "left_anti")
    return rows.join(F.broadcast(crowded), key).unionByName(apart.join(others, key))
