"""Tables in the folder that driver and executors share, and joins that withstand hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder on a local master; elsewhere an error, as executors do not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch between an executor and its Python workers, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES in this session, unless it has a setting of its own. Spark's 10,000 rows are some 30 MB of
    texts, which a task holds several times, in the JVM's native memory and in its worker; rows of any size still go through whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given column names, each with as many underscores before it as make it new to df, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame | None:
    """The rows of all parts, each written to one table of the shared folder before the next is begun, so that the plan does not grow with their number; null if there is no part."""
    path, first = None, None
    for part in parts:
        if first is None:
            first, path = part, f"{shared_dir(part.sparkSession)}/{name}-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(path)
    return None if first is None else first.sparkSession.read.schema(first.schema).parquet(path)


#: A key with more than one row in this many is hot, so there are fewer hot keys than this; one with fewer rows than HOT_ROWS never is.
HOT_SHARE, HOT_ROWS = 512, 1000


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined with lookup, which has a row for each key at most. most: as many rows as there are, or more; where it is not given, they are counted.

    Keys with over 1/HOT_SHARE of the rows are fewer than HOT_SHARE by definition; their lookup rows are
    broadcast, so that such rows stay where they are. All other keys go through an ordinary join.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = (counts.agg(F.sum("count")).first()[0] or 0) if most is None else most
    hot = [r[0] for r in counts.filter(F.col("count") > max(HOT_ROWS, total // HOT_SHARE)).select(key).collect()] if total > HOT_ROWS else []
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(~is_hot).join(lookup.filter(~is_hot), key, how).unionByName(rows.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), key, how))
