"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Without either, a session in one process gets a
    temporary one, and a cluster is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed there, so that its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def dealt(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder whose files are dealt and sorted by the key, so that joins by it don't
    shuffle it. The table's name goes at the end; what was made of it has to be settled by then."""
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
