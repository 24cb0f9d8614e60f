"""What the operators of this subpackage share: tables, scratch space, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between two of these ASCII characters lies a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint
    folder. Without either, a session in one process gets a temporary one, and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables in the shared folder, each written once and read however often.

    Writing a table cuts the lineage and survives lost executors. A table that is written again under
    the same name replaces the one before it, and drop() removes a table, so nothing may read the old
    one from then on. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}
        atexit.register(self.keep)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the named tables."""
        jsc = self.spark.sparkContext._jsc
        for name in names:
            path = self.paths.pop(name, None)
            if path and jsc is not None and not jsc.sc().isStopped():
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, *names: str) -> None:
        """Remove all but the named tables."""
        self.drop(*[n for n in self.paths if n not in names])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of its own that stays until the driver ends."""
    return Scratch(df.sparkSession).table(df, tag)


def prefix(columns: Iterable[str]) -> str:
    """Two underscores, or as many more as it takes until none of the columns starts with them."""
    p = "__"
    while any(c.startswith(p) for c in columns):
        p += "_"
    return p


def quoted(name: str) -> str:
    """name as an identifier of its own, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    t = F.coalesce(text, F.lit(""))
    inner = F.regexp_replace(t, rf"^{WORD_GAP}|{WORD_GAP}\z", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, WORD_GAP, -1))).cast("long")


def bucket_count(rows: int, per_bucket: int, least: int = 1) -> int:
    return max(least, -(-rows // per_bucket))
