"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def durable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and return a reader of the copy.

    The folder is the session's `spark.checkpoint.dir`. Where none is set, a local session
    (tests, one machine) gets a temporary folder; on a cluster, whose executors would not
    see it, that is an error. With `spark.cleaner.referenceTracking.cleanCheckpoints` the
    copies are removed once nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="quietlines-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, salt_from: str | None, salts: int = 8, how: str = "inner") -> DataFrame:
    """Join `rows` to a table with unique `key`; a hot key is spread over `salts` tasks, by `salt_from` or by the partition a row comes from.

    Both stay the same when a lost task is repeated.
    """
    seed = F.xxhash64(salt_from) if salt_from else F.spark_partition_id()
    left = rows.withColumn("_salt", F.pmod(seed, F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def plain(frame):
    """A pandas frame whose text columns hold Python objects.

    Selecting no row of an Arrow-backed text column leaves an array without chunks,
    which cannot be sent back to the JVM.
    """
    return frame.astype({c: object for c in frame.columns if str(frame[c].dtype) in ("str", "string", "string[pyarrow]")})
