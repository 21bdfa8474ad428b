"""Where jobs put what every executor has to read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster names; a temporary one where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Short rows (an id and a few numbers) of a written table that may be broadcast.
BROADCAST = 500_000


def checked(small: DataFrame, rows: int) -> DataFrame:
    """A written table of so many short rows, marked to be broadcast only if they are few."""
    return F.broadcast(small) if rows <= BROADCAST else small


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose id is not in the one column of ids; few ids go to the rows, many meet them in a join. Null ids stay."""
    gone = cut(ids.toDF("gone__").distinct())
    return df.join(checked(gone, gone.count()), df[column].cast("long") == gone["gone__"], "left_anti")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder, so that what follows neither recomputes them nor fails with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """The state of an iteration. A checkpoint hands the estimated size of its plan on, and joins multiply estimates, so that after
    some rounds the estimate alone fills the driver; a table that is written and read again has the size of its files. Each round's
    table takes the place of the one before, which nothing but the new one may have been made of."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.n = spark, fresh_dir(spark, label), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        if self.n > 1:
            delete(self.spark, f"{self.path}/{self.n - 1}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def end(self, df: DataFrame) -> DataFrame:
        """What is made of the last state, as a checkpoint; the state itself is deleted."""
        done = cut(df)
        delete(self.spark, self.path)
        return done
