"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, set as the checkpoint folder.

    Where the session names none, a temporary folder is taken if the master is local; on a
    cluster that would be the driver's own, so there it is an error.
    """
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not own.isEmpty():
        return own.get()
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tickweave-")
    if own.isEmpty():
        context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, not yet made, below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a partition of a table that is read over and over.
PART_ROWS = 50_000


def sized(df: DataFrame) -> DataFrame:
    """``cut``, then in no more partitions than the rows need.

    A small table made from a large one keeps the large one's partitions; whatever goes over it
    in hundreds of passes would start as many tasks each time, and every task answers to the
    driver and shuffles its share.
    """
    found = cut(df)
    return found.coalesce(max(1, -(-found.count() // PART_ROWS)))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
