"""Stages that are redone only for those parts whose inputs or code have changed.

A stage reads a table kept by key (one folder per key), and its result is kept by the same
key. What a part depends on is the listing of its files (names, lengths, times of change),
so nothing is read to find out, and the version that its code is given. An index of committed
parts is the only thing that says what counts: an attempt that ended early has no row in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder

_INDEX = "stage string, part string, print string, path string, run bigint"


def listed(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """``part, listing``: a digest of the names, lengths and times of each key's files; their contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    part = F.regexp_extract("path", f"/{key}=([^/]*)/", 1)
    entry = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return files.select(part.alias("part"), entry.alias("entry")).groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("listing"))


def _committed(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(_INDEX).parquet(f"{store}/index")
    except AnalysisException:
        return spark.createDataFrame([], _INDEX)


def staged(spark: SparkSession, store: str, name: str, version: str, folder: str, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with ``run``, the number of the call that made a part.

    ``build`` gets the rows of the parts that are stale and returns rows with ``key`` (those of
    a part must depend on that part alone). They are written to a folder of their own, and one
    append to the index commits them all. If no part is stale the input is not read. Parts
    whose folder has gone are no longer in the result. Two calls at a time both do the work;
    of equal parts the later run counts.
    """
    now = listed(spark, folder, key).select("part", F.sha2(F.concat_ws("|", F.lit(name), F.lit(version), "listing"), 256).alias("print"))
    now = now.persist()
    try:
        index = _committed(spark, store).where(F.col("stage") == name)
        run = (index.agg(F.max("run")).first()[0] or 0) + 1
        stale = now.join(index, ["part", "print"], "left_anti").select(F.col("part").alias("_part"))
        if stale.limit(1).count():
            path = new_folder(spark, f"stage-{name}")
            # the keys prune the folders that are read; they are as many as there are parts
            rows = spark.read.parquet(folder)
            rows = rows.join(F.broadcast(stale), rows[key].cast("string") == F.col("_part"), "left_semi")
            build(rows).write.partitionBy(key).parquet(path)
            made = stale.join(now, F.col("_part") == F.col("part")).select(F.lit(name).alias("stage"), "part", "print", F.lit(path).alias("path"), F.lit(run).cast("long").alias("run"))
            made.repartition(1).write.mode("append").parquet(f"{store}/index")
            index = _committed(spark, store).where(F.col("stage") == name)
        valid = index.join(now, ["part", "print"]).groupBy("part").agg(F.max_by(F.struct("path", "run"), "run").alias("at")).select("part", "at.*")
        out = None
        for path, number in sorted({(r.path, r.run) for r in valid.select("path", "run").distinct().collect()}, key=lambda r: r[1]):  # one per run
            at = spark.read.parquet(path)
            own = valid.where(F.col("path") == path).select(F.col("part").alias("_part"))
            at = at.join(F.broadcast(own), at[key].cast("string") == F.col("_part"), "left_semi").withColumn("run", F.lit(number).cast("long"))
            out = at if out is None else out.unionByName(at)
        return build(spark.read.parquet(folder)).limit(0).withColumn("run", F.lit(0).cast("long")) if out is None else out
    finally:
        now.unpersist()
