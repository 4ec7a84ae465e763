"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z in UTF-8 bytes; bytes of longer characters are all above 0x7F.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case; none for null."""
    return text.translate(ASCII_LOWER).split() if text else []


def as_row(docs: DataFrame, *replaced: str) -> DataFrame:
    """One column ``row`` that holds all columns but those to be replaced."""
    plain = docs.drop(*replaced)
    return plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row"))


def field_of(batch, path: str | tuple[str, ...]):
    """A column of the ``row`` structs of an Arrow batch, or one nested in its columns."""
    column = batch.column("row")
    for name in (path,) if isinstance(path, str) else path:
        column = column.field(name)
    return column


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set once if the master is local;
    on a cluster that folder would be the driver's own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(found)
        return found
    own = context._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickweave-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows (a few numbers or digests each) of a partition of a table that later steps go over.
PART_ROWS = 50_000


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, in no more partitions than the rows need, and the number of rows.

    A small table made by a shuffle keeps the shuffle's partitions; each step over it would
    start as many tasks, and write as many files, again. What fits one partition is joined and
    grouped there without a shuffle. For tables of narrow rows only.
    """
    found = cut(df)
    rows = found.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).count()
    return found.coalesce(max(1, -(-rows // PART_ROWS))), rows


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, not yet made, below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def crc_mod(column: str, modulus: int):
    """crc32 of a key written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bytes(setting: str) -> int:
    """A Spark size such as 16m, 8MB or 1024b in bytes."""
    found = setting.lower().removesuffix("b")
    return int(found.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(found[-1:], 1)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Have Spark pass rows to Python in Arrow batches of at most ``size`` bytes (and one row), from now on.

    Spark's default of 64 MB a batch, held several times over by each map on each core, takes
    most of a small executor; a smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key)) > size:
        spark.conf.set(key, f"{size}b")


def larger_tasks(scan: DataFrame, size: int = 128 << 20) -> DataFrame:
    """A file scan in tasks of about ``size`` bytes where its splits are smaller, but not fewer than the cores.

    For operators that work once on what repeats within a task; nothing is shuffled.
    """
    spark = scan.sparkSession
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    now = scan.rdd.getNumPartitions()
    least = max(-(-now * split // size), min(now, spark.sparkContext.defaultParallelism))
    return scan.coalesce(least) if least < now else scan
