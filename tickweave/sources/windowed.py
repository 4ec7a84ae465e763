"""A Spark data source over a paged service that hands out a bounded number of rows per window.

Such a service answers for a key and a half-open window of time, a page at a time, in order of
time, and no further than an offset. The reader halves windows that hold more rows than that
until none does; each window left is a partition, read page by page on an executor. Filters on
key and time reach the planner, so keys and spans that a query leaves out are never asked for.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Without this setting Spark offers no filters to Python sources; rows are the same.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Client(Protocol):
    """What a service must answer; made on driver and executors alike from the source's options."""

    def keys(self) -> list[str]: ...

    def page(self, key: str, start: int, stop: int, limit: int, offset: int) -> pa.Table:
        """Rows ``offset`` to ``offset + limit`` of the key's rows in ``[start, stop)``, in an order that does not change."""
        ...


class PageStore:
    """A client over Parquet files by key and slot of time, as ``write_pages`` makes them.

    Options: ``path``, ``time`` (column), ``order`` (column that breaks ties), ``slot`` (seconds).
    A slot outside the window is not opened, and one wholly before the offset is only counted.
    """

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(options["path"])
        self.time, self.order, self.slot = options["time"], options["order"], int(options["slot"])
        self._slots: dict[str, list[tuple[int, list[str], int]]] = {}
        self._last: tuple[list[str], pa.Table] | None = None

    def _folders(self, path: str, prefix: str) -> dict[str, str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {i.base_name.removeprefix(prefix): i.path for i in found if i.base_name.startswith(prefix)}

    def keys(self) -> list[str]:
        return sorted(bytes.fromhex(name).decode() for name in self._folders(self.root, "_key="))

    def _counted(self, key: str) -> list[tuple[int, list[str], int]]:
        """Begin, files and rows of the key's slots, in order of time; counted once from the files' footers."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        if key not in self._slots:
            out = []
            for slot, folder in self._folders(f"{self.root}/_key={key.encode().hex()}", "_slot=").items():
                files = [i.path for i in self.fs.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".parquet")]
                out.append((int(slot) * self.slot, files, sum(pq.read_metadata(f, filesystem=self.fs).num_rows for f in files)))
            self._slots[key] = sorted(out)
        return self._slots[key]

    def _read(self, files: list[str]) -> pa.Table:
        """A slot's rows in order; the last one is kept, since pages follow each other."""
        import pyarrow.parquet as pq

        if self._last is None or self._last[0] != files:
            rows = pa.concat_tables([pq.read_table(f, filesystem=self.fs, partitioning=None) for f in files])
            self._last = files, rows.sort_by([(self.time, "ascending"), (self.order, "ascending")])
        return self._last[1]

    def page(self, key: str, start: int, stop: int, limit: int, offset: int) -> pa.Table:
        parts = []
        for begin, files, held in self._counted(key):
            if begin + self.slot <= start or begin >= stop or limit <= 0:
                continue
            if start <= begin and begin + self.slot <= stop and held <= offset:
                offset -= held
                continue
            rows = self._read(files)
            rows = rows.filter(pc.and_(pc.greater_equal(rows.column(self.time), start), pc.less(rows.column(self.time), stop)))
            taken = rows.slice(offset, limit)
            offset, limit = max(0, offset - rows.num_rows), limit - taken.num_rows
            parts.append(taken)
        return pa.concat_tables(parts) if parts else pa.table({})


def write_pages(rows: DataFrame, path: str, key: str, time: str, slot: int) -> None:
    """``rows`` as files that ``PageStore`` serves; rows without key or time are in no window and are left out."""
    placed = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumns({"_key": F.lower(F.hex(F.encode(F.col(key), "utf-8"))), "_slot": F.floor(F.col(time) / slot)})
    placed.repartition("_key", "_slot").write.partitionBy("_key", "_slot").parquet(path)


@dataclass
class Window(InputPartition):
    key: str
    start: int
    stop: int

    def __post_init__(self):
        super().__init__((self.key, self.start, self.stop))


class WindowedReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.key, self.time = options["key"], options["time"]
        self.limit, self.most = int(options["limit"]), int(options["most"])
        self.least = int(options.get("least", "1"))
        self.start, self.stop = int(options["start"]), int(options["stop"])
        self.wanted: set[str] | None = None

    def client(self) -> Client:
        module, _, name = self.options.get("client", f"{__name__}:PageStore").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if column == self.key and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            elif column == self.time and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, value + isinstance(f, GreaterThan))
            elif column == self.time and isinstance(f, (LessThan, LessThanOrEqual)):
                self.stop = min(self.stop, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One window each, none of which holds more than ``most`` rows; one that cannot be halved any more is an error."""
        client, out = self.client(), []
        for key in client.keys():
            if self.wanted is not None and key not in self.wanted:
                continue
            open_ = [(self.start, self.stop)] if self.start < self.stop else []
            while open_:
                start, stop = open_.pop()
                if not client.page(key, start, stop, 1, self.most).num_rows:
                    out.append(Window(key, start, stop))
                elif stop - start <= self.least:
                    raise ValueError(f"{key}: more than {self.most} rows in [{start}, {stop})")
                else:
                    middle = start + (stop - start) // 2
                    open_ += [(middle, stop), (start, middle)]
        return out

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        client, schema = self.client(), to_arrow_schema(self.schema)
        for offset in range(0, self.most + 1, self.limit):
            page = client.page(partition.key, partition.start, partition.stop, min(self.limit, self.most + 1 - offset), offset)
            if offset + page.num_rows > self.most:
                raise ValueError(f"{partition.key}: [{partition.start}, {partition.stop}) has grown beyond {self.most} rows since it was planned")
            if page.num_rows:
                yield from page.select(schema.names).cast(schema).to_batches()
            if page.num_rows < self.limit:
                return


class WindowedSource(DataSource):
    """Format ``windowed``. Options: ``columns`` (DDL), ``key``, ``time``, ``start``, ``stop``, ``limit`` (rows of a page),
    ``most`` (rows that a window may hold), ``least`` (narrowest window), ``client`` (``module:class``) and the client's own.
    """

    @classmethod
    def name(cls) -> str:
        return "windowed"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return WindowedReader(schema, dict(self.options))


def windowed(spark: SparkSession, **options: Any) -> DataFrame:
    """The source's rows as a table; columns and windows are pruned by the filters put on it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WindowedSource)
    return spark.read.format("windowed").options(**{k: str(v) for k, v in options.items()}).load()
