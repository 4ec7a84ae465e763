"""The windowed data source: what is planned, what is read, what is pushed into it."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tickweave.sources import windowed as w

COLUMNS = "id long, k string, sec long, v double"


@pytest.fixture()
def stored(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b/c", "é ü"]), rng.choice([rng.randrange(1_000), 500 + rng.randrange(9)]), float(i)) for i in range(900)]
    path = f"file://{tmp_path}/pages"
    w.write_pages(spark.createDataFrame([*rows, (9_000, None, 3, 0.0), (9_001, "a", None, 0.0)], COLUMNS), path, "k", "sec", 70)
    return rows, {"path": path, "columns": COLUMNS, "key": "k", "time": "sec", "order": "id", "slot": 70, "start": 0, "stop": 1_000, "limit": 7, "most": 60}


def reader(options):
    from pyspark.sql.types import StructType

    return w.WindowedReader(StructType.fromDDL(COLUMNS), {k: str(v) for k, v in options.items()})


def test_reads_every_row_once(spark, stored):
    rows, options = stored
    found = w.windowed(spark, **options)
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    part = found.where(F.col("k").isin("a", "é ü") & (F.col("sec") >= 100) & (F.col("sec") < 505)).select("id")
    assert sorted(r.id for r in part.collect()) == sorted(i for i, k, s, _ in rows if k != "b/c" and 100 <= s < 505)


def test_windows_are_halved_until_they_fit(stored):
    rows, options = stored
    planned = reader(options).partitions()
    held = {(p.key, p.start, p.stop): sum(k == p.key and p.start <= s < p.stop for _, k, s, _ in rows) for p in planned}
    assert sum(held.values()) == 900 and max(held.values()) <= 60 and len({p.stop - p.start for p in planned}) > 3
    for key in ("a", "b/c", "é ü"):
        spans = sorted((s, e) for k, s, e in held if k == key)
        assert spans[0][0] == 0 and spans[-1][1] == 1_000 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    with pytest.raises(ValueError, match="more than 5 rows"):
        reader(options | {"most": 5}).partitions()


def test_filters_prune_the_plan(stored):
    _, options = stored
    own = reader(options)
    other = EqualTo(("v",), 1.0)
    assert list(own.pushFilters([In(("k",), ("a", "b/c")), EqualTo(("k",), "a"), GreaterThan(("sec",), 99), LessThanOrEqual(("sec",), 200), other])) == [other]
    planned = own.partitions()
    assert {p.key for p in planned} == {"a"} and min(p.start for p in planned) == 100 and max(p.stop for p in planned) == 201
    assert list(own.pushFilters([GreaterThan(("sec",), 5_000)])) == [] and own.partitions() == []


class Grown:
    """A service that has more rows when it is read than when it was planned."""

    def __init__(self, options):
        self.rows = int(options["rows"])

    def page(self, key, start, stop, limit, offset):
        return pa.table({"id": range(self.rows), "k": ["a"] * self.rows, "sec": [1] * self.rows, "v": [0.0] * self.rows}).slice(offset, limit)


def test_a_window_that_has_grown_is_an_error(stored):
    _, options = stored
    own = {**options, "client": f"{__name__}:Grown"}
    assert sum(b.num_rows for b in reader({**own, "rows": 60}).read(w.Window("a", 0, 9))) == 60
    with pytest.raises(ValueError, match="has grown"):
        list(reader({**own, "rows": 61}).read(w.Window("a", 0, 9)))
