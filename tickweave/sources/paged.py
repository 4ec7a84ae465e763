"""Sources that hand out pages: chains of cursors, followed where their start lies."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

#: Pages of one chain after which a scan is taken for endless.
MOST_PAGES = 1_000_000


def cursor_pages(starts: DataFrame, fetch: Callable[[str, str | None], tuple[Iterable[tuple], str | None]], columns: str) -> DataFrame:
    """Rows of all pages of all chains: ``chain, page`` and ``columns`` (a schema in DDL).

    ``starts`` has one row per chain (a tag, a series, a window) in its first column.
    ``fetch(chain, cursor)`` returns a page's rows and the next cursor; the first cursor is
    null and an empty one ends the chain. Pages of a chain must be read one after the other,
    so chains, not pages, are what is spread over tasks; a task holds one page. ``fetch``
    must be repeatable, since a lost task reads its chains again.
    """
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(columns).names

    def run(frames):
        for frame in frames:
            for chain in frame.iloc[:, 0]:
                cursor, seen = None, set()
                for page in range(MOST_PAGES + 1):
                    if page == MOST_PAGES or cursor in seen:
                        raise RuntimeError(f"{chain}: the cursors do not end")
                    seen.add(cursor)
                    rows, cursor = fetch(chain, cursor)
                    rows = list(rows)
                    if rows:
                        found = pd.DataFrame(rows, columns=names)
                        found.insert(0, "page", page)
                        found.insert(0, "chain", chain)
                        yield found
                    if not cursor:
                        break

    return starts.select(starts.columns[0]).mapInPandas(run, f"chain string, page int, {columns}")
