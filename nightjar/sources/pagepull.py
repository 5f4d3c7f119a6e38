"""Incremental pull of landed query-log pages as a Spark data source (S-4, ST-1).

A puller lands pages under names that sort by time. The source streams the names of pages that
are behind its offset, the last page that was taken: it lists the folder newest first and stops
at the offset, so older pages are never touched, however many a folder holds. A pull admits
``maxPages`` pages, the oldest unread ones, and tells how many it leaves for the next. Only
names pass through it; the pages themselves are read by Spark's JSON reader.

    spark.dataSource.register(LandedPages)
    spark.readStream.format("landed_pages").option("path", folder).option("maxPages", 200).load()

Pages lie on any store that Arrow knows. Names that start with ``.`` or ``_`` are work in
progress. A page that lands late, under a name before the offset, is not seen (the cursor of
the pull that this replaces drops its entries too).
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Most pages of a pull.
MAX_PAGES = 200


def unread(folder: str, last: str) -> list[tuple[str, str]]:
    """``(name, path)`` of the pages behind ``last``, newest first."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
    found = []
    entries = {e.base_name: e for e in store.get_file_info(fs.FileSelector(base, recursive=False))}
    for name in sorted(entries, reverse=True):
        if name <= last:
            break
        if not name.startswith((".", "_")):
            found.append((name, f"{folder.rstrip('/')}/{name}"))
    return found


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "page string, path string, left int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PageReader(self.options)


class PageReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.most = options["path"], int(options.get("maxPages", MAX_PAGES))
        self.after = options.get("after", "")

    def initialOffset(self) -> dict:
        return {"last": self.after}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        pages = unread(self.folder, start["last"])
        taken = pages[max(0, len(pages) - self.most):]
        left = len(pages) - len(taken)
        return iter([(*p, left) for p in reversed(taken)]), {"last": taken[0][0] if taken else start["last"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A pull that is done again takes the same pages."""
        pages = [p for p in unread(self.folder, start["last"]) if p[0] <= end["last"]]
        return iter([(*p, 0) for p in reversed(pages)])
