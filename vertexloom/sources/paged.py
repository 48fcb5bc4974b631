"""A Python data source that pages through a JSON service, for sources whose rows aren't in files."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedJson(DataSource):
    """``format("paged_json")`` with ``url`` (``{page}`` is replaced) and optionally ``pages`` and ``field``.

    With ``pages`` each of them is a task.  Without it one task goes on until a page is empty
    or shorter than the first.  If ``lenient`` is true, a page that can't be fetched is skipped where the
    number of pages is given, and otherwise ends the reading.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, json string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.pages = options["url"], int(options["pages"]) if "pages" in options else None
        self.field, self.lenient = options.get("field"), options.get("lenient", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in (range(1, self.pages + 1) if self.pages is not None else [0])]

    def page(self, n: int) -> list:
        found = fetch(self.url.replace("{page}", str(n)), self.lenient)
        return [] if found is None else found[self.field] if self.field else found

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        n, first = partition.value or 1, None
        while True:
            rows = self.page(n)
            for row in rows:
                yield n, json.dumps(row)
            first = len(rows) if first is None else first
            if partition.value or not rows or len(rows) < first:
                return
            n += 1


def fetch(url: str, lenient: bool):
    """The JSON at an address; None if it can't be had and that is no matter."""
    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            return json.load(r)
    except (OSError, ValueError):
        if not lenient:
            raise
        return None


def read_pages(spark, url: str, schema: str, **options):
    """The objects of all pages as typed rows."""
    from pyspark.sql import functions as F

    from vertexloom.functions.shipping import ship

    ship(spark)
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").options(url=url, **{k: str(v) for k, v in options.items()}).load()
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def read_each(keys, url: str, schema: str, lenient: bool = True):
    """The objects that a service has for distinct ``keys``, in one column: ``{key}`` is replaced in ``url``.

    For edges that take ``starts``.  Objects are fetched in tasks; those that can't be had, or are null, are skipped if
    ``lenient`` is true.  The key comes first, as ``key``.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from vertexloom.functions.shipping import ship

    ship(keys.sparkSession)
    name = keys.columns[0]

    def run(batches):
        for b in batches:
            got = [(k, fetch(url.replace("{key}", urllib.parse.quote(str(k), safe="")), lenient)) for k in b.column(0).to_pylist() if k is not None]
            got = [(k, json.dumps(v)) for k, v in got if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], b.column(0).type), pa.array([v for _, v in got], pa.string())], ["key", "json"])

    kind = keys.schema[name].dataType.simpleString()
    rows = keys.select(name).distinct().mapInArrow(run, f"key {kind}, json string")
    return rows.select("key", F.from_json("json", schema).alias("r")).select("key", "r.*")
