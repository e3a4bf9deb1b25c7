"""Fetching as a Spark data source: stored pages by host, engine by engine, each host in one partition, with what became of them.

`keep_pages` writes fetched pages to a folder, dealt to buckets of their host, one folder for each engine. `stored_pages` reads them
as a source of its own (`spark.read.format("stored_pages")`): a partition is a bucket, so no two tasks ask one host. Of pushed
filters, those on the host choose buckets, and those on equal host, page or address are done while a file is read. A page that the
first engine doesn't give, or gives as a challenge, is taken from the next one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from presswork.functions import text, urls

SCHEMA = "host string, page_id long, url string, html string, engine string, outcome string, attempts int"
COUNTERS = "bucket int, host string, engine string, outcome string, pages long"
BUCKETS = 32
FILTERED = ("host", "page_id", "url")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def keep_pages(pages: DataFrame, path: str, engine: str = "plain", buckets: int = BUCKETS) -> None:
    """Adds fetched pages (page_id, url, html) of an engine. A page is `ok`, a `challenge`, or `failed` if it is empty."""
    gate = F.coalesce(text.is_bot_gate(F.col("html")), F.lit(False))
    outcome = F.when(F.coalesce("html", F.lit("")) == "", "failed").when(gate, "challenge").otherwise("ok")
    host = F.coalesce(urls.host(F.col("url")), F.lit(""))
    rows = pages.select(host.alias("host"), "page_id", "url", "html", outcome.alias("outcome")).withColumn("bucket", F.pmod(F.crc32("host"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path.rstrip('/')}/{engine}")


@dataclass
class Bucket(InputPartition):
    number: int
    #: For each engine, in order, its folder of this bucket.
    folders: list[tuple[str, str]]


def _open(path: str):
    """(file system, path) of a folder, in any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class StoredPages(DataSource):
    """Options: path; engines, comma-separated in the order in which they are asked; report=outcomes for counters in place of pages."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return COUNTERS if self.options.get("report") == "outcomes" else SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"].rstrip("/"), [e.strip() for e in self.options.get("engines", "plain").split(",")], self.options.get("report") == "outcomes", int(self.options.get("buckets", BUCKETS)))


class Reader(DataSourceReader):
    def __init__(self, path: str, engines: list[str], report: bool, buckets: int):
        self.path, self.engines, self.report, self.buckets = path, engines, report, buckets
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities on host, page and address; gives the others back to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in FILTERED and not self.report:
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import zlib

        from pyarrow import fs

        found: dict[int, list[tuple[str, str]]] = {}
        for engine in self.engines:
            system, root = _open(f"{self.path}/{engine}")
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name.startswith("bucket="):
                    found.setdefault(int(info.base_name[7:]), []).append((engine, f"{self.path}/{engine}/{info.base_name}"))
        hosts = self.wanted.get("host")
        asked = None if hosts is None else {zlib.crc32((h or "").encode()) % self.buckets for h in hosts}
        return [Bucket(number, folders) for number, folders in sorted(found.items()) if asked is None or number in asked]

    def read(self, partition: Bucket | None) -> Iterator:
        if partition is None:  # no bucket at all
            return
        counts: dict[tuple, int] = {}
        for row in self._fetched(partition):
            if not self.report:
                yield row
                continue
            key = (row[0], row[4], row[5])
            counts[key] = counts.get(key, 0) + 1
        for (host, engine, outcome), n in sorted(counts.items()):
            yield partition.number, host, engine, outcome, n

    def _fetched(self, partition: Bucket) -> Iterator[tuple]:
        """Each page as the first engine that has it as `ok` gives it, else as the last one does."""
        later = list(partition.folders)
        waiting: dict[tuple, tuple[int, tuple]] = {}
        while later:
            (engine, folder), *later = later
            first = engine == partition.folders[0][0]
            for host, page, url, html, outcome in self._rows(folder):
                tries, _ = waiting.pop((page, url), (0, None)) if not first else (0, None)
                if not first and not tries:
                    continue  # the engine before had it
                row = (host, page, url, html, engine, outcome, tries + 1)
                if outcome == "ok" or not later:
                    yield row
                else:
                    waiting[page, url] = tries + 1, row
        for _, row in waiting.values():
            yield row

    def _rows(self, folder: str) -> Iterator[tuple]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        system, root = _open(folder)
        condition = None
        for name, values in self.wanted.items():
            one = pc.field(name).isin(list(values))
            condition = one if condition is None else condition & one
        for batch in ds.dataset(root, filesystem=system, format="parquet").to_batches(columns=["host", "page_id", "url", "html", "outcome"], filter=condition, batch_size=256, use_threads=False):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def read_stored(spark: SparkSession, path: str, engines: str = "plain", report: bool = False) -> DataFrame:
    """Stored pages, or how many of each host had which outcome."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(StoredPages)
    options = {"path": path, "engines": engines} | ({"report": "outcomes"} if report else {})
    return spark.read.format("stored_pages").options(**options).load()
