"""Pages by URL: a Spark data source, `webpage`, that fetches a list of URLs in parallel.

A page that can't be fetched is a row with its status or error and an empty html; it doesn't fail the job.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webextract.sources.charset import decode_page

USER_AGENT = "Mozilla/5.0 (compatible; Webextract/1.0)"
TIMEOUT = 30.0
SCHEMA = "page_id bigint, requested_url string, url string, fetch_status int, fetch_error string, content_type string, html string"


@dataclass(frozen=True)
class Client:
    user_agent: str = USER_AGENT
    timeout: float = TIMEOUT
    headers: dict[str, str] = field(default_factory=dict)
    proxy: str = ""


@dataclass(frozen=True)
class Response:
    status: int
    url: str
    content_type: str
    body: bytes
    error: str = ""


class HTTPStatusError(Exception):
    """The server answered with an error status."""

    def __init__(self, url: str, status: int) -> None:
        super().__init__(f"{url}: status {status}")
        self.url, self.status_code = url, status


def parse_headers(lines: list[str]) -> dict[str, str]:
    """`Key: Value` lines, cut at the first colon."""
    out = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ValueError(f"not a header: {line!r}")
        out[key.strip()] = value.strip()
    return out


def fetch(url: str, client: Client = Client()) -> Response:
    """One GET, redirects followed. A timeout of zero or less is none."""
    request = urllib.request.Request(url, headers={"User-Agent": client.user_agent} | client.headers)
    handlers = [urllib.request.ProxyHandler({"http": client.proxy, "https": client.proxy} if client.proxy else {})]
    opener = urllib.request.build_opener(*handlers)
    try:
        with opener.open(request, **({"timeout": client.timeout} if client.timeout > 0 else {})) as r:
            return Response(r.status, r.url, r.headers.get("Content-Type", ""), r.read())
    except urllib.error.HTTPError as e:
        return Response(e.code, e.url or url, e.headers.get("Content-Type", "") if e.headers else "", b"", f"status {e.code}")
    except (urllib.error.URLError, OSError, ValueError) as e:
        return Response(0, url, "", b"", f"{type(e).__name__}: {e}")


def effective_url(given: Column, final: Column, requested: Column) -> Column:
    """The caller's URL if there is one, else where redirects ended, else what was asked for."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(given), some(final), requested)


class _Slice(InputPartition):
    def __init__(self, pairs: list[tuple[int, str]]) -> None:
        self.pairs = pairs


class WebpageSource(DataSource):
    """Options: urls (a JSON list), per_partition, user_agent, timeout, headers (a JSON object), proxy."""

    @classmethod
    def name(cls) -> str:
        return "webpage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.size = int(options.get("per_partition", "50"))
        self.client = Client(options.get("user_agent", USER_AGENT), float(options.get("timeout", TIMEOUT)), json.loads(options.get("headers", "{}")), options.get("proxy", ""))

    def partitions(self) -> list[InputPartition]:
        pairs = list(enumerate(self.urls))
        return [_Slice(pairs[i : i + self.size]) for i in range(0, len(pairs), self.size)] or [_Slice([])]

    def read(self, partition) -> Iterator[tuple]:
        for k, url in partition.pairs:
            r = fetch(url, self.client)
            yield k, url, r.url, r.status, r.error or None, r.content_type, decode_page(r.body, r.content_type)


def read_urls(spark: SparkSession, urls: list[str], per_partition: int = 50, client: Client = Client()) -> DataFrame:
    spark.dataSource.register(WebpageSource)
    options = {"urls": json.dumps(urls), "per_partition": str(per_partition), "user_agent": client.user_agent, "timeout": str(client.timeout), "headers": json.dumps(client.headers), "proxy": client.proxy}
    return spark.read.format("webpage").options(**options).load()


def fetch_urls(urls: DataFrame, client: Client = Client(), fetcher: Callable[[str, Client], Response] = fetch) -> DataFrame:
    """A table of URLs (page_id, url) fetched where it lies; for lists too long for the driver. `fetcher` may be another one."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [fetcher(u, client) for u in b.column(1).to_pylist()]
            columns = [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*((r.url, r.status, r.error or None, r.content_type, decode_page(r.body, r.content_type)) for r in got)) if got else [[]] * 5, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "requested_url", "url", "fetch_status", "fetch_error", "content_type", "html"])

    return urls.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as pages, decoded by their own marks. A path with `..` is refused."""
    if ".." in path.split("/"):
        raise ValueError(f"the path leads upwards: {path}")
    import pyarrow as pa

    def decoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([decode_page(x.as_py()) for x in b.column(2)], pa.string())], names=["page_id", "url", "html"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), "content")
    return files.mapInArrow(decoded, "page_id bigint, url string, html string")


def is_url(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))
