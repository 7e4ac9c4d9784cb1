"""Addresses as a Spark data source: a row for every answer or failure.

`spark.dataSource.register(WebSource)`, then `spark.read.format("web")`; or `answers`. Addresses are dealt by host to lanes, one partition each.
A lane asks for `per_host` addresses at once, a host of it after another, and there are no more lanes than `most` allows, so no host and not the
whole scan ever has more open requests, whatever the cluster runs at once. A request has `timeout` seconds, a lane `total`; what is
left then is a row with the error `total timeout`.

Conditions on `url` reach the scan: addresses that a filter (`url = `, `IN`, their negations) excludes are never asked, which is how a
history of known addresses saves requests.

Attempts: HTTP 429 waits `delay`, then twice as long each time; time-outs wait a multiple of `delay`; any other answer ends the attempts of
`kind` text, and lets `json` try again at once; a body that is no JSON is an error of kind json; other errors end the attempts. A failure is a
row, never the end of the job. A task that Spark runs again asks again.

Cases: null and empty addresses are left out; repeated ones are asked once; an address without a host is an error row; no addresses give no rows.
"""

from __future__ import annotations

import asyncio
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not

SCHEMA = "url string, kind string, status int, body string, error string"
#: Requests at once in all and for a host, seconds for a request and for a scan.
MOST, PER_HOST, TIMEOUT, TOTAL = 20, 3, 15.0, 120.0


def get(url: str, timeout: float) -> tuple[int, str]:
    """(status, body) of an address by the standard library."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; tidewell)"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimeoutError from e
        raise


@dataclass
class Lane(InputPartition):
    """(url, kind) of some hosts."""

    hosts: tuple[tuple[tuple[str, str], ...], ...]


def lanes(addresses: Iterable[tuple[str, str]], most: int, per_host: int) -> list[Lane]:
    """Hosts dealt to lanes, those with most addresses first and each to the lane that has fewest."""
    by: dict[str, dict[str, str]] = {}
    for url, kind in addresses:
        if url:
            by.setdefault(urlsplit(url).hostname or "", {}).setdefault(url, kind)
    out: list[list] = [[] for _ in range(min(max(most // per_host, 1), len(by)))]
    for _, own in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        min(out, key=lambda lane: sum(map(len, lane))).append(tuple(own.items()))
    return [Lane(tuple(own)) for own in out]


async def _asked(url: str, kind: str, fetch: Callable[[str, float], tuple[int, str]], retries: int, delay: float, timeout: float) -> tuple:
    status, error = None, None
    for attempt in range(retries + 1):
        try:
            status, body = await asyncio.wait_for(asyncio.to_thread(fetch, url, timeout), timeout)
            if status == 200:
                if kind == "json":
                    json.loads(body)
                return url, kind, status, body, None
            error = f"HTTP {status}"
            if status == 429:
                await asyncio.sleep(delay * 2**attempt)
            elif kind != "json":
                break
        except TimeoutError:
            error = "timeout"
            await asyncio.sleep(delay * (attempt + 1))
        except Exception as e:  # noqa: BLE001  a client may raise anything
            error = f"{type(e).__name__}: {e}"[:100]
            break
    return url, kind, status, None, error


async def _lane(hosts: Sequence, fetch, retries: int, delay: float, timeout: float, total: float, per_host: int) -> list[tuple]:
    ends, out = asyncio.get_running_loop().time() + total, []
    for own in hosts:
        free = asyncio.Semaphore(per_host)

        async def one(url: str, kind: str, free: asyncio.Semaphore = free) -> tuple:
            async with free:
                return await _asked(url, kind, fetch, retries, delay, timeout)

        tasks = {asyncio.create_task(one(url, kind)): (url, kind) for url, kind in own}
        done, late = await asyncio.wait(tasks, timeout=max(ends - asyncio.get_running_loop().time(), 0))
        out += [t.result() for t in done]
        for t in late:
            t.cancel()
            out.append((*tasks[t], None, None, "total timeout"))
    return out


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.addresses = [(u, k) for u, k in json.loads(options.get("addresses", "[]")) if u]
        number = lambda name, default: type(default)(options.get(name, default))
        self.most, self.per_host = number("most", MOST), number("perHost", PER_HOST)
        self.rules = {"retries": number("retries", 2), "delay": number("delay", 1.0), "timeout": number("timeout", TIMEOUT), "total": number("total", TOTAL)}
        self.fetch = get

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
            if isinstance(inner, (In, EqualTo)) and inner.attribute == ("url",):
                values = {*inner.value} if isinstance(inner, In) else {inner.value}
                self.addresses = [(u, k) for u, k in self.addresses if (u in values) != negated]
            else:
                yield f

    def partitions(self) -> list[Lane]:
        return lanes(self.addresses, self.most, self.per_host)

    def read(self, partition: Lane | None) -> Iterator[tuple]:
        if partition is not None:  # Spark asks for no lane at all where there are none
            yield from asyncio.run(_lane(partition.hosts, self.fetch, per_host=self.per_host, **self.rules))


class WebSource(DataSource):
    """Options: addresses (a JSON list of [url, kind]), most, perHost, retries, delay, timeout, total."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def answers(spark: SparkSession, addresses: Iterable[tuple[str, str]], known: Iterable[str] = (), **options: float) -> DataFrame:
    """The answers to (url, kind) addresses, a list of feeds and searches, but those in `known`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebSource)
    df = spark.read.format("web").options(addresses=json.dumps([list(a) for a in addresses]), **{k: str(v) for k, v in options.items()}).load()
    known = [k for k in known if k]
    return df.where(~F.col("url").isin(known)) if known else df


def story_answers(spark: SparkSession, base: str, first: int = 50, known: Iterable[str] = (), **options: float) -> DataFrame:
    """The first stories' answers: the list of ids, then an address for each id, at most `first`."""
    ids = answers(spark, [(f"{base}/topstories.json", "json")], **options).select(F.slice(F.from_json("body", "array<long>"), 1, first).alias("ids")).first()
    return answers(spark, [(f"{base}/item/{i}.json", "json") for i in (ids.ids if ids and ids.ids else [])], known, **options)
