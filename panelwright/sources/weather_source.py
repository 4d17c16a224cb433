"""Live weather: as a Python data source for a list of cities, and for the cities of a table.

``spark.dataSource.register(WeatherSource)``, then
``spark.read.format("panel_weather").option("cities", json.dumps([...])).option("url", ...).load()``
gives ``city``, ``payload`` and ``error`` (the kind of failure; then the payload is null). ``weather_of`` does so with conditions
on the city taken over by the source: other cities aren't asked for. Cities are dealt over at most ``partitions`` tasks.
``fetched`` does the same for a column of any size. The key is read from the environment of the workers and goes into no
message. Parse with ``operators.weather.parsed``.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from panelwright.functions.text import CITY_LENGTH, SPACES

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
KEY = "OPENWEATHER_API_KEY"
TIMEOUT_S = 10
ATTEMPTS = 3
#: Seconds before the second attempt; each later pause is twice as long.
PAUSE_S = 0.5
PARTITIONS = 8
SCHEMA = "city string, payload string, error string"


class Request(NamedTuple):
    city: str
    url: str
    units: str
    key: str
    attempt: int


def http_payload(request: Request) -> str:
    query = urlencode({"q": request.city, "appid": request.key, "units": request.units})
    with urlopen(f"{request.url}?{query}", timeout=TIMEOUT_S) as answer:
        return answer.read().decode("utf-8")


class Fetcher:
    """Asks for one city at a time. ``get`` names the function that takes a Request, as ``module:function``; tests have their own."""

    def __init__(self, url: str, units: str = "metric", get: str = f"{__name__}:http_payload", attempts: int = ATTEMPTS, pause_s: float = PAUSE_S):
        self.url, self.units, self.get, self.attempts, self.pause_s = url, units, get, attempts, pause_s

    def __call__(self, city: str | None) -> tuple[str | None, str | None]:
        """Payload, or the kind of failure. Only what may pass is tried again: not a refusal, nor an answer that isn't text."""
        asked = (city or "").strip(SPACES)
        if not asked or any(ord(c) < 32 or ord(c) == 127 for c in city):
            return None, "InvalidCity"
        key = os.environ.get(KEY)
        own = self.get.endswith(":http_payload")
        if own and not (key and self.url):
            return None, "NoKey"
        module, name = self.get.split(":")
        get = getattr(importlib.import_module(module), name)
        problem: Exception | None = None
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.pause_s * 2 ** (attempt - 1))
            try:
                return get(Request(asked[:CITY_LENGTH], self.url, self.units, key or "", attempt)), None
            except ValueError as found:
                return None, type(found).__name__
            except OSError as found:
                problem = found
                if isinstance(found, HTTPError) and found.code < 500 and found.code != 429:
                    break
        return None, type(problem).__name__


class Cities(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WeatherReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.cities = list(dict.fromkeys(json.loads(options.get("cities", "[]"))))
        self.ways = int(options.get("partitions", PARTITIONS))
        more = {"get": options["get"]} if "get" in options else {}
        self.fetch = Fetcher(options.get("url", ""), options.get("units", "metric"), attempts=int(options.get("attempts", ATTEMPTS)), pause_s=float(options.get("pause_s", PAUSE_S)), **more)

    def partitions(self) -> list[Cities]:
        ways = min(self.ways, len(self.cities))
        return [Cities(self.cities[k::ways]) for k in range(ways)]

    def read(self, partition: Cities) -> Iterator[tuple[str, str | None, str | None]]:
        for city in partition.names if partition else []:
            yield city, *self.fetch(city)


class FilteringReader(WeatherReader):
    """Takes conditions on the city over. Spark refuses such a reader unless PUSHDOWN is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("city",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cities = [c for c in self.cities if c in wanted]
            elif not (isinstance(f, IsNotNull) and f.attribute == ("city",)):
                yield f


class WeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "panel_weather"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WeatherReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else WeatherReader)(self.options)


def weather_of(spark: SparkSession, cities: list[str], **options: str) -> DataFrame:
    """The source over a list of cities, with conditions on the city pushed down."""
    spark.dataSource.register(WeatherSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("panel_weather").options(cities=json.dumps(cities), pushdown="true", **options).load()


def fetched(cities: DataFrame, fetch: Fetcher, column: str = "city", ways: int = PARTITIONS) -> DataFrame:
    """``city``, ``payload``, ``error``: one request for each distinct city, by at most ``ways`` tasks at a time. A city that is null isn't asked for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fetch(c) for c in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["city", "payload", "error"])

    distinct = cities.select(F.col(column).alias("city")).where("city is not null").distinct()
    return distinct.repartition(ways).mapInArrow(run, SCHEMA)
