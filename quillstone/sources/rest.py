"""A Python data source over HTTP with retries, for citation and document APIs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 502, 503, 504)


def fetch(url: str, retries: int = 2, timeout: float = 120, wait: Callable[[float], None] = time.sleep, open_=urlopen) -> str:
    """The answer's text; 429 and gateway errors are tried again after ``Retry-After`` or a growing pause."""
    for attempt in range(retries + 1):
        try:
            with open_(url, timeout=timeout) as response:
                return response.read().decode()
        except HTTPError as e:
            if e.code not in RETRIED or attempt == retries:
                raise
            pause = e.headers.get("retry-after") if e.headers else None
            wait(float(pause) if pause and pause.isdigit() else 0.5 * 2**attempt)
    raise AssertionError


class RestSource(DataSource):
    """``format("rest")``: option ``urls`` (JSON list), one partition each, rows ``url, status, body``.

    A failed request is a row with its status and no body; it never counts as an empty answer.
    """

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "url string, status string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["urls"]))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield partition.value, "ok", fetch(partition.value)
        except Exception as e:
            yield partition.value, f"error: {e}", None
