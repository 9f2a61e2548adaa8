"""Reading from a REST service: one client for a task, with a rate, retries with growing pauses, and one token.

Requests are rows, so Spark deals them out; a service that lists pages is a data source whose partitions are ranges of pages.
The transport is injected: what speaks HTTP, or a local one.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, LEAST_PAUSE, MOST_PAUSE, EARLY = 5, 2.0, 30.0, 60.0


class Transport(Protocol):
    """Pickled to the executors. Any exception of send() is a failure of the connection."""

    def token(self) -> tuple[str, float]:
        """A new token and for how many seconds it holds."""

    def send(self, path: str, payload: dict, token: str) -> tuple[int, str]:
        """(status, body) of a request."""


class RequestFailed(RuntimeError):
    pass


@dataclass
class Client:
    """Requests a second at most `rate`; up to ATTEMPTS tries each, with pauses that double; a refused token is renewed once a try."""

    transport: Transport
    rate: float = 5.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    tries: int = 0
    _token: str | None = None
    _until: float = 0.0
    _next: float = field(default=float("-inf"))

    def _wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + 1 / self.rate

    def _held(self) -> str:
        if self._token is None or self.clock() >= self._until:
            self._token, seconds = self.transport.token()
            self._until = self.clock() + seconds - EARLY
        return self._token

    def _once(self, path: str, payload: dict) -> str:
        self._wait()
        self.tries += 1
        status, body = self.transport.send(path, payload, self._held())
        if status == 401:
            self._token = None
            status, body = self.transport.send(path, payload, self._held())
        if status >= 400:
            raise RequestFailed(f"{path}: {status} {body[:200]}")
        return body

    def post(self, path: str, payload: dict) -> str:
        """The body of a request's answer; the last failure is raised."""
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return self._once(path, payload)
            except Exception:
                if attempt == ATTEMPTS:
                    raise
                self.sleep(min(MOST_PAUSE, max(LEAST_PAUSE, 2.0 ** (attempt - 1))))
        raise AssertionError


def fetched(requests: DataFrame, transport: Transport, rate: float = 5.0, tasks: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (path, payload as JSON, more) with status ('ok' or 'failed'), attempts and body (of a failure: why).

    `tasks` tasks at once at most, each at its share of the rate, so the service sees no more than the rate however many
    requests there are; each request is sent by one task. A request that fails to the end is a row, and the others go on. A lost
    task sends its requests again. The columns status, attempts and body are replaced.
    """
    kept = [c for c in requests.columns if c not in ("status", "attempts", "body")]
    fields = ", ".join(f"`{n}` {t}" for n, t in requests.select(kept).dtypes)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(transport, rate / tasks, sleep=sleep)
        for frame in frames:
            rows = []
            for path, payload in zip(frame["path"], frame["payload"], strict=True):
                before = client.tries
                try:
                    body, status = client.post(path, json.loads(payload or "{}")), "ok"
                except Exception as e:
                    body, status = str(e), "failed"
                rows.append((status, client.tries - before, body))
            yield frame.assign(**{c: [r[i] for r in rows] for i, c in enumerate(("status", "attempts", "body"))})

    return requests.select(kept).repartition(tasks).mapInPandas(send, f"{fields}, status string, attempts int, body string")


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _client(self, share: int = 1) -> Client:
        module, _, name = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), name)(dict(self.options))
        pause = float(self.options.get("pause", "1"))
        return Client(transport, float(self.options.get("rate", "5")) / share, sleep=lambda s: time.sleep(s * pause))

    def partitions(self) -> list[Pages]:
        """The first page says how many there are; tasks get ranges of them."""
        total = int(json.loads(self._client().post(self.options["path"], {"page": 0}))["pages"])
        tasks = min(int(self.options.get("tasks", "8")), max(total, 1))
        return [Pages(total * i // tasks, total * (i + 1) // tasks) for i in range(tasks)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        client = self._client(int(self.options.get("tasks", "8")))
        for page in range(partition.first, partition.last):
            for item in json.loads(client.post(self.options["path"], {"page": page}))["items"]:
                yield page, json.dumps(item, ensure_ascii=False)


class RestPages(DataSource):
    """spark.read.format("rest_pages") with options path, transport (module:factory, given the options), rate, tasks, pause.

    Rows (page, item as JSON). An answer is {"pages": n, "items": [...]}; a page that fails to the end fails its task.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
