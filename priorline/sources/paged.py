"""Paged season feeds as a Spark data source: ``spark.read.format("season_pages")``, and ``readStream``.

Seasons are partitions, so each is read by its own task, page after page. The source is named by ``client``, a
``module:function`` that the executors call with the options to make a ``pages.Client``; ``interval`` is the least time
between calls of all tasks together, which each of n tasks keeps by waiting n times as long. A season that the first path
does not know (404) is asked for once at ``fallback``. As a stream the offset is the season and the cursor of its next
page: a batch is a page, and a replay asks for the same cursor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module
from itertools import count

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from priorline.functions.values import season_list
from priorline.sources.pages import Client, SourceError, Throttle

SCHEMA = "season int, source string, page int, raw string"


def _client(options: dict[str, str], tasks: int) -> Client:
    module, _, name = options["client"].partition(":")
    client = getattr(import_module(module), name)(options)
    client.throttle = Throttle(float(options.get("interval", 0)) * tasks, client.throttle.now, client.throttle.sleep)
    return client


def _request(client: Client, path: str, season: int, options: dict[str, str], cursor) -> dict:
    params = {"seasons[]": season, "per_page": int(options.get("per_page", 100))}
    return client.get(path, params | ({"cursor": cursor} if cursor else {}))


def _next(body: dict):
    return (body.get("meta") or {}).get("next_cursor")


def season_rows(client: Client, season: int, options: dict[str, str], most: int | None = None) -> Iterator[tuple]:
    """Rows of one season: its pages in order, until the cursor is empty or repeats, or a page has no items.

    More than ``most`` pages, if it is given, are an error, not an end.
    """
    path, cursor, seen = options["path"], None, set()
    for page in count():
        if most is not None and page >= most:
            raise SourceError(f"{path}: more than {most} pages in season {season}")
        try:
            body = _request(client, path, season, options, cursor)
        except SourceError as e:
            if page or "status 404" not in str(e) or path == options.get("fallback", path):
                raise
            path = options["fallback"]
            body = _request(client, path, season, options, cursor)
        if not body.get("data"):
            return
        yield season, path, page, json.dumps(body)
        cursor = _next(body)
        if not cursor or cursor in seen:
            return
        seen.add(cursor)


class SeasonPages(DataSource):
    """Options: client, path, seasons (``1999-2001, 2003``), fallback, per_page, interval, most_pages, and what the client asks for."""

    @classmethod
    def name(cls) -> str:
        return "season_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.seasons = options, season_list(options["seasons"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.seasons]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        most = self.options.get("most_pages")
        yield from season_rows(_client(self.options, len(self.seasons)), partition.value, self.options, int(most) if most else None)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.seasons = options, season_list(options["seasons"])

    def initialOffset(self) -> dict:
        return {"at": 0, "page": 0, "cursor": None, "path": self.options["path"]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["at"] >= len(self.seasons):
            return iter([]), start
        season, path = self.seasons[start["at"]], start["path"]
        client = _client(self.options, 1)
        try:
            body = _request(client, path, season, self.options, start["cursor"])
        except SourceError as e:
            if start["page"] or "status 404" not in str(e) or path == self.options.get("fallback", path):
                raise
            path = self.options["fallback"]
            body = _request(client, path, season, self.options, start["cursor"])
        after = {"at": start["at"] + 1, "page": 0, "cursor": None, "path": self.options["path"]}
        if not body.get("data"):
            return iter([]), after
        cursor = _next(body)
        end = {"at": start["at"], "page": start["page"] + 1, "cursor": cursor, "path": path} if cursor and cursor != start["cursor"] else after
        return iter([(season, path, start["page"], json.dumps(body))]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            rows, start = self.read(start)
            yield from rows
