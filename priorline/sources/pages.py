"""Sources of nested payloads: paged requests, landed pages, caches, and how they become typed rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions import values

RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})


class SourceError(RuntimeError):
    """A source that cannot be read whole."""


@dataclass
class Throttle:
    """Least seconds between calls."""

    interval: float
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float | None = None

    def wait(self) -> None:
        if self._last is not None and (left := self.interval - (self.now() - self._last)) > 0:
            self.sleep(left)
        self._last = self.now()


@dataclass
class Client:
    """GET with retries over an injected ``fetch(path, params) -> (status, headers, body)``.

    Server errors, timeouts and 429 are tried again after 1, 2, 4 ... 30 s, or after what Retry-After says and one more
    second, 120 s at most.
    """

    fetch: Callable[[str, dict], tuple[int, dict, Any]]
    throttle: Throttle = field(default_factory=lambda: Throttle(0.0))
    attempts: int = 5
    sleep: Callable[[float], None] = time.sleep

    def get(self, path: str, params: dict | None = None) -> Any:
        for attempt in range(self.attempts):
            self.throttle.wait()
            try:
                status, headers, body = self.fetch(path, params or {})
            except TimeoutError:
                status, headers, body = 503, {}, None
            if status < 400:
                return body
            if status not in RETRY_STATUSES:
                raise SourceError(f"{path}: status {status}")
            if attempt + 1 < self.attempts:
                after = headers.get("Retry-After")
                self.sleep(min(120.0, float(after) + 1) if after else min(30.0, 2.0**attempt))
        raise SourceError(f"{path}: status {status} after {self.attempts} attempts")

    def pages(self, path: str, params: dict, items_key: str, next_cursor: Callable[[Any], Any], max_pages: int = 1000) -> Iterator[Any]:
        """Pages until the cursor is empty or repeats, or a page has no items; too many pages are an error, not an end."""
        cursor, seen = None, set()
        for _ in range(max_pages):
            body = self.get(path, params | ({"cursor": cursor} if cursor else {}))
            if not body.get(items_key):
                return
            yield body
            cursor = next_cursor(body)
            if not cursor or cursor in seen:
                return
            seen.add(cursor)
        raise SourceError(f"{path}: more than {max_pages} pages")


#: Most items of a page, and the candle lengths in minutes, that sources serve.
MOST_PER_PAGE, CANDLE_MINUTES = 100, (1, 60, 1440)


def season_pages(client: Client, season: int, per_page: int = 100, dates: tuple[str, str] | None = None) -> Iterator[Any]:
    """Pages of one season's games, or of those between two days; sizes that no source serves are refused before a call."""
    if not 1 <= per_page <= MOST_PER_PAGE:
        raise ValueError(f"per_page {per_page} is not between 1 and {MOST_PER_PAGE}")
    params: dict[str, Any] = {"seasons[]": season, "per_page": per_page}
    if dates:
        params |= {"start_date": dates[0], "end_date": dates[1]}
    return client.pages("games", params, "data", lambda body: (body.get("meta") or {}).get("next_cursor"))


def season_feed(client: Client, path: str, season: int, per_page: int = 100) -> Iterator[Any]:
    """Pages of a paid feed (box rows, advanced rows) of one season; an item of another season ends the run."""
    for body in client.pages(path, {"seasons[]": season, "per_page": per_page}, "data", lambda b: (b.get("meta") or {}).get("next_cursor")):
        odd = [x for x in body["data"] if (x.get("game") or {}).get("season", season) != season]
        if odd:
            raise SourceError(f"{path}: {len(odd)} items of other seasons than {season}")
        yield body


def event_pages(client: Client, series: str, status: str | None = None) -> Iterator[Any]:
    """Pages of a series' events."""
    params = {"series_ticker": series} | ({"status": status} if status else {})
    return client.pages("events", params, "events", lambda body: body.get("cursor"))


def historical_cutoff(client: Client) -> int | None:
    """Until when the archive is complete, in epoch seconds; None where it does not say."""
    body = client.get("historical/cutoff") or {}
    at = body.get("cutoff_ts", body.get("market_data_cutoff_ts"))
    return int(at) if at is not None else None


def candle_request(ticker: str, start_ts: int, end_ts: int, minutes: int = 1) -> dict[str, Any]:
    """The parameters of a candle request; a length that is not served or a window that ends before it starts is refused."""
    if minutes not in CANDLE_MINUTES:
        raise ValueError(f"candles of {minutes} minutes: not one of {CANDLE_MINUTES}")
    if end_ts < start_ts:
        raise ValueError(f"{ticker}: window ends at {end_ts}, before {start_ts}")
    return {"ticker": ticker, "start_ts": start_ts, "end_ts": end_ts, "period_interval": minutes}


def fetched(client: Client, request: dict[str, Any], cutoff: int | None, cache: dict | None = None) -> tuple[Any, str]:
    """A candle payload and where it came from: cache, archive or live.

    The archive serves windows that ended by the cutoff; where it does not know the market (404) the live endpoint is
    asked once. Equal requests are asked once for each ``cache``.
    """
    key = json.dumps(request, sort_keys=True)
    if cache is not None and key in cache:
        return cache[key], "cache"
    first = "archive" if cutoff is not None and request["end_ts"] <= cutoff else "live"
    try:
        body, source = client.get(f"{first}/candlesticks", request), first
    except SourceError as e:
        if first != "archive" or "status 404" not in str(e):
            raise
        body, source = client.get("live/candlesticks", request), "live"
    if cache is not None:
        cache[key] = body
    return body, source


GAME = (
    "id: long, date: string, season: int, status: string, period: int, time: string, postseason: boolean, ist_stage: string, home_team_score: int, visitor_team_score: int, datetime: string, "
    "home_team: struct<id: long, abbreviation: string, full_name: string>, visitor_team: struct<id: long, abbreviation: string, full_name: string>"
)


def flattened(pages: DataFrame, key: str, item: str) -> DataFrame:
    """Items of landed pages (``raw`` string: a page envelope), in order, with page and place; bad pages give none."""
    parsed = F.from_json("raw", f"`{key}` array<struct<{item}>>")
    return pages.select("page", F.posexplode(parsed[key]).alias("place", "item"))


def games(pages: DataFrame) -> DataFrame:
    """Game payloads as flat typed rows; the outcome is null unless final, scored and not level; the first of an id stays."""
    from priorline.operators.sequence import keep_first

    it = F.col("item")
    final = F.lower(F.trim(it["status"])).startswith("final")
    rows = flattened(pages, "data", GAME).select(
        it["id"].alias("game_id"), values.calendar_date(it["date"]).alias("date"), it["season"].alias("season"), it["status"].alias("status"), F.coalesce(final, F.lit(False)).alias("is_final"),
        F.try_to_timestamp(it["datetime"]).alias("tipoff"), it["home_team"]["id"].alias("home_id"), it["visitor_team"]["id"].alias("away_id"), it["home_team"]["abbreviation"].alias("home"), it["visitor_team"]["abbreviation"].alias("away"),
        it["home_team_score"].alias("home_score"), it["visitor_team_score"].alias("away_score"), it["postseason"].alias("postseason"), it["ist_stage"].alias("ist_stage"), F.struct("page", "place").alias("_at"),
    )
    rows = rows.withColumn("home_win", values.guarded_outcome(F.col("is_final"), F.col("home_score"), F.col("away_score"))).withColumn("pair_key", values.pair_key(F.col("date"), F.col("home"), F.col("away")))
    return keep_first(rows, ["game_id"], "_at").drop("_at")


CANDLE_LEG = "struct<open: string, high: string, low: string, close: string, open_dollars: string, high_dollars: string, low_dollars: string, close_dollars: string>"
CANDLE = (f"end_period_ts: long, volume: string, volume_fp: string, open_interest: string, open_interest_fp: string, price: {CANDLE_LEG}, yes_bid: {CANDLE_LEG}, yes_ask: {CANDLE_LEG}")


def candles(pages: DataFrame) -> DataFrame:
    """Candle payloads in either spelling: market, ts, bid, ask, last price, volume, open interest; one for an instant, the last."""
    it = F.col("item")
    either = lambda leg: values.price(F.coalesce(it[leg]["close"], it[leg]["close_dollars"]))
    parsed = F.from_json("raw", f"candlesticks array<struct<{CANDLE}>>")
    rows = pages.select("market", "page", F.posexplode(parsed["candlesticks"]).alias("place", "item")).select(
        "market", it["end_period_ts"].alias("ts"), either("yes_bid").alias("bid"), either("yes_ask").alias("ask"), either("price").alias("last_price"),
        values.number(F.coalesce(it["volume"], it["volume_fp"])).alias("volume"), values.number(F.coalesce(it["open_interest"], it["open_interest_fp"])).alias("open_interest"), F.struct("page", "place").alias("ordinal"),
    )
    from priorline.operators.asof import deduplicated

    return deduplicated(rows.where(F.col("ts").isNotNull()), "market", "ts", "ordinal").drop("ordinal")


#: Pages that are written together.
LANDED_AT_ONCE = 50


def land(spark: SparkSession, pages: Iterator[Any], path: str) -> DataFrame:
    """Pages written verbatim, some at a time and once: an existing path is an error."""
    at, rows, mode = 0, [], "errorifexists"

    def write() -> None:
        spark.createDataFrame(rows, "page int, raw string").coalesce(1).write.mode(mode).parquet(path)

    for at, page in enumerate(pages):
        rows.append((at, json.dumps(page, sort_keys=True)))
        if len(rows) == LANDED_AT_ONCE:
            write()
            rows, mode = [], "append"
    if rows or mode == "errorifexists":
        write()
    return spark.read.parquet(path)


def landings(spark: SparkSession, root: str) -> DataFrame:
    """name and path of every landing below ``root``, by name, which begins with its time."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
    rows = sorted((p.getName(), p.toString()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return spark.createDataFrame(rows, "name string, path string")


def latest_landing(spark: SparkSession, root: str) -> DataFrame | None:
    """The pages of the newest whole landing below ``root``, None where there is none."""
    last = landings(spark, root).orderBy(F.desc("name")).first()
    return None if last is None else spark.read.parquet(last["path"])


def routed(requests: DataFrame, cutoff) -> DataFrame:
    """Which endpoint serves a window: the archive where it ended by the cutoff, else live; an unknown cutoff is live."""
    return requests.withColumn("endpoint", F.when(F.col("end_ts") <= cutoff, "archive").otherwise("live"))
