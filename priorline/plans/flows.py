"""Queries on sources and streams: landed pages, the snapshot log, and form as a stream."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from priorline.operators import audit, sequence
from priorline.plans.views import CONTESTS, SIDES, contests, seconds, table
from priorline.sources import archive, paged, pages, report_rows, stores
from priorline.streaming import sequences, snapshots, timed


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    root = root or f"file://{tempfile.gettempdir()}/priorline-scratch"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def payload_pages(spark, d) -> DataFrame:
    """Contests as nested game payloads, fifty to a page."""
    c = contests(spark, d)
    team = lambda x: F.struct(F.col(x).cast("long").alias("id"), F.format_string("T%02d", x).alias("abbreviation"))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    item = F.struct(F.col("game_id").alias("id"), F.concat(date, F.lit("T00:00:00.000Z")).alias("date"), "season", F.when(F.col("game_id") % 12 == 0, "7:00 pm ET").otherwise("Final").alias("status"), F.col("home_score").alias("home_team_score"), F.col("away_score").alias("visitor_team_score"), team("home").alias("home_team"), team("away").alias("visitor_team"))
    rows = c.select(F.floor(F.col("game_id") / 50).cast("int").alias("page"), item.alias("item"))
    return rows.groupBy("page").agg(F.to_json(F.struct(F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("data"))).alias("raw"))


def json_page_flatten(spark, d):
    g = pages.games(payload_pages(spark, d))
    return g.select("game_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "is_final", "home", "away", "home_score", "away_score", "home_win")


FLATTEN = "with " + SIDES.split(",\nsides as")[0] + """ select game_id, strftime(date '1970-01-01' + cast(day as int), '%Y-%m-%d') as date, game_id % 12 <> 0 as is_final, 'T' || lpad(home::varchar, 2, '0') as home, 'T' || lpad(away::varchar, 2, '0') as away, home_score, away_score,
case when game_id % 12 <> 0 and home_score <> away_score then home_score > away_score end as home_win from contests"""


def candle_pages(spark, d):
    """Quotes as candle payloads in two spellings, read back."""
    e = table(spark, d, "events").where("event_type <> 'purchase'").select(F.col("user_id").alias("market"), seconds(F.col("ts")).alias("ts"), "event_id", F.round(F.col("value") / 400, 6).cast("string").alias("bid"))
    new = F.col("event_id") % 2 == 0
    leg = F.struct(F.when(new, F.col("bid")).alias("close_dollars"), F.when(~new, F.col("bid")).alias("close"))
    item = F.struct("event_id", F.col("ts").alias("end_period_ts"), leg.alias("yes_bid"))
    raw = e.groupBy("market").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("candlesticks"))).alias("raw")).withColumn("page", F.lit(0))
    return pages.candles(raw).select("market", "ts", "bid", "ask")


CANDLES = """select market, ts, case when bid between 0 and 1 then bid end as bid, null as ask from (
  select user_id as market, cast(floor(epoch(ts)) as bigint) as ts, round(value / 400, 6) as bid from events where event_type <> 'purchase' qualify row_number() over (partition by user_id, cast(floor(epoch(ts)) as bigint) order by event_id desc) = 1)"""


def idempotent_append(spark, d):
    """Captures stored twice over: the second time adds none."""
    e = table(spark, d, "events")
    cap = e.select(F.col("event_type").alias("source"), seconds(F.col("ts")).alias("retrieved_ts"), F.col("user_id").cast("string").alias("request"), F.col("value").cast("string").alias("payload"))
    path = scratch(spark, "snapshots")
    first = stores.append_snapshots(cap, path)
    again = stores.append_snapshots(cap, path)
    replayed = stores.replay(spark, path, "view", 1704067200, 1705276800).agg(F.count(F.lit(1)).alias("n_replayed"))
    return replayed.select(F.lit(first).cast("long").alias("n_first"), F.lit(again).cast("long").alias("n_again"), "n_replayed")


APPEND = """with e as (select distinct event_type as source, cast(floor(epoch(ts)) as bigint) as s, user_id, value from events)
select count(*) as n_first, 0 as n_again, count(*) filter (where source = 'view' and s between 1704067200 and 1705276800) as n_replayed from e"""


def report_row_parse(spark, d):
    """Glyph cells laid out from events and read back into entries."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    y = F.col("event_id").cast("double")
    cell = lambda x, text: F.struct(F.lit(x).alias("x"), text.cast("string").alias("text"))
    some = F.array_compact(F.array(F.when(F.col("event_id") % 40 == 0, cell(10.0, F.concat(F.lit("G"), F.col("event_id")))), F.when(F.col("event_id") % 8 == 0, cell(99.0, F.concat(F.lit("T"), F.col("user_id")))), F.when(F.col("event_type") != "error", cell(201.5, F.concat(F.lit("Doe,P"), F.col("user_id")))), cell(300.0, F.col("event_type"))))
    cells = e.select(F.lit("f").alias("file"), F.floor(F.col("event_id") / 100).cast("int").alias("page"), y.alias("y"), F.explode(some).alias("c")).select("file", "page", "y", "c.*")
    rows = report_rows.bucketed(cells, [10.0, 100.0, 200.0, 300.0], ("game_date", "team", "player", "reason"))
    full = rows.select("file", "page", "y", "game_date", F.lit(None).cast("string").alias("game_time"), F.lit(None).cast("string").alias("matchup"), "team", "player", F.lit("Out").alias("status"), "reason")
    return report_rows.entries(full).select("entry", "game_date", "team", "player", "reason")


REPORT_ROWS = """with e as (select event_id, case when event_id % 40 = 0 then 'G' || event_id end as g, case when event_id % 8 = 0 then 'T' || user_id end as t, case when event_type <> 'error' then 'Doe, P' || user_id end as p, event_type from events),
f as (select *, last_value(g ignore nulls) over w as game_date, last_value(t ignore nulls) over w as team, sum((p is not null)::int) over w as entry from e window w as (order by event_id rows between unbounded preceding and current row))
select entry, min_by(game_date, event_id) as game_date, min_by(team, event_id) as team, min_by(p, event_id) as player, string_agg(event_type, ' ' order by event_id) as reason from f where entry > 0 group by entry"""


def fed(rows: DataFrame, kind: str, order: str, last: dict, files: int = 4) -> DataFrame:
    """A stream of ``rows`` in a handful of files, one a micro-batch: spans of ``order``, unordered within each.

    ``last`` (columns by name, the others null) ends the feed in its last file, so that nothing is left waiting for the
    watermark and no micro-batch is spent on it alone.
    """
    spark = rows.sparkSession
    end = spark.range(1).select(*[F.lit(last.get(c)).cast(t).alias(c) for c, t in rows.dtypes])
    source = scratch(spark, kind)
    rows.repartitionByRange(files, order).sortWithinPartitions(F.xxhash64(order)).write.parquet(f"{source}/rows")
    names = sorted(spark.read.schema(rows.schema).parquet(f"{source}/rows").inputFiles())
    for i, name in enumerate(names):
        part = spark.read.schema(rows.schema).parquet(name)
        (part if i + 1 < len(names) else part.union(end)).coalesce(1).write.parquet(f"{source}/feed/part={i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/feed")


#: The instant of the row that ends a feed.
END = 4102444800


def stream_emit_then_update(spark, d):
    """Form as a stream with keyed state, replayed to its end from files that come one at a time, each unordered."""
    rows = sequence.side_rows(contests(spark, d)).select("game_id", "ts", "season", "team", "won", "margin")
    feed = fed(rows, "sides", "ts", {"game_id": 0, "ts": END, "season": 9999, "team": 0, "margin": 0})
    out = sequences.run_to_end(sequences.form_stream(feed), scratch(spark, "stream"), scratch(spark, "form"))
    return out.where("season < 9999").select(
        "game_id", "team", "games_played", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("win_rate", "mean_margin", "rest_days")]  # halves as SQL rounds them
    )


STREAM = f"""with {SIDES} select game_id, team, count(won) over w as games_played, round(avg(won::int) over w, 6) as win_rate,
  round(avg(case when won is not null then margin end) over w, 6) as mean_margin, round((ts - max(case when won is not null then ts end) over w) / 86400.0, 6) as rest_days
from sides window w as (partition by season, team order by ts, game_id rows between unbounded preceding and 1 preceding)"""


def stream_asof_state(spark, d):
    """Purchases with the last exactly dated observation of their user: two streams, each from unordered files."""
    e = table(spark, d, "events").select("event_id", "user_id", seconds(F.col("ts")).alias("ts"), "event_type")
    exact = (F.col("event_id") % 3 != 0) & (F.col("event_id") % 7 != 0)
    anchors = fed(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), "anchors", "ts", {"user_id": -1, "event_id": -1, "ts": END})
    seen = fed(e.where((F.col("event_type") != "purchase") & exact), "seen", "ts", {"user_id": -1, "event_id": -2, "ts": END})
    out, refused = timed.run(timed.asof_stream(anchors, seen, ["user_id"], "ts", "ts", "event_id"), scratch(spark, "stream"), scratch(spark, "asof"))
    out = out.where("event_id >= 0").withColumn("n_refused", F.lit(refused).cast("long"))
    return out.select("event_id", "user_id", F.col("seen_event_id").alias("seen_id"), F.col("seen_event_type").alias("seen_type"), "staleness", "n_refused")


STREAM_ASOF = """with e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as ts, event_type from events),
o as (select * from e where event_type <> 'purchase' and event_id % 3 <> 0 and event_id % 7 <> 0)
select a.event_id, a.user_id, o.event_id as seen_id, o.event_type as seen_type, a.ts - o.ts as staleness, 0::bigint as n_refused
from e a left join o on o.user_id = a.user_id and o.ts <= a.ts where a.event_type = 'purchase'
qualify row_number() over (partition by a.event_id order by o.ts desc nulls last, o.event_id desc) = 1"""

SOURCES, BEFORES, BEFORE_START = ["market", "report", "lineup"], [86400, 3600, 1800, 600], 900


def stream_due_captures(spark, d):
    """Captures of contests that were announced two days ahead; every seventh moves by an hour a day before, every eleventh is cancelled."""
    c = contests(spark, d).select("game_id", "ts")
    first = c.select("game_id", (F.col("ts") - 172800).alias("announced"), F.col("ts").alias("starts"))
    later = c.where("game_id % 7 = 0 or game_id % 11 = 0").select("game_id", (F.col("ts") - 80000).alias("announced"), F.when(F.col("game_id") % 11 != 0, F.col("ts") + 3600).alias("starts"))
    feed = fed(first.unionByName(later), "announced", "announced", {"game_id": -1, "announced": END})
    due = timed.due_captures(feed, "game_id", "announced", "starts", SOURCES, BEFORES, BEFORE_START)
    return timed.run(due, scratch(spark, "stream"), scratch(spark, "due"))[0]


DUE = f"""with {CONTESTS}, p as (select game_id, source, before::bigint as before, ts from contests, (select unnest(['market', 'report', 'lineup']) as source), (select unnest([86400, 3600, 1800]) as before)),
w as (select *, game_id % 7 = 0 and game_id % 11 <> 0 as moved, game_id % 11 = 0 as gone from p)
select game_id, source, before, ts - before as capture_ts, ts - {BEFORE_START} as anchor_ts from w where before > 80000 or not (moved or gone)
union all select game_id, source, before, ts + 3600 - before, ts + 3600 - {BEFORE_START} from w where moved and before <= 80000"""


def _state_now(source: str, request: str):
    """A feed's answer: one source is down for every third request."""
    if source == "error" and int(request) % 3 == 0:
        raise OSError("no answer")
    return {"data": [request] * (int(request) % 4)}


def snapshot_captures(spark, d):
    """Requests from events, captured batch by batch, one batch run twice; what each source gave."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("request"))
    feed = fed(e, "requests", "event_id", {"source": "end", "request": "0"}, 3)
    path, checkpoint = scratch(spark, "snapshots"), scratch(spark, "stream")
    off = {"purchase": "no subscription"}
    snapshots.capture(feed.select("source", "request"), path, checkpoint, _state_now, disabled=off)
    snapshots.batch_writer(path, _state_now, disabled=off)(spark.createDataFrame([("again", "1")], "source string, request string"), 0)  # a replay adds nothing
    rows = snapshots.captured(spark, path).where("source <> 'end'").select("source", "request", "status", "records").distinct()
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("records").alias("n_records"))


CAPTURED = """with e as (select distinct event_type as source, user_id as r from events),
s as (select source, case when source = 'purchase' then 'disabled' when source = 'error' and r % 3 = 0 then 'failed' else 'captured' end as status, r from e)
select source, status, count(*) as n_requests, sum(case when status = 'captured' then r % 4 else 0 end)::bigint as n_records from s group by all"""


#: Pages of a season that lie in one file.
BLOCK = 256


def _landed(options) -> pages.Client:
    """A client over pages that lie as Parquet in ``folder``, a folder to each season and block of pages; the archive lacks odd seasons.

    Pages are asked for in order, so a block is read once and kept until the next one is.
    """
    import pyarrow.parquet as pq

    store, place = fs.FileSystem.from_uri(options["folder"])

    @lru_cache(maxsize=2)
    def block(season: int, number: int) -> dict[int, str]:
        where = f"{place}/season={season}/block={number}"
        if store.get_file_info(where).type == fs.FileType.NotFound:
            return {}
        rows = pq.read_table(where, columns=["page", "raw"], filesystem=store, partitioning=None)
        return dict(zip(rows["page"].to_pylist(), rows["raw"].to_pylist(), strict=True))

    def fetch(path, params):
        season, page = params["seasons[]"], int(params.get("cursor", 0))
        if path == "archive" and season % 2:
            return 404, {}, None
        own = block(season, page // BLOCK).get(page)
        after = page + 1 in block(season, (page + 1) // BLOCK)
        return 200, {}, (json.loads(own) if own else {"data": []}) | {"meta": {"next_cursor": page + 1 if after else None}}

    return pages.Client(fetch)


def paged_source(spark, d):
    """Contests as season pages, read back through the data source: a task a season, odd seasons by the fallback."""
    place = F.row_number().over(W.partitionBy("season").orderBy("game_id")) - 1  # a season of contests, four whole numbers each
    c = contests(spark, d).select("season", "game_id", "home_score", "away_score").withColumn("page", F.floor(place / 100).cast("int"))
    item = F.struct(F.col("game_id").alias("id"), "home_score", "away_score")
    raw = F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("data")))
    folder = scratch(spark, "pages")
    blocks = c.withColumn("block", F.floor(F.col("page") / BLOCK).cast("int")).repartition("season", "block")
    blocks.groupBy("season", "block", "page").agg(raw.alias("raw")).write.partitionBy("season", "block").parquet(folder)
    first, last = c.agg(F.min("season"), F.max("season")).first()
    spark.dataSource.register(paged.SeasonPages)
    feed = spark.read.format("season_pages").options(client="priorline.plans.flows:_landed", folder=folder, path="archive", fallback="live", seasons=f"{first}-{last}").load()
    one = F.explode(F.from_json("raw", "data array<struct<id: long, home_score: int, away_score: int>>")["data"]).alias("g")
    return feed.select("season", "source", "page", one).select("season", "source", "page", F.col("g.id").alias("game_id"), "g.home_score", "g.away_score")


PAGED = f"""with {CONTESTS} select season, case when season % 2 = 1 then 'live' else 'archive' end as source, cast((row_number() over (partition by season order by game_id) - 1) // 100 as int) as page,
  game_id, home_score, away_score from contests"""

#: Where a report's columns begin, before a file's own shift, and what its header says above them.
_BEGINS = ((10.0, "Game", "Date"), (100.0, "Team", None), (200.0, "Player", "Name"), (300.0, "Reason", None))


def report_header_columns(spark, d):
    """Cells of reports whose columns stand elsewhere in each file, placed by their header rows; page 1 repeats none."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    file, shift = F.floor(F.col("event_id") / 200).cast("int"), F.floor(F.col("event_id") / 200) % 7 * 13
    at = e.select(file.alias("file"), F.floor(F.col("event_id") % 200 / 100).cast("int").alias("page"), F.col("event_id").cast("double").alias("y"), shift.alias("shift"), "*")
    cell = lambda x, text: F.struct((F.lit(x) + F.col("shift")).alias("x"), text.cast("string").alias("text"))
    some = [F.when(F.col("event_id") % 10 == 0, cell(9.0, F.concat(F.lit("G"), "event_id"))), F.when(F.col("event_id") % 4 == 0, cell(99.0, F.concat(F.lit("T"), "user_id")))]
    some += [cell(201.5, F.lit("Doe,")), cell(240.0, F.concat(F.lit("P"), "user_id")), F.when(F.col("event_type") != "error", cell(310.0, F.col("event_type")))]
    body = at.select("file", "page", "y", F.explode(F.array_compact(F.array(*some))).alias("c")).select("file", "page", "y", "c.*")
    words = [F.struct((F.lit(x + 30 * i) + F.col("shift")).alias("x"), F.lit(w).alias("text")) for x, *ws in _BEGINS for i, w in enumerate(ws) if w]
    heads = at.select("file", "shift").distinct().select("file", F.lit(0).alias("page"), F.lit(-1.0).alias("y"), F.explode(F.array(*words)).alias("c")).select("file", "page", "y", "c.*")
    labels, names = tuple(" ".join(w for w in ws if w) for _, *ws in _BEGINS), ("game_date", "team", "player", "reason")
    out = report_rows.by_headers(body.unionByName(heads), labels, names)
    return out.select(F.col("y").cast("long").alias("event_id"), "file", "page", *names)


HEADERS = """select event_id, cast(event_id // 200 as int) as file, cast(event_id % 200 // 100 as int) as page, case when event_id % 10 = 0 then 'G' || event_id end as game_date,
  case when event_id % 4 = 0 then 'T' || user_id end as team, 'Doe, P' || user_id as player, case when event_type <> 'error' then event_type end as reason from events"""


def archive_put(spark, d):
    """Files of suppliers archived twice over, every seventh with other bytes later: versions and conflicts."""
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey", "s_nationkey")
    body = lambda more: F.concat_ws("|", "name", "s_nationkey", F.lit(more)).cast("binary")
    files = s.select("name", body("a").alias("content"), F.lit(100).alias("retrieved_ts"))
    other = s.where("s_suppkey % 7 = 0").select("name", body("b").alias("content"), F.lit(200).alias("retrieved_ts"))
    root = scratch(spark, "archive")
    both = files.unionByName(other)
    new = [archive.put(rows, root).agg(F.count_if("new")).first()[0] for rows in (both.union(both).repartition(4), both)]
    held = archive.contents(spark, root, archive.scan(spark, root))
    return held.select("name", "bytes", "conflict", F.md5("content").alias("md5"), F.lit(new[1]).cast("long").alias("n_again"))


ARCHIVED = """with f as (select s_name as name, s_name || '|' || s_nationkey || '|' || v as body, v = 'b' as conflict from supplier, (select unnest(['a', 'b']) as v) where v = 'a' or s_suppkey % 7 = 0)
select name, strlen(body) as bytes, conflict, md5(body) as md5, 0::bigint as n_again from f"""


def keep_first_in_input(spark, d):
    """The first event of each user and type in the order of the input, by file and row."""
    rows = stores.in_order(spark, f"{d}/events.parquet").select("user_id", "event_type", "event_id", "value", "file", "ordinal")
    return stores.keep_first(rows, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


KEEP_FIRST = "select user_id, event_type, event_id, round(value, 6) as value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1"


def json_report(spark, d):
    """Audit tables as one document."""
    c = contests(spark, d)
    parts = {"seasons": c.groupBy("season").agg(F.count(F.lit(1)).alias("n")), "level": c.agg(F.count_if(F.col("home_win").isNull()).alias("n"))}
    return audit.report(parts)


REPORT = "with " + SIDES.split(",\nsides as")[0] + """ select 'seasons' as section, '[' || string_agg(j, ',' order by j) || ']' as body from (select '{"season":' || season || ',"n":' || count(*) || '}' as j from contests group by season)
union all select 'level', '[{"n":' || count(*) filter (where home_win is null) || '}]' from contests"""


QUERIES = {f.__name__: f for f in (json_page_flatten, candle_pages, idempotent_append, report_row_parse, stream_emit_then_update, stream_asof_state, stream_due_captures, snapshot_captures, paged_source, report_header_columns, archive_put, keep_first_in_input, json_report)}
ORACLES = {"json_page_flatten": FLATTEN, "candle_pages": CANDLES, "idempotent_append": APPEND, "report_row_parse": REPORT_ROWS, "stream_emit_then_update": STREAM, "stream_asof_state": STREAM_ASOF, "stream_due_captures": DUE, "snapshot_captures": CAPTURED, "paged_source": PAGED, "report_header_columns": HEADERS, "archive_put": ARCHIVED, "keep_first_in_input": KEEP_FIRST, "json_report": REPORT}
