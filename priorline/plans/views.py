"""Derived tables: contests, quotes and box rows over the supplied tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions import values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts) -> F.Column:
    """Epoch seconds of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, ts (epoch seconds), day (epoch days), season, home, away, scores and home_win (null when level)."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    home = (F.col("o_custkey") % 30 + 1).cast("int")
    rows = o.select(
        F.col("o_orderkey").alias("game_id"),
        (seconds(F.col("o_orderdate")) + F.col("o_orderkey") % 1440 * 60).alias("ts"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        values.season_of(F.year("o_orderdate"), F.month("o_orderdate")).alias("season"),
        home.alias("home"),
        ((home + F.col("o_orderkey") % 29) % 30 + 1).cast("int").alias("away"),
        (80 + F.floor("o_totalprice") % 61).cast("int").alias("home_score"),
        (80 + cents % 59).cast("int").alias("away_score"),
    )
    return rows.withColumn("home_win", values.guarded_outcome(F.lit(True), F.col("home_score"), F.col("away_score")))


CONTESTS = """contests as (
  select *, case when home_score <> away_score then home_score > away_score end as home_win from (
    select o_orderkey as game_id, cast(epoch(o_orderdate) as bigint) + o_orderkey % 1440 * 60 as ts,
      date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day,
      cast(year(o_orderdate) - case when month(o_orderdate) < 7 then 1 else 0 end as int) as season,
      cast(o_custkey % 30 + 1 as int) as home, cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 + 1 as int) as away,
      cast(80 + cast(floor(o_totalprice) as bigint) % 61 as int) as home_score,
      cast(80 + cast(round(o_totalprice * 100) as bigint) % 59 as int) as away_score
    from orders))"""

SIDES = CONTESTS + """,
sides as (
  select game_id, ts, season, home as team, away as opponent, true as is_home, home_win as won, home_score as scored, away_score as allowed, home_score - away_score as margin from contests
  union all
  select game_id, ts, season, away, home, false, not home_win, away_score, home_score, away_score - home_score from contests)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, ts, ordinal, bid and ask: views give both, errors only a bid, clicks neither."""
    e = table(spark, sf_dir, "events")
    bid = F.when(F.col("event_type") != "click", F.round(F.col("value") / 500, 6))
    ask = F.when(~F.col("event_type").isin("click", "error"), F.round(F.col("value") / 500 + 0.01, 6))
    return e.where("event_type <> 'purchase'").select(F.col("user_id").alias("market"), seconds(F.col("ts")).alias("ts"), F.col("event_id").alias("ordinal"), bid.alias("bid"), ask.alias("ask"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("anchor_id"), F.col("user_id").alias("market"), seconds(F.col("ts")).alias("anchor_ts"))


QUOTES = """quotes as (
  select market, ts, ordinal, bid, ask from (
    select user_id as market, cast(floor(epoch(ts)) as bigint) as ts, event_id as ordinal,
      case when event_type <> 'click' then round(value / 500, 6) end as bid,
      case when event_type not in ('click', 'error') then round(value / 500 + 0.01, 6) end as ask
    from events where event_type <> 'purchase')
  qualify row_number() over (partition by market, ts order by ordinal desc) = 1),
anchors as (select event_id as anchor_id, user_id as market, cast(floor(epoch(ts)) as bigint) as anchor_ts from events where event_type = 'purchase')"""


#: Order lines of one task where they meet their contests and are added up: its memory is the same whatever the table is.
LINES_A_TASK = 250_000


def line_tasks(spark: SparkSession, lines: DataFrame) -> int:
    return max(lines.count() // LINES_A_TASK + 1, spark.sparkContext.defaultParallelism)


def _with_contests(spark: SparkSession, sf_dir: str, lines: DataFrame, tasks: int) -> DataFrame:
    """Order lines beside game_id, ts, season, home and away of their contest."""
    c = contests(spark, sf_dir).select("game_id", "ts", "season", "home", "away")
    return lines.repartition(tasks, "l_orderkey").join(c.repartition(tasks, "game_id"), F.col("l_orderkey") == F.col("game_id"))


def stints(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """What ``box`` adds up, with minutes and plus-minus alone: one row an order line, made before lines are sent."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    one = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") % 2 == 1).alias("_odd"), (F.col("l_partkey") % 12).cast("int").alias("player"),
        F.col("l_quantity").alias("minutes"), (cents % 41 - 20).cast("int").alias("plus_minus"),
    )
    team = F.when(F.col("_odd"), F.col("home")).otherwise(F.col("away")).alias("team")
    return _with_contests(spark, sf_dir, one, tasks).select("game_id", "ts", "season", team, "player", "minutes", "plus_minus")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One appearance for each order line: side by line number, twelve players a side, minutes by quantity."""
    li = table(spark, sf_dir, "lineitem")
    rows = _with_contests(spark, sf_dir, li, line_tasks(spark, li))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    one = rows.select(
        "game_id", "ts", "season", F.when(F.col("l_linenumber") % 2 == 1, F.col("home")).otherwise(F.col("away")).alias("team"),
        (F.col("l_partkey") % 12).cast("int").alias("player"), F.col("l_quantity").alias("minutes"),
        (cents % 31).cast("int").alias("pts"), (cents % 11).cast("int").alias("fgm"), (cents % 11 + cents % 7).cast("int").alias("fga"), (cents % 4).cast("int").alias("fg3m"),
        (cents % 5).cast("int").alias("ftm"), (cents % 5 + cents % 3).cast("int").alias("fta"), (cents % 6).cast("int").alias("oreb"), (cents % 9).cast("int").alias("dreb"),
        (cents % 5).cast("int").alias("turnover"), (cents % 41 - 20).cast("int").alias("plus_minus"),
    )
    # One row a player and game; equal lines of an order are one appearance in several stints.
    stats = [c for c in one.columns if c not in ("game_id", "ts", "season", "team", "player")]
    return one.groupBy("game_id", "ts", "season", "team", "player").agg(*[F.sum(s).alias(s) for s in stats])


BOX = CONTESTS + """,
box as (
  select game_id, ts, season, case when l_linenumber % 2 = 1 then home else away end as team, cast(l_partkey % 12 as int) as player, sum(l_quantity) as minutes,
    sum(c % 31) as pts, sum(c % 11) as fgm, sum(c % 11 + c % 7) as fga, sum(c % 4) as fg3m, sum(c % 5) as ftm, sum(c % 5 + c % 3) as fta,
    sum(c % 6) as oreb, sum(c % 9) as dreb, sum(c % 5) as turnover, sum(c % 41 - 20) as plus_minus
  from (select *, cast(round(l_extendedprice * 100) as bigint) as c from lineitem) join contests on l_orderkey = game_id
  group by all)"""
