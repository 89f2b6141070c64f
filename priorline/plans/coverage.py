"""Queries on plans and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import dims
from priorline.operators import league
from priorline.plans import tables
from priorline.plans.views import CONTESTS, contests, seconds, table
from priorline.sources import capture


def slot_grid(spark, d):
    return capture.slot_grid(spark, 19723, 19753)


def anchor_guarantee(spark, d):
    """Every contest's capture tasks before its anchor."""
    c = contests(spark, d)
    before = F.when(F.col("game_id") % 3 == 0, F.array(F.lit(900))).otherwise(F.array(F.lit(900), F.lit(3600), F.lit(7200)))
    tasks = c.select("game_id", "ts", F.explode(before).alias("before")).select("game_id", (F.col("ts") - F.col("before")).alias("capture_ts"))
    return capture.guaranteed(c.select("game_id", (F.col("ts") - 1800).alias("anchor_ts")), tasks)


GUARANTEE = f"with {CONTESTS} select game_id, ts - 1800 as anchor_ts, case when game_id % 3 = 0 then 0 else 2 end as n_tasks, game_id % 3 <> 0 as covered from contests"


def anchor_health(spark, d):
    """Each user's latest report before an instant: its age in minutes, stale beyond sixty, or missing."""
    until = 1705320000
    e = table(spark, d, "events").select("user_id", seconds(F.col("ts")).alias("s"))
    own = e.groupBy("user_id").agg(F.max(F.when(F.col("s") <= until, F.col("s"))).alias("s"))
    age = (until - F.col("s")) / 60
    return own.select("user_id", F.round(age + 1e-9, 6).alias("age_minutes"), F.when(F.col("s").isNull(), "missing").when(age > 60, "stale").otherwise("healthy").alias("health"))


HEALTH = """with o as (select user_id, max(cast(floor(epoch(ts)) as bigint)) filter (where epoch(ts) < 1705320001) as s from events group by 1)
select user_id, round((1705320000 - s) / 60.0 + 1e-9, 6) as age_minutes, case when s is null then 'missing' when (1705320000 - s) / 60.0 > 60 then 'stale' else 'healthy' end as health from o"""


def join_coverage(spark, d):
    """By season: contests expected and those with lines; and, by phase, lines' orders whose contest is outside the regular season or none."""
    c = league.with_phase(tables.placed_in_seasons(spark, d), dims.seasons(spark)).select("game_id", "season", "phase").where("game_id % 19 <> 0")
    present = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id")).distinct().withColumn("here", F.lit(1))
    both = c.join(present, "game_id", "full_outer")
    regular = F.col("phase") == league.PHASES[0]
    by_season = both.where(regular).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("here").alias("covered"))
    outside = both.where(F.col("here").isNotNull() & ~F.coalesce(regular, F.lit(False))).groupBy(F.coalesce("phase", F.lit("no contest")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    expected = by_season.select(F.lit("expected").alias("part"), F.col("season").cast("string").alias("of"), "n", "covered", F.round(100 * F.col("covered") / F.col("n"), 4).alias("pct"))
    return expected.unionByName(outside.select(F.lit("outside").alias("part"), F.col("phase").alias("of"), "n"), allowMissingColumns=True)


JOIN_COVERAGE = f"""with {tables.PHASED}, l as (select distinct l_orderkey as game_id, 1 as here from lineitem), b as (select * from (select game_id, season, phase from p where game_id % 19 <> 0) full join l using (game_id))
select 'expected' as part, season::varchar as of, count(*) as n, count(here) as covered, round(100.0 * count(here) / count(*), 4) as pct from b where phase = 'regular_season' group by season
union all select 'outside', coalesce(phase, 'no contest'), count(*), null, null from b where here = 1 and coalesce(phase <> 'regular_season', true) group by phase"""


def report_to_game(spark, d):
    """Reports by day and pair against contests: matched, ambiguous or unmatched, before or after the seasons."""
    c = contests(spark, d).select("day", "home", "away", "game_id")
    n = c.groupBy("day", "home", "away").agg(F.count(F.lit(1)).alias("n"), F.min("game_id").alias("game_id"))
    r = c.where("game_id % 3 = 0").select((F.col("day") + F.when(F.col("game_id") % 4 == 0, 3000).otherwise(0)).alias("day"), "home", "away", F.col("game_id").alias("report_id"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").when(F.col("day") > 11600, "unmatched_after").otherwise("unmatched_within")
    return r.join(n, ["day", "home", "away"], "left").select("report_id", F.when(F.col("n") == 1, F.col("game_id")).alias("game_id"), status.alias("status"))


REPORT_GAME = f"""with {CONTESTS}, n as (select day, home, away, count(*) as n, min(game_id) as game_id from contests group by all), r as (select day + case when game_id % 4 = 0 then 3000 else 0 end as day, home, away, game_id as report_id from contests where game_id % 3 = 0)
select report_id, case when n = 1 then game_id end as game_id, case when n = 1 then 'matched' when n > 1 then 'ambiguous' when day > 11600 then 'unmatched_after' else 'unmatched_within' end as status from r left join n using (day, home, away)"""


QUERIES = {f.__name__: f for f in (slot_grid, anchor_guarantee, anchor_health, join_coverage, report_to_game)}
ORACLES = {
    "slot_grid": "select day, day * 86400 + s as slot_ts from (select unnest(range(19723, 19754)) as day), (select unnest(range(0, 86400, 1800)) as s)",
    "anchor_guarantee": GUARANTEE, "anchor_health": HEALTH, "join_coverage": JOIN_COVERAGE, "report_to_game": REPORT_GAME,
}
