"""Queries on market normalisation and feed checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import dims
from priorline.functions import values
from priorline.operators import feeds, markets, sequence
from priorline.plans.forms import rounded
from priorline.plans.views import BOX, CONTESTS, SIDES, box, contests

CODES = [t[1] for t in dims.TEAMS]
CITIES = [t[2] for t in dims.TEAMS]


def raw_markets(spark, d):
    """One market a contest and side in the payload's words, with gaps and contradictions."""
    c = contests(spark, d)
    code = lambda x: F.element_at(F.array(*map(F.lit, CODES)), F.col(x))
    city = lambda x: F.element_at(F.array(*map(F.lit, CITIES)), F.col(x))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day") + 9131)  # twenty-five years on
    event = F.concat(F.lit("KXGAME-"), F.upper(F.date_format(date, "yyMMMdd")), code("away"), code("home"))
    g = F.col("game_id")
    sub = F.when(g % 3 == 0, F.concat(code("away"), F.lit(" at "), code("home"), F.lit(" (Jun 13)"))).when(g % 3 == 1, F.concat(code("home"), F.lit(" at "), code("away")))
    rules = F.when(g % 4 != 0, F.concat(F.lit("If the game originally scheduled for "), F.date_format(F.date_add(date, F.when(g % 7 == 0, 1).otherwise(0)), "MMM d, yyyy"), F.lit(" is won")))
    title = F.concat(city("away"), F.when(g % 5 == 0, " vs ").otherwise(" at "), city("home"), F.lit(" Winner?"))
    side = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = c.select("game_id", event.alias("e"), sub.alias("event_sub_title"), rules.alias("rules_primary"), title.alias("title"), code("home").alias("h"), code("away").alias("a"), city("home").alias("hc"), city("away").alias("ac"), side.alias("s"))
    team = F.when(g % 11 == 0, F.lit("BOS")).when(F.col("s"), F.col("h")).otherwise(F.col("a"))
    return rows.select(
        "game_id", F.when(g % 13 != 0, F.concat("e", F.lit("-"), team)).otherwise(F.lit("ODD")).alias("ticker"), F.when(g % 17 != 0, F.lower("e")).alias("event_ticker"),
        "event_sub_title", "rules_primary", "title", F.when(F.col("s"), F.col("hc")).otherwise(F.col("ac")).alias("yes_sub_title"),
    )


MARKET_COLUMNS = ("away_code", "home_code", "orientation_source", "codes_agree", "date_source", "date_agrees", "team_code", "team_agrees", "team_is_home", "is_matchup", "matchup_key")


def market_normalise(spark, d):
    rows = markets.normalised(raw_markets(spark, d), dims.aliases(spark))
    away, home = markets.title_sides(F.col("title"))
    day = F.date_format("scheduled_date", "yyyy-MM-dd")
    return rows.select("game_id", "ticker", "yes_sub_title", day.alias("scheduled_date"), *MARKET_COLUMNS, away.alias("title_away"), home.alias("title_home"))


_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in dims.alias_table().items() if v)
_FOLD = "lower(trim(regexp_replace(replace(replace({0}, '.', ''), '''', ''), '\\s+', ' ', 'g')))"
MARKETS = f"""with {CONTESTS}, al(spelling, code) as (values {_ALIASES}),
tc as (select unnest({CODES}) as code, unnest({CITIES}) as city, unnest(range(1, 31)) as id),
b as (
  select game_id, date '1970-01-01' + cast(day + 9131 as int) as dt, h.code as h, a.code as a, h.city as hc, a.city as ac
  from contests join tc h on h.id = home join tc a on a.id = away),
m as (
  select *, 'KXGAME-' || upper(strftime(dt, '%y%b%d')) || a || h as e,
    case game_id % 3 when 0 then a || ' at ' || h || ' (Jun 13)' when 1 then h || ' at ' || a end as sub,
    case when game_id % 4 <> 0 then dt + case when game_id % 7 = 0 then 1 else 0 end end as rd,
    ac || case when game_id % 5 = 0 then ' vs ' else ' at ' end || hc || ' Winner?' as title
  from b cross join (select unnest([true, false]) as s)),
r as (
  select *, case when game_id % 13 <> 0 then e || '-' || case when game_id % 11 = 0 then 'BOS' when s then h else a end else 'ODD' end as ticker,
    case when game_id % 17 <> 0 then e end as et, case when s then hc else ac end as yes from m),
p as (
  select *, case when game_id % 13 <> 0 then right(ticker, 3) end as team, case when et is not null then a end as ta, case when et is not null then h end as th,
    case when et is not null then dt end as td, split_part(sub, ' ', 1) as sa, split_part(sub, ' ', 3) as sh from r),
q as (
  select p.*, x.code as yes_code, case when sub is not null then sa else ta end as away_code, case when sub is not null then sh else th end as home_code
  from p left join al x on x.spelling = {_FOLD.format("yes")})
select game_id, ticker, yes as yes_sub_title, strftime(coalesce(rd, td), '%Y-%m-%d') as scheduled_date, away_code, home_code,
  case when sub is not null then 'event_sub_title' when et is not null then 'event_ticker' end as orientation_source,
  case when sub is not null and et is not null then sa = ta and sh = th end as codes_agree,
  case when rd is not null then 'rules_primary' when td is not null then 'event_ticker' end as date_source, rd = td as date_agrees,
  team as team_code, team = yes_code as team_agrees,
  case when team = home_code then true when team = away_code then false end as team_is_home,
  coalesce(team is not null and home_code is not null and away_code is not null and home_code <> away_code, false) as is_matchup,
  case when team is not null and home_code <> away_code and coalesce(rd, td) is not null
    then strftime(coalesce(rd, td), '%Y-%m-%d') || '|' || least(home_code, away_code) || '|' || greatest(home_code, away_code) end as matchup_key,
  case when game_id % 5 <> 0 then ac end as title_away, case when game_id % 5 <> 0 then hc end as title_home
from q"""


def match_agreement(spark, d):
    """What a matched market says of sides, day and outcome against the contest."""
    c = contests(spark, d)
    g = F.col("game_id")
    turned, silent = g % 6 == 0, g % 19 == 0
    rows = c.select(
        "game_id", F.col("home").alias("home_code"), F.col("away").alias("away_code"), "day", "home_win",
        F.when(~silent, F.when(turned, F.col("away")).otherwise(F.col("home"))).alias("market_home"),
        F.when(~silent, F.when(turned, F.col("home")).when(g % 29 == 0, F.lit(31)).otherwise(F.col("away"))).alias("market_away"),
        (F.col("day") + g % 2).cast("int").alias("market_day"), (F.col("home_win") != turned).alias("market_home_won"),
    )
    return markets.agreement(rows).select("game_id", "orientation", F.col("days_apart").cast("int").alias("days_apart"), "outcome_agrees")


AGREEMENT = f"""with {CONTESTS} select game_id, case when game_id % 19 = 0 then 'unknown' when game_id % 6 = 0 then 'turned' when game_id % 29 = 0 then 'other_teams' else 'same' end as orientation,
  cast(game_id % 2 as int) as days_apart,
  case when home_win is not null then case when game_id % 19 = 0 and game_id % 6 = 0 then false else true end end as outcome_agrees from contests"""


def identity_validation(spark, d):
    b = box(spark, d).select("game_id", "team", F.when(F.col("player") != 7, F.col("player")).alias("player"))
    s = sequence.side_rows(contests(spark, d)).select("game_id", "team", "is_home")
    rows = b.join(s, ["game_id", "team"], "left").withColumn("team", F.when(F.col("team") == 30, F.lit(99)).otherwise(F.col("team")))
    out = feeds.identity(rows, dims.teams(spark).select(F.col("franchise_id").alias("team")))
    return rounded(out.withColumn("unknown_teams", F.array_join("unknown_teams", ",")), "pct_side_known")


IDENTITY = f"""with {BOX}, s as (select game_id, home as team, true as is_home from contests union all select game_id, away, false from contests),
r as (select case when b.team = 30 then 99 else b.team end as team, case when player <> 7 then player end as player, is_home from box b left join s on s.game_id = b.game_id and s.team = b.team)
select count(distinct team) as teams, coalesce(string_agg(distinct team::varchar, ',') filter (where team not between 1 and 30), '') as unknown_teams, count(distinct player) as players,
  count(*) filter (where player is null) as without_player, count(*) filter (where team is null) as without_team, round(100 * avg((is_home is not null)::int), 6) as pct_side_known from r"""


def feed_consistency(spark, d):
    """Players' points against scores, and the plausibility of minutes, fractions and pace."""
    b = box(spark, d)
    s = sequence.side_rows(contests(spark, d)).select("game_id", "team", F.when(F.col("game_id") % 3 == 0, F.col("scored")).alias("scored"))
    sums = b.groupBy("game_id", "team").agg(F.sum("pts").cast("int").alias("own"))
    scored = s.join(sums, ["game_id", "team"], "left").select("game_id", "team", F.coalesce("scored", "own").alias("scored"))
    advanced = b.groupBy("game_id", "player").agg(F.sum("pts").alias("n"), F.sum("minutes").alias("m"))
    usage = (F.col("n") % 23) / 20.0
    advanced = advanced.select("game_id", "player", F.when(F.col("n") % 9 == 0, 0.0).otherwise(60.0 + F.col("n")).alias("pace"), usage.alias("usage"))
    players = b.groupBy("game_id", "player").agg(F.sum("minutes").alias("minutes")).where("player <> 5")
    totals = feeds.point_totals(b, scored)
    out = totals.crossJoin(F.broadcast(feeds.plausibility(players, advanced, ["usage"])))  # one row by one row
    return rounded(out, "pct_exact", "pace_p01", "pace_p50", "pace_p99", "pace_high_median_minutes")


CONSISTENCY = f"""with {SIDES}, {BOX[BOX.index("box as"):]},
own as (select game_id, team, sum(pts) as own from box group by all),
t as (select o.own - coalesce(case when s.game_id % 3 = 0 then s.scored end, o.own) as delta from own o join sides s on s.game_id = o.game_id and s.team = o.team),
adv as (select game_id, player, case when sum(pts) % 9 = 0 then 0.0 else 60.0 + sum(pts) end::double as pace, (sum(pts) % 23) / 20.0::double as usage from box group by all),
pl as (select game_id, player, sum(minutes) as minutes from box where player <> 5 group by all),
j as (select pace, usage, coalesce(minutes, 0) as minutes from adv left join pl using (game_id, player)),
x as (select count(*) as checked, count(*) filter (where delta = 0) as exact, max(abs(delta)) as max_abs_delta from t),
y as (select min(minutes) as minutes_min, max(minutes) as minutes_max, count(*) filter (where minutes > 70) as minutes_long from pl),
z as (
  select count(*) filter (where pace = 0) as pace_zero, count(*) filter (where pace = 0 and minutes = 0) as pace_zero_unplayed,
    count(*) filter (where pace = 0 and minutes > 0) as pace_zero_played, count(*) filter (where minutes > 0) as pace_checked,
    round(quantile_cont(pace, 0.01) filter (where minutes > 0), 6) as pace_p01, round(quantile_cont(pace, 0.5) filter (where minutes > 0), 6) as pace_p50,
    round(quantile_cont(pace, 0.99) filter (where minutes > 0), 6) as pace_p99, count(*) filter (where minutes > 0 and pace > 200) as pace_high,
    round(median(minutes) filter (where minutes > 0 and pace > 200), 6) as pace_high_median_minutes,
    count(*) filter (where usage < 0 or usage > 1) as usage_out_of_range from j)
select *, round(100.0 * exact / checked, 6) as pct_exact from x, y, z"""


def study_set(spark, d):
    """Eligible contests, each with whether its tip-off's day is near its scheduled one."""
    c = contests(spark, d)
    g = F.col("game_id")
    tip = F.timestamp_add("SECOND", F.col("ts"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day") + F.when(g % 9 == 0, 3).otherwise(0))
    rows = c.select(
        "game_id", "season", F.when(g % 8 == 0, "ambiguous").otherwise("matched").alias("status"),
        F.when(g % 10 == 0, "play_in").otherwise("regular_season").alias("phase"), values.near_date(F.when(g % 21 != 0, tip), date).alias("near"),
    )
    return feeds.eligible(rows, F.col("season")).select("game_id", "near")


STUDY = f"""with {CONTESTS} select game_id, case when game_id % 21 <> 0 then abs(ts // 86400 - (day + case when game_id % 9 = 0 then 3 else 0 end)) <= 1 end as near
from contests where game_id % 8 <> 0 and game_id % 10 <> 0"""


def season_verification(spark, d):
    c = contests(spark, d).select(F.when(F.col("game_id") % 5000 == 7, F.col("season") - 1).otherwise(F.col("season")).alias("season"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("date"))
    out = feeds.season_problems(c)
    return out.select("season", "games", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), F.array_join("problems", ",").alias("problems"))


VERIFICATION = f"""with {CONTESTS}, g as (select case when game_id % 5000 = 7 then season - 1 else season end as season, date '1970-01-01' + cast(day as int) as dt from contests),
s as (select season, count(*) as games, min(dt) as first, max(dt) as last from g group by season)
select season, games, strftime(first, '%Y-%m-%d') as first, strftime(last, '%Y-%m-%d') as last,
  array_to_string(list_filter([case when first not between make_date(season, 7, 1) and make_date(season + 1, 6, 30) then 'starts_outside_window' end,
    case when last not between make_date(season, 7, 1) and make_date(season + 1, 6, 30) then 'ends_outside_window' end,
    case when year(first) <> season or month(first) < 9 then 'no_autumn_start' end], lambda x: x is not null), ',') as problems from s"""


def unresolved_report(spark, d):
    """Names that no id was found for, by reason, with how many ids share them and where they occur first."""
    names = ["L.A. Lakers", "Los Angeles", "Bos", "Metropolis", "LA", "Gotham"]
    c = contests(spark, d).select("game_id", F.element_at(F.array(*map(F.lit, names)), (F.col("game_id") % 6 + 1).cast("int")).alias("name")).withColumn("key", values.folded(F.col("name")))
    known = dims.aliases(spark).select(F.col("spelling").alias("key"), F.col("code"), F.lit(True).alias("known"))
    shared = F.when(F.col("known") & F.col("code").isNull(), F.array(F.lit("LAC"), F.lit("LAL")))
    rows = c.join(F.broadcast(known), "key", "left").withColumn("reason", F.when(F.col("known"), "ambiguous").otherwise("unknown")).withColumn("claims", shared)
    return feeds.unresolved(rows, "name", "code", "reason", "claims", "game_id", 3)


UNRESOLVED = f"""with {CONTESTS}, n as (select game_id, ['L.A. Lakers', 'Los Angeles', 'Bos', 'Metropolis', 'LA', 'Gotham'][game_id % 6 + 1] as name from contests),
o as (select *, case when name in ('Los Angeles', 'LA') then 'ambiguous' else 'unknown' end as reason, row_number() over (partition by name order by game_id) as place from n where name in ('Los Angeles', 'LA', 'Metropolis', 'Gotham'))
select name, reason, count(*) as rows, case when reason = 'ambiguous' then 2 else 0 end as ids, round(100.0 * count(*) / (select count(*) from o), 4) as pct,
  string_agg(game_id::varchar, ',' order by game_id) filter (where place <= 3) as examples from o group by name, reason"""

QUERIES = {f.__name__: f for f in (market_normalise, match_agreement, identity_validation, feed_consistency, study_set, season_verification, unresolved_report)}
ORACLES = {
    "market_normalise": MARKETS, "match_agreement": AGREEMENT, "identity_validation": IDENTITY, "feed_consistency": CONSISTENCY,
    "study_set": STUDY, "season_verification": VERIFICATION, "unresolved_report": UNRESOLVED,
}
