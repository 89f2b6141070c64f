"""Queries on as-of joins, matching and other joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.operators import asof, match, sequence
from priorline.plans.views import BOX, CONTESTS, QUOTES, SIDES, anchors, box, contests, quotes, seconds, table

MAX_AGE = 6 * 3600
OFFSETS = [86400, 21600, 3600, 1800, 0]
#: The instant that state queries ask about: 2024-01-15 12:00 UTC.
UNTIL = 1705320000


def clean_quotes(spark, d) -> DataFrame:
    return asof.deduplicated(quotes(spark, d), "market", "ts", "ordinal")


def asof_quote(spark, d):
    """The last two-sided quote at or before each purchase."""
    two_sided = clean_quotes(spark, d).where("bid is not null and ask is not null")
    j = asof.latest_before(anchors(spark, d), two_sided, "market", "anchor_ts", "ts", {"q": "struct(ts as t, bid, ask)"})
    return j.select("anchor_id", "market", F.col("q.t").alias("quote_ts"), F.round((F.col("q.bid") + F.col("q.ask")) / 2 + 1e-9, 6).alias("midpoint"), (F.col("anchor_ts") - F.col("q.t")).alias("age_seconds"))


ASOF = f"""with {QUOTES} select anchor_id, a.market, q.ts as quote_ts, round((bid + ask) / 2 + 1e-9, 6) as midpoint, anchor_ts - q.ts as age_seconds
from anchors a asof left join (select * from quotes where bid is not null and ask is not null) q on a.market = q.market and a.anchor_ts >= q.ts"""


def asof_quote_salted(spark, d):
    """The same with every market cut into days that are sorted apart, for hot markets."""
    two_sided = clean_quotes(spark, d).where("bid is not null and ask is not null")
    j = asof.latest_before(anchors(spark, d), two_sided, "market", "anchor_ts", "ts", {"q": "struct(ts as t, bid, ask)"}, bucket_seconds=86400)
    return j.select("anchor_id", "market", F.col("q.t").alias("quote_ts"), F.round((F.col("q.bid") + F.col("q.ask")) / 2 + 1e-9, 6).alias("midpoint"), (F.col("anchor_ts") - F.col("q.t")).alias("age_seconds"))


def asof_quote_issues(spark, d):
    out = asof.quote_asof(anchors(spark, d), clean_quotes(spark, d), "market", "anchor_ts", MAX_AGE)
    return out.select("anchor_id", "quote_ts", "bid", "ask", "age_seconds", F.coalesce("issue", F.lit("usable")).alias("issue"))


ISSUES = f"""with {QUOTES}, e as (
  select a.*, q.ts as any_ts, q.bid as any_bid, q.ask as any_ask from anchors a asof left join quotes q on a.market = q.market and a.anchor_ts >= q.ts),
j as (select e.*, q.ts as q_ts, q.bid as q_bid, q.ask as q_ask from e asof left join (select * from quotes where bid is not null or ask is not null) q on e.market = q.market and e.anchor_ts >= q.ts),
p as (select *, coalesce(q_ts, any_ts) as quote_ts, case when q_ts is not null then q_bid else any_bid end as bid, case when q_ts is not null then q_ask else any_ask end as ask from j)
select anchor_id, quote_ts, bid, ask, anchor_ts - quote_ts as age_seconds,
  case when market not in (select market from quotes) then 'no_candles_returned' when any_ts is null then 'no_candle_at_or_before_prediction_ts' when q_ts is null then 'no_bid_or_ask_in_window'
    when anchor_ts - quote_ts > {MAX_AGE} then 'stale_quote' when bid is null then 'missing_bid' when ask is null then 'missing_ask' else 'usable' end as issue from p"""


def asof_multi_anchor(spark, d):
    """One stream of quotes serves every offset before each purchase."""
    many = asof.at_offsets(anchors(spark, d), "anchor_ts", OFFSETS)
    return asof.quote_asof(many, clean_quotes(spark, d), "market", "at_ts", MAX_AGE).select("anchor_id", F.col("offset_seconds").cast("long").alias("offset_seconds"), "quote_ts", "age_seconds", F.coalesce("issue", F.lit("usable")).alias("issue"))


MULTI = ISSUES.replace(f"with {QUOTES}, e as", f"with {QUOTES}, m as (select anchor_id, market, anchor_ts - o as anchor_ts, o as offset_seconds from anchors, (select unnest({OFFSETS}) as o)), e as").replace("from anchors a asof", "from m a asof").replace("select anchor_id, quote_ts, bid, ask, anchor_ts", "select anchor_id, cast(offset_seconds as bigint) as offset_seconds, quote_ts, anchor_ts")


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("ts"))


EVENTS = "ev as (select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as ts from events)"


def latest_state(spark, d):
    return asof.latest_state(_events(spark, d), ["user_id"], "ts", "event_id", UNTIL).select("user_id", "event_id", "event_type", (UNTIL - F.col("ts")).alias("staleness"))


LATEST = f"with {EVENTS} select user_id, event_id, event_type, {UNTIL} - ts as staleness from ev where ts <= {UNTIL} qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def latest_exact_state(spark, d):
    """The same, but observations dated only to a day, or of unknown time, decide nothing."""
    precision = F.when(F.col("event_id") % 3 == 0, "date_only").when(F.col("event_id") % 7 == 0, "unknown").otherwise("exact")
    e = _events(spark, d).withColumn("precision", precision)
    latest = asof.latest_state(e, ["user_id"], "ts", "event_id", UNTIL, "precision")
    return latest.select("user_id", "event_id", "event_type", (UNTIL - F.col("ts")).alias("staleness"))


LATEST_EXACT = f"""with {EVENTS} select user_id, event_id, event_type, {UNTIL} - ts as staleness from ev
where ts <= {UNTIL} and event_id % 3 <> 0 and event_id % 7 <> 0 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"""


def minutes_attach(spark, d):
    """A second feed's rows with the minutes of the first, by game and player; null where the first has none."""
    b = box(spark, d)
    advanced = b.select("game_id", "team", "player", (F.col("pts") + F.col("fga")).cast("long").alias("load"))
    minutes = b.where("player <> 5").select("game_id", "team", "player", "minutes")
    return advanced.join(minutes, ["game_id", "team", "player"], "left")


MINUTES = f"with {BOX} select game_id, team, player, cast(pts + fga as bigint) as load, case when player <> 5 then minutes end as minutes from box"


def state_coverage(spark, d):
    """By user: events known in time and refused as later, the latest, its age, and the kinds on either side."""
    e = _events(spark, d)
    known = F.col("ts") <= UNTIL
    return e.groupBy("user_id").agg(
        F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_refused"), F.max(F.when(known, F.col("ts"))).alias("latest_ts"), (UNTIL - F.max(F.when(known, F.col("ts")))).alias("staleness"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("event_type")))), ",").alias("kinds_known"), F.array_join(F.array_sort(F.collect_set(F.when(~known, F.col("event_type")))), ",").alias("kinds_refused"),
    )


COVERAGE = f"""with {EVENTS} select user_id, count(*) filter (where ts <= {UNTIL}) as n_known, count(*) filter (where ts > {UNTIL}) as n_refused, max(ts) filter (where ts <= {UNTIL}) as latest_ts, {UNTIL} - max(ts) filter (where ts <= {UNTIL}) as staleness,
coalesce(string_agg(distinct event_type, ',' order by event_type) filter (where ts <= {UNTIL}), '') as kinds_known, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (where ts > {UNTIL}), '') as kinds_refused from ev group by user_id"""


def batch_report_state(spark, d):
    """Events as hourly reports: of each user's latest report, all rows."""
    hourly = _events(spark, d).withColumn("report_ts", F.col("ts") - F.col("ts") % 3600)
    return asof.latest_batch(hourly, ["user_id"], "report_ts", UNTIL).groupBy("user_id", "report_ts").agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("kinds"))


BATCH = f"""with {EVENTS}, h as (select *, ts - ts % 3600 as report_ts from ev), r as (select * from h where report_ts <= {UNTIL} qualify rank() over (partition by user_id order by report_ts desc) = 1)
select user_id, report_ts, count(*) as n_rows, string_agg(event_type, ',' order by event_type) as kinds from r group by all"""


def match_two_tier(spark, d):
    """Contests against a copy with shifted days, some rows missing and some twice."""
    c = contests(spark, d)
    key = lambda day: F.concat_ws("|", day.cast("string"), F.least("home", "away").cast("string"), F.greatest("home", "away").cast("string"))
    pair = F.concat_ws("|", F.least("home", "away").cast("string"), F.greatest("home", "away").cast("string"))
    left = c.select(F.col("game_id").alias("left_id"), key(F.col("day")).alias("key"), pair.alias("pair"), "day")
    moved = c.where("game_id % 11 <> 0").withColumn("day", (F.col("day") + F.when(F.col("game_id") % 4 == 3, F.lit(0)).otherwise((F.col("game_id") % 4 - 1).cast("int"))).cast("int"))
    twice = moved.withColumn("copy", F.explode(F.when(F.col("game_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    right = twice.select((F.col("game_id") * 2 + F.col("copy")).alias("right_id"), F.when(F.col("game_id") % 17 != 0, key(F.col("day"))).alias("key"), pair.alias("pair"), "day")
    return match.two_tier(left, right)


MATCH = f"""with {CONTESTS},
l as (select game_id as left_id, day || '|' || least(home, away) || '|' || greatest(home, away) as key, least(home, away) || '|' || greatest(home, away) as pair, day from contests),
m as (select * exclude (day), day + case when game_id % 4 = 3 then 0 else game_id % 4 - 1 end as day from contests where game_id % 11 <> 0),
r as (select game_id * 2 + copy as right_id, case when game_id % 17 <> 0 then day || '|' || least(home, away) || '|' || greatest(home, away) end as key, least(home, away) || '|' || greatest(home, away) as pair, day
  from m, (select unnest([0, 1]) as copy) where copy = 0 or game_id % 13 = 0),
k as (select key, coalesce(nl, 0) as nl, coalesce(nr, 0) as nr, ls, rs from (select key, count(*) as nl, string_agg(left_id::varchar, ',' order by left_id) as ls from l group by key) full join (select key, count(*) as nr, string_agg(right_id::varchar, ',' order by right_id) as rs from r where key is not null group by key) using (key)),
l1 as (select l.*, nl, nr, rs from l left join k using (key)), r1 as (select r.*, nl, nr, ls from r left join k using (key)),
lp as (select * from l1 where nl is null or nl = 0 or nr = 0), rp as (select * from r1 where nl is null or nl = 0 or nr = 0),
n0 as (select left_id, right_id from lp join rp using (pair) where abs(lp.day - rp.day) <= 1),
n as (select *, count(*) over (partition by left_id) as dl, count(*) over (partition by right_id) as dr from n0)
select 'matched' as status, 'exact' as tier, left_id, cast(rs as bigint) as right_id, null as candidates from l1 where nl = 1 and nr = 1
union all select 'ambiguous', 'exact', left_id, null, rs from l1 where nl > 0 and nr > 0 and nl * nr > 1
union all select 'ambiguous', 'exact', null, right_id, ls from r1 where nl > 0 and nr > 0 and nl * nr > 1
union all select 'matched', 'near', left_id, right_id, null from n where dl = 1 and dr = 1
union all select 'ambiguous', 'near', left_id, null, string_agg(right_id::varchar, ',' order by right_id) from n where dl > 1 group by left_id
union all select 'unmatched_left', null, left_id, null, null from lp where left_id not in (select left_id from n where dl > 1 or dr = 1)
union all select 'unmatched_right', null, null, right_id, null from rp where right_id not in (select right_id from n where dl = 1 and dr = 1)"""


def identity_cascade(spark, d):
    """Customers resolved to suppliers by reference, then by alias, then by nation and ending of the name.

    A reference that is given but unknown ends the search, as does a blank name, and a nation whose names are known.
    """
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 11 != 0, F.substring("c_name", -9, 9)).otherwise(F.lit(" "))
    c = c.select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 97).alias("ref"), name.alias("name"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("nation"), F.substring(name, -1, 1).alias("ending"),
    )
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("resolved"), F.col("s_suppkey").alias("ref"), F.substring("s_name", -9, 9).alias("name"), F.col("s_nationkey").alias("nation"), F.substring("s_name", -1, 1).alias("ending"))
    tiers = [
        match.Tier("reference", match.registered(s.where("ref % 2 = 0"), ["ref"], "resolved"), ["ref"], "unknown reference"),
        match.Stop(F.trim("name") == "", "blank name"),
        match.Tier("alias", match.registered(s.where("ref % 3 = 0"), ["name"], "resolved"), ["name"]),
        match.Tier("nation and name", match.registered(s, ["nation", "ending"], "resolved", "none"), ["nation", "ending"], "unknown in nation"),
    ]
    return match.cascade(c, tiers, "resolved").select("c_custkey", "resolved", "method", "reason")


#: A given reference decides alone; then a blank name; then the alias; then the nation, which decides alone where it is given.
CASCADE = """with c as (select c_custkey, case when c_custkey % 5 = 0 then c_custkey % 97 end as ref, case when c_custkey % 11 <> 0 then right(c_name, 9) else ' ' end as name, case when c_custkey % 7 <> 0 then c_nationkey end as nation from customer),
s as (select s_suppkey as x, right(s_name, 9) as name, s_nationkey as nation, right(s_name, 1) as ending from supplier),
n as (select nation, ending, min(x) as x from s group by all having count(distinct x) = 1),
j as (select c.c_custkey, c.ref, c.name, c.nation, r.x as rx, a.x as ax, n.x as nx from c left join s r on r.x = c.ref and r.x % 2 = 0 left join s a on a.name = c.name and a.x % 3 = 0
  left join n on n.nation = c.nation and n.ending = right(c.name, 1)),
d as (select *, case when ref is not null then 'r' when trim(name) = '' then 'b' when ax is not null then 'a' when nation is not null then 'n' else 'u' end as step from j)
select c_custkey, case step when 'r' then rx when 'a' then ax when 'n' then nx end as resolved,
  case when step = 'r' and rx is not null then 'reference' when step = 'a' then 'alias' when step = 'n' and nx is not null then 'nation and name' end as method,
  case when step = 'r' and rx is null then 'unknown reference' when step = 'b' then 'blank name' when step = 'n' and nx is null then 'unknown in nation' when step = 'u' then 'unknown' end as reason from d"""


def two_store_precedence(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return match.by_precedence([("archive", o.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.lit("A"))), ("live", o.where("o_orderkey % 5 <> 0"))], "o_orderkey")


PRECEDENCE = """with b as (select 0 as r, 'archive' as source, o_orderkey, 'A' as o_orderstatus, o_totalprice from orders where o_orderkey % 3 <> 0 union all select 1, 'live', o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 5 <> 0)
select o_orderkey, o_orderstatus, o_totalprice, source, string_agg(source, ',') over (partition by o_orderkey order by source rows between unbounded preceding and unbounded following) as sources from b qualify row_number() over (partition by o_orderkey order by r) = 1"""


def one_to_one_checked_join(spark, d):
    c = contests(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("game_id"), "o_orderstatus", "o_orderpriority")
    return match.one_to_one(c.select("game_id", "season", "home_win"), o, ["game_id"])


ONE_TO_ONE = f"with {CONTESTS} select game_id, season, home_win, o_orderstatus, o_orderpriority from contests join orders on game_id = o_orderkey"


def semi_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity >= 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


def anti_join(spark, d):
    """Orders without lines, by season."""
    c = contests(spark, d)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"))
    return c.join(li, "game_id", "left_anti").groupBy("season").agg(F.count(F.lit(1)).alias("n_missing"))


def self_join_opponent(spark, d):
    s = sequence.side_rows(contests(spark, d)).select("game_id", "team", "opponent", "scored", "won")
    other = s.select("game_id", F.col("team").alias("opponent"), F.col("scored").alias("opp_scored"), F.col("won").alias("opp_won"))
    return s.join(other, ["game_id", "opponent"], "left")


OPPONENT = f"with {SIDES} select s.game_id, s.team, s.opponent, s.scored, s.won, o.scored as opp_scored, o.won as opp_won from sides s left join sides o on o.game_id = s.game_id and o.team = s.opponent"


def cross_plan(spark, d):
    """Capture tasks: every contest, source and offset, but none at or after its anchor."""
    c = contests(spark, d).select("game_id", (F.col("ts") - 1800).alias("anchor_ts"), "ts")
    tasks = c.withColumn("source", F.explode(F.array(F.lit("market"), F.lit("report"), F.lit("lineup")))).withColumn("before", F.explode(F.array(*map(F.lit, (86400, 3600, 1800, 600)))))
    return tasks.withColumn("capture_ts", F.col("ts") - F.col("before")).where("capture_ts < anchor_ts").select("game_id", "source", F.col("before").cast("long").alias("before"), "capture_ts", "anchor_ts")


CROSS = f"with {CONTESTS} select game_id, source, cast(before as bigint) as before, ts - before as capture_ts, ts - 1800 as anchor_ts from contests, (select unnest(['market', 'report', 'lineup']) as source), (select unnest([86400, 3600, 1800, 600]) as before) where ts - before < ts - 1800"


def theta_bucket(spark, d):
    """The last column edge at or left of each value, with slack."""
    edges = F.array(*map(F.lit, (0.0, 100.0, 250.0, 400.0)))
    e = table(spark, d, "events").select("event_id", "value")
    return e.select("event_id", F.aggregate(edges, F.lit(None).cast("double"), lambda a, x: F.when(x <= F.col("value") + 2.0, x).otherwise(a)).alias("edge"))


THETA = "select event_id, case when value + 2.0 >= 400 then 400.0 when value + 2.0 >= 250 then 250.0 when value + 2.0 >= 100 then 100.0 when value + 2.0 >= 0 then 0.0 end::double as edge from events"

QUERIES = {f.__name__: f for f in (asof_quote, asof_quote_salted, asof_quote_issues, asof_multi_anchor, latest_state, latest_exact_state, minutes_attach, state_coverage, batch_report_state, match_two_tier, identity_cascade, two_store_precedence, one_to_one_checked_join, semi_join, anti_join, self_join_opponent, cross_plan, theta_bucket)}
ORACLES = {
    "asof_quote": ASOF, "asof_quote_salted": ASOF, "asof_quote_issues": ISSUES, "asof_multi_anchor": MULTI, "latest_state": LATEST, "latest_exact_state": LATEST_EXACT, "minutes_attach": MINUTES, "state_coverage": COVERAGE, "batch_report_state": BATCH, "match_two_tier": MATCH,
    "identity_cascade": CASCADE, "two_store_precedence": PRECEDENCE, "one_to_one_checked_join": ONE_TO_ONE,
    "semi_join": "select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 45)",
    "anti_join": f"with {CONTESTS} select season, count(*) as n_missing from contests where game_id not in (select l_orderkey from lineitem) group by season",
    "self_join_opponent": OPPONENT, "cross_plan": CROSS, "theta_bucket": THETA,
}
