"""Queries on sequential features, ratings and playing time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from priorline.functions import box as box_math
from priorline.functions.rating import shrunk_rating
from priorline.functions.values import DAY_SECONDS
from priorline.operators import recursive, rotation, sequence
from priorline.plans.views import BOX, CONTESTS, SIDES, box, contests, line_tasks, stints, table

#: Added before rounding where quotients of small whole numbers would often fall on halves of the last place.
NUDGE = 1e-9


def rounded(df: DataFrame, *names: str, nudge: float = 0.0) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + nudge, 6) for n in names})


def sides(spark, d) -> DataFrame:
    return sequence.side_rows(contests(spark, d))


def prior_form(spark, d):
    rows = sequence.form(sides(spark, d))
    return rounded(rows, "win_rate", "win_rate_5", "margin_5", "win_rate_10", "margin_10", "rest_days").select("game_id", "team", "is_home", "games_played", "win_rate", "win_rate_5", "margin_5", "win_rate_10", "margin_10", "rest_days", "back_to_back")


#: Side rows with how many results came before (k), and what counts only with a result.
RESULTS = SIDES + """,
counted as (
  select *, case when won is not null then margin end as m, case when won is not null then scored end as pts,
    case when won is not null then ts end as played_ts,
    count(won) over (partition by season, team order by ts, game_id rows between unbounded preceding and 1 preceding) as k
  from sides)"""

FORM_WINDOWS = """w as (partition by season, team order by ts, game_id rows between unbounded preceding and 1 preceding),
  w5 as (partition by season, team order by k range between 5 preceding and 1 preceding),
  w10 as (partition by season, team order by k range between 10 preceding and 1 preceding)"""

PRIOR_FORM = f"""with {RESULTS}
select game_id, team, is_home, k as games_played, round(avg(won::int) over w, 6) as win_rate,
  round(avg(won::int) over w5, 6) as win_rate_5, round(avg(m) over w5, 6) as margin_5,
  round(avg(won::int) over w10, 6) as win_rate_10, round(avg(m) over w10, 6) as margin_10,
  round((ts - max(played_ts) over w) / 86400.0, 6) as rest_days,
  coalesce((ts - max(played_ts) over w) / 86400.0 <= 1.5, false) as back_to_back
from counted window {FORM_WINDOWS}"""


def form_by_contest(spark, d):
    rows = sequence.form(sides(spark, d), (5,))
    return rounded(sequence.both_sides(rows, ["win_rate", "margin_5", "rest_days"]), *[f"{s}_{n}" for s in ("home", "away", "diff") for n in ("win_rate", "margin_5", "rest_days")])


FORM_BY_CONTEST = f"""with {RESULTS}, f as (
  select *, avg(won::int) over w as win_rate, avg(m) over w5 as margin_5, (ts - max(played_ts) over w) / 86400.0 as rest_days
  from counted window {FORM_WINDOWS})
select h.game_id, round(h.win_rate, 6) as home_win_rate, round(h.margin_5, 6) as home_margin_5, round(h.rest_days, 6) as home_rest_days,
  round(a.win_rate, 6) as away_win_rate, round(a.margin_5, 6) as away_margin_5, round(a.rest_days, 6) as away_rest_days,
  round(h.win_rate - a.win_rate, 6) as diff_win_rate, round(h.margin_5 - a.margin_5, 6) as diff_margin_5,
  round(h.rest_days - a.rest_days, 6) as diff_rest_days
from f h join f a on h.game_id = a.game_id and h.is_home and not a.is_home"""


def rest_back_to_back(spark, d):
    before = F.lag("ts").over(W.partitionBy("team").orderBy("ts", "game_id"))
    rest = (F.col("ts") - before) / 86400.0
    return sides(spark, d).select("game_id", "team", F.round(rest, 6).alias("rest_days"), F.coalesce(rest <= 1.5, F.lit(False)).alias("back_to_back"), (F.coalesce(rest, F.lit(0.0)) < 0).alias("out_of_order"))


REST = f"""with {SIDES} select game_id, team, round((ts - lag(ts) over w) / 86400.0, 6) as rest_days, coalesce((ts - lag(ts) over w) / 86400.0 <= 1.5, false) as back_to_back,
  coalesce((ts - lag(ts) over w) < 0, false) as out_of_order from sides window w as (partition by team order by ts, game_id)"""


def trailing_days_load(spark, d):
    return sequence.load(sides(spark, d)).select("game_id", "team", "games_3d", "games_5d", "games_7d", "third_in_4", "fourth_in_6")


def _days_frame(name: str, days: int) -> str:
    return f"{name} as (partition by season, team order by ts range between {days * 86400} preceding and 1 preceding)"


LOAD = f"""with {SIDES} select game_id, team, count(won) over d3 as games_3d, count(won) over d5 as games_5d,
  count(won) over d7 as games_7d, count(won) over d4 >= 2 as third_in_4, count(won) over d6 >= 3 as fourth_in_6
from sides window {", ".join(_days_frame(f"d{n}", n) for n in (3, 4, 5, 6, 7))}"""


def venue_split(spark, d):
    w = sequence.prior(by=["season", "team", "is_home"])
    rate, margin = F.avg(F.col("won").cast("double")).over(w), F.avg(sequence.settled("margin")).over(w)
    return sides(spark, d).select(
        "game_id", "team", F.count("won").over(w).alias("n_there"), F.round(rate, 6).alias("win_rate_there"),
        F.round(margin, 6).alias("margin_there"),
    )


VENUE = f"""with {RESULTS} select game_id, team, count(won) over w as n_there, round(avg(won::int) over w, 6) as win_rate_there,
  round(avg(m) over w, 6) as margin_there
from counted window w as (partition by season, team, is_home order by ts, game_id rows between unbounded preceding and 1 preceding)"""


def league_relative(spark, d):
    """Own mean points before the contest against the league's, from contests with a result processed earlier."""
    own = sides(spark, d)
    own = own.select("game_id", "season", "ts", "team", "won", "scored", F.avg(sequence.settled("scored")).over(sequence.prior()).alias("own"))
    rows = sequence.league_mean(own, "scored")
    return rows.select("game_id", "team", F.round(F.col("own") - F.col("league"), 6).alias("points_vs_league"))


LEAGUE = f"""with {RESULTS}, l as (
  select game_id, sum(s) over w / sum(n) over w as league
  from (select season, ts, game_id, sum(pts) as s, count(pts) as n from counted group by all)
  window w as (partition by season order by ts, game_id rows between unbounded preceding and 1 preceding)),
o as (select game_id, team, avg(pts) over (partition by season, team order by ts, game_id
  rows between unbounded preceding and 1 preceding) as own from counted)
select game_id, team, round(own - league, 6) as points_vs_league from o join l using (game_id)"""


def ewma_form(spark, d):
    rows = sides(spark, d).withColumn("margin", sequence.settled("margin"))
    out = sequence.trailing_means(rows, {"margin": "margin"}, (3,))
    return rounded(out.select("game_id", "team", "margin_ewma", "margin_last3"), "margin_ewma", "margin_last3")


def means_sql(name: str, h: str, lasts: tuple[int, ...], nudge: str = "") -> list[str]:
    """The means of trailing_means over a list ``h`` of earlier values, oldest first."""
    weigh = f"pow(pow(0.5, 0.2), len({h}) - i)"
    decayed = f"list_sum(list_transform(range(1, len({h}) + 1), lambda i: {h}[i] * {weigh})) / list_sum(list_transform(range(1, len({h}) + 1), lambda i: {weigh}))"
    parts = {"mean": f"list_avg({h})", **{f"last{n}": f"list_avg({h}[greatest(len({h}) - {n - 1}, 1):])" for n in lasts}, "ewma": decayed}
    return [f"case when len({h}) > 0 then round({x}{nudge}, 6) end as {name}_{k}" for k, x in parts.items()]


BEFORE = "over (partition by season, team order by ts, game_id rows between unbounded preceding and 1 preceding)"
EWMA = f"""with {RESULTS}, n as (select *, list(m) filter (where m is not null) {BEFORE} as h from counted)
select game_id, team, {", ".join(x for x in means_sql("margin", "h", (3,)) if not x.endswith("_mean"))} from n"""


RATED = ("home_rating", "away_rating", "home_probability")


def elo(spark, d):
    rated = recursive.elo(contests(spark, d), [recursive.EloConfig()])
    return rounded(rated, *RATED).select("game_id", *RATED)


def _elo_sql(configs: list[recursive.EloConfig]) -> str:
    """Ratings folded over all contests in order, a list of thirty for each configuration.

    Between seasons each rating keeps its share of the distance from 1500.
    """
    rows = ", ".join(f"({i}, {c.k}, {c.advantage}, {c.kept}, '{c.margin or ''}')" for i, c in enumerate(configs))
    by_log = "ln(abs(home_score - away_score) + 1) / ln(12)"
    lead = "case when home_win then h + adv - a else a - h - adv end"
    factor = f"""case margin when 'sqrt' then sqrt(abs(home_score - away_score)) / sqrt(11) when 'log' then {by_log}
      when 'fivethirtyeight' then {by_log} * (2.2 / (0.001 * {lead} + 2.2)) else 1 end"""
    return f"""with recursive {CONTESTS},
g as materialized (
  select *, row_number() over (order by ts, game_id) as i, season - coalesce(lag(season) over (order by ts, game_id), season) as gap
  from contests),
c(config_id, k, adv, kept, margin) as (values {rows}),
r as (
  select config_id, k::double as k, adv::double as adv, kept::double as kept, margin, cast(0 as bigint) as i, cast(null as bigint) as game_id,
    cast(null as double) as h, cast(null as double) as a, cast(null as double) as p, list_transform(range(0, 30), lambda x: cast(1500 as double)) as rating
  from c
  union all
  select config_id, k, adv, kept, margin, i, game_id, h, a, p,
    list_transform(range(1, 31), lambda x: now[x] + case when home_win is null then 0 when x = home then u when x = away then -u else 0 end)
  from (select *, k * {factor} * (cast(home_win as int) - p) as u from (
    select *, 1 / (1 + pow(10, -((h + adv) - a) / 400)) as p from (
      select *, now[home] as h, now[away] as a from (
        select g.*, r.config_id, r.k, r.adv, r.kept, r.margin, list_transform(r.rating, lambda x: 1500 + pow(r.kept, g.gap) * (x - 1500)) as now
        from r join g on g.i = r.i + 1)))))
"""


RATED_SQL = "round(h, 6) as home_rating, round(a, 6) as away_rating, round(p, 6) as home_probability from r where i > 0"
ELO = _elo_sql([recursive.EloConfig()]) + f"select game_id, {RATED_SQL}"


def mov_elo(spark, d):
    rated = recursive.elo(contests(spark, d), [recursive.EloConfig(kept=0.75, margin="fivethirtyeight")])
    return rounded(rated, *RATED).select("game_id", *RATED)


MOV_ELO = _elo_sql([recursive.EloConfig(kept=0.75, margin="fivethirtyeight")]) + f"select game_id, {RATED_SQL}"

GRID = [
    recursive.EloConfig(k, a, kept, None, m)
    for k, a in ((10.0, 40.0), (20.0, 80.0)) for kept in (0.25, 0.75) for m in (None, "sqrt", "log")
]


def elo_grid(spark, d):
    """Ratings of several configurations side by side, over all seasons."""
    return rounded(recursive.elo(contests(spark, d), GRID), *RATED).select("config_id", "game_id", *RATED)


ELO_GRID = _elo_sql(GRID) + f"select config_id, game_id, {RATED_SQL}"


def srs(spark, d):
    return rounded(recursive.srs(contests(spark, d)), "home_srs", "away_srs")


def sos_from_pregame_elo(spark, d):
    """Mean rating that earlier opponents had before those contests, of contests with a result."""
    rated = recursive.elo(contests(spark, d), [recursive.EloConfig()]).select("game_id", "home_rating", "away_rating")
    opp = F.when(F.col("is_home"), F.col("away_rating")).otherwise(F.col("home_rating"))
    rows = sides(spark, d).join(rated, "game_id").withColumn("opp", sequence.settled(opp))
    out = sequence.trailing_means(rows.select("game_id", "ts", "season", "team", "opp"), {"sos": "opp"}, (5, 10))
    return out.select("game_id", "team", *[F.round(c, 6).alias(n) for c, n in (("sos_mean", "sos"), ("sos_last5", "sos_5"), ("sos_last10", "sos_10"))])


SOS = _elo_sql([recursive.EloConfig()]) + f""", s as (
  select game_id, ts, season, home as team, case when home_win is not null then r.a end as opp from g join r using (game_id)
  union all select game_id, ts, season, away, case when home_win is not null then r.h end from g join r using (game_id)),
n as (select *, list(opp) filter (where opp is not null) {BEFORE} as x from s)
select game_id, team, round(list_avg(x), 6) as sos, round(list_avg(x[greatest(len(x) - 4, 1):]), 6) as sos_5,
  round(list_avg(x[greatest(len(x) - 9, 1):]), 6) as sos_10 from n"""

STATS = box_math.COUNTS


def side_totals(spark, d) -> DataFrame:
    """Side rows with their players' sums and the trusted score, which in one contest of five is another than theirs."""
    b = box(spark, d)
    sums = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS]
    own = b.groupBy("game_id", "team").agg(*sums, F.sum("minutes").alias("team_minutes"), F.count_if(F.col("minutes") > 0).alias("n_players"))
    trusted = sides(spark, d).select("game_id", "ts", "season", "team", "opponent", "is_home", "won", "scored")
    both = trusted.join(own, ["game_id", "team"], "left")
    score = F.when(F.col("game_id") % 5 != 0, F.coalesce("pts", "scored")).otherwise(F.col("scored"))
    return both.withColumn("trusted_pts", score).drop("scored")


def team_box(spark, d):
    rows = side_totals(spark, d)
    return rows.select(
        "game_id", "team", *[F.col(s).cast("long").alias(s) for s in STATS], F.round("team_minutes", 6).alias("team_minutes"),
        "n_players", (F.col("pts") - F.col("trusted_pts")).cast("long").alias("points_delta"), F.col("pts").isNull().alias("no_players"),
    )


TOTALS = f"""{BOX},
trusted as (
  select game_id, ts, season, home as team, away as opponent, home_win as won, home_score as scored from contests
  union all select game_id, ts, season, away, home, not home_win, away_score from contests),
own as (
  select game_id, team, {", ".join(f"sum({s}) as {s}" for s in STATS)}, sum(minutes) as team_minutes, count(*) filter (where minutes > 0) as n_players
  from box group by all),
totals as (
  select t.* exclude (scored), o.* exclude (game_id, team), case when t.game_id % 5 <> 0 then coalesce(o.pts, t.scored) else t.scored end as trusted_pts
  from trusted t left join own o on o.game_id = t.game_id and o.team = t.team)"""

TEAM_BOX = f"""with {TOTALS} select game_id, team, {", ".join(f"cast({s} as bigint) as {s}" for s in STATS)},
  round(team_minutes, 6) as team_minutes, n_players, cast(pts - trusted_pts as bigint) as points_delta, pts is null as no_players from totals"""


FACTORS = ("efg", "tov_rate", "oreb_rate", "ft_rate", "true_shooting", "opp_efg", "opp_tov_rate", "opp_oreb_rate", "opp_ft_rate")
FIGURES = ("possessions", "off_efficiency", "def_efficiency", "net_efficiency", "pace", *FACTORS)


def possessions_four_factors(spark, d):
    """Figures of reconciled boxes alone; no figure is made from one that is a point off."""
    rows = box_math.derived(side_totals(spark, d))
    return rows.select("game_id", "team", "complete", *[F.round(F.col(f) + NUDGE, 6).alias(f) for f in FIGURES])


_P = "({0}fga + 0.44 * {0}fta - 1.07 * (case when {0}oreb + {1}dreb = 0 then 0 else {0}oreb / ({0}oreb + {1}dreb) end) * ({0}fga - {0}fgm) + {0}turnover)"


def _factors_sql(x: str, y: str, prefix: str) -> str:
    return f"""({x}fgm + 0.5 * {x}fg3m) / nullif({x}fga, 0) as {prefix}efg, {x}turnover / nullif({x}fga + 0.44 * {x}fta + {x}turnover, 0) as {prefix}tov_rate,
  {x}oreb / nullif({x}oreb + {y}dreb, 0) as {prefix}oreb_rate, {x}fta / nullif({x}fga, 0) as {prefix}ft_rate"""


DERIVED = f"""{TOTALS},
met as (
  select t.*, {", ".join(f"o.{s} as opp_{s}" for s in STATS)}, coalesce(t.pts = t.trusted_pts and t.fga is not null, false) as complete
  from totals t left join totals o on o.game_id = t.game_id and o.team = t.opponent),
poss as (
  select *, case when complete and opp_pts is not null then 0.5 * ({_P.format("", "opp_")} + {_P.format("opp_", "")}) end as p0 from met),
derived as (
  select game_id, ts, season, team, complete, won, p as possessions, 100 * pts / p as off_efficiency, 100 * opp_pts / p as def_efficiency,
    100 * pts / p - 100 * opp_pts / p as net_efficiency, case when team_minutes > 0 then 48 * p / (team_minutes / 5) end as pace,
    {", ".join(f"case when p is not null then {f} end as {f}" for f in FACTORS)}
  from (
    select *, case when p0 > 0 then p0 end as p, {_factors_sql("", "opp_", "")}, {_factors_sql("opp_", "", "opp_")},
      pts / nullif(2 * (fga + 0.44 * fta), 0) as true_shooting
    from poss))"""
POSSESSIONS = f"""with {DERIVED} select game_id, team, complete, {", ".join(f"round({f} + 1e-9, 6) as {f}" for f in FIGURES)} from derived"""

#: What is followed through a season, over all games, the last so many, and decayed.
METRICS = ("off_efficiency", "def_efficiency", "net_efficiency", "pace", "efg", "tov_rate", "oreb_rate", "ft_rate")
LASTS = (3, 5, 10)


def _figures(spark, d) -> DataFrame:
    return box_math.derived(side_totals(spark, d)).select("game_id", "ts", "season", "team", "is_home", "complete", "pts", *METRICS)


def _followed(figures: DataFrame) -> DataFrame:
    return sequence.trailing_means(figures, {m: m for m in METRICS}, LASTS)


MEANS = [f"{m}_{k}" for m in METRICS for k in ("mean", *(f"last{n}" for n in LASTS), "ewma")]


def efficiency_windows(spark, d):
    """Eight figures before each contest: season mean, last three, five and ten, decayed; of complete boxes alone."""
    return rounded(_followed(_figures(spark, d)).select("game_id", "team", *MEANS), *MEANS, nudge=NUDGE)


FOLLOWED = f"""{DERIVED}, lists as (
  select *, {", ".join(f"list({m}) filter (where {m} is not null) {BEFORE} as h_{m}" for m in METRICS)} from derived)"""
EFFICIENCY = f"""with {FOLLOWED}
select game_id, team, {", ".join(x for m in METRICS for x in means_sql(m, f"h_{m}", LASTS, " + 1e-9"))} from lists"""


def efficiency_by_contest(spark, d):
    """Home, away and difference of season means, each against the league's so far, and whether no box was incomplete.

    The league's baseline is the mean of the complete sides of contests processed earlier this season, offence for
    both efficiencies. Boxes without any player count neither way.
    """
    # The league's sums are of the figures: read behind the pass over each side's past, they would have it run again.
    figures = _figures(spark, d)
    rows = _followed(figures)
    one = figures.groupBy("season", "game_id", "ts").agg(*[
        x for m in ("off_efficiency", "efg") for x in (F.coalesce(F.sum(m), F.lit(0.0)).alias(f"s_{m}"), F.count(m).alias(f"n_{m}"))
    ])
    sums = {f"{k}_{m}": F.col(f"{k}_{m}") for m in ("off_efficiency", "efg") for k in ("s", "n")}
    totals = {f"l{n}": c for n, c in sums.items()}
    league = sequence.totals_before(one, ["season"], 86400, totals).select(
        "game_id", *[F.try_divide(F.col(f"ls_{m}"), F.col(f"ln_{m}")).alias(f"league_{m}") for m in ("off_efficiency", "efg")]
    )
    incomplete = F.count_if(~F.col("complete") & F.col("pts").isNotNull()).over(sequence.prior())
    own = rows.withColumn("clean", F.coalesce(incomplete, F.lit(0)) == 0).join(league, "game_id")
    base = {"off_efficiency": "league_off_efficiency", "def_efficiency": "league_off_efficiency", "efg": "league_efg"}
    own = own.withColumns({f"{m}_vs_league": F.col(f"{m}_mean") - F.col(b) for m, b in base.items()})
    names = ["net_efficiency_mean", "pace_ewma", *[f"{m}_vs_league" for m in base]]
    out = sequence.both_sides(own, names, (F.bool_and("clean").alias("complete_history"), F.max("league_off_efficiency").alias("league_off_efficiency")))
    return rounded(out, "league_off_efficiency", *[f"{s}_{n}" for s in ("home", "away", "diff") for n in names], nudge=NUDGE)


def _efficiency_by_contest_sql() -> str:
    base = {"off_efficiency": "league_off_efficiency", "def_efficiency": "league_off_efficiency", "efg": "league_efg"}
    names = ["net_efficiency_mean", "pace_ewma", *[f"{m}_vs_league" for m in base]]
    means = {m: [x.replace("round(", "").replace(", 6)", "") for x in means_sql(m, f"h_{m}", (3,))] for m in METRICS}
    pick = lambda m, k: next(x for x in means[m] if x.endswith(f"_{k}"))
    wanted = ", ".join([pick("net_efficiency", "mean"), pick("pace", "ewma"), *[pick(m, "mean") for m in base]])
    cols = ", ".join(f"round({x} + 1e-9, 6) as {s}_{n}" for n in names for s, x in (("home", f"h.{n}"), ("away", f"a.{n}"), ("diff", f"(h.{n} - a.{n})")))
    return f"""with {FOLLOWED}, lg as (
  select game_id, sum(so) over w / nullif(sum(no) over w, 0) as league_off_efficiency, sum(se) over w / nullif(sum(ne) over w, 0) as league_efg
  from (select season, game_id, ts, coalesce(sum(off_efficiency), 0) as so, count(off_efficiency) as no, coalesce(sum(efg), 0) as se, count(efg) as ne
    from derived group by all)
  window w as (partition by season order by ts, game_id rows between unbounded preceding and 1 preceding)),
x as (select game_id, team, {wanted}, coalesce(count(*) filter (where not complete and box_pts is not null) {BEFORE}, 0) = 0 as clean
  from (select l.*, t.pts as box_pts from lists l join totals t using (game_id, team))),
y as (select *, {", ".join(f"{m}_mean - {b} as {m}_vs_league" for m, b in base.items())} from x join lg using (game_id))
select h.game_id, {cols}, h.clean and a.clean as complete_history, round(h.league_off_efficiency + 1e-9, 6) as league_off_efficiency
from y h join contests c on c.game_id = h.game_id and c.home = h.team join y a on a.game_id = c.game_id and a.team = c.away"""


EFFICIENCY_BY_CONTEST = _efficiency_by_contest_sql()


def _rotation(spark, d, window):
    return rotation.window_minutes(rotation.numbered(box(spark, d)), window)


def rotation_shares(spark, d):
    return rounded(_rotation(spark, d, "recent"), "minutes", "share")


def _window_sql(name: str, window: str) -> str:
    first, last = rotation.WINDOWS[window]
    return f"""{name} as (select season, team, game_no, player, minutes, minutes / sum(minutes) over (partition by season, team, game_no) as share from (
  select b.season, b.team, b.game_no + a as game_no, player, sum(minutes) as minutes from nb b, range({last}, {first + 1}) t(a) group by all))"""


NUMBERED = f"""{BOX}, nb as (select b.*, n.game_no from box b join (select season, team, game_id, row_number() over (partition by season, team order by ts, game_id) as game_no from (select distinct season, team, game_id, ts from box)) n using (season, team, game_id))"""
ROTATION = f"with {NUMBERED}, {_window_sql('w', 'recent')} select season, team, game_no, player, round(minutes, 6) as minutes, round(share, 6) as share from w"


def hhi_topn(spark, d):
    return rounded(rotation.concentration(_rotation(spark, d, "recent")), "hhi", "top_share", nudge=NUDGE)


HHI = f"""with {NUMBERED}, {_window_sql('w', 'recent')} select season, team, game_no, round(sum(share * share) + 1e-9, 6) as hhi, round(list_sum(list_sort(list(share), 'desc')[:5]) + 1e-9, 6) as top_share, count(*) filter (where share > 0) as n_players from w group by all"""


def minutes_overlap(spark, d):
    return rounded(rotation.overlap(rotation.numbered(box(spark, d)), "recent", "trailing5"), "overlap", nudge=NUDGE)


OVERLAP = f"""with {NUMBERED}, {_window_sql('x', 'recent')}, {_window_sql('y', 'trailing5')}
select season, team, game_no, round(sum(least(coalesce(x.share, 0), coalesce(y.share, 0))) + 1e-9, 6) as overlap from x full join y using (season, team, game_no, player) group by all"""


def disruption(spark, d):
    return rounded(rotation.disruption(rotation.numbered(box(spark, d))), "minutes_lost", "lost_ratio", nudge=NUDGE)


def _games_sql(x: str, window: str) -> str:
    """Recorded games of a side in the window before its game of that number."""
    first, last = rotation.WINDOWS[window]
    return f"(select count(*) from range(greatest({x}.game_no - {first}, 1), {x}.game_no - {last} + 1))"


DISRUPTION = f"""with {NUMBERED}, {_window_sql("x", "baseline")}, {_window_sql("y", "recent3")},
n as (select game_no, {_games_sql("g", "baseline")} as nb, {_games_sql("g", "recent3")} as nr from (select distinct game_no from x) g),
j as (select x.season, x.team, x.game_no, x.minutes / nb as b, coalesce(y.minutes / nr, 0) as r
  from x join n using (game_no) left join y using (season, team, game_no, player) where x.minutes > 0)
select season, team, game_no, round(sum(greatest(0, b - r)) + 1e-9, 6) as minutes_lost, count(*) filter (where b >= 20 and r = 0) as absent,
  round(sum(greatest(0, b - r)) / nullif(sum(b), 0) + 1e-9, 6) as lost_ratio from j group by all"""


def player_quality(spark, d):
    """Shrunk plus-minus for 36 minutes before each game, of the same season and side; missing minutes count as not played."""
    b = box(spark, d)
    w = sequence.prior(by=["season", "team", "player"])
    quality = shrunk_rating(F.coalesce(F.sum("plus_minus").over(w), F.lit(0)), F.coalesce(F.sum("minutes").over(w), F.lit(0)), F.count(F.lit(1)).over(w))
    return b.select("game_id", "team", "player", F.round(quality, 6).alias("quality"))


QUALITY = f"""with {BOX} select game_id, team, player, round(coalesce(case when sum(minutes) over w > 0 then 36 * sum(plus_minus) over w / sum(minutes) over w * count(*) over w / (count(*) over w + 20.0) end, 0), 6) as quality
from box window w as (partition by season, team, player order by ts, game_id rows between unbounded preceding and 1 preceding)"""


#: Sides that contests are between, by the derived tables.
SIDES_A_DAY = 30


def rotation_strength(spark, d):
    """Sum of share times quality over the recent window."""
    tasks = line_tasks(spark, table(spark, d, "lineitem"))
    # Spans as long as a side's lines of a fifth of a task take, on the days that have contests.
    days = contests(spark, d).agg(F.approx_count_distinct("day")).first()[0]
    seconds = max(60, DAY_SECONDS * max(days, 1) * SIDES_A_DAY // (5 * tasks))
    return rounded(rotation.strength(stints(spark, d, tasks), seconds, tasks), "strength")


STRENGTH = f"""with {NUMBERED}, {_window_sql('w', 'recent')},
q as (select season, team, player, game_no, case when sum(minutes) over u > 0 then 36 * sum(plus_minus) over u / sum(minutes) over u * count(*) over u / (count(*) over u + 20.0) else 0 end as quality
  from nb window u as (partition by season, team, player order by game_no rows between unbounded preceding and current row))
select w.season, w.team, w.game_no, round(sum(w.share * q.quality), 6) as strength from w asof join q on w.season = q.season and w.team = q.team and w.player = q.player and w.game_no > q.game_no group by all"""

QUERIES = {f.__name__: f for f in (prior_form, form_by_contest, rest_back_to_back, trailing_days_load, venue_split, league_relative, ewma_form, elo, mov_elo, elo_grid, srs, sos_from_pregame_elo, team_box, possessions_four_factors, rotation_shares, hhi_topn, minutes_overlap, disruption, player_quality, rotation_strength, efficiency_windows, efficiency_by_contest)}
ORACLES = {
    "prior_form": PRIOR_FORM, "form_by_contest": FORM_BY_CONTEST, "rest_back_to_back": REST, "trailing_days_load": LOAD, "venue_split": VENUE, "league_relative": LEAGUE, "ewma_form": EWMA, "elo": ELO, "mov_elo": MOV_ELO, "elo_grid": ELO_GRID, "efficiency_windows": EFFICIENCY, "efficiency_by_contest": EFFICIENCY_BY_CONTEST,
    "sos_from_pregame_elo": SOS, "team_box": TEAM_BOX, "possessions_four_factors": POSSESSIONS, "rotation_shares": ROTATION, "hhi_topn": HHI, "minutes_overlap": OVERLAP, "disruption": DISRUPTION, "player_quality": QUALITY, "rotation_strength": STRENGTH,
}
