"""Checks of whole feeds against what is trusted: identities, point totals, plausible values, seasons and study sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from priorline.functions import values

#: A player's minutes beyond which a row is counted as odd, and the same for pace.
LONG_MINUTES, HIGH_PACE = 70, 200
MATCHED, REGULAR = "matched", "regular_season"


def identity(rows: DataFrame, known_teams: DataFrame) -> DataFrame:
    """One row: teams, teams unknown, players, rows without either id, and the part of rows whose side is known."""
    known = F.broadcast(known_teams.select(F.col("team").alias("_known")).distinct())
    joined = rows.join(known, F.col("team") == F.col("_known"), "left")
    odd = F.col("team").isNotNull() & F.col("_known").isNull()
    return joined.agg(
        F.count_distinct("team").alias("teams"), F.array_sort(F.collect_set(F.when(odd, F.col("team")))).alias("unknown_teams"),
        F.count_distinct("player").alias("players"), F.count_if(F.col("player").isNull()).alias("without_player"),
        F.count_if(F.col("team").isNull()).alias("without_team"),
        (100 * F.avg(F.col("is_home").isNotNull().cast("double"))).alias("pct_side_known"),
    )


def point_totals(players: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: sides whose players' points were summed, how many are exactly the score, and the largest difference."""
    sums = players.groupBy("game_id", "team").agg(F.sum("pts").alias("_pts"))
    delta = F.col("_pts") - F.col("scored")
    exact = F.count_if(delta == 0)
    return sums.join(sides.select("game_id", "team", "scored"), ["game_id", "team"]).agg(
        F.count(F.lit(1)).alias("checked"), exact.alias("exact"), (100 * exact / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pct_exact"),
        F.max(F.abs(delta)).alias("max_abs_delta"),
    )


def plausibility(players: DataFrame, advanced: DataFrame, fractions: list[str]) -> DataFrame:
    """One row: extremes of minutes, fractions out of [0, 1], and pace, of those who played.

    Feeds give 0 and not null to who did not play: a zero pace is counted by whether there were minutes, and quantiles
    are of participants alone.
    """
    joined = advanced.join(players.select("game_id", "player", "minutes"), ["game_id", "player"], "left")
    minutes, pace = F.coalesce("minutes", F.lit(0.0)), F.col("pace")
    played = F.when(minutes > 0, pace)
    high = F.when((minutes > 0) & (pace > HIGH_PACE), minutes)
    quantile = lambda q: F.percentile(played, F.lit(q))
    own = players.agg(
        F.min("minutes").alias("minutes_min"), F.max("minutes").alias("minutes_max"),
        F.count_if(F.col("minutes") > LONG_MINUTES).alias("minutes_long"),
    )
    rest = joined.agg(
        F.count_if(pace == 0).alias("pace_zero"), F.count_if((pace == 0) & (minutes == 0)).alias("pace_zero_unplayed"),
        F.count_if((pace == 0) & (minutes > 0)).alias("pace_zero_played"), F.count(played).alias("pace_checked"),
        *[quantile(q).alias(f"pace_p{int(100 * q):02d}") for q in (0.01, 0.5, 0.99)],
        F.count(high).alias("pace_high"), F.median(high).alias("pace_high_median_minutes"),
        *[F.count_if((F.col(f) < 0) | (F.col(f) > 1)).alias(f"{f}_out_of_range") for f in fractions],
    )
    return own.crossJoin(F.broadcast(rest))  # one row by one row


def eligible(matches: DataFrame, season: int | Column) -> DataFrame:
    """The study set: matched games of a season in its regular phase, by the phase's name and not by a playoff flag."""
    return matches.where((F.col("status") == MATCHED) & (F.col("season") == season) & (F.col("phase") == REGULAR))


def season_problems(games: DataFrame) -> DataFrame:
    """season, games, first and last day, and what is wrong with each season's dates: an empty list where nothing is."""
    first, last = F.min("date"), F.max("date")
    own = games.groupBy("season").agg(F.count(F.lit(1)).alias("games"), first.alias("first"), last.alias("last"))
    start, end = values.season_window(F.col("season"))
    problems = {
        "no_dates": F.col("first").isNull(),
        "starts_outside_window": ~F.col("first").between(start, end),
        "ends_outside_window": ~F.col("last").between(start, end),
        "no_autumn_start": (F.year("first") != F.col("season")) | (F.month("first") < 9),
    }
    return own.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()])))


def verified_season(games: DataFrame, season: int) -> DataFrame:
    """``games`` of one season; the job fails where a game is of another or the dates cannot be that season's."""
    odd = games.where(F.coalesce(F.col("season") != season, F.lit(True))).select(F.lit("another season's game").alias("problem"))
    dates = season_problems(games).select(F.explode("problems").alias("problem"))
    found = odd.unionByName(dates).agg(F.array_join(F.collect_set("problem"), ", ").alias("_problems"))
    text = F.concat(F.lit(f"season {season}: "), F.col("_problems"))
    ok = F.when(F.col("_problems") != "", F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return games.crossJoin(F.broadcast(found)).where(ok).drop("_problems")  # one row


def unresolved(rows: DataFrame, name: str, resolved_id: str, reason: str, claims: str | None = None, at: str | None = None, examples: int = 5) -> DataFrame:
    """Every name that stayed unresolved: its reason, rows, share of all unresolved rows in percent, ids and examples.

    ``claims`` is a column of the ids that claimed a row (an array), ``ids`` how many different ones did: 0 for a name that
    nobody knows, 2 or more for one that several share. ``at`` is a column whose smallest ``examples`` values are listed,
    so that a name can be looked up where it occurs. A null name is a name of its own.
    """
    open_ = rows.where(F.col(resolved_id).isNull())
    ids = F.size(F.array_distinct(F.flatten(F.collect_set(claims)))) if claims else F.lit(0)
    out = open_.groupBy(name, reason).agg(F.count(F.lit(1)).alias("rows"), ids.cast("int").alias("ids"))
    total = open_.agg(F.count(F.lit(1)).alias("_all"))
    out = out.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("rows") / F.col("_all"), 4)).drop("_all")  # one row
    if at:
        place = F.row_number().over(W.partitionBy(name, reason).orderBy(at))
        first = open_.select(name, reason, at).distinct().withColumn("_n", place).where(F.col("_n") <= examples)
        listed = F.array_join(F.array_sort(F.collect_list(at)).cast("array<string>"), ",").alias("examples")
        listed = first.groupBy(F.col(name).alias("_name"), F.col(reason).alias("_reason")).agg(listed)
        out = out.join(listed, F.col(name).eqNullSafe(F.col("_name")) & F.col(reason).eqNullSafe(F.col("_reason")), "left").drop("_name", "_reason")
    return out


def first_rows(rows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """A run's first so many rows in an order, or all of them: for trial runs of paced jobs."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)
