"""Contests in their season: franchises, phases, whether they may be modelled, and what a regular season must add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phases of a season, and the mark of a cup's last contest.
PHASES = ("regular_season", "play_in", "playoffs", "nba_cup_championship", "other_special", "unclassified")
CUP_MARK = "Championship"
#: Fixed value: franchises are numbered from 1 to this.
FRANCHISES = 30


def is_franchise(team: Column) -> Column:
    """Whether a team's number is a franchise's; null stays null."""
    return team.between(1, FRANCHISES)


def with_phase(games: DataFrame, seasons: DataFrame, name: str = "phase") -> DataFrame:
    """``games`` (season, date, home, away, postseason, mark) with their phase by the declared windows of ``seasons``.

    In turn: a side that is no franchise; the play-in days; the feed's playoff flag; the cup's mark; the cup's day; the
    regular days. What none of them says is unclassified, never guessed: an undated contest, one of an undeclared season,
    one between the windows. ``seasons`` is a small dimension, a row a season.
    """
    windows = ("first_day", "last_day", "play_in_first", "play_in_last", "cup_final")
    dim = seasons.select(F.col("season").alias("_season"), *[F.to_date(c).alias(f"_{c}") for c in windows])
    date = F.col("date")
    special = F.coalesce(~is_franchise(F.col("home")), F.lit(False)) | F.coalesce(~is_franchise(F.col("away")), F.lit(False))
    phase = (
        F.when(special, PHASES[4]).when(date.between(F.col("_play_in_first"), F.col("_play_in_last")), PHASES[1]).when(F.col("postseason"), PHASES[2])
        .when(F.trim("mark") == CUP_MARK, PHASES[3]).when(date == F.col("_cup_final"), PHASES[3])
        .when(date.between(F.col("_first_day"), F.col("_last_day")), PHASES[0]).otherwise(PHASES[5])
    )
    return games.join(F.broadcast(dim), games["season"] == dim["_season"], "left").select(*games.columns, phase.alias(name))


def regular_seasons(games: DataFrame, seasons: DataFrame, exceptions: DataFrame, teams: int = FRANCHISES) -> DataFrame:
    """A row a season of ``games`` (season, phase, home, away): its regular contests against what is declared for it.

    n_games and expected, n_teams, least and most contests of a team, n_unexpected teams whose number is neither the
    season's nor their declared exception (season, team, games), and verified. What a season does not declare is not
    asked of it; one that is not declared at all is not verified. It reports and never fails: a season under way has
    not reached its numbers.
    """
    regular = games.where(F.col("phase") == PHASES[0])
    dim = seasons.select("season", "structure", F.col("expected_games").alias("expected"), F.col("expected_each").alias("each"))
    sides = regular.select("season", F.explode(F.array("home", "away")).alias("team")).where("team is not null")
    counts = sides.groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.broadcast(exceptions.select("season", "team", F.col("games").alias("_games")))
    judged = counts.join(allowed, ["season", "team"], "left").join(F.broadcast(dim), "season", "left")
    wrong = F.coalesce(F.col("n") != F.coalesce("_games", "each"), F.lit(False))
    by_team = judged.groupBy("season").agg(F.count(F.lit(1)).alias("n_teams"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(wrong).alias("n_unexpected"))
    totals = games.groupBy("season").agg(F.count_if(F.col("phase") == PHASES[0]).alias("n_games"))
    out = totals.join(by_team, "season", "left").join(F.broadcast(dim), "season", "left")
    sound = F.col("structure").isNotNull() & (F.coalesce("n_teams", F.lit(0)) == teams) & F.coalesce(F.col("n_games") == F.col("expected"), F.lit(True)) & (F.coalesce("n_unexpected", F.lit(0)) == 0)
    return out.select("season", "structure", "n_games", "expected", F.coalesce("n_teams", F.lit(0)).alias("n_teams"), "least", "most", F.coalesce("n_unexpected", F.lit(0)).alias("n_unexpected"), sound.alias("verified"))


#: How exactly a contest's instant is known where that is enough, and the reasons for leaving one out.
SOUND_PRECISIONS = ("exact_datetime", "date_only_verified")
EXCLUSIONS = ("unresolved_outcome", "unusable_chronology")


def with_eligibility(games: DataFrame, outcome: str = "home_win", precision: str = "precision") -> DataFrame:
    """``games`` with eligible, and the first reason why not: no trusted outcome, or no place in time; null is neither."""
    reason = F.when(F.col(outcome).isNull(), EXCLUSIONS[0]).when(~F.coalesce(F.col(precision).isin(*SOUND_PRECISIONS), F.lit(False)), EXCLUSIONS[1])
    return games.withColumns({"eligible": reason.isNull(), "reason": reason})
