"""Box-score arithmetic as column expressions; a missing term makes the result missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def possessions(own: dict[str, Column], other: dict[str, Column]) -> Column:
    """Mean of both sides' estimates: attempts, free throws, rebounds of own misses, turnovers."""

    def one(x: dict[str, Column], y: dict[str, Column]) -> Column:
        chances = x["oreb"] + y["dreb"]
        kept = F.when(chances == 0, F.lit(0.0)).otherwise(F.try_divide(x["oreb"], chances))
        return x["fga"] + 0.44 * x["fta"] - 1.07 * kept * (x["fga"] - x["fgm"]) + x["turnover"]

    return 0.5 * (one(own, other) + one(other, own))


def four_factors(own: dict[str, Column], other: dict[str, Column]) -> dict[str, Column]:
    return {
        "efg": ratio(own["fgm"] + 0.5 * own["fg3m"], own["fga"]),
        "tov_rate": ratio(own["turnover"], own["fga"] + 0.44 * own["fta"] + own["turnover"]),
        "oreb_rate": ratio(own["oreb"], own["oreb"] + other["dreb"]),
        "ft_rate": ratio(own["fta"], own["fga"]),
        "true_shooting": ratio(own["pts"], 2 * (own["fga"] + 0.44 * own["fta"])),
    }


def pace(poss: Column, minutes: Column) -> Column:
    """Possessions for 48 minutes of five players."""
    return F.when((poss > 0) & (minutes > 0), 48 * poss / (minutes / 5))


#: The counts that a side's row must have for its opponent's figures.
COUNTS = ("pts", "fgm", "fga", "fg3m", "ftm", "fta", "oreb", "dreb", "turnover")


def derived(sides: DataFrame) -> DataFrame:
    """Possessions, efficiencies, pace and factors of side rows (counts, trusted_pts, team_minutes, opponent).

    A side is complete where its players' points are exactly the trusted score and its attempts are known. Whatever is
    not complete, has no complete set of the opponent's counts, or comes to no possessions has no figure at all.
    Adds points_delta, complete and the figures; opp_ figures are the opponent's, from the same possessions.
    """
    # The other side of a contest is its other row: both meet in one shuffle, without a join of the table with itself.
    meet = W.partitionBy("game_id").orderBy("team")
    counts = F.struct("team", *COUNTS)
    beside = F.when(F.lag("team").over(meet) == F.col("opponent"), F.lag(counts).over(meet)).when(F.lead("team").over(meet) == F.col("opponent"), F.lead(counts).over(meet))
    both = sides.withColumn("_other", beside)
    both = both.select(*sides.columns, *[F.col(f"_other.{s}").alias(f"opp_{s}") for s in COUNTS])
    own, opp = {s: F.col(s) for s in COUNTS}, {s: F.col(f"opp_{s}") for s in COUNTS}
    delta = F.col("pts") - F.col("trusted_pts")
    complete = F.coalesce((delta == 0) & F.col("fga").isNotNull(), F.lit(False))
    both = both.withColumn("points_delta", delta).withColumn("complete", complete)
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in opp.values()])
    poss = F.when(F.col("complete") & known, possessions(own, opp))
    both = both.withColumn("possessions", F.when(poss > 0, poss))
    p = F.col("possessions")
    figure = lambda c: F.when(p.isNotNull(), c)
    factors = {k: figure(v) for k, v in four_factors(own, opp).items()}
    against = {f"opp_{k}": figure(v) for k, v in four_factors(opp, own).items() if k != "true_shooting"}
    off, dff = 100 * F.col("pts") / p, 100 * F.col("opp_pts") / p
    return both.withColumns({
        "off_efficiency": off, "def_efficiency": dff, "net_efficiency": off - dff,
        "pace": pace(p, F.col("team_minutes")), **factors, **against,
    })
