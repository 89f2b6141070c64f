"""Rating arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisors that bring an average margin's multiplier near one.
NORMALISERS = {"log": math.log(12.0), "fivethirtyeight": math.log(12.0), "sqrt": math.sqrt(11.0)}


def expected(home: Column, away: Column, advantage: float) -> Column:
    """Chance of the home side."""
    return 1 / (1 + F.pow(F.lit(10.0), -((home + advantage) - away) / 400))


def multiplier(kind: str, margin: Column, winner_diff: Column) -> Column:
    """How a margin scales a rating's update."""
    size = F.abs(margin)
    raw = {"log": F.log1p(size), "sqrt": F.sqrt(size), "fivethirtyeight": F.log1p(size) * (2.2 / (0.001 * winner_diff + 2.2))}[kind]
    return raw / NORMALISERS[kind]


def shrunk_rating(plus_minus: Column, minutes: Column, games: Column, prior_games: float = 20.0) -> Column:
    """Plus-minus for 36 minutes, drawn to 0 by few games; 0 without minutes."""
    return F.coalesce(F.when(minutes > 0, 36 * plus_minus / minutes * games / (games + prior_games)), F.lit(0.0))
