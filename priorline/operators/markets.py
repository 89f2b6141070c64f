"""Market payloads as typed rows: what a contract is about, from where that is known, and whether sources agree.

Nothing is guessed: a code that resolves to no team, or to several, is null, and so is every flag that would need it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions import values

# The forms of tickers, subtitles, titles and settlement rules.
EVENT_TICKER = r"^([A-Z0-9]+)-(\d{2})([A-Z]{3})(\d{2})([A-Z]{3})([A-Z]{3})$"
MARKET_TICKER = r"^([A-Z0-9]+-\d{2}[A-Z]{3}\d{2}[A-Z]{6})-([A-Z]{3})$"
RULES_DATE = r"(?:originally )?scheduled for ([A-Z][a-z]{2} \d{1,2}, \d{4})"
SUBTITLE = r"^([A-Z]{2,4}) at ([A-Z]{2,4})\b"
TITLE = r"^(?:Game \d+: )?(.+?) at (.+?) Winner\?$"


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the pattern, null where it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def event_ticker(x: Column) -> dict[str, Column]:
    """series, date, away and home of an event's ticker."""
    t = F.upper(F.trim(x))
    month = F.concat(F.substring(part(t, EVENT_TICKER, 3), 1, 1), F.lower(F.substring(part(t, EVENT_TICKER, 3), 2, 2)))
    day = F.concat(F.lit("20"), part(t, EVENT_TICKER, 2), month, part(t, EVENT_TICKER, 4))
    return {
        "series": part(t, EVENT_TICKER, 1), "ticker_date": F.try_to_date(day, "yyyyMMMdd"),
        "ticker_away": part(t, EVENT_TICKER, 5), "ticker_home": part(t, EVENT_TICKER, 6),
    }


def market_ticker(x: Column) -> dict[str, Column]:
    """The event's ticker and the team that a market's ticker names."""
    t = F.upper(F.trim(x))
    return {"ticker_event": part(t, MARKET_TICKER, 1), "team": part(t, MARKET_TICKER, 2)}


def rules_date(x: Column) -> Column:
    """The scheduled day, with its year, in the text of the settlement rules."""
    return F.try_to_date(part(x, RULES_DATE, 1), "MMM d, yyyy")


def title_sides(x: Column) -> tuple[Column, Column]:
    """Away and home of an ``A at B Winner?`` title; ``A vs B`` says nothing of sides."""
    return part(F.trim(x), TITLE, 1), part(F.trim(x), TITLE, 2)


def resolved(rows: DataFrame, aliases: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with the team code of each spelling column (name -> new column); one small broadcast join each."""
    for i, (spelling, code) in enumerate(names.items()):
        known = aliases.where("code is not null").select(F.col("spelling").alias(f"_s{i}"), F.col("code").alias(code))
        rows = rows.join(F.broadcast(known), values.folded(F.col(spelling)) == F.col(f"_s{i}"), "left").drop(f"_s{i}")
    return rows


def normalised(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Markets (ticker, event_ticker, event_sub_title, rules_primary, yes_sub_title) with what they are about.

    Sides come from the event's subtitle, else its ticker; ``codes_agree`` compares the two only where they are two
    opinions. The day comes from the rules, else the ticker. ``team_is_home`` is null for a team of neither side.
    """
    own = raw.withColumns(event_ticker(F.col("event_ticker")) | market_ticker(F.col("ticker")))
    sub = F.trim("event_sub_title")
    own = own.withColumns({"sub_away": part(sub, SUBTITLE, 1), "sub_home": part(sub, SUBTITLE, 2), "rules_date": rules_date(F.col("rules_primary"))})
    spellings = {"sub_away": "_sa", "sub_home": "_sh", "ticker_away": "_ta", "ticker_home": "_th", "team": "team_code", "yes_sub_title": "_yes"}
    own = resolved(own, aliases, spellings)
    by_sub = F.col("_sa").isNotNull() & F.col("_sh").isNotNull()
    by_ticker = F.col("_ta").isNotNull() & F.col("_th").isNotNull()
    pick = lambda a, b: F.when(by_sub, F.col(a)).when(by_ticker, F.col(b)).otherwise(F.col(a))
    own = own.withColumns({
        "away_code": pick("_sa", "_ta"), "home_code": pick("_sh", "_th"),
        "orientation_source": F.when(by_sub, "event_sub_title").when(by_ticker, "event_ticker"),
        "codes_agree": F.when(by_sub & by_ticker, (F.col("_sa") == F.col("_ta")) & (F.col("_sh") == F.col("_th"))),
        "scheduled_date": F.coalesce("rules_date", "ticker_date"),
        "date_source": F.when(F.col("rules_date").isNotNull(), "rules_primary").when(F.col("ticker_date").isNotNull(), "event_ticker"),
        "date_agrees": F.col("rules_date") == F.col("ticker_date"), "team_agrees": F.col("team_code") == F.col("_yes"),
    })
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("team_code", "home_code", "away_code")])
    is_home = F.when(known & (F.col("team_code") == F.col("home_code")), True).when(known & (F.col("team_code") == F.col("away_code")), False)
    is_matchup = known & (F.col("away_code") != F.col("home_code"))
    key = F.when(is_matchup, values.pair_key(F.col("scheduled_date"), F.col("home_code"), F.col("away_code")))
    return own.withColumns({"team_is_home": is_home, "is_matchup": is_matchup, "matchup_key": key}).drop(*[c for c in spellings.values() if c.startswith("_")])


def agreement(matches: DataFrame) -> DataFrame:
    """Matched rows with what both sources say compared: orientation, day and outcome; null where one is silent.

    Needs home_code, away_code, market_home, market_away, day, market_day, home_win and market_home_won.
    """
    same = (F.col("home_code") == F.col("market_home")) & (F.col("away_code") == F.col("market_away"))
    turned = (F.col("home_code") == F.col("market_away")) & (F.col("away_code") == F.col("market_home"))
    won = F.when(turned, ~F.col("market_home_won")).otherwise(F.col("market_home_won"))
    return matches.withColumns({
        "orientation": F.when(same, "same").when(turned, "turned").when(F.col("market_home").isNull() | F.col("market_away").isNull(), "unknown").otherwise("other_teams"),
        "days_apart": F.col("market_day") - F.col("day"), "outcome_agrees": F.col("home_win") == won,
    })
