"""Small fixed dimensions as DataFrames: teams and their spellings, seasons, corrections, status words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Franchise id, code, city, nickname.
TEAMS = (
    (1, "ATL", "Atlanta", "Hawks"), (2, "BOS", "Boston", "Celtics"), (3, "BKN", "Brooklyn", "Nets"), (4, "CHA", "Charlotte", "Hornets"),
    (5, "CHI", "Chicago", "Bulls"), (6, "CLE", "Cleveland", "Cavaliers"), (7, "DAL", "Dallas", "Mavericks"), (8, "DEN", "Denver", "Nuggets"),
    (9, "DET", "Detroit", "Pistons"), (10, "GSW", "Golden State", "Warriors"), (11, "HOU", "Houston", "Rockets"), (12, "IND", "Indiana", "Pacers"),
    (13, "LAC", "Los Angeles", "Clippers"), (14, "LAL", "Los Angeles", "Lakers"), (15, "MEM", "Memphis", "Grizzlies"), (16, "MIA", "Miami", "Heat"),
    (17, "MIL", "Milwaukee", "Bucks"), (18, "MIN", "Minnesota", "Timberwolves"), (19, "NOP", "New Orleans", "Pelicans"), (20, "NYK", "New York", "Knicks"),
    (21, "OKC", "Oklahoma City", "Thunder"), (22, "ORL", "Orlando", "Magic"), (23, "PHI", "Philadelphia", "76ers"), (24, "PHX", "Phoenix", "Suns"),
    (25, "POR", "Portland", "Trail Blazers"), (26, "SAC", "Sacramento", "Kings"), (27, "SAS", "San Antonio", "Spurs"), (28, "TOR", "Toronto", "Raptors"),
    (29, "UTA", "Utah", "Jazz"), (30, "WAS", "Washington", "Wizards"),
)

# Further exact spellings.
SPELLINGS = {
    "brk": "BKN", "bro": "BKN", "njn": "BKN", "cho": "CHA", "gs": "GSW", "no": "NOP", "noh": "NOP", "nor": "NOP", "ny": "NYK",
    "phe": "PHX", "pho": "PHX", "sa": "SAS", "san": "SAS", "wsh": "WAS", "los angeles l": "LAL", "los angeles c": "LAC", "la l": "LAL", "la c": "LAC",
    "new york k": "NYK", "la lakers": "LAL", "la clippers": "LAC", "sixers": "PHI", "philadelphia sixers": "PHI", "blazers": "POR", "trailblazers": "POR",
    "portland trailblazers": "POR", "wolves": "MIN", "cavs": "CLE", "mavs": "DAL",
}

# Spellings of more than one team.
AMBIGUOUS = ("la", "los angeles", "losangeles")

# Season, structure, first and last regular day, games, games for each team, play-in days, first playoff day, cup final day.
SEASONS = (
    (2006, "standard", "2006-10-31", "2007-04-18", 1230, 82, None, None, "2007-04-21", None),
    (2007, "standard", "2007-10-30", "2008-04-16", 1230, 82, None, None, "2008-04-19", None),
    (2008, "standard", "2008-10-28", "2009-04-15", 1230, 82, None, None, "2009-04-18", None),
    (2009, "standard", "2009-10-27", "2010-04-14", 1230, 82, None, None, "2010-04-17", None),
    (2010, "standard", "2010-10-26", "2011-04-13", 1230, 82, None, None, "2011-04-16", None),
    (2011, "shortened", "2011-12-25", "2012-04-26", 990, 66, None, None, "2012-04-28", None),
    (2012, "interrupted", "2012-10-30", "2013-04-17", 1229, 82, None, None, "2013-04-20", None),
    (2013, "standard", "2013-10-29", "2014-04-16", 1230, 82, None, None, "2014-04-19", None),
    (2014, "standard", "2014-10-28", "2015-04-15", 1230, 82, None, None, "2015-04-18", None),
    (2015, "standard", "2015-10-27", "2016-04-13", 1230, 82, None, None, "2016-04-16", None),
    (2016, "standard", "2016-10-25", "2017-04-12", 1230, 82, None, None, "2017-04-15", None),
    (2017, "standard", "2017-10-17", "2018-04-11", 1230, 82, None, None, "2018-04-14", None),
    (2018, "standard", "2018-10-16", "2019-04-10", 1230, 82, None, None, "2019-04-13", None),
    (2019, "interrupted", "2019-10-22", "2020-08-14", None, None, "2020-08-15", "2020-08-16", "2020-08-17", None),
    (2020, "shortened", "2020-12-22", "2021-05-16", 1080, 72, "2021-05-18", "2021-05-21", "2021-05-22", None),
    (2021, "standard", "2021-10-19", "2022-04-10", 1230, 82, "2022-04-12", "2022-04-15", "2022-04-16", None),
    (2022, "standard", "2022-10-18", "2023-04-09", 1230, 82, "2023-04-11", "2023-04-14", "2023-04-15", None),
    (2023, "standard", "2023-10-24", "2024-04-14", 1230, 82, "2024-04-16", "2024-04-19", "2024-04-20", "2023-12-09"),
    (2024, "standard", "2024-10-22", "2025-04-13", 1230, 82, "2025-04-15", "2025-04-18", "2025-04-19", "2024-12-17"),
    (2025, "standard", "2025-10-21", "2026-04-12", 1230, 82, "2026-04-14", "2026-04-17", "2026-04-18", "2025-12-16"),
)

# Teams that played another number of games.
GAME_COUNT_EXCEPTIONS = ((2012, "BOS", 81), (2012, "IND", 81))

# Game id, day, away, home, source scores, corrected tipoff or scores.
CORRECTIONS = (
    (23784, "2009-01-22", "BOS", "ORL", 90, 80, "2009-01-23T01:00Z", None, None),
    (21849, "2009-01-22", "WAS", "LAL", 97, 117, "2009-01-23T03:30Z", None, None),
    (857686, "2022-12-02", "WAS", "CHA", 116, 117, "2022-12-03T00:00Z", None, None),
    (857681, "2022-12-02", "DEN", "ATL", 109, 117, "2022-12-03T00:30Z", None, None),
    (857680, "2022-12-02", "MIA", "BOS", 120, 116, "2022-12-03T00:30Z", None, None),
    (857685, "2022-12-02", "TOR", "BKN", 105, 114, "2022-12-03T00:30Z", None, None),
    (857689, "2022-12-02", "ORL", "CLE", 96, 107, "2022-12-03T00:30Z", None, None),
    (857683, "2022-12-02", "LAL", "MIL", 133, 129, "2022-12-03T00:30Z", None, None),
    (857688, "2022-12-02", "PHI", "MEM", 109, 117, "2022-12-03T01:00Z", None, None),
    (857684, "2022-12-02", "NOP", "SAS", 117, 99, "2022-12-03T01:00Z", None, None),
    (857682, "2022-12-02", "HOU", "PHX", 122, 121, "2022-12-03T02:00Z", None, None),
    (857687, "2022-12-02", "IND", "UTA", 119, 139, "2022-12-03T02:00Z", None, None),
    (857690, "2022-12-02", "CHI", "GSW", 111, 119, "2022-12-03T03:00Z", None, None),
    (28012, "2012-03-25", "UTA", "ATL", 123, 123, None, 133, 139),
    (32587, "2015-12-18", "DET", "CHI", 127, 127, None, 147, 144),
    (34714, "2017-01-29", "NYK", "ATL", 130, 130, None, 139, 142),
    (48851, "2019-03-01", "CHI", "ATL", 155, 155, None, 168, 161),
)

# Status phrases.
STATUSES = {
    "available": "available", "active": "available", "probable": "probable", "questionable": "questionable", "doubtful": "doubtful",
    "out": "out", "out for season": "out", "out indefinitely": "out", "inactive": "out", "day to day": "questionable", "day-to-day": "questionable",
    "unknown": "unknown", "not yet submitted": "unknown",
}


def folded(name: str) -> str:
    return " ".join(name.lower().replace(".", "").replace("'", "").split())


def alias_table() -> dict[str, str | None]:
    """Every exact spelling -> code; None for those that more than one team goes by."""
    found: dict[str, str | None] = {}
    for _, code, city, nickname in TEAMS:
        for name in (code, city, nickname, f"{city} {nickname}"):
            key = folded(name)
            found[key] = code if found.get(key, code) == code else None
    return found | SPELLINGS | dict.fromkeys(AMBIGUOUS)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(alias_table().items()), "spelling string, code string")


def teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEAMS, "franchise_id int, code string, city string, nickname string")


def seasons(spark: SparkSession) -> DataFrame:
    kinds = "season int, structure string, first_day string, last_day string, expected_games int, expected_each int, play_in_first string, play_in_last string, playoffs_first string, cup_final string"
    return spark.createDataFrame(SEASONS, kinds)


def corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORRECTIONS, "game_id long, date string, away string, home string, away_score int, home_score int, tipoff string, new_away int, new_home int")


def correction_guards(spark: SparkSession) -> DataFrame:
    """The corrections as what a record must be (expects_) and what it becomes (new_)."""
    names = {
        "date": "expects_date", "home": "expects_home", "away": "expects_away", "home_score": "expects_home_score",
        "away_score": "expects_away_score", "tipoff": "new_tipoff", "new_home": "new_home_score", "new_away": "new_away_score",
    }
    return corrections(spark).withColumnsRenamed(names)


def statuses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUSES.items()), "phrase string, status string")
