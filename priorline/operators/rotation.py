"""How playing time is shared: distributions over players in windows of a side's recorded games."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from priorline.functions.values import DAY_SECONDS

#: Windows as (games back to the first, games back to the last).
WINDOWS = {"recent": (5, 1), "trailing5": (6, 2), "last3": (3, 1), "prior10": (13, 4), "baseline": (10, 4), "recent3": (3, 1)}
ABSENT_FROM = 20.0


def numbered(appearances: DataFrame) -> DataFrame:
    """Appearances with the number of the side's recorded game, in time.

    Games are numbered within a side's day, and its earlier days' games are added, so no task sorts a side's season of
    appearances: what is cumulated over a side is one row a day. The numbers then meet the appearances by game.
    """
    side, day = ["season", "team"], F.coalesce(F.floor(F.col("ts") / DAY_SECONDS), F.lit(-(1 << 62)))  # undated games come first
    games = appearances.select(*side, "ts", "game_id").distinct().withColumn("_day", day)
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*side).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = games.groupBy(*side, "_day").agg(F.count(F.lit(1)).alias("_n")).select(*side, "_day", earlier.alias("_earlier"))
    within = F.row_number().over(W.partitionBy(*side, "_day").orderBy("ts", "game_id"))
    numbers = _beside(games.withColumn("_within", within), days, [*side, "_day"], ["_earlier"])
    numbers = numbers.withColumn("game_no", (F.col("_earlier") + F.col("_within")).cast("int"))
    return _beside(appearances, numbers, [*side, "ts", "game_id"], ["game_no"])


def _beside(left: DataFrame, right: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """``left`` with columns of the one row of ``right`` that has its keys; missing keys are equal."""
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    return left.alias("_l").join(right.alias("_r"), same).select("_l.*", *[f"_r.{c}" for c in more])


def windows_minutes(rows: DataFrame, *windows: str) -> DataFrame:
    """season, team, game_no, player, and for each window w minutes_w and share_w: null where the player was in none of its games.

    Each appearance is sent forward once to the few games that have it in any of the windows; nothing is joined.
    """
    steps = sorted({k for w in windows for k in range(WINDOWS[w][1], WINDOWS[w][0] + 1)})
    ahead = F.explode(F.array(*map(F.lit, steps)))
    sent = rows.select("season", "team", "player", "minutes", "game_no", ahead.alias("_a")).withColumn("game_no", F.col("game_no") + F.col("_a"))
    within = {w: F.col("_a").between(WINDOWS[w][1], WINDOWS[w][0]) for w in windows}
    # Dealt by game once: every group below is within a side's game, and there are many of them.
    sent = sent.repartition("season", "team", "game_no")
    totals = sent.groupBy("season", "team", "game_no", "player").agg(*[F.sum(F.when(c, F.col("minutes"))).alias(f"minutes_{w}") for w, c in within.items()])
    whole = W.partitionBy("season", "team", "game_no")
    shares = {f"share_{w}": F.try_divide(f"minutes_{w}", F.sum(f"minutes_{w}").over(whole)) for w in windows}
    return totals.withColumns(shares)


def window_minutes(rows: DataFrame, window: str) -> DataFrame:
    """season, team, game_no, player, minutes and share in a window before each game, from games of the same side alone."""
    return windows_minutes(rows, window).select("season", "team", "game_no", "player", F.col(f"minutes_{window}").alias("minutes"), F.col(f"share_{window}").alias("share"))


def concentration(shares: DataFrame, top: int = 5) -> DataFrame:
    """Herfindahl index, share of the top players and how many had any."""
    ordered = F.sort_array(F.collect_list("share"), asc=False)
    return shares.groupBy("season", "team", "game_no").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.aggregate(F.slice(ordered, 1, top), F.lit(0.0), lambda a, x: a + x).alias("top_share"), F.count_if(F.col("share") > 0).alias("n_players"))


def overlap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of the smaller share of each player in two windows before each game; absent is zero."""
    zero = lambda w: F.coalesce(f"share_{w}", F.lit(0.0))
    return windows_minutes(rows, a, b).groupBy("season", "team", "game_no").agg(F.sum(F.least(zero(a), zero(b))).alias("overlap"))


def games_in(window: str, game_no: Column) -> Column:
    """How many recorded games are in a side's window before its game of that number; the first games have fewer."""
    first, last = WINDOWS[window]
    return F.greatest(game_no - last - F.greatest(game_no - first, F.lit(1)) + 1, F.lit(0))


def disruption(rows: DataFrame, baseline: str = "baseline", recent: str = "recent3") -> DataFrame:
    """Mean minutes lost against the baseline, regulars absent from the recent window, and the lost part of all.

    Means are for each game that is in the window, not for each appearance and not for the games it could hold.
    """
    both = windows_minutes(rows, baseline, recent).where(F.col(f"minutes_{baseline}") > 0)
    mean = lambda w: F.when(F.col(f"minutes_{w}") > 0, F.col(f"minutes_{w}") / games_in(w, F.col("game_no")))
    both = both.select("season", "team", "game_no", mean(baseline).alias("b"), F.coalesce(mean(recent), F.lit(0.0)).alias("r"))
    lost: Column = F.greatest(F.lit(0.0), F.col("b") - F.col("r"))
    return both.groupBy("season", "team", "game_no").agg(F.sum(lost).alias("minutes_lost"), F.count_if((F.col("b") >= ABSENT_FROM) & (F.col("r") == 0)).alias("absent"), F.try_divide(F.sum(lost), F.sum("b")).alias("lost_ratio"))


#: Stands for a player that is not named: such minutes count in a window's total alone.
NOBODY = -(1 << 62)
SIDE = ["season", "team"]
#: What one span of a side leaves behind, arrays as bytes: see ``_Past``.
PAST = "games long, players binary, sums binary, last binary"


class _Past:
    """What a side's games leave behind: how many there were, its players, their sums, and the last games of a window.

    ``sums`` is (appearances, minutes, known minutes, plus-minus, known plus-minus) x players, ``last`` the first three of
    these x games x players, of as many games as a window reaches back at most.
    """

    def __init__(self, games: int = 0, players: np.ndarray | None = None, sums: np.ndarray | None = None, last: np.ndarray | None = None):
        self.games = games
        self.players = np.zeros(0, np.int64) if players is None else players
        self.sums = np.zeros((5, 0)) if sums is None else sums
        self.last = np.zeros((3, 0, 0)) if last is None else last

    @classmethod
    def read(cls, kept: dict) -> _Past:
        players = np.frombuffer(kept["players"], np.int64)
        games = min(kept["games"], WINDOWS["recent"][0])
        return cls(kept["games"], players, np.frombuffer(kept["sums"]).reshape(5, len(players)), np.frombuffer(kept["last"]).reshape(3, games, len(players)))

    def written(self) -> dict:
        return {"games": self.games, "players": self.players.tobytes(), "sums": self.sums.tobytes(), "last": self.last.tobytes()}

    def over(self, players: np.ndarray) -> _Past:
        """The same over more players."""
        at = np.searchsorted(players, self.players)
        sums, last = np.zeros((5, len(players))), np.zeros((3, self.last.shape[1], len(players)))
        sums[:, at], last[:, :, at] = self.sums, self.last
        return _Past(self.games, players, sums, last)

    def then(self, later: _Past) -> _Past:
        players = np.union1d(self.players, later.players)
        a, b = self.over(players), later.over(players)
        return _Past(a.games + b.games, players, a.sums + b.sums, np.concatenate([a.last, b.last], 1)[:, -WINDOWS["recent"][0] :])


def _games(rows: pa.RecordBatch, game: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Players, and (appearances, minutes, known minutes, plus-minus, known plus-minus) x games x players of rows with their game's place."""
    named = rows.column("player").fill_null(NOBODY).to_numpy(zero_copy_only=False)
    players, at = np.unique(named, return_inverse=True)
    n = int(game[-1]) + 1
    place = game * len(players) + at
    count = lambda weights: np.bincount(place, weights, n * len(players))
    there = np.bincount(place, minlength=n * len(players)) > 0
    cells = [there]
    for c in ("minutes", "plus_minus"):
        x = rows.column(c)
        cells += [count(x.fill_null(0).to_numpy(zero_copy_only=False)), count(np.asarray(x.is_valid())) if x.null_count else there]
    return players, np.array(cells, float).reshape(5, n, len(players))


def _left(players: np.ndarray, cells: np.ndarray) -> _Past:
    return _Past(cells.shape[1], players, cells.sum(1), cells[:3, -WINDOWS["recent"][0] :])


def _strengths(past: _Past, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before each game: whether a named player was in its window, the sum of share times quality, and whether any is known.

    Nobody plays between an appearance that is a player's latest and the game, so a quality is made of all games before.
    """
    first, last = WINDOWS["recent"]
    n, named = cells.shape[1], past.players != NOBODY
    beside = np.concatenate([np.zeros((3, first - past.last.shape[1], len(named))), past.last, cells[:3]], 1)
    there, minutes, known = sum(beside[:, first - a : first - a + n] for a in range(last, first + 1))
    games, played, has_played, plus, has_plus = np.cumsum(np.concatenate([past.sums[:, None], cells[:, :-1]], 1), 1)
    with np.errstate(all="ignore"):
        plays = (has_played > 0) & ~(played <= 0)
        quality = np.where(plays, 36 * plus / played * games / (games + 20.0), 0.0)
        total = minutes.sum(1)[:, None]
        counted = (known > 0) & (~plays | (has_plus > 0)) & (total != 0) & named
        strength = np.where(counted, minutes / total * quality, 0.0).sum(1)
    return ((there > 0) & named).any(1), strength, counted.any(1)


def _spans(batches: Iterator[pa.RecordBatch], seconds: int) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray]]:
    """(season, team, span), rows and their game's place, of rows in order: whole games, cut where a span begins and near a batch's end."""

    def cut(rows: pa.RecordBatch, begins: np.ndarray, season, team, span):
        """Rows up to the last of ``begins``, which are where games begin."""
        lo, hi = begins[:-1], begins[1:]
        fresh = np.zeros(len(lo), bool)
        fresh[:1] = True
        for x in (season, team, span):
            fresh[1:] |= x[lo[1:]] != x[lo[:-1]]
        starts = np.flatnonzero(fresh).tolist()
        for i, j in zip(starts, [*starts[1:], len(lo)], strict=False):
            b, e = int(lo[i]), int(hi[j - 1])
            yield (int(season[b]), int(team[b]), int(span[b])), rows.slice(b, e - b), np.repeat(np.arange(j - i), hi[i:j] - lo[i:j])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        season, team, ts, game = (rows.column(c).to_numpy(zero_copy_only=False) for c in (*SIDE, "ts", "game_id"))
        changed = np.ones(len(ts), bool)
        changed[1:] = (season[1:] != season[:-1]) | (team[1:] != team[:-1]) | (ts[1:] != ts[:-1]) | (game[1:] != game[:-1])
        begins, places = np.flatnonzero(changed), (season, team, ts - ts % seconds)
        yield from cut(rows, begins, *places)
        rest = rows.slice(begins[-1])  # its last game may go on in the next batch
    if rest is not None:
        yield from cut(rest, np.array([0, rest.num_rows]), *(x[begins[-1] :] for x in places))


def strength(stints: DataFrame, seconds: int, tasks: int) -> DataFrame:
    """season, team, game_no, strength: the sum of share times quality over the recent window, before each game of a side.

    Stints (season, team, ts, game_id, player, minutes, plus_minus; several of a player in a game are one appearance)
    are sent once, to the span of ``seconds`` that their side's game falls into. A first pass over the spans tells what each
    leaves behind; cumulated over the side, that is what a second pass over the same shuffle begins a span with.
    """
    order = [*SIDE, "ts", "game_id"]
    rows = stints.where(F.col("season").isNotNull() & F.col("team").isNotNull()).select(*order, F.col("player").cast("long").alias("player"), "minutes", F.col("plus_minus").cast("double").alias("plus_minus"))
    rows = rows.repartition(tasks, *SIDE, F.col("ts") - F.pmod("ts", F.lit(seconds)))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for key, part, game in _spans(batches, seconds):
            if key != now:
                now = key
                out.append(({c: part.column(c)[0].as_py() for c in order}, _Past()))
            out[-1] = (out[-1][0], out[-1][1].then(_left(*_games(part, game))))
        if out:
            yield pa.RecordBatch.from_pylist([first | past.written() for first, past in out], schema=left_schema)

    def cumulate(table: pa.Table) -> pa.Table:
        past, out = _Past(), []
        for span in sorted(table.to_pylist(), key=lambda r: (r["ts"], r["game_id"])):
            out.append({c: span[c] for c in order} | past.written() | {"ends": False})
            past = past.then(_Past.read(span))
        out[-1]["ends"] = True
        return pa.Table.from_pylist(out, schema=pa.schema([*left_schema, ("ends", pa.bool_())]))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, past, ends = None, _Past(), False

        def made(key, past, cells):
            there, value, known = _strengths(past, cells)
            at, n = np.flatnonzero(there), len(there)
            numbers = (past.games + 1 + np.arange(n))[at].astype(np.int32)
            own = [pa.array(np.full(len(at), k, np.int32)) for k in key[:2]]
            return pa.RecordBatch.from_arrays([*own, pa.array(numbers), pa.array(value[at], mask=~known[at])], names=[*SIDE, "game_no", "strength"])

        def behind():
            """A side's last games are in windows of games that are still to come."""
            if ends:
                yield made(now, past, np.zeros((5, WINDOWS["recent"][0], len(past.players))))

        for key, part, game in _spans(batches, seconds):
            if key != now:
                yield from behind()
                first = part.column("past")[0].as_py()
                now, past, ends = key, _Past.read(first), first["ends"]
            players, cells = _games(part, game)
            every = np.union1d(past.players, players)
            past, wide = past.over(every), np.zeros((5, cells.shape[1], len(every)))
            wide[:, :, np.searchsorted(every, players)] = cells
            yield made(key, past, wide)
            past = past.then(_left(every, wide))
        yield from behind()

    binary = [(c, pa.binary()) for c in ("players", "sums", "last")]
    left_schema = pa.schema([*[(c, pa.int32()) for c in SIDE], ("ts", pa.int64()), ("game_id", pa.int64()), ("games", pa.int64()), *binary])
    keys = "season int, team int, ts long, game_id long"
    left = rows.sortWithinPartitions(*order).mapInArrow(leave, f"{keys}, {PAST}")
    before = left.groupBy(*SIDE).applyInArrow(cumulate, f"{keys}, {PAST}, ends boolean")
    before = before.select(*order, F.struct("games", "players", "sums", "last", "ends").alias("past"))
    # Some kilobytes a span, on the rows of the span's first game.
    begun = rows.join(F.broadcast(before), order, "left").sortWithinPartitions(*order)
    return begun.mapInArrow(follow, "season int, team int, game_no int, strength double")
