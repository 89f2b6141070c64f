"""State that no window frame can express: ratings that feed on themselves.

Contests stream past in order, packed into spans that other tasks have sorted; what is held is one number a side (and
configuration), never the contests. Groups (sets of configurations, seasons) run apart. A contest's row is written before its own result changes
anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.functions.rating import NORMALISERS

#: Every side starts from here, and ratings are drawn to here between seasons.
START = 1500.0
#: Rounds of the adjusted-margin iteration, from zero: fixed, as it need not converge on sparse graphs.
ROUNDS, LEAST_GAMES = 25, 3
#: Configurations rated side by side in one pass over the contests.
SIDE_BY_SIDE = 64
#: Up to so many configurations are rated apart, a task each: plain floats take a tenth of a vector's time.
APART = 16
#: Forecasts are kept this far from 0 and 1 where their logarithm is taken.
LEAST = 1e-15
#: Contests whose states are solved at once.
SOLVED_AT_ONCE = 256
#: Numbers that the states solved at once may hold; leagues of very many sides take fewer at a time.
MOST_NUMBERS = 8 << 20


@dataclass(frozen=True)
class EloConfig:
    """k: points at stake; advantage: home points; kept: share of its distance from START that a rating keeps between
    seasons; first_season: None for all; margin: None, "sqrt", "log" or "fivethirtyeight"; only: the seasons whose
    contests are written, all if None."""

    k: float = 20.0
    advantage: float = 40.0
    kept: float = 0.5
    first_season: int | None = None
    margin: str | None = None
    only: tuple[int, ...] | None = None


class Ratings:
    """One rating a side for each configuration: plain floats for one, vectors for many."""

    def __init__(self, configs: list[EloConfig]) -> None:
        self.configs, self.one = configs, len(configs) == 1
        each = lambda f: float(f(configs[0])) if self.one else np.array([f(c) for c in configs], float)
        self.k, self.advantage, self.kept = each(lambda c: c.k), each(lambda c: c.advantage), each(lambda c: c.kept)
        self.first = each(lambda c: -math.inf if c.first_season is None else c.first_season)
        weigh = lambda kind: each(lambda c: 1 / NORMALISERS[kind] if c.margin == kind else 0.0)
        self.plain = each(lambda c: c.margin is None)
        self.root, self.log, self.drawn = weigh("sqrt"), weigh("log"), weigh("fivethirtyeight")
        self.by_margin = any(c.margin for c in configs)
        self.start = START if self.one else np.full(len(configs), START)
        self.held: dict = {}
        self.season: int | None = None

    def _stake(self, margin: float, lead):
        """How many points a result moves, before surprise."""
        size = abs(margin)
        by_log = math.log1p(size)
        return self.k * (self.plain + self.root * math.sqrt(size) + by_log * (self.log + self.drawn * 2.2 / (0.001 * lead + 2.2)))

    def before(self, season, home, away, margin, won) -> np.ndarray:
        """Ratings of both sides and home's chance before each contest, in order (contests x 3 x configurations).

        ``won`` is 1, 0, or -1 without a result; a result is taken in after its contest's figures are made.
        """
        out = np.empty((len(season), 3, len(self.configs)))
        cuts = np.flatnonzero(np.r_[True, season[1:] != season[:-1]]).tolist() + [len(season)] if len(season) else []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            now = int(season[begin])
            if self.season is not None and now > self.season:
                part = self.kept ** (now - self.season)
                self.held = {side: START + part * (r - START) for side, r in self.held.items()}
            self.season = now
            for side in set(home[begin:end].tolist()) | set(away[begin:end].tolist()):
                self.held.setdefault(side, self.start if self.one else self.start.copy())
            span = (x[begin:end].tolist() for x in (home, away, margin, won))
            (self._one if self.one else self._many)(out[begin:end], self.first <= now, *span)
        return out

    def _one(self, out, counts, home, away, margin, won) -> None:
        held, advantage, k, by_margin, made = self.held, self.advantage, self.k, self.by_margin, []
        for h_, a_, m, w in zip(home, away, margin, won, strict=True):
            h, a = held[h_], held[a_]
            ahead = h + advantage - a
            chance = 1 / (1 + 10.0 ** (-ahead / 400))
            made.append((h, a, chance))
            if counts and w >= 0:
                step = (self._stake(m, ahead if w else -ahead) if by_margin else k) * (w - chance)
                held[h_], held[a_] = h + step, a - step
        out[:, :, 0] = made

    def _many(self, out, counts, home, away, margin, won) -> None:
        held, advantage, k, by_margin = self.held, self.advantage, self.k * counts, self.by_margin
        ahead, step, scale = np.empty_like(advantage), np.empty_like(advantage), -math.log(10) / 400
        for i, (h_, a_, m, w) in enumerate(zip(home, away, margin, won, strict=True)):
            h, a, row = held[h_], held[a_], out[i]
            row[0], row[1], chance = h, a, row[2]
            np.subtract(h, a, ahead)
            np.add(ahead, advantage, ahead)
            np.multiply(ahead, scale, step)
            np.exp(step, chance)
            np.add(chance, 1.0, chance)
            np.reciprocal(chance, chance)
            if w >= 0:
                np.subtract(float(w), chance, step)
                np.multiply(step, self._stake(m, ahead if w else -ahead) * counts if by_margin else k, step)
                if h_ == a_:  # the later of two writes to one side counts
                    held[a_] = a - step
                else:
                    np.add(h, step, h)
                    np.subtract(a, step, a)


COLUMNS = ("game_id", "ts", "season", "home", "away", "home_score", "away_score", "home_win")
RATED = (
    "config_id int, game_id long, season int, home int, away int, home_rating double, away_rating double, "
    "home_probability double"
)


#: Contests of one packed row.
PACKED = 16_384
#: How a packed contest lies in memory.
RECORD = {"game_id": "i8", "season": "i4", "home": "i4", "away": "i4", "margin": "f8", "won": "i1"}
#: Stands for a side that is not named.
NOBODY = -(1 << 31)


def _packed(contests: DataFrame) -> DataFrame:
    """``at`` (a place in time) and ``rows``: spans of contests in order, PACKED at most to a row.

    Contests are sorted in as many tasks as there are partitions; an ordered pass then meets some thousands of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PACKED):
                part = batch.slice(begin, PACKED)
                own = b"".join(part.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes() for c, kind in RECORD.items())
                rows = part.num_rows.to_bytes(8, "little") + pa.compress(own, "lz4", asbytes=True)
                yield pa.RecordBatch.from_arrays([part.column("ts")[:1], part.column("game_id")[:1], pa.array([rows], pa.binary())], names=["ts", "game_id", "rows"])

    margin = (F.coalesce("home_score", F.lit(0)) - F.coalesce("away_score", F.lit(0))).cast("double").alias("margin")
    won = F.coalesce(F.col("home_win").cast("int"), F.lit(-1)).alias("won")
    sides = [F.coalesce(c, F.lit(NOBODY)).cast("int").alias(c) for c in ("home", "away")]
    own = contests.select("ts", "game_id", "season", *sides, margin, won)
    return own.repartitionByRange("ts", "game_id").sortWithinPartitions("ts", "game_id").mapInArrow(run, "ts long, game_id long, rows binary")


def _unpacked(packed: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    held, at, out = pa.decompress(packed[8:], n * sum(np.dtype(k).itemsize for k in RECORD.values()), "lz4", asbytes=True), 0, {}
    for c, kind in RECORD.items():
        out[c] = np.frombuffer(held, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _rated(contests: DataFrame, configs: list[EloConfig], made, schema: str) -> DataFrame:
    """What ``made(before, configs, rows, values)`` gives of each packed span, over one ordered pass a set of configurations,
    which ``before`` others precede."""
    size = 1 if len(configs) <= APART else SIDE_BY_SIDE
    sets = [configs[i : i + size] for i in range(0, len(configs), size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rated = None
        for batch in batches:
            for which, packed in zip(batch.column("_set").to_pylist(), batch.column("rows"), strict=True):
                if rated is None:
                    rated = Ratings(sets[which])
                rows = _unpacked(packed.as_py())
                for begin in range(0, len(rows["won"]), 2048):  # bounded whatever the configurations are
                    part = {c: x[begin : begin + 2048] for c, x in rows.items()}
                    yield from made(which * size, sets[which], part, rated.before(*(part[c] for c in list(RECORD)[1:])))

    dealt = _packed(contests).select(F.explode(F.array(*map(F.lit, range(len(sets))))).alias("_set"), "ts", "game_id", "rows")
    # One set a partition: by hash two of them might share one and wait for each other.
    ordered = dealt.repartitionById(len(sets), F.col("_set")).sortWithinPartitions("ts", "game_id").select("_set", "rows")
    return ordered.mapInArrow(run, schema)


def _wanted(of: list[EloConfig], season: np.ndarray) -> np.ndarray:
    """Which configurations (columns) write which contests (rows)."""
    return np.column_stack([np.ones(len(season), bool) if c.only is None else np.isin(season, c.only) for c in of])


def elo(contests: DataFrame, configs: list[EloConfig]) -> DataFrame:
    """Ratings before every contest for each configuration; null before a configuration's first season.

    Where all configurations name the seasons they are wanted for, contests of other seasons only feed the ratings. Up to APART configurations have a task each; of more, SIDE_BY_SIDE share one ordered pass.
    """
    names = [f.split()[0] for f in RATED.split(", ")]

    def made(before, of, rows, values):
        config, at = np.nonzero(_wanted(of, rows["season"]).T)
        if not len(at):
            return
        own = {c: x[at] for c, x in rows.items()}
        first = np.array([-math.inf if c.first_season is None else c.first_season for c in of])[config]
        early = own["season"] < first
        yield pa.RecordBatch.from_arrays(
            [pa.array((config + before).astype(np.int32)), *(pa.array(own[c], mask=own[c] == NOBODY) for c in ("game_id", "season", "home", "away"))]
            + [pa.array(values[at, k, config], mask=early) for k in range(3)],
            names=names,
        )

    return _rated(contests, configs, made, RATED)


def elo_losses(contests: DataFrame, configs: list[EloConfig]) -> DataFrame:
    """config_id, season, n, brier and log_loss (sums) of each configuration's forecasts of contests with a result.

    The pass that rates adds the losses up, so contests x configurations are never rows. A season before a
    configuration's first has none.
    """

    def made(before, of, rows, values):
        known = rows["won"] >= 0
        for season in np.unique(rows["season"][known]):
            on = known & (rows["season"] == season)
            which_ = np.flatnonzero([(c.only is None or season in c.only) and (c.first_season is None or season >= c.first_season) for c in of])
            if not len(which_):
                continue
            p, y = values[on, 2][:, which_], rows["won"][on][:, None]
            q = np.clip(np.where(y, p, 1 - p), LEAST, None)
            sums = [((p - y) ** 2).sum(axis=0), -np.log(np.minimum(q, 1 - LEAST)).sum(axis=0)]
            columns = [pa.array((which_ + before).astype(np.int32)), pa.array(np.full(len(which_), season, np.int32)), pa.array(np.full(len(which_), on.sum(), np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in sums], names=["config_id", "season", "n", "brier", "log_loss"])

    parts = _rated(contests, configs, made, "config_id int, season int, n long, brier double, log_loss double")
    return parts.groupBy("config_id", "season").agg(*[F.sum(c).alias(c) for c in ("n", "brier", "log_loss")])


class Margins:
    """What a season's contests so far say of its sides: margins, games, and who met whom."""

    def __init__(self) -> None:
        self.index: dict = {}
        self.met, self.margin, self.played = np.zeros((0, 0)), np.zeros(0), np.zeros(0)

    def _grow(self, sides: list) -> None:
        for side in sides:
            self.index.setdefault(side, len(self.index))
        more = len(self.index) - len(self.played)
        if more:
            self.met = np.pad(self.met, (0, more))
            self.margin, self.played = np.pad(self.margin, (0, more)), np.pad(self.played, (0, more))

    def before(self, home: list, away: list, diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adjusted margins of both sides before each contest, in order; a result that is NaN counts for nothing.

        All states at once: running totals are cumulated over the contests, and the rounds run on every state together.
        """
        self._grow([*home, *away])
        h, a = (np.array([self.index[s] for s in x]) for x in (home, away))
        n, k = len(h), len(self.played)
        at, counts = np.arange(n), np.isfinite(diff)
        margin, played, met = np.zeros((n + 1, k)), np.zeros((n + 1, k)), np.zeros((n + 1, k, k))
        margin[0], played[0], met[0] = self.margin, self.played, self.met
        value, one = np.where(counts, diff, 0.0), counts.astype(float)
        np.add.at(margin, (at + 1, h), value)
        np.add.at(margin, (at + 1, a), -value)
        for x, y in ((h, a), (a, h)):
            np.add.at(played, (at + 1, x), one)
            np.add.at(met, (at + 1, x, y), one)
        for total in (margin, played, met):
            np.cumsum(total, axis=0, out=total)
        self.margin, self.played, self.met = margin[n].copy(), played[n].copy(), met[n].copy()
        seen = played[:n] > 0
        games, sides = np.where(seen, played[:n], 1.0), np.maximum(seen.sum(axis=1, keepdims=True), 1)
        share, mean = met[:n] / games[:, :, None], margin[:n] / games
        level = np.zeros((n, k))
        for _ in range(ROUNDS):
            level = np.where(seen, mean + (share @ level[:, :, None])[:, :, 0], 0.0)
            level = np.where(seen, level - level.sum(axis=1, keepdims=True) / sides, 0.0)
        enough = lambda x: np.where(played[at, x] >= LEAST_GAMES, level[at, x], np.nan)
        return enough(h), enough(a)


def srs(contests: DataFrame) -> DataFrame:
    """Adjusted margins before every contest; null for a side of fewer than LEAST_GAMES games. Seasons run apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            season = batch.column("season").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, season[1:] != season[:-1]]).tolist() + [len(season)] if len(season) else []
            made: list[tuple[np.ndarray, np.ndarray]] = []
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if season[begin] != now:
                    now, state = season[begin], Margins()
                step = max(1, min(SOLVED_AT_ONCE, MOST_NUMBERS // max(1, len(state.played)) ** 2))
                for first in range(begin, end, step):
                    part = batch.slice(first, min(step, end - first))
                    scores = [part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("home_score", "away_score")]
                    sides = [part.column(c).to_pylist() for c in ("home", "away")]
                    made.append(state.before(*sides, scores[0] - scores[1]))
            if made:
                both = [np.concatenate(x) for x in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("game_id"), batch.column("season")]
                    + [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in both],
                    names=["game_id", "season", "home_srs", "away_srs"],
                )

    ordered = contests.select(*COLUMNS).repartition("season").sortWithinPartitions("season", "ts", "game_id")
    return ordered.mapInArrow(run, "game_id long, season int, home_srs double, away_srs double")
