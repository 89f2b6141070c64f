"""Features of what came before: every frame ends one row, or one instant, before the current row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorline.functions import values

SIDE = ["season", "team"]
ORDER = ["ts", "game_id"]


def side_rows(contests: DataFrame) -> DataFrame:
    """Each contest from both sides, in one pass: team, opponent, is_home, won (null without a result), scored, allowed, margin."""
    one = lambda home: F.struct(
        F.col("home" if home else "away").alias("team"), F.col("away" if home else "home").alias("opponent"), F.lit(home).alias("is_home"),
        (F.col("home_win") if home else ~F.col("home_win")).alias("won"),
        F.col("home_score" if home else "away_score").alias("scored"), F.col("away_score" if home else "home_score").alias("allowed"),
    )
    rows = contests.select("game_id", "ts", "season", F.explode(F.array(one(True), one(False))).alias("_s")).select("game_id", "ts", "season", "_s.*")
    return rows.withColumn("margin", F.col("scored") - F.col("allowed"))


def prior(last: int | None = None, by: list[str] | None = None):
    """The frame of earlier rows: all of them, or the ``last`` so many."""
    return W.partitionBy(*(by or SIDE)).orderBy(*ORDER).rowsBetween(W.unboundedPreceding if last is None else -last, -1)


def trailing(seconds: int, by: list[str] | None = None):
    """The frame of instants in [now - seconds, now)."""
    return W.partitionBy(*(by or SIDE)).orderBy("ts").rangeBetween(-seconds, -1)


def settled(x: str | Column) -> Column:
    """A value that counts only where the contest has a result."""
    return F.when(F.col("won").isNotNull(), F.col(x) if isinstance(x, str) else x)


def form(rows: DataFrame, lasts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Games played, win rate, recent win rates and margins, rest and back-to-back before each row.

    A contest without a result has its row but leaves nothing behind: it takes no place among the last so many, adds no
    margin and is no day of play. The recent frames therefore run over how many results came before, not over rows.
    """
    won = F.col("won").cast("double")
    before = F.last(settled("ts"), ignorenulls=True).over(prior())
    rest = values.rest_days(F.col("ts"), before)
    out = rows.select("*", F.count("won").over(prior()).alias("games_played"), F.avg(won).over(prior()).alias("win_rate"), rest.alias("rest_days"), values.back_to_back(rest).alias("back_to_back"))
    for n in lasts:
        recent = W.partitionBy(*SIDE).orderBy("games_played").rangeBetween(-n, -1)
        out = out.withColumns({f"win_rate_{n}": F.avg(won).over(recent), f"margin_{n}": F.avg(settled("margin")).over(recent)})
    return out


def both_sides(features: DataFrame, names: list[str], also: tuple[Column, ...] = ()) -> DataFrame:
    """Side rows back to one row a contest: home_x, away_x and diff_x, null where either side is, and aggregates of both."""
    pick = lambda side, n: F.max(F.when(F.col("is_home") == side, F.col(n)))
    wide = features.groupBy("game_id").agg(*[pick(True, n).alias(f"home_{n}") for n in names], *[pick(False, n).alias(f"away_{n}") for n in names], *also)
    return wide.select("*", *[(F.col(f"home_{n}") - F.col(f"away_{n}")).alias(f"diff_{n}") for n in names])


#: Values whose decayed sums are made by one product.
DECAYED_AT_ONCE = 32


class _Trail:
    """What came before of one value: its count, its sum, its last so many, and its decayed sum."""

    def __init__(self, keep: int, decay: float) -> None:
        self.n, self.total, self.last, self.sum = 0, 0.0, np.zeros(0), 0.0
        self.keep, self.decay = keep, decay

    def means(self, values: np.ndarray, lasts: tuple[int, ...]) -> list[np.ndarray]:
        """The means before each of ``values``, in order, which are then taken in; NaN where none came before."""
        there = ~np.isnan(values)
        x, at = values[there], np.cumsum(there) - there
        n = self.n + np.arange(len(x) + 1)
        some = np.where(n > 0, n, np.nan)
        totals = np.cumsum(np.r_[self.total, x])
        held = np.r_[np.zeros(self.keep), self.last, x]
        begin = self.keep + len(self.last)
        recent = [sliding_window_view(held, k)[begin - k :].sum(axis=1) / np.minimum(some, k) for k in lasts]
        decayed = self._decayed(x)
        weight = n.astype(float) if self.decay == 1 else (1 - self.decay**n) / (1 - self.decay)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = [totals / some, *recent, np.where(n > 0, decayed / weight, np.nan)]
        self.n, self.total, self.sum = int(n[-1]), float(totals[-1]), float(decayed[-1])
        self.last = held[max(self.keep, len(held) - self.keep) :]
        return [m[at] for m in out]

    def _decayed(self, x: np.ndarray) -> np.ndarray:
        """The decayed sum before each of ``x`` and after the last of them."""
        if not np.isfinite(x).all():  # an infinite value is in no product with zeros
            return np.array(list(accumulate(x.tolist(), lambda total, value: total * self.decay + value, initial=self.sum)))
        size = DECAYED_AT_ONCE
        blocks = np.r_[x, np.zeros(-len(x) % size)].reshape(-1, size)
        age = np.arange(size) - np.arange(size)[:, None]
        within = blocks @ np.where(age >= 0, self.decay ** np.maximum(age, 0), 0.0)
        whole = self.decay**size
        into = list(accumulate(within[:, -1].tolist(), lambda total, value: total * whole + value, initial=self.sum))
        sums = within + np.array(into[:-1])[:, None] * self.decay ** np.arange(1, size + 1)
        return np.r_[self.sum, sums.ravel()[: len(x)]]


def _spans(keys: list[pa.Array]) -> list[int]:
    """Where rows of one key begin, of rows that lie together by key, and where the last end."""
    changed = np.zeros(len(keys[0]), bool)
    for k in keys:
        code = pc.fill_null(k.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        changed[1:] |= code[1:] != code[:-1]
    return [0, *np.flatnonzero(changed).tolist(), len(changed)]


def trailing_means(
    rows: DataFrame, cols: dict[str, str], lasts: tuple[int, ...] = (3, 5, 10), half_life: float = 5.0,
    by: list[str] | None = None,
) -> DataFrame:
    """For each of ``cols`` (name -> column) the means of its earlier values: all, the last so many, and decayed.

    Adds name_mean, name_last{n} and name_ewma, where a value weighs half as much as one ``half_life`` values later.
    Nulls are passed over and take no place. One sort a group, one pass in constant memory over whole columns; the row is
    written before its own values are taken in.
    """
    by = by or SIDE
    added = [f"{name}_{kind}" for name in cols for kind in ("mean", *(f"last{n}" for n in lasts), "ewma")]
    own = rows.withColumns({f"_v_{name}": F.col(c).cast("double") for name, c in cols.items()})
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in added)])
    decay, keep, names, held = 0.5 ** (1 / half_life), max(lasts, default=1), schema.names, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trails = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in by]
            cuts = _spans(keys)
            values_ = {name: batch.column(f"_v_{name}").to_numpy(zero_copy_only=False) for name in cols}
            out = np.empty((len(added), batch.num_rows))
            for begin, end in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[begin].as_py() for k in keys)
                if key != now:
                    now, trails = key, {name: _Trail(keep, decay) for name in cols}
                out[:, begin:end] = [m for name, trail in trails.items() for m in trail.means(values_[name][begin:end], lasts)]
            kept = [batch.column(c) for c in held]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, mask=np.isnan(x)) for x in out], names=names)

    return own.repartition(*by).sortWithinPartitions(*by, *ORDER).mapInArrow(run, schema)


#: Days before a row in which results are counted.
LOAD_DAYS = (3, 5, 7, 4, 6)


def load(rows: DataFrame) -> DataFrame:
    """Games with a result in the 3, 5 and 7 days before, and whether this one is the third in 4 or the fourth in 6 days.

    One sort a side and one pass that holds the results of the last seven days: a count is the difference of two places
    among them, so a row costs the same however many results its frames hold. Rows without an instant count each other.
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"_{d}", T.LongType()) for d in LOAD_DAYS)])
    names, held, longest = schema.names, rows.columns, max(LOAD_DAYS) * values.DAY_SECONDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, results = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ts = batch.column("ts").to_numpy(zero_copy_only=False).astype(np.int64)
            there = np.asarray(batch.column("won").is_valid())
            keys = [batch.column(c) for c in SIDE]
            cuts = _spans(keys)
            counts = np.zeros((len(LOAD_DAYS), len(ts)), np.int64)
            for begin, end in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[begin].as_py() for k in keys)
                if key != now:
                    now, results = key, np.zeros(0, np.int64)
                own = ts[begin:end]
                results = np.concatenate([results, own[there[begin:end]]])
                upto = np.searchsorted(results, own, "left")
                for i, days in enumerate(LOAD_DAYS):
                    counts[i, begin:end] = upto - np.searchsorted(results, own - days * values.DAY_SECONDS, "left")
                results = results[np.searchsorted(results, own[-1] - longest, "left") :]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(x) for x in counts], names=names)

    dated = rows.where(F.col("ts").isNotNull()).repartition(*SIDE).sortWithinPartitions(*SIDE, *ORDER).mapInArrow(run, schema)
    undated = rows.where(F.col("ts").isNull()).withColumn("_n", F.count("won").over(W.partitionBy(*SIDE)))
    both = dated.unionByName(undated.select(*held, *[F.col("_n").alias(f"_{d}") for d in LOAD_DAYS]))
    return both.select(*held, *[F.col(f"_{d}").alias(f"games_{d}d") for d in (3, 5, 7)], (F.col("_4") >= 2).alias("third_in_4"), (F.col("_6") >= 3).alias("fourth_in_6"))


def totals_before(rows: DataFrame, by: list[str], span: int, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with each of ``sums`` over the earlier rows of its group, 0 where none, however large the group is.

    Sums of whole spans of ``span`` seconds come first and are cumulated over spans; within a span its own rows are. So
    no task sorts more than one group's span, and what is cumulated over a group is one row a span.
    """
    own = rows.withColumns({f"_{n}": c for n, c in sums.items()}).withColumn("_span", F.floor(F.col("ts") / span))
    earlier = W.partitionBy(*by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    spans = own.groupBy(*by, "_span").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    carried_in = spans.select(*by, "_span", *[zero(F.sum(f"_{n}").over(earlier)).alias(f"_in_{n}") for n in sums])
    within = W.partitionBy(*by, "_span").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    both = own.join(carried_in, [*by, "_span"])
    return both.select(*rows.columns, *[(F.col(f"_in_{n}") + zero(F.sum(f"_{n}").over(within))).alias(n) for n in sums])


def league_mean(rows: DataFrame, x: str, span: int = values.DAY_SECONDS) -> DataFrame:
    """``rows`` with ``league``: the mean of ``x`` over the side rows of contests processed earlier this season.

    The other side of the same contest is not earlier.
    """
    one = rows.groupBy("season", "game_id", "ts").agg(F.sum(settled(x)).alias("_x"), F.count(settled(x)).alias("_n"))
    sums = {"league_sum": F.coalesce("_x", F.lit(0)), "league_n": F.col("_n")}
    before = totals_before(one, ["season"], span, sums)
    mean = before.select("game_id", F.try_divide("league_sum", "league_n").alias("league"))
    return rows.join(mean, "game_id")


def islands(days: DataFrame, key: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: first, last and length of each."""
    w = W.partitionBy(*key).orderBy(day) if key else W.orderBy(day)
    return days.withColumn("_g", F.col(day) - F.row_number().over(w)).groupBy(*key, "_g").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("_g")


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of each key that came first."""
    w = W.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carried(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Columns filled from the last row above that has them."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def continued(df: DataFrame, by: list[str], order: str, is_entry: Column, text: str) -> DataFrame:
    """Entries with the texts of the continuation rows below them joined on; rows above the first entry are dropped."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    numbered = df.withColumn("_e", F.sum(is_entry.cast("int")).over(w)).where("_e > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return numbered.groupBy(*by, "_e").agg(F.min(order).alias(order), F.array_join(parts, " ").alias(text)).withColumnRenamed("_e", "entry")
