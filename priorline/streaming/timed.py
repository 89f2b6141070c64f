"""Streams with timers: rows wait until the watermark has passed their instant and are then taken in order.

Keys are dealt to a fixed number of lots. A lot appends what comes in a micro-batch to a list, one entry whatever the rows,
with one timer at the earliest instant that waits; when the watermark passes it, all rows that are due are taken together, in
the order of time and whole columns at once, and only what is not due is written again. A key's past is one row of its lot's
table. So the calls to the state store grow with lots and micro-batches, not with keys, instants or rows.

Rows that come after the watermark has passed their instant are refused; ``refused`` counts them. The queries need the
RocksDB state store, which ``run`` sets for their start alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: Lots that keys are dealt to; a checkpoint belongs to one number.
LOTS = 512


class InOrder(StatefulProcessor):
    """Rows (``ts`` seconds, ``keys`` and whatever ``packed`` was given) of a lot's keys in the order of time.

    A subclass gives ``OUT`` (columns after the keys) and ``take``, which gets the rows that are due (of many keys) and the
    table that earlier ones left (None at first) and returns output rows and the table to keep. ``due`` may make a row due
    at several instants.
    """

    OUT: tuple[str, ...] = ()

    def __init__(self, keys: list[str], **fields) -> None:
        self.keys = [*keys, "nulls_"]
        for name, value in fields.items():
            setattr(self, name, value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.next = handle.getValueState("next", "ts long")
        self.state = handle.getValueState("state", "rows binary")

    def due(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows

    def take(self, rows: pd.DataFrame, state: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        raise NotImplementedError

    def _wait(self, earliest: int) -> None:
        """One timer a lot, at the earliest instant that waits."""
        there = self.next.get()[0] if self.next.exists() else None
        if there is not None and there <= earliest:
            return
        if there is not None:
            self.handle.deleteTimer(there * 1000)
        self.handle.registerTimer(earliest * 1000)
        self.next.update((earliest,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = self.due(pd.concat(list(rows), ignore_index=True).drop(columns=["lot_", "at"]))
        if len(new):
            self.waiting.appendValue((_dumped(new),))
            self._wait(int(new["ts"].min()))
        yield pd.DataFrame({c: [] for c in [*self.keys, *self.OUT]}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        held = pd.concat([pickle.loads(rows) for (rows,) in self.waiting.get()], ignore_index=True)
        now = held["ts"] <= passed
        self.waiting.clear()
        self.next.clear()
        if not now.all():
            later = held[~now]
            self.waiting.appendValue((_dumped(later),))
            self._wait(int(later["ts"].min()))
        if now.any():
            out, state = self.take(held[now].reset_index(drop=True), pickle.loads(self.state.get()[0]) if self.state.exists() else None)
            self.state.update((_dumped(state),))
            yield out[[*self.keys, *self.OUT]]

    def close(self) -> None:
        pass


def _dumped(rows: pd.DataFrame) -> bytes:
    return pickle.dumps(rows.reset_index(drop=True), protocol=5)


def _numbered(rows: pd.DataFrame, keys: list[str]) -> pd.Series:
    """A number for each row's key; missing keys are a key of their own."""
    return rows.groupby(keys, sort=False, dropna=False).ngroup()


def _last_there(key: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For rows that lie together by key: the place of the last row at or before each that is ``there``, -1 if none."""
    n = len(key)
    begins = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n), 0)) if n else np.zeros(0, int)
    last = np.maximum.accumulate(np.where(there, np.arange(n), -1)) if n else np.zeros(0, int)
    return np.where(last >= begins, last, -1)


def _at(values: pd.Series, places: np.ndarray) -> np.ndarray:
    """Values at places; None at -1."""
    out = values.to_numpy(object)[places]
    out[places < 0] = None
    return out


def packed(stream: DataFrame, keys: list[str], ts: str, columns: dict[str, F.Column], delay: str) -> DataFrame:
    """A stream's lot, keys, instant and ``columns`` as the rows that a processor takes, behind a watermark.

    Missing keys are told by ``nulls_`` (a bit each) and filled, as whole numbers beside missing ones would become floats.
    """
    nulls = sum((F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0)).cast("long")
    filled = [F.coalesce(F.col(k), F.lit(0).cast(stream.schema[k].dataType)).alias(k) if isinstance(stream.schema[k].dataType, T.IntegralType) else F.col(k) for k in keys]
    lot = F.pmod(F.xxhash64(*keys), F.lit(LOTS)).cast("int").alias("lot_")
    own = stream.select(lot, *filled, nulls.alias("nulls_"), F.timestamp_seconds(ts).alias("at"), F.col(ts).cast("long").alias("ts"), *[c.alias(n) for n, c in columns.items()])
    return own.withWatermark("at", delay)


def _taken(rows: DataFrame, source: DataFrame, kind: type[InOrder], keys: list[str], out: str, **fields) -> DataFrame:
    """What a processor makes of packed rows, with its keys as they were."""
    types = ", ".join([f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys])
    made = rows.groupBy("lot_").transformWithStateInPandas(kind(keys, **fields), f"{types}, nulls_ long, {out}", "Append", "EventTime")
    named = [c for c in made.columns if c not in keys and c != "nulls_"]
    return made.select(*[F.when(F.col("nulls_").bitwiseAND(1 << i) == 0, F.col(k)).alias(k) for i, k in enumerate(keys)], *named)


class _LatestBefore(InOrder):
    """The last observation at or before each anchor; of one instant the largest tie counts."""

    OUT = ("anchor", "anchor_ts", "seen_ts", "seen")

    def take(self, rows, state):
        every = rows if state is None else pd.concat([state, rows], ignore_index=True)
        every["_key"] = _numbered(every, self.keys)
        every = every.sort_values(["_key", "ts", "side", "tie"], kind="stable", na_position="first", ignore_index=True)
        seen = (every["side"] == 0).to_numpy()
        key = every["_key"].to_numpy()
        last = _last_there(key, seen)
        at = np.flatnonzero(~seen)
        out = every.loc[at, [*self.keys]].assign(anchor=every["row"].to_numpy(object)[at], anchor_ts=every["ts"].to_numpy()[at], seen_ts=_at(every["ts"], last[at]), seen=_at(every["row"], last[at]))
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else np.zeros(0, int)
        kept = last[ends]
        return out, every.iloc[kept[kept >= 0]].drop(columns="_key")


def asof_stream(anchors: DataFrame, observations: DataFrame, keys: list[str], anchor_ts: str, seen_ts: str, tie: str, delay: str = "0 seconds") -> DataFrame:
    """A stream of anchors with the latest observation of their key at or before them: two streams, one state.

    Both streams have their watermark, and the older one counts. Observations pass into a key's state in the order of
    time, whatever order and files they came in, and each replaces the one before: past the watermark a key holds one
    observation. An anchor waits until no earlier observation can come; one that none precedes has nulls. An observation
    at the anchor's own instant counts. All other columns of both sides are kept, the observation's as ``seen_*``, with
    ``staleness`` in seconds. Null keys form a key of their own; rows without an instant are left out.
    """
    kept = [c for c in anchors.columns if c not in keys]
    seen = [c for c in observations.columns if c not in keys]
    row = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    none = F.lit(None).cast(observations.schema[tie].dataType)
    left = packed(anchors.where(F.col(anchor_ts).isNotNull()), keys, anchor_ts, {"side": F.lit(1), "tie": none, "row": row(kept)}, delay)
    right = packed(observations.where(F.col(seen_ts).isNotNull()), keys, seen_ts, {"side": F.lit(0), "tie": F.col(tie), "row": row(seen)}, delay)
    out = _taken(left.union(right), anchors, _LatestBefore, keys, "anchor string, anchor_ts long, seen_ts long, seen string")
    types = lambda df, names: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    out = out.select(*keys, "anchor_ts", "seen_ts", F.from_json("anchor", types(anchors, kept)).alias("_a"), F.from_json("seen", types(observations, seen)).alias("_s"))
    return out.select(*keys, *[F.col("_a")[c].alias(c) for c in kept], *[F.col("_s")[c].alias(f"seen_{c}") for c in seen], (F.col("anchor_ts") - F.col("seen_ts")).alias("staleness"))


class _Planner(InOrder):
    """Captures of each contest, each fired once when its time comes; a contest that moves is planned anew.

    Rows: an announcement at its own instant (``before`` -1), and the captures of the start that it gives at theirs. The
    table keeps each contest's start (``before`` -1) and which of its captures have fired.
    """

    OUT = ("before", "capture_ts", "anchor_ts")

    def due(self, rows):
        rows = rows.assign(before=-1)
        parts = [rows]
        for b in self.befores:
            planned = rows[rows["given"] & (rows["starts"] - b >= rows["ts"])] if b > self.anchor else rows[:0]
            parts.append(planned.assign(before=b, ts=planned["starts"] - b))
        return pd.concat(parts, ignore_index=True)

    def take(self, rows, state):
        every = rows.assign(held=False) if state is None else pd.concat([state, rows.assign(held=False)], ignore_index=True)
        every["_key"] = _numbered(every, self.keys)
        # What was held comes first, then by time; of one instant the announcements first, of those the latest start last.
        every["_first"] = ~every["held"]
        every["_plan"] = every["before"] >= 0
        every = every.sort_values(["_key", "_first", "ts", "_plan", "given", "starts"], kind="stable", ignore_index=True)
        key, told = every["_key"].to_numpy(), ~every["_plan"].to_numpy()
        last = _last_there(key, told)
        starts, given = every["starts"].to_numpy(), every["given"].to_numpy()
        held = every["held"].to_numpy()
        fires = held | (~told & (last >= 0) & given[last] & (starts == starts[last]))
        fired = every[fires & ~told].drop_duplicates(["_key", "before"])
        new = fired[~fired["held"].to_numpy()]
        out = new.assign(capture_ts=new["ts"], anchor_ts=new["starts"] - self.anchor)
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
        now = every.iloc[last[ends][last[ends] >= 0]]
        kept = pd.concat([now, fired], ignore_index=True).assign(held=True)
        return out, kept[[*self.keys, "ts", "starts", "given", "before", "held"]]


def due_captures(announcements: DataFrame, key: str, announced: str, starts: str, sources: list[str], befores: list[int], anchor: int, delay: str = "0 seconds") -> DataFrame:
    """key, source, before, capture_ts, anchor_ts of every planned capture, once, when the watermark reaches its time.

    An announcement gives a contest's start; a later one moves or (null) cancels it, and captures of the old start never fire.
    A capture whose time was past when the contest was announced is not made up for, none is planned at or after the anchor
    (``anchor`` seconds before the start), and none fires twice, whatever moves or restarts there are.
    """
    told = {"starts": F.coalesce(F.col(starts), F.lit(0)).cast("long"), "given": F.col(starts).isNotNull()}
    rows = packed(announcements.where(F.col(announced).isNotNull()), [key], announced, told, delay)
    out = _taken(rows, announcements, _Planner, [key], "before long, capture_ts long, anchor_ts long", befores=list(dict.fromkeys(befores)), anchor=anchor)
    source = F.explode(F.array(*map(F.lit, dict.fromkeys(sources)))).alias("source")  # all sources of a time fire together
    return out.select(key, source, "before", "capture_ts", "anchor_ts")


class _Form(InOrder):
    """A side's results before each of its contests."""

    OUT = ("game_id", "ts", "games_played", "win_rate", "mean_margin", "rest_days")

    def take(self, rows, state):
        rows = rows.assign(results=rows["known"].astype("int64"), wins=rows["wins"].astype("int64"), last=rows["ts"], held=False)
        every = rows if state is None else pd.concat([state, rows], ignore_index=True)
        every["_key"] = _numbered(every, self.keys)
        every["_first"] = ~every["held"]
        every = every.sort_values(["_key", "_first", "ts", "game_id"], kind="stable", ignore_index=True)
        key, known = every["_key"].to_numpy(), every["known"].to_numpy(bool)
        sums = every.groupby("_key", sort=False)[["wins", "results", "margin"]].cumsum()
        last = _last_there(key, known)
        begins = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        before = np.where(begins, -1, np.r_[-1, np.arange(len(key) - 1)]) if len(key) else np.zeros(0, int)
        new = ~every["held"].to_numpy(bool)
        before = before[new]
        results, wins, margin = (np.where(before < 0, 0, sums[c].to_numpy()[before]) for c in ("results", "wins", "margin"))
        seen = np.where(before < 0, -1, last[before])
        own, some = every[new], results > 0
        rate = lambda x: np.where(some, x / np.where(some, results, 1), np.nan)
        rest = np.where(seen < 0, np.nan, (own["ts"].to_numpy() - every["last"].to_numpy()[seen]) / 86400)
        out = own[[*self.keys, "game_id", "ts"]].assign(games_played=results, win_rate=rate(wins), mean_margin=rate(margin), rest_days=rest)
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else np.zeros(0, int)
        kept = every.iloc[ends][[*self.keys, "ts", "game_id"]].assign(**{c: sums[c].to_numpy()[ends] for c in ("wins", "results", "margin")})
        return out, kept.assign(last=np.where(last[ends] < 0, 0, every["last"].to_numpy()[last[ends]]), known=last[ends] >= 0, held=True)


def form_stream(sides: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """What each side's form was before each contest; a contest without a result leaves nothing behind."""
    known = F.col("won").isNotNull()
    counted = {"game_id": F.col("game_id"), "known": known, "wins": F.coalesce(F.col("won").cast("int"), F.lit(0)), "margin": F.when(known, F.coalesce(F.col("margin").cast("double"), F.lit(0.0))).otherwise(0.0)}
    rows = packed(sides.where(F.col("ts").isNotNull()), ["season", "team"], "ts", counted, delay)
    out = _taken(rows, sides, _Form, ["season", "team"], "game_id long, ts long, games_played long, win_rate double, mean_margin double, rest_days double")
    return out.select("season", "team", "game_id", "ts", "games_played", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("win_rate", "mean_margin", "rest_days")])


def run(stream: DataFrame, checkpoint: str, sink: str) -> tuple[DataFrame, int]:
    """All there is of a stream, into Parquet, and how many rows were refused as late; goes on from its checkpoint.

    State is parted by the session's shuffle partitions, but into no more parts than the cluster has cores: each is a
    store of its own, opened in every micro-batch, which then writes what has changed and not the store anew.
    """
    spark = stream.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, CHANGES: "true", "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(sink), refused(query)


def refused(query) -> int:
    """Rows that came after the watermark had passed them, over the micro-batches that a query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
