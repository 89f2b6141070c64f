"""As-of joins: what was known at an instant. Backward, inclusive, with staleness and a reason for every refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Reasons, in the order in which they are decided.
ISSUES = ("no_candles_returned", "no_candle_at_or_before_prediction_ts", "no_bid_or_ask_in_window", "stale_quote", "missing_bid", "missing_ask")


def latest_before(anchors: DataFrame, events: DataFrame, key: str, anchor_ts: str, event_ts: str, payload: dict[str, str], bucket_seconds: int | None = None) -> DataFrame:
    """``anchors`` with, for each name in ``payload``, that struct or column of the latest event at or before the anchor.

    Both sides become one sorted stream for each key (events before anchors at the same instant) and a running last
    value: one shuffle, no row is paired with another. ``payload`` maps an output name to an expression over ``events``
    that is null where the event must be passed over. With ``bucket_seconds`` a hot key is cut into spans of time that
    are sorted apart; each span starts from the last value of the spans before it, joined in as one row.
    """
    names = list(payload)
    right = events.select(F.col(key).alias("_k"), F.col(event_ts).alias("_t"), F.lit(0).alias("_side"), *[F.expr(e).alias(n) for n, e in payload.items()])
    held = F.struct(*[F.col(f"`{c}`") for c in anchors.columns])
    left = anchors.select(F.col(key).alias("_k"), F.col(anchor_ts).alias("_t"), F.lit(1).alias("_side"), held.alias("_row"))
    both = right.unionByName(left, allowMissingColumns=True)
    if bucket_seconds is None:
        w = W.partitionBy("_k").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
        filled = both.select("_side", "_row", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])
    else:
        both = both.withColumn("_b", F.floor(F.col("_t") / bucket_seconds))
        ends = right.withColumn("_b", F.floor(F.col("_t") / bucket_seconds)).groupBy("_k", "_b").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_t"))).alias(n) for n in names])
        over = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        spans = both.select("_k", "_b").distinct()
        carried = spans.join(ends, ["_k", "_b"], "left").select("_k", "_b", *[F.last(n, ignorenulls=True).over(over).alias(n) for n in names])
        start = carried.select("_k", "_b", (F.col("_b") * bucket_seconds - 1).cast("long").alias("_t"), F.lit(-1).alias("_side"), *names)
        w = W.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
        filled = both.unionByName(start, allowMissingColumns=True).select("_side", "_row", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])
    return filled.where("_side = 1").select("_row.*", *names)


def deduplicated(candles: DataFrame, key: str, ts: str, ordinal: str) -> DataFrame:
    """One candle for each instant: the last that came in."""
    w = W.partitionBy(key, ts).orderBy(F.desc(ordinal))
    return candles.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quote_asof(anchors: DataFrame, candles: DataFrame, key: str, anchor_ts: str, max_age: int) -> DataFrame:
    """The newest quoted candle (ts, bid, ask) at or before each anchor, its age, and the issue that makes it unusable.

    The window is filtered before the pick: one-sided candles count as quoted but are not usable; without any quoted
    candle the newest eligible one is reported. An age of exactly ``max_age`` is usable; nothing is filled forward.
    """
    candle = "struct(ts as c_ts, bid, ask)"
    joined = latest_before(anchors, candles, key, anchor_ts, "ts", {"_any": candle, "_quoted": f"case when bid is not null or ask is not null then {candle} end"})
    known = candles.select(key).distinct().withColumn("_known", F.lit(True))
    joined = joined.join(known, key, "left")
    pick = F.coalesce("_quoted", "_any")
    age = F.col(anchor_ts) - pick["c_ts"]
    issue = (
        F.when(F.col("_known").isNull(), ISSUES[0]).when(F.col("_any").isNull(), ISSUES[1]).when(F.col("_quoted").isNull(), ISSUES[2])
        .when(age > max_age, ISSUES[3]).when(pick["bid"].isNull(), ISSUES[4]).when(pick["ask"].isNull(), ISSUES[5])
    )
    return joined.select(*anchors.columns, pick["c_ts"].alias("quote_ts"), pick["bid"].alias("bid"), pick["ask"].alias("ask"), age.alias("age_seconds"), issue.alias("issue"))


def at_offsets(anchors: DataFrame, anchor_ts: str, offsets: list[int]) -> DataFrame:
    """Each anchor once for every offset (seconds before it), as ``offset_seconds`` and ``at_ts``."""
    return anchors.withColumn("offset_seconds", F.explode(F.array(*map(F.lit, offsets)))).withColumn("at_ts", F.col(anchor_ts) - F.col("offset_seconds"))


#: How exactly an observation's instant is known; only the first may decide what was known at an instant.
PRECISIONS = ("exact", "date_only", "unknown")


def latest_state(events: DataFrame, keys: list[str], ts: str, tie: str, until, precision: str | None = None) -> DataFrame:
    """The latest event of each key at or before an instant; among equal instants the largest ``tie``.

    Where a ``precision`` column is named, rows whose instant is not exact are refused: one dated to a day may have come
    after the instant.
    """
    w = W.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    if precision:
        events = events.where(F.col(precision) == PRECISIONS[0])
    return events.where(F.col(ts) <= until).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_batch(events: DataFrame, keys: list[str], ts: str, until) -> DataFrame:
    """All rows of each key's latest instant at or before ``until``: a batch is taken whole."""
    w = W.partitionBy(*keys).orderBy(F.desc(ts))
    return events.where(F.col(ts) <= until).withColumn("_n", F.rank().over(w)).where("_n = 1").drop("_n")
