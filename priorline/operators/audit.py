"""Audits: counts, coverage, duplicates, structure and leakage, as tables beside every result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """name, value and n for several columns in one scan; nulls are a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("_p")).select("_p.*").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Share of rows with each metric, for each group, and a verdict."""
    wide = df.groupBy(by).agg(*[F.round(F.avg(F.col(m).isNotNull().cast("double")), 4).alias(m) for m in metrics])
    long = wide.unpivot(by, metrics, "metric", "share")
    return long.withColumn("verdict", F.when(F.col("share") >= 1, "complete").when(F.col("share") > 0, "partial").otherwise("absent"))


def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot("_n", cols, "column_name", "n_null").select("column_name", "n_null", F.round(100 * F.col("n_null") / F.col("_n"), 4).alias("pct_null"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how many rows beyond the first."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


#: Values of a group that may be sorted in one task; parts into which a larger group's range is cut, again and again.
SORTED_VALUES, RANGE_PARTS = 100_000, 4096
#: Most ranges that are sent to every task.
BROADCAST_RANGES = 100_000


def quantiles(df: DataFrame, col: str, at: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation over all rows: q and value."""
    return quantiles_by(df, [], col, at)


def quantiles_by(df: DataFrame, by: list[str], col: str, at: list[float], small: int = SORTED_VALUES, parts: int = RANGE_PARTS) -> DataFrame:
    """Exact quantiles with linear interpolation of each group: its columns, q and value; nulls and NaN are left out.

    A group of at most ``small`` values is sorted in one task. A larger one is never: its range is cut into parts that are
    counted, and only the parts that hold a wanted rank are cut further, until they are small or one value. A round is a
    scan, and what is shuffled are counts. A group without values has no rows.
    """
    group = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(c).alias(g) for c, g in zip(by, group, strict=False)] or [F.lit(0).alias("_g0")]
    rows = df.select(*keys, F.col(col).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*map(F.lit, at))).alias("q")
    most = sizes.agg(F.max("_n")).first()[0]
    named = [F.col(g).alias(c) for c, g in zip(by, group, strict=False)]
    few = rows
    if most is not None and most > small:
        large = sizes.where(F.col("_n") > small)
        few = rows.join(large.select(*group), _same(group, rows, large), "left_anti")
    direct = few.groupBy(*group).agg(F.percentile("_v", F.array(*map(F.lit, at))).alias("_p"))
    direct = direct.select(*named, F.posexplode("_p").alias("_i", "value")).select(*by, F.element_at(F.array(*map(F.lit, at)), F.col("_i") + 1).alias("q"), "value")
    if most is None or most <= small:
        return direct
    place = F.col("q") * (F.col("_n") - 1)
    ranks = large.select(*group, "_n", wanted, "_lo", "_hi").withColumn("_place", place)
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
    ranges = ranks.select(*group, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in")).distinct()
    while True:
        ranges = _held(ranges)
        open_ = ranges.where((F.col("_in") > small) & (F.col("_lo") < F.col("_hi")))
        if open_.isEmpty():
            break
        ranges = _narrowed(rows, group, open_, parts).unionByName(ranges.where((F.col("_in") <= small) | (F.col("_lo") >= F.col("_hi"))))
    one = ranges.where(F.col("_lo") >= F.col("_hi")).select(*group, "_rank", F.col("_lo").alias("_value"))
    left = ranges.where(F.col("_lo") < F.col("_hi"))
    sorted_ = _within(rows, group, left).groupBy(*group, "_rank", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    found = one.unionByName(sorted_.select(*group, "_rank", F.get("_vs", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value")))
    low, high = found.withColumnRenamed("_value", "_a"), found.withColumnRenamed("_value", "_b")
    out = ranks.select(*group, "q", "_place").distinct()
    out = out.join(low, [out[g].eqNullSafe(low[g]) for g in group] + [F.floor(out["_place"]) == low["_rank"]]).select(*[out[g] for g in group], "q", "_place", "_a")
    out = out.join(high, [out[g].eqNullSafe(high[g]) for g in group] + [F.ceil(out["_place"]) == high["_rank"]]).select(*[out[g] for g in group], "q", "_place", "_a", "_b")
    part = F.col("_place") - F.floor("_place")
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * part)
    return direct.unionByName(out.select(*named, "q", value.alias("value")))


def _same(group: list[str], a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[g].eqNullSafe(b[g]) for g in group])


def _held(ranges: DataFrame) -> DataFrame:
    """The ranges, computed once: as rows of the plan while they are few, cached beyond."""
    first = ranges.limit(BROADCAST_RANGES + 1).collect()
    if len(first) <= BROADCAST_RANGES:
        return ranges.sparkSession.createDataFrame(first, ranges.schema)
    return ranges.persist()


def _within(rows: DataFrame, group: list[str], ranges: DataFrame) -> DataFrame:
    """Rows with each range of their group that they are in."""
    small = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    ranges = ranges.select(*[F.col(g).alias(f"{g}_") for g in group], "_rank", "_lo", "_hi", "_below")
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(ranges[f"{g}_"]) for g in group])
    return rows.join(F.broadcast(ranges) if small else ranges, same & F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(rows: DataFrame, group: list[str], ranges: DataFrame, parts: int) -> DataFrame:
    """Each range cut down to the part that holds its rank; a part's ends are values that are there."""
    share = F.nanvl((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.5))  # NaN: an end is infinite
    inner = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts)))
    part = F.when(F.col("_v") == F.col("_hi"), parts).when(F.col("_v") == F.col("_lo"), -1).otherwise(inner)
    counted = _within(rows, group, ranges).groupBy(*group, "_rank", "_below", part.alias("_part"))
    counted = counted.agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = W.partitionBy(*group, "_rank").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
    holds = (F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_in"))
    return counted.where(holds).select(*group, "_rank", "_lo", "_hi", "_below", "_in")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are on one side only; both 0 when the sets are equal."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, keys, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def assert_holds(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing when it runs where the condition does not hold."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def invariants(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: for each check whether it holds on every row, null counting as not."""
    return df.agg(*[F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(name) for name, c in checks.items()])


def examples(df: DataFrame, cls: str, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each class."""
    return df.withColumn("example", F.row_number().over(W.partitionBy(cls).orderBy(*order))).where(F.col("example") <= n)


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Small audit tables as one JSON document: section and its rows, in order of their text."""
    one = [df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.array_sort(F.collect_list("j")).alias("rows")).select(F.lit(name).alias("section"), F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("body")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, one)


def corrected(records: DataFrame, fixes: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """``records`` with declared overrides: ``expects_x`` must be what the record has, ``new_x`` takes its place.

    A null expectation asks nothing, a null new value changes nothing. Guards are checked before anything changes. A
    record that is not as declared fails the job (strict), or keeps its values and is marked ``refused``. Adds source_x
    for each changed column, corrected and refused; home_win follows from corrected scores.
    """
    guards = [c for c in fixes.columns if c.startswith("expects_")]
    changed = [c.removeprefix("new_") for c in fixes.columns if c.startswith("new_")]
    j = records.join(F.broadcast(fixes.withColumn("_declared", F.lit(True))), keys, "left")
    same = reduce(lambda a, b: a & b, [F.col(g).isNull() | F.coalesce(F.col(g.removeprefix("expects_")) == F.col(g), F.lit(False)) for g in guards], F.lit(True))
    declared = F.col("_declared").isNotNull()
    if strict:
        text = F.concat(F.lit("a correction's record is not as declared: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        same = F.when(declared & ~same, F.raise_error(text).cast("boolean")).otherwise(same)
    ok = declared & same
    j = j.withColumn("corrected", ok).withColumn("refused", declared & ~F.col("corrected"))
    now = {x: F.when(F.col("corrected"), F.coalesce(F.col(f"new_{x}"), F.col(x))).otherwise(F.col(x)) for x in changed}
    out = j.select(*[F.col(c).alias(f"source_{c}") for c in changed], *[now.get(c, F.col(c)).alias(c) for c in records.columns], "corrected", "refused")
    if "home_win" in records.columns and "home_score" in changed:
        win = F.when(F.col("home_score") != F.col("away_score"), F.col("home_score") > F.col("away_score"))
        out = out.withColumn("home_win", F.when(F.col("corrected"), win).otherwise(F.col("home_win")))
    return out


#: Part of a day's slots that must be missing for a suspicion.
SUSPECT_MISSING = 0.9


def suspect_days(days: DataFrame, day: str, filled: str, slots: int) -> DataFrame:
    """Every day of the span with its filled slots and missing part; suspect where nearly all is missing between two
    complete days. The first and last day never are: there the archive may just begin or end."""
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    every = span.join(days, day, "left").select(day, F.coalesce(filled, F.lit(0)).cast("long").alias(filled))
    complete = every.where(F.col(filled) == slots).select(day)
    beside = lambda step, name: complete.select((F.col(day) + step).alias(day), F.lit(True).alias(name))
    both = every.join(beside(1, "_before"), day, "left").join(beside(-1, "_after"), day, "left")
    missing = 1 - F.col(filled) / slots
    flag = (missing >= SUSPECT_MISSING) & F.col("_before").isNotNull() & F.col("_after").isNotNull()
    return both.select(day, filled, F.round(missing + 1e-9, 6).alias("missing"), flag.alias("suspect"))


def lookahead(rows: DataFrame) -> DataFrame:
    """Whether side rows with games_played and win_rate can be of what came before alone."""
    w = W.partitionBy("season", "team").orderBy("ts", "game_id")
    rows = rows.withColumn("_before", F.lag("games_played").over(w)).withColumn("_won", F.lag("won").over(w))
    return invariants(rows, {
        "first_has_none": F.col("_before").isNotNull() | ((F.col("games_played") == 0) & F.col("win_rate").isNull()),
        "rate_in_bounds": F.col("win_rate").isNull() | F.col("win_rate").between(0, 1),
        "counts_follow": F.col("_before").isNull() | (F.col("games_played") == F.col("_before") + F.when(F.col("_won").isNull(), 0).otherwise(1)),
    })
