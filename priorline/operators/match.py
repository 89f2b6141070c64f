"""Deterministic matching of two sources: exact, then mutually unique within a tolerance; all else is reported."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def two_tier(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """Classified union of ``left`` (left_id, key, pair, day) and ``right`` (right_id, key, pair, day).

    Tier 1: one row a side for a key match exactly; several on a side are ambiguous, all of them. Tier 2, among what tier
    1 left: rows of one pair within ``tolerance`` days match if each is the other's only candidate; a left row with
    several candidates is ambiguous, any other row unmatched. A null key goes to tier 2. Days are epoch days.

    status: matched, ambiguous, unmatched_left, unmatched_right; tier: exact, near or null; candidates: the ids that an
    ambiguous row could have, in order. Sides are counted by key before they meet, so an n:m key never multiplies.
    """
    one = lambda df, side: df.select(F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), "key", "pair", "day")
    rows = one(left, "left").unionByName(one(right, "right"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("id"))))
    known = rows.where("key is not null").groupBy("key").agg(of("left").alias("ls"), of("right").alias("rs"))
    known = known.where((F.size("ls") > 0) & (F.size("rs") > 0))
    sides = rows.join(known, "key", "left")
    is_left, none = F.col("side") == "left", F.lit(None).cast("long")
    out = lambda status, tier, lid, rid, found: [F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), tier.cast("string").alias("tier"), lid.alias("left_id"), rid.alias("right_id"), found.alias("candidates")]
    # Tier 1: what both sides hold of a key, each row once; a match is written from its left row.
    exact = (F.size("ls") == 1) & (F.size("rs") == 1)
    others = F.array_join(F.when(is_left, F.col("rs")).otherwise(F.col("ls")).cast("array<string>"), ",")
    first = sides.where(F.col("ls").isNotNull() & (is_left | ~exact)).select(*out(
        F.when(exact, "matched").otherwise("ambiguous"), F.lit("exact"), F.when(is_left, F.col("id")), F.when(exact, F.col("rs")[0]).when(~is_left, F.col("id")), F.when(~exact, others),
    ))
    # Tier 2: each right row is sent to the days that it is near, so rows of one pair meet within days, not over all its history.
    open_ = sides.where(F.col("ls").isNull())
    lp = open_.where(is_left).select(F.col("id").alias("left_id"), "pair", F.col("day").alias("ld"))
    rp = open_.where(~is_left).select(F.col("id").alias("right_id"), "pair", "day")
    days = F.explode(F.sequence(F.col("day") - tolerance, F.col("day") + tolerance))
    near = lp.join(rp.select("right_id", "pair", days.alias("ld")), ["pair", "ld"], "left")
    apart = F.when(F.col("right_id").isNull(), F.col("left_id"))  # rows near nothing do not meet
    near = near.withColumn("dr", F.count(F.lit(1)).over(W.partitionBy("right_id", apart)))
    found = F.array_sort(F.collect_list("right_id"))
    own = near.groupBy("left_id").agg(F.count("right_id").alias("dl"), F.max("dr").alias("dr"), found.alias("found"))
    unique, several = (F.col("dl") == 1) & (F.col("dr") == 1), F.col("dl") > 1
    second = own.select(*out(
        F.when(unique, "matched").when(several, "ambiguous").otherwise("unmatched_left"), F.when(unique | several, F.lit("near")),
        F.col("left_id"), F.when(unique, F.col("found")[0]), F.when(several, F.array_join(F.col("found").cast("array<string>"), ",")),
    ))
    taken = own.where(unique).select(F.col("found")[0].alias("right_id"))
    rest = rp.join(taken, "right_id", "left_anti").select(*out("unmatched_right", F.lit(None), none, F.col("right_id"), F.lit(None).cast("string")))
    return first.unionByName(second).unionByName(rest)


@dataclass(frozen=True)
class Tier:
    """One way to know a row: a lookup of unique keys. With ``ends``, a row that has these keys ends here, known or not.

    ``ends`` is the reason such a row gets where the lookup does not know it.
    """

    method: str
    lookup: DataFrame
    keys: list[str]
    ends: str | None = None


@dataclass(frozen=True)
class Stop:
    """Rows that meet the condition and were not decided before end unresolved, for this reason."""

    condition: Column
    reason: str


#: The reason of a row that no tier decides.
UNKNOWN = "unknown"


def registered(entries: DataFrame, keys: list[str], resolved: str, conflicts: str = "fail") -> DataFrame:
    """A lookup from ``entries``: each key once. Equal entries are one; entries without one of the keys are left out.

    A key that several ids claim fails the job when it runs (``fail``), or resolves to none (``none``).
    """
    known = entries.dropna(subset=[*keys, resolved]).groupBy(*keys).agg(F.min(resolved).alias(resolved), F.max(resolved).alias("_other"))
    same = F.col(resolved) == F.col("_other")
    if conflicts == "fail":
        text = F.concat(F.lit("a key is claimed by several ids: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
        same = F.when(same, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return known.where(same).select(*keys, resolved)


def cascade(rows: DataFrame, tiers: list[Tier | Stop], resolved: str) -> DataFrame:
    """``rows`` with the id of the first tier that knows them, its method, and the reason where none does.

    Tiers are asked in turn. A row that has a null among a tier's keys, or that an open tier does not know, goes on to the
    next; one that a closing tier (``ends``) does not know, or that meets a stop, ends there and is not looked up further:
    an identifier that is given but unknown is not overruled by a name. Lookups have unique keys (``registered``).
    """
    out, steps = rows, []
    for i, tier in enumerate(tiers):
        if isinstance(tier, Tier):
            at = [f"_k{i}_{k}" for k in range(len(tier.keys))]
            side = tier.lookup.select(*[F.col(k).alias(n) for k, n in zip(tier.keys, at, strict=True)], F.col(resolved).alias(f"_r{i}"))
            on = [F.col(f"_row.`{k}`") == F.col(n) for k, n in zip(tier.keys, at, strict=True)]
            out = (out if i and "_row" in out.columns else out.select(F.struct("*").alias("_row"))).join(side, on, "left").drop(*at)
        elif "_row" not in out.columns:
            out = out.select(F.struct("*").alias("_row"))
    for i, tier in enumerate(tiers):
        if isinstance(tier, Stop):
            flag = F.coalesce(tier.condition, F.lit(False))
            steps.append((flag, F.lit(None), F.lit(None), F.lit(tier.reason)))
            continue
        known = F.col(f"_r{i}").isNotNull()
        steps.append((known, F.col(f"_r{i}"), F.lit(tier.method), F.lit(None)))
        if tier.ends:
            given = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in tier.keys])
            steps.append((given, F.lit(None), F.lit(None), F.lit(tier.ends)))
    # Conditions speak of the rows' own columns, so those come back before they are read.
    out = out.select("_row.*", *[f"_r{i}" for i, t in enumerate(tiers) if isinstance(t, Tier)])

    def first(k: int, otherwise: Column, kind: str) -> Column:
        value = otherwise
        for step in reversed(steps):
            value = F.when(step[0], step[k].cast(kind)).otherwise(value)
        return value

    kind = next(t.lookup.schema[resolved].dataType.simpleString() for t in tiers if isinstance(t, Tier))
    none = F.lit(None)
    decided = [first(1, none.cast(kind), kind).alias(resolved), first(2, none.cast("string"), "string").alias("method"), first(3, F.lit(UNKNOWN), "string").alias("reason")]
    return out.select(*rows.columns, *decided)


def by_precedence(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One row for each key from several stores; the earlier store wins, and all that had the key are listed."""
    both = None
    for rank, (name, df) in enumerate(sources):
        part = df.withColumn("_rank", F.lit(rank)).withColumn("_source", F.lit(name))
        both = part if both is None else both.unionByName(part)
    w = W.partitionBy(key)
    first = F.row_number().over(w.orderBy("_rank"))
    return both.withColumn("sources", F.array_join(F.array_sort(F.collect_set("_source").over(w)), ",")).withColumn("_n", first).where("_n = 1").drop("_n", "_rank").withColumnRenamed("_source", "source")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that fails, when it runs, where a key occurs twice on either side."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        ok = F.when(n > 1, F.raise_error(F.concat(F.lit(f"{side} key occurs more than once: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
        return df.withColumn("_ok", ok.cast("boolean")).where("_ok").drop("_ok")

    return checked(left, "left").join(checked(right, "right"), keys, how)
