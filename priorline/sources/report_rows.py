"""Tables printed in documents: glyph rows with places become typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLACK = 2.0
#: A report's columns, in order.
COLUMNS = ("game_date", "game_time", "matchup", "team", "player", "status", "reason")


def bucketed(cells: DataFrame, anchors: list[float], names: tuple[str, ...] = COLUMNS) -> DataFrame:
    """file, page, y and one column for each anchor: a cell belongs to the last anchor at most ``SLACK`` right of it.

    Cells of one column are joined from left to right.
    """
    edges = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(n).alias("name")) for a, n in zip(anchors, names, strict=True)])
    column = F.aggregate(edges, F.lit(None).cast("string"), lambda acc, e: F.when(e["x"] <= F.col("x") + SLACK, e["name"]).otherwise(acc))
    placed = cells.withColumn("_c", column).where(F.col("_c").isNotNull())
    parts = placed.groupBy("file", "page", "y", "_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ").alias("text"))
    return parts.groupBy("file", "page", "y").pivot("_c", list(names)).agg(F.first("text"))


#: What a report's header row says above each column, in order.
LABELS = ("Game Date", "Game Time", "Matchup", "Team", "Player Name", "Current Status", "Reason")


def header_rows(cells: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """file, page, y and anchors (where each column begins) of every row that has all labels' words in their order.

    A label may be one cell or several; its column begins at its first word. Other words between labels do not matter.
    """
    words = [(w, i == 0) for label in labels for i, w in enumerate(label.split())]
    expected = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(first).alias("first")) for w, first in words])
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: F.transform(F.split(F.trim(c["text"]), r"\s+"), lambda w: F.struct(c["x"].alias("x"), w.alias("word")))))
    rows = cells.where(F.col("text").isNotNull()).groupBy("file", "page", "y").agg(parts.alias("_words"))

    def step(acc, w):
        want = F.get(expected, acc["k"])
        hit = want["word"] == w["word"]
        anchors = F.when(want["first"], F.concat(acc["anchors"], F.array(w["x"].cast("double")))).otherwise(acc["anchors"])
        return F.when(hit, F.struct((acc["k"] + 1).alias("k"), anchors.alias("anchors"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<double>").alias("anchors"))
    found = rows.withColumn("_h", F.aggregate("_words", start, step)).where(F.col("_h.k") == len(words))
    return found.select("file", "page", "y", F.col("_h.anchors").alias("anchors"))


def by_headers(cells: DataFrame, labels: tuple[str, ...] = LABELS, names: tuple[str, ...] = COLUMNS) -> DataFrame:
    """file, page, y and one column for each label, by the last header row above: pages need not repeat it, columns may shift.

    A cell belongs to the last column that begins at most ``SLACK`` right of it, or to the first. Header rows are no rows,
    nor is anything above a file's first header.
    """
    heads = header_rows(cells, labels)
    order = W.partitionBy("file").orderBy("page", "y").rowsBetween(W.unboundedPreceding, 0)
    rows = cells.select("file", "page", "y").distinct().join(heads, ["file", "page", "y"], "left")
    rows = rows.withColumn("_head", F.col("anchors").isNotNull()).withColumn("anchors", F.last("anchors", ignorenulls=True).over(order))
    placed = cells.join(rows.where(~F.col("_head") & F.col("anchors").isNotNull()).drop("_head"), ["file", "page", "y"])
    column = F.greatest(F.lit(0), F.size(F.filter("anchors", lambda a: a <= F.col("x") + SLACK)) - 1)
    parts = placed.groupBy("file", "page", "y", column.alias("_c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ").alias("text"))
    one = [F.max(F.when(F.col("_c") == i, F.col("text"))).alias(n) for i, n in enumerate(names)]
    return parts.groupBy("file", "page", "y").agg(*one)


def entries(rows: DataFrame) -> DataFrame:
    """Player rows: group columns carried down across pages, wrapped reasons joined, teams without a report marked."""
    order = W.partitionBy("file").orderBy("page", "y").rowsBetween(W.unboundedPreceding, 0)
    carried = rows.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("game_date", "game_time", "matchup", "team")})
    missing = F.upper(F.coalesce("reason", F.lit(""))).contains("NOT YET SUBMITTED")
    starts = F.col("player").isNotNull() | missing
    numbered = carried.withColumn("_e", F.sum(starts.cast("int")).over(order)).where("_e > 0")
    reason = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("page", "y", "reason")))), lambda s: s["reason"]), " ")
    first = lambda c: F.min_by(c, F.struct("page", "y")).alias(c)
    out = numbered.groupBy("file", "_e").agg(*[first(c) for c in ("game_date", "game_time", "matchup", "team", "player", "status")], F.nullif(reason, F.lit("")).alias("reason"))
    tidy = F.regexp_replace(F.regexp_replace("player", r",(?=\S)", ", "), r"-\s+", "-")
    submitted = ~F.upper(F.coalesce("reason", F.lit(""))).contains("NOT YET SUBMITTED")
    return out.select("file", F.col("_e").alias("entry"), "game_date", "game_time", "matchup", "team", tidy.alias("player"), "status", "reason", submitted.alias("submitted"))
