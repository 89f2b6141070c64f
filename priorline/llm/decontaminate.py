"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's set is its distinct runs of five words (lower case, letters and digits). Its sketch is a bottom-k MinHash: its
k smallest hashes under one permutation. An item of n shingles that is contained to ``MIN_CONTAINED`` percent may lack
at most n - need of them, so with k = n - need + 1 at least one hash of the sketch is the document's too, and the search
loses nothing. Items are partitioned by size, in powers of two. Sketches of long items lie low among the hashes, those
of short ones anywhere, so each partition has its own ceiling, its sketches' largest hash, and its own least need. A
document is looked up in those partitions alone that it is long enough for, with its hashes up to the highest of their
ceilings: a document's part of the hashes below the ceiling is its own sketch, as long as the partition needs, where
minima of equal length next to a short item's would almost never agree. Every candidate is verified on the shingles'
own text.

Sketches are broadcast while they are below ``BROADCAST_ROWS`` rows and candidates likewise, after a count; beyond that
both are joined by shuffle. Items of fewer than five words have no shingle and match nothing, as do null or empty texts.
A row is known by a hash of its id and text, so equal and null ids do not mix; equal rows give one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import durable, id_text, rows_of
from priorline.llm.native import let, windows

SHINGLE = 5
MIN_CONTAINED = 80
BROADCAST_ROWS = 1_000_000
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    return let(F.transform(tokens(text), lambda t: F.xxhash64(t)), lambda h: windows(h, SHINGLE))


def shingles(text: Column) -> Column:
    """Distinct shingles as text."""
    return let(
        tokens(text),
        lambda t: F.array_distinct(
            F.when(F.size(t) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(t) - SHINGLE), lambda i: F.array_join(F.slice(t, i + 1, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))
        ),
    )


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, shingles, n, need (fewest that make a match) and size_class for every item with a shingle."""
    own = benchmark.select("item_id", shingles(F.coalesce("text", F.lit(""))).alias("shingles")).withColumn("n", F.size("shingles")).where("n > 0")
    need = F.ceil(F.col("n") * MIN_CONTAINED / 100.0 - 1e-9).cast("int")
    return own.withColumn("need", need).withColumn("size_class", F.floor(F.log2("n")).cast("int"))


def sketches(items: DataFrame) -> DataFrame:
    """hash, item_id and need: each item's n - need + 1 smallest shingle hashes."""
    hashed = F.sort_array(F.array_distinct(F.transform("shingles", lambda s: let(F.transform(F.split(s, " "), lambda t: F.xxhash64(t)), lambda h: F.xxhash64(*[F.get(h, F.lit(k)) for k in range(SHINGLE)])))))
    return items.select("item_id", "need", "size_class", F.explode(F.slice(hashed, 1, F.col("n") - F.col("need") + 1)).alias("hash"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where a count shows that it is small."""
    return F.broadcast(df) if rows_of(df) <= rows else df


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))


def ceiling_of(n_doc: Column, parts: list) -> Column:
    """The highest ceiling among the partitions that a document of so many shingles is long enough for; null if none."""
    own = [F.when(n_doc >= p["least"], F.lit(p["ceiling"])) for p in parts]
    return F.array_max(F.array(*own, F.lit(None).cast("long")))


def under_ceiling(hashes: Column, parts: list) -> Column:
    """n_doc, how many hashes there are, and those of them up to the document's ceiling (h)."""
    n_doc = F.size(hashes).alias("n_doc")
    return let(ceiling_of(F.size(hashes), parts), lambda top: F.struct(n_doc, F.filter(hashes, lambda h: h <= top).alias("h")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_key, doc_id, item_id, n_item_shingles and n_matched of every document that holds an item."""
    items = durable(items_of(benchmark), "items")
    texts = id_text(docs)
    texts = texts.select(row_key(texts).alias("row_key"), "doc_id", "text")
    sketch = sketches(items)
    # One row for each power of two among the items' sizes: at most 31.
    parts = sketch.groupBy("size_class").agg(F.max("hash").alias("ceiling"), F.min("need").alias("least")).collect()
    looked = texts.select("row_key", let(shingle_hashes(F.col("text")), lambda h: under_ceiling(h, parts)).alias("own"))
    looked = looked.select("row_key", F.col("own.n_doc").alias("n_doc"), F.explode("own.h").alias("hash"))
    hits = looked.join(_small(sketch, BROADCAST_ROWS), "hash").where("n_doc >= need").select("row_key", "item_id").distinct()
    candidates = durable(hits, "candidates")
    pairs = texts.join(_small(candidates, BROADCAST_ROWS), "row_key").join(_small(items, BROADCAST_ROWS // 10), "item_id")
    matched = F.size(F.array_intersect(shingles(F.col("text")), F.col("shingles")))
    verified = pairs.select("row_key", "doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"), matched.cast("long").alias("n_matched"), "need")
    return verified.where("n_matched >= need").drop("need").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns as they were."""
    found = durable(contaminated(docs, benchmark).select("row_key").distinct(), "leaks")
    keyed = docs.select(row_key(docs).alias("row_key"), F.struct("*").alias("row"))
    return keyed.join(_small(found, BROADCAST_ROWS), "row_key", "left_anti").select("row.*")
