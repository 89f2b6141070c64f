"""Quality rules: shape counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed unigrams and bigrams of letter, digit and sign runs: one from documents that
labels trust, one from all documents. A document's score is the mean over its n-grams of log p(target) - log p(raw); it
is kept where its base rules hold and the score is at least ``THRESHOLD``. Nothing is drawn at random, so equal text
gets an equal verdict.

The raw counts cover every document, those of the target every trusted one. The list of trusted ids is broadcast up to
``BROADCAST_IDS`` of them, after a count, and joined by shuffle beyond. The weights that come back are one array of
``BUCKETS`` numbers of four decimals, a constant of the scoring plan. All else is one scan each, aggregated before it is
shuffled.

Null text counts as no words: base_failed, not kept. Rows are judged one by one, so equal or null ids do not matter,
except that a trusted id trusts all its rows. Without trusted rows all weights are 0 and the base rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import id_text
from priorline.llm.native import BLANKS, let, windows, words

BUCKETS = 1 << 14
#: Trusted ids that are broadcast: 16 MB.
BROADCAST_IDS = 2_000_000
THRESHOLD = -0.15
SIGNS = "#*$%&|<>"
#: Runs of letters and digits, and runs of signs.
RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def buckets(text: Column) -> Column:
    """Hashed unigrams and bigrams; the last unigram pairs with the end."""
    return let(
        F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), lambda t: F.xxhash64(t)),
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")),
            F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)).cast("int")),
        ),
    )


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one array: log p(target) - log p(raw) for each bucket, both with one added to every count."""
    spark = docs.sparkSession
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("_trusted", F.lit(1))
    marked = id_text(docs).join(F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted, "doc_id", "left")
    seen = marked.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(buckets(F.col("text"))).alias("b"))
    counts = seen.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    full = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    one = full.agg(
        F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("rows"),
        F.log(F.sum("raw") + F.lit(float(BUCKETS))).alias("raw_total"),
        F.log(F.sum("target") + F.lit(float(BUCKETS))).alias("target_total"),
        F.sum("target").alias("n"),
    )
    ratio = F.transform("rows", lambda r: (F.log(r["target"] + 1.0) - F.col("target_total")) - (F.log(r["raw"] + 1.0) - F.col("raw_total")))
    return one.select(F.when(F.col("n") > 0, ratio).otherwise(F.transform("rows", lambda r: F.lit(0.0))).alias("weights"))


def repeated_words(w: Column) -> Column:
    """Words in 5-word windows found twice or more in the text, first included."""

    def covered(found: Column) -> Column:
        # Sorted by hash, equal windows are neighbours; their places, in order, cover five words each but for overlaps.
        places = let(
            F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
            lambda s: F.filter(
                F.transform(s, lambda e, k: F.when((e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]), e["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        return let(
            F.sort_array(places),
            lambda p: F.aggregate(F.transform(p, lambda i, k: F.coalesce(F.least(F.lit(5), F.get(p, k + 1) - i), F.lit(5))), F.lit(0).cast("long"), lambda a, n: a + n),
        )

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return let(let(hashes, lambda h: windows(h, 5)), lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), F.lit(0).cast("long")).otherwise(covered(f)))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every row of ``docs``."""
    text = F.col("text")
    fitted = weights(docs, labels).first()["weights"]
    w = F.split(F.lit(",".join(f"{x:.4f}" for x in fitted)), ",").cast("array<double>")  # folded once, when planned
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    measured = id_text(docs).select(
        "doc_id",
        let(words(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), repeated_words(x).alias("r"))).alias("_w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SIGNS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(w, lambda v: let(buckets(text), lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(v, x)) / F.greatest(F.size(b), F.lit(1)))).alias("score"),
    )
    n, r = F.col("_w.n"), F.col("_w.r")
    failed = (n < 10) | (100 * r > 20 * n)
    return measured.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
