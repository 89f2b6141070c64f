"""Line dedup by a log-template tree of fixed depth.

A line's tokens are its blank-separated words; words with a digit are variable from the start. Lines descend by token
count and by their ``DEPTH`` leading tokens to a leaf. In a leaf, a line joins the template it agrees with in most
places, if at least ``SIMILAR`` of them, and the places where they differ become variable; else it starts a template.
Lines that are equal but for words with digits are one line there, so a leaf sees distinct lines only, in the order of
their hashes: the result does not depend on the order of rows. The rule is the same whatever the size of a leaf: lines
stream past the leaf's templates, and once there are more than ``DENSE`` of them, those that can agree in enough places
are looked up. Past the leading tokens, which all lines of a leaf share, the places are cut into one block more than
may differ, so a template that a line may join has a block equal to the line's.

Documents of one near-duplicate component (the n-gram Jaccard join of ``jaccard``, over all documents that hold a line
whose template another has too) hold the same lines because they are copies as a whole, and count as one occurrence. A
template that occurs in ``MIN_DOCS`` components is dropped from all its documents, copies too; one that stays within a
component is left for near-duplicate search. Lines of fewer than ``MIN_TOKENS`` tokens are never dropped.

Null text stays null, empty text empty. Rows with equal ids are documents of their own unless their texts are equal too,
which count as one. Dropped lines go with their line end; all else stays byte for byte.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm import jaccard
from priorline.llm.common import bounded_batches, collected, durable, forget, release, rows_of
from priorline.llm.native import let

MIN_TOKENS, MIN_DOCS = 5, 2
DEPTH = 3
SIMILAR = 0.8
#: Up to so many templates of a leaf are compared with a line without a look-up.
DENSE = 64
#: Rows of two numbers that are broadcast: 16 MB. Beyond, joins are by shuffle, and adaptive execution splits hot keys.
BROADCAST_LINES = 500_000
#: Distinct lines that a task remembers as sent; a line forgotten is sent once more.
REMEMBERED_LINES = 200_000
DIGIT = re.compile(rb"[0-9]")
#: What parts words, but for line ends and single blanks.
OTHER_BLANKS = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")
VARIABLE = xxhash.xxh3_64_intdigest(b"<*>")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def token_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, one value for all that hold a digit."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if DIGIT.search(b"".join(words)):
        for i, w in enumerate(words):
            if DIGIT.search(w):
                hashed[i] = VARIABLE
    return hashed


def _signed(x: int) -> int:
    return x - (1 << 63)


def leaf_of(head: list[bytes], n: int) -> int:
    """The leaf that a line of n words descends to: by their number and the leading ones (``head``)."""
    key = b" ".join(head)
    if DIGIT.search(key):
        key = b" ".join(b"<*>" if DIGIT.search(w) else w for w in head)
    return _signed(xxhash.xxh3_64_intdigest(key, seed=n))


def long_lines(text: bytes):
    """Number, line and leaf of every line of at least MIN_TOKENS words; where single blanks part them, they are counted, not cut out."""
    plain = not any(c in text for c in OTHER_BLANKS)
    for number, line in enumerate(text.split(b"\n")):
        if plain and line[:1] != b" " and line[-1:] != b" ":
            n = line.count(b" ") + 1
        else:
            n = len(line.split())
        if n >= MIN_TOKENS:
            yield number, line, leaf_of(line.split(None, DEPTH)[:DEPTH], n)


def leaves_of(texts: DataFrame) -> DataFrame:
    """row_key and leaf of every leaf that a text's lines of at least MIN_TOKENS tokens descend to."""

    def run(batches):
        forget()
        for batch in batches:
            rows, leaves = [], []
            for row, value in enumerate(batch.column("text").cast(pa.binary())):
                own = {leaf for _, _, leaf in long_lines(value.as_py())}
                rows += [row] * len(own)
                leaves += own
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(rows, pa.int64())), pa.array(leaves, pa.int64())], names=["row_key", "leaf"])

    return texts.mapInArrow(run, "row_key long, leaf long")


def lines_of(texts: DataFrame) -> DataFrame:
    """row_key, line_no, line (hash) and leaf of every line of at least MIN_TOKENS tokens whose leaf several rows share; tokens (32-bit hashes) once for each line and task.

    A line alone in its leaf cannot recur. Which leaves are shared is told by a map of bits; what it lets through beyond
    them changes nothing.
    """
    rows = leaves_of(texts).groupBy("leaf").agg(F.min("row_key").alias("x"), F.max("row_key").alias("y"))
    sent = texts.sparkSession.sparkContext.broadcast(jaccard.marked(rows.where("x <> y"), "leaf"))

    def run(batches):
        forget()
        seen: set[int] = set()
        known: dict[int, int] = {}  # lines as they are written; what is not in ``seen`` was not met before in any writing
        shared = sent.value
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("row", "line_no", "line", "leaf", "tokens")}
            held = 0

            def flushed():
                return pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(pa.array(cols["row"], pa.int64())), pa.array(cols["line_no"], pa.int32()), pa.array(cols["line"], pa.int64()), pa.array(cols["leaf"], pa.int64()), pa.array(cols["tokens"], pa.binary())],
                    names=["row_key", "line_no", "line", "leaf", "tokens"],
                )

            for row, value in enumerate(batch.column("text").cast(pa.binary())):
                for number, line, leaf in long_lines(value.as_py()):
                    spot = leaf % jaccard.MAP_BITS
                    if not shared[spot >> 3] >> (spot & 7) & 1:
                        continue
                    raw, tokens = xxhash.xxh3_64_intdigest(line), None
                    one = known.get(raw)
                    if one is None:
                        hashed = token_hashes(line.split())
                        one = known[raw] = _signed(xxhash.xxh3_64_intdigest(hashed.tobytes()))
                    if one not in seen:
                        seen.add(one)
                        tokens = np.where(hashed == VARIABLE, 0, hashed | np.uint64(1)).astype(np.uint32).tobytes()
                        held += len(tokens)
                    for k, v in zip(cols, (row, number, one, leaf, tokens), strict=True):
                        cols[k].append(v)
                    held += 50
                if held > 8 << 20:
                    yield flushed()
                    for v in cols.values():
                        v.clear()
                    held = 0
            yield flushed()
            if len(known) > REMEMBERED_LINES:
                seen.clear()
                known.clear()

    return texts.mapInArrow(run, "row_key long, line_no int, line long, leaf long, tokens binary")


class Leaf:
    """The templates of one leaf, each named by its first line."""

    def __init__(self, width: int) -> None:
        self.held = np.empty((4, width), np.uint32)
        self.names: list[int] = []
        self.least = next(n for n in range(width + 1) if n >= SIMILAR * width)
        self.blocks: list[tuple[int, int]] = []
        self.seen: dict[tuple[int, bytes], list[int]] | None = None

    def _enter(self, k: int) -> None:
        row = self.held[k]
        for i, (a, b) in enumerate(self.blocks):
            if row[a:b].all():
                self.seen.setdefault((i, row[a:b].tobytes()), []).append(k)

    def _index(self) -> None:
        """Blocks of the places past the leading ones; those of them that vary already count as differing."""
        width = self.held.shape[1]
        spare = width - self.least - int((self.held[0, :DEPTH] == 0).sum())
        if spare >= 0:
            cuts = np.linspace(DEPTH, width, min(spare + 1, width - DEPTH) + 1).astype(int)
            self.blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.seen = {}
        for k in range(len(self.names)):
            self._enter(k)

    def _near(self, row: np.ndarray):
        """Templates that ``row`` may join, in their order."""
        k = len(self.names)
        if k <= DENSE:
            return np.arange(k)
        if self.seen is None:
            self._index()
        found = {t for i, (a, b) in enumerate(self.blocks) for t in self.seen.get((i, row[a:b].tobytes()), ())}
        return np.array(sorted(found), np.int64)

    def join(self, line: int, row: np.ndarray) -> int | None:
        """The name of the template that the line joins, None where it starts one."""
        near = self._near(row)
        if len(near):
            same = ((self.held[near] == row) & (row != 0)).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.least:
                own = self.held[near[best]]
                own[own != row] = 0
                return self.names[near[best]]
        k = len(self.names)
        if k == len(self.held):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        self.held[k] = row
        self.names.append(line)
        if self.seen is not None:
            self._enter(k)
        return None


def templates(lines: DataFrame, parts: int) -> DataFrame:
    """line and template of every line that is not its template's first."""
    shared = durable(lines.groupBy("leaf").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("leaf"), "shared")
    own = lines.where("tokens is not null").select("line", "leaf", "tokens")
    # Most leaves hold one line; only the others' tokens are moved.
    own = own.join(_small(shared), "leaf", "left_semi").dropDuplicates(["line"])

    def run(batches):
        now, held = None, None
        for batch in batches:
            out = []
            for leaf, line, raw in zip(batch.column("leaf").to_pylist(), batch.column("line").to_pylist(), batch.column("tokens"), strict=True):
                row = np.frombuffer(raw.as_buffer(), np.uint32)
                if now != (leaf, len(row)):
                    now, held = (leaf, len(row)), Leaf(len(row))
                name = held.join(line, row)
                if name is not None:
                    out.append((line, name))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["line", "template"])

    dealt = own.repartition(parts, "leaf").sortWithinPartitions("leaf", F.octet_length("tokens"), "line")
    return dealt.mapInArrow(run, "line long, template long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_of(df) <= BROADCAST_LINES else df


def in_recurring(rows: DataFrame, of: DataFrame, by: str) -> DataFrame:
    """The ``rows`` whose template recurs in ``of``; a hot template's rows stay where they are."""
    again = durable(recurring(of, by), "again")
    return rows.join(_small(again), "template", "left_semi")


def recurring(rows: DataFrame, by: str) -> DataFrame:
    """Templates with at least MIN_DOCS values of ``by``."""
    return rows.select("template", by).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS).select("template")


def lines_by_row(rows: DataFrame) -> DataFrame:
    return rows.groupBy("row_key").agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """row_key and the line numbers (from 0) that its document loses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(row_key(docs).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    lines = durable(lines_of(keyed), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    renamed = durable(templates(lines, parts), "templates")
    named = lines.select("row_key", "line_no", "line").join(_small(renamed), "line", "left")
    rows = durable(named.select("row_key", "line_no", F.coalesce("template", "line").alias("template")), "rows")
    often = durable(in_recurring(rows, rows, "row_key"), "often")
    for done in (lines, renamed, rows):
        release(done)
    if not rows_of(often):
        return lines_by_row(often)
    # The join needs as much room as what has run so far: shuffle files go when the driver collects its garbage.
    collected(spark)
    holders = durable(often.select("row_key").distinct(), "holders")
    held = docs.select("doc_id", "text", row_key(docs).alias("row_key")).join(_small(holders), "row_key", "left_semi")
    copies = durable(jaccard.nodes(held).select("row_key", F.coalesce("node", "row_key").alias("node")).distinct(), "copies")
    drops = durable(lines_by_row(in_recurring(often, often.join(_small(copies), "row_key"), "node")), "drops")
    for done in (often, holders, copies):
        release(done)
    return drops


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its recurring lines dropped from ``text`` and their number in ``_pl_dropped``; all other columns as they were."""
    drops = dropped_lines(docs)
    if (drops.agg(F.sum(F.size("line_nos"))).first()[0] or 0) <= BROADCAST_LINES:
        drops = F.broadcast(drops)
    # The columns of docs travel as one, so that no name of theirs can clash; a column named _pl_dropped is replaced.
    keyed = docs.select(row_key(docs).alias("row_key"), F.struct("*").alias("row"))
    joined = keyed.join(drops, "row_key", "left")

    def left(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("line_nos"))  # hashed: linear in both
        return F.transform(numbers, lambda i: F.get(lines, i))

    text = F.when(F.col("line_nos").isNull(), F.col("row.text")).otherwise(F.array_join(let(F.split("row.text", "\n"), left), "\n"))
    dropped = F.when(F.col("line_nos").isNull(), F.lit(0)).otherwise(F.size("line_nos")).cast("long")
    own = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "_pl_dropped"]
    return joined.select(*own, dropped.alias("_pl_dropped"))
