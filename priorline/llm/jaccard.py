"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A text's row of the matrix is its set of distinct ``SHINGLE``-word shingles, as 64-bit hashes. Equal rows are one node
(their signature), so copies are never paired. A pair of sizes (a, b) at 80 percent shares at least need = ceil(4(a+b)/9)
shingles, so of any order of the columns the first n - ceil(0.8 n) + 1 of each row must meet: only these entries are
multiplied. They are dealt by column into blocks; a block accumulates the overlap count of each pair that meets in it
if their sizes allow a link; counts of all blocks are summed, and pairs are discarded whose count and whose entries yet
unseen cannot make up need. What is left is verified on whole rows. The order is any one order for all rows: columns that many rows hold come last (at most ``HOT_COLUMNS`` of
them, found by counting every row's first entries), the rest by hash. So a passage that many texts share meets only
where a text is little else.

A meeting also has room only if what lies before and after it in the two rows can still make up need, and the first
meeting of rows that link needs no help from before it: in a column where a row of n entries has ``pos`` entries ahead,
its partner is of at most (5 n - 9 pos) / 4.

Columns that still hold more than ``BLOCK_ROWS`` entries - large groups of near copies - are not squared: their entries
are paired with one pivot for each size band. Each row is verified with the partner it met most and with pivots; rows
that are connected then need no more pairs for their component. The rows of a pivot's group that is still of several
components are multiplied again with the columns in a second order, in which what is frequent among *these* rows comes
last: copies edited too much to link have enough columns of their own to meet nowhere. Columns that are large even then
are multiplied tile by tile, rows outside the group's largest component by all others; a tile is bounded in rows and
bytes and returns a star for each connected part, never the pairs. Components are found on links by alternating
large-star and small-star rounds of joins.

Hash collisions (2^-64 for any two shingles or sets) aside, the result is exact.

Null or empty texts have no shingles, link with nothing and are their own component. Texts below ``SHINGLE`` words are
one shingle. Equal or null ids: rows are linked by their own texts; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorline.llm.common import BLANK, collected, durable, forget, id_text, mixed, release, rows_of, seen_in, small_batches

SHINGLE = 5
#: Columns put last: at most so many, each among the first entries of more than HOT_FROM rows.
HOT_COLUMNS, HOT_FROM = 1 << 21, 8
#: Entries of a column that are paired with each other: few, as their pairs grow with the square of a group of near copies.
BLOCK_ROWS = 8
#: Entries for a block's task.
TASK_ENTRIES = 500_000
#: Rows with whole sets that go to Python at once.
BATCH_ROWS = 500
#: Rows of what tasks have dealt that go to Python at once: each holds thousands of numbers.
DEALT_ROWS = 100
#: Rows and bytes of one chunk, and columns of one slice, where large columns are multiplied tile by tile.
TILE_ROWS, TILE_BYTES, TILE_COLUMNS = 1024, 6 << 20, 1024
#: Rows of a tile whose counts are compared with their bounds at a time.
TILE_SLICE = 256
#: Columns put last in the second order: 4 bytes each.
HOT_AGAIN = 1 << 21
#: Rows below which a table is broadcast.
BROADCAST_ROWS = 500_000
#: Bits of the map that tells which rows have a candidate: 8 MB.
MAP_BITS = 1 << 26

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: Bytes of a text that are hashed at once, and of a word whose letters are: longer words are hashed by xxhash.
PIECE, WORD_BYTES = 1 << 16, 64
#: Value of each byte in a word's polynomial, A-Z as a-z, blanks none; powers of its base and their inverses.
BASE = 0x9E3779B97F4A7C15
LETTERS = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))
BLANKS = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
LETTERS[BLANKS] = 0
IS_BLANK = BLANKS.tobytes()


def _powers(base: int) -> np.ndarray:
    powers = np.full(PIECE + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


POWERS, INVERSES = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _pieces(text: bytes):
    """``text`` in pieces of whole words, of at most PIECE bytes but for a longer word, which is a piece of its own."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = BLANK.search(text, at + 1)
            cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _hashed(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a piece of at most PIECE bytes, and where the word begins."""
    raw = np.frombuffer(piece, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = np.frombuffer(piece.translate(IS_BLANK), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    values = LETTERS.take(raw)
    values *= POWERS[: len(raw)]
    np.cumsum(values, out=sums[1:])
    w = mixed((sums[end] - sums[start]) * INVERSES[start])
    for i in np.flatnonzero(end - start > WORD_BYTES):
        w[i] = xxhash.xxh3_64_intdigest(piece[start[i] : end[i]].lower())
    return w, start


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, A-Z as a-z: a polynomial of its bytes, by whole arrays, mixed."""
    out = []
    for piece in _pieces(text):
        if len(piece) > PIECE:  # one long word, behind a blank at most
            out.append(np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in piece.split()], np.uint64))
        else:
            out.append(_hashed(piece)[0])
    return out[0] if len(out) == 1 else np.concatenate(out)


def _shingles(w: np.ndarray) -> np.ndarray:
    """A hash of every SHINGLE words in sequence."""
    n = len(w) - SHINGLE + 1
    sums = w[:n] * FACTORS[0]
    for k in range(1, SHINGLE):
        sums += w[k : k + n] * FACTORS[k]
    return mixed(sums)


def _row(w: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of ``row``, the shingles of words ``w``; fewer words than SHINGLE are one."""
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return mixed((w * FACTORS[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
    row.sort()
    new = row[1:] != row[:-1]
    return row if new.all() else row[np.r_[True, new]]


def row_of(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; A-Z count as a-z."""
    w = word_hashes(text)
    return _row(w, _shingles(w) if len(w) >= SHINGLE else w)


def _together(texts: list[bytes]):
    """``row_of`` of each of some texts of at most PIECE bytes in all, line ends between them: most passes are over all at once."""
    w, start = _hashed(b"\n".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(start, begins).tolist()
    every = _shingles(w) if len(w) >= SHINGLE else w
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield _row(w[a:b], every[a : max(b - SHINGLE + 1, a)])


def rows_of_texts(texts):
    """``row_of`` of each text, in order; short ones are hashed as many at a time as a piece holds."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > PIECE:
            yield from _together(held)
            held, size = [], 0
        if len(text) > PIECE:
            yield row_of(text)
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield from _together(held)


def signature(row: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(row.tobytes(), seed=len(row)) - (1 << 63)


def first_entries(n: int) -> int:
    """How many entries of a row of n must meet those of every row that it links with."""
    return n - -(-4 * n // 5) + 1 if n else 0


def _parted(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that groups by part, keeping what order there is, and each part's slice of it."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(part) else [0]
    return order, [(int(part[order[i]]), slice(i, j)) for i, j in zip(cuts, cuts[1:], strict=False)]


#: Numbers that a task gathers before it deals them to the parts.
DEALT = 400_000


def signatures(texts: DataFrame, parts: int) -> DataFrame:
    """row_key, doc_id, n and sig of every row; between them rows of one part and ``heads`` alone.

    heads are the high halves of first entries in hash order, once for each set and task, four bytes each.
    """

    def run(batches):
        forget()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        id_type = None

        def dealt():
            halves = np.concatenate(held) if held else np.empty(0, np.uint32)
            held.clear()
            order, own = _parted((halves % np.uint32(parts)).astype(np.int64))
            halves, k = halves[order], len(own)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
                + [pa.array([i for i, _ in own], pa.int32()), pa.array([halves[at].tobytes() for _, at in own], pa.binary())],
                names=names,
            )

        for batch in batches:
            id_type = batch.column("doc_id").type
            n, sig = [], []
            for row in _rows_of(batch):
                one = signature(row) if len(row) else None
                n.append(len(row))
                sig.append(one)
                if one is not None and one not in seen:
                    seen.add(one)
                    held.append((row[: first_entries(len(row)) * 5 // 4] >> np.uint64(32)).astype(np.uint32))
            if len(seen) > 1_000_000:
                seen.clear()
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64())]
                + [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=names,
            )
            if sum(map(len, held)) > DEALT:
                yield dealt()
        if held:
            yield dealt()

    names = ["row_key", "doc_id", "n", "sig", "part", "heads"]
    kinds = (T.LongType(), texts.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType())
    return texts.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(names, kinds, strict=True)]))


def counted_heads(rows: DataFrame, parts: int) -> DataFrame:
    """h and c of the high halves that more than HOT_FROM rows have among their heads."""

    def run(batches):
        held = [np.frombuffer(x.as_buffer(), np.uint32) for batch in batches for x in batch.column("heads")]
        h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint32), np.empty(0, np.int64))
        often = c > HOT_FROM
        yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int32)), pa.array(c[often])], names=["h", "c"])

    return rows.where("heads is not null").select("part", "heads").repartition(parts, "part").mapInArrow(run, "h int, c long")


def hot_columns(halves: DataFrame, most: int) -> np.ndarray:
    """The ``most`` high halves of columns (h, c times) that come last, sorted: those of more than HOT_FROM rows."""
    counted = halves.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > HOT_FROM)
    top = counted.orderBy(F.desc("c"), "h").limit(most).select("h").toPandas()["h"].to_numpy(np.int32)
    return np.sort(top.view(np.uint32))


def all_halves(sets: DataFrame) -> DataFrame:
    """h and how often (c) each batch of whole rows has it."""

    def run(batches):
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32) for x in batch.column("set")]
            if rows:
                h, c = np.unique(np.concatenate(rows).astype(np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int32)), pa.array(c)], names=["h", "c"])

    return sets.select("set").mapInArrow(run, "h int, c long")


def _rows_of(batch: pa.RecordBatch):
    """The rows of a batch of texts, or of whole rows."""
    if "set" in batch.schema.names:
        return (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set"))
    return rows_of_texts(x.as_py() for x in batch.column("text").cast(pa.binary()))


def entries(source: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """First entries of every row (of ``text`` or ``set``), once for each set and task, dealt to ``parts`` by column.

    One row holds what a task has gathered for a part, as little-endian numbers: sig and n of rows, how many entries
    each has here, and col, pos and hot of the entries. Hot columns are dealt by row too, so that none is one part's.
    """
    sent = source.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        forget()
        late = sent.value
        seen: set[int] = set()
        cols, hots, sigs, sizes, held = [], [], [], [], 0

        def dealt():
            col, is_late = np.concatenate(cols), np.concatenate(hots)
            sig, n = np.array(sigs, np.int64), np.array(sizes, np.int32)
            counts = np.fromiter(map(len, cols), np.int64, len(cols))
            row = np.repeat(np.arange(len(cols)), counts)
            pos = np.concatenate([np.arange(c, dtype=np.uint32) for c in counts])
            salt = np.where(is_late, sig.view(np.uint64)[row] % np.uint64(4096), np.uint64(0))
            order, own = _parted(((mixed(col) + salt) % np.uint64(parts)).astype(np.int64))
            out: list[tuple] = []
            for part, at in own:
                i = order[at]
                rows, reps = np.unique(row[i], return_counts=True)  # rows rise within a part
                p = pos[i]
                p = p.astype(np.uint16) if p.max() < 1 << 16 else p
                made = (sig[rows], n[rows], reps.astype(np.uint16 if reps.max() < 1 << 16 else np.uint32), col[i], p, np.packbits(is_late[i]))
                out.append((part, *(x.tobytes() for x in made)))
            for x in (cols, hots, sigs, sizes):
                x.clear()
            kinds = [pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=DEALT_COLUMNS)

        for batch in batches:
            for row in _rows_of(batch):
                if not len(row):
                    continue
                one = signature(row)
                if one in seen:
                    continue
                seen.add(one)
                k = first_entries(len(row))
                for looked in (2 * k, len(row)):  # mostly the front of a row has enough columns that are not hot
                    is_late = np.zeros(min(looked, len(row)), bool)
                    if len(late):
                        high = (row[:looked] >> np.uint64(32)).astype(np.uint32)
                        at = np.minimum(np.searchsorted(late, high), len(late) - 1)
                        is_late = late[at] == high
                    if len(is_late) - np.count_nonzero(is_late) >= k:
                        break
                order = np.concatenate([np.flatnonzero(~is_late)[:k], np.flatnonzero(is_late)[:k]])[:k]
                cols.append(row[order])
                hots.append(is_late[order])
                sigs.append(one)
                sizes.append(len(row))
                held += k
                if held > DEALT:
                    yield dealt()
                    held = 0
            if len(seen) > 1_000_000:
                seen.clear()
        if cols:
            yield dealt()

    return source.mapInArrow(run, "part int, sig binary, n binary, reps binary, col binary, pos binary, hot binary")


DEALT_COLUMNS = ["part", "sig", "n", "reps", "col", "pos", "hot"]


def _undealt(batch: pa.RecordBatch):
    """col, sig, n, pos and hot of every entry, a dealt row at a time."""
    for x in zip(*(batch.column(c) for c in DEALT_COLUMNS[1:]), strict=True):
        sig, n, reps, col, pos, hot = (v.as_buffer() for v in x)
        sig, n, col = np.frombuffer(sig, np.int64), np.frombuffer(n, np.int32), np.frombuffer(col, np.int64)
        reps = np.frombuffer(reps, np.uint16 if len(reps) == 2 * len(sig) else np.uint32)
        pos = np.frombuffer(pos, np.uint16 if len(pos) == 2 * len(col) else np.uint32)
        is_late = np.unpackbits(np.frombuffer(hot, np.uint8), count=len(col)).astype(bool)
        yield is_late, {"col": col, "sig": np.repeat(sig, reps), "n": np.repeat(n, reps), "pos": pos.astype(np.int32)}


def _meet(ai, bi, n, pos):
    """Which of the entry pairs (ai, bi) of one column have sizes and places that can link."""
    na, nb, pa_, pb = n[ai], n[bi], pos[ai], pos[bi]
    ok = 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)
    ok &= 9 * (np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)) >= 4 * (na + nb)
    return ai[ok], bi[ok]


def blocks(entry_rows: DataFrame, parts: int) -> DataFrame:
    """a < b with sizes and the count of columns that met (kind 0), and entries of columns too large to square (kind 1: a, na, col, pos)."""

    def run(batches):
        forget()
        cold = []
        for hot, table in (x for batch in batches for x in _undealt(batch)):
            if hot.any():
                yield kind1({c: v[hot] for c, v in table.items()})
                table = {c: v[~hot] for c, v in table.items()}
            cold.append(table)
        if not cold:
            return
        col, sig, n, pos = (np.concatenate([t[c] for t in cold]) for c in ("col", "sig", "n", "pos"))
        cold.clear()
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((sig, col))
        col, sig, n, pos = col[order], sig[order], n[order], pos[order]
        if not len(col):
            return
        new = np.r_[True, (col[1:] != col[:-1]) | (sig[1:] != sig[:-1])]  # one set may come from several tasks
        col, sig, n, pos = col[new], sig[new], n[new], pos[new]
        start = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
        length = np.diff(np.r_[start, len(col)])
        pairs, held = [], 0
        for m in np.unique(length[length > 1]):
            at = start[length == m]
            if m > BLOCK_ROWS:
                for s in at:
                    part = slice(s, s + m)
                    yield kind1({"col": col[part], "sig": sig[part], "n": n[part], "pos": pos[part]})
                continue
            i, j = np.triu_indices(m, 1)
            step = max(1, 250_000 // len(i))
            for s in range(0, len(at), step):
                base = at[s : s + step, None]
                ai, bi = _meet((base + i).ravel(), (base + j).ravel(), n, pos)
                pairs.append(np.stack([sig[ai], sig[bi], n[ai], n[bi]]))  # sorted by sig within a column, so a < b
                held += len(ai)
                if held > 400_000:
                    yield kind0(np.concatenate(pairs, axis=1))
                    pairs, held = [], 0
        if held:
            yield kind0(np.concatenate(pairs, axis=1))

    def batch_of(kind, a, na, *more):
        k = len(a)
        full = lambda x: pa.nulls(k, pa.int64()) if x is None else pa.array(np.asarray(x).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *map(full, (a, na, *more))], names=["kind", "a", "na", "b", "nb", "met", "col", "pos"])

    def kind1(t):
        return batch_of(1, t["sig"], t["n"], None, None, None, t["col"], t["pos"])

    def kind0(pairs):
        order = np.lexsort((pairs[1], pairs[0]))
        a, b, na, nb = pairs[:, order]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return batch_of(0, a[start], na[start], b[start], nb[start], np.diff(np.r_[start, len(a)]), None, None)

    return entry_rows.repartition(parts, "part").mapInArrow(run, "kind int, a long, na long, b long, nb long, met long, col long, pos long")


def _first(n: Column) -> Column:
    """``first_entries`` as a column."""
    return n - F.ceil(4 * n / F.lit(5.0) - 1e-9) + 1


def _room(met: Column, ua: Column, ub: Column) -> Column:
    """Whether rows of sizes na and nb that met ``met`` times outside large columns, and have ua and ub entries in those, can link."""
    na, nb = F.col("na"), F.col("nb")
    rest = F.greatest(na - _first(na), nb - _first(nb))
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (met + F.least(ua, ub) + rest >= F.ceil(4 * (na + nb) / F.lit(9.0) - 1e-9))


def enough(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of all blocks whose counts leave room for a link.

    In the common order, every shared column up to the nearer end of the two rows' first entries has met, but for those in
    columns too large to square; beyond that end there are at most n - first_entries(n) columns of the row that ends there.
    """
    large = met.where("kind = 1").select("a", "col").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("u"))
    counted = met.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("met").alias("met"))
    known = _small(large)
    both = counted.join(known.select("a", F.col("u").alias("ua")), "a", "left").join(known.select(F.col("a").alias("b"), F.col("u").alias("ub")), "b", "left")
    return both.where(_room(F.col("met"), F.coalesce("ua", F.lit(0)), F.coalesce("ub", F.lit(0)))).select("a", "b", "met")


def best_partners(pairs: DataFrame) -> DataFrame:
    """For each row the pair that met in most columns."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "met")
    best = ends.groupBy("e.x").agg(F.max_by("e.y", F.struct("met", "e.y")).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_of(df) <= BROADCAST_ROWS else df


def marked(keys: DataFrame, column: str) -> np.ndarray:
    """A map of MAP_BITS bits, in bytes, with the spots of all values of a long ``column`` set."""
    spot = F.pmod(F.col(column), F.lit(MAP_BITS)) + 1
    maps = keys.select(F.bitmap_bucket_number(spot).alias("k"), F.bitmap_bit_position(spot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8 + 4096, np.uint8)
    for r in maps:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(own)] = own
    return bits


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig and whole row (binary) of the texts in ``wanted`` (row_key), from one more scan; only those are moved."""
    bits = marked(wanted, "row_key")
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        forget()
        have = sent.value
        for batch in batches:
            spots = batch.column("row_key").to_numpy() % MAP_BITS
            rows = np.flatnonzero(have[spots >> 3] >> (spots & 7) & 1)
            part = batch.take(pa.array(rows))
            keys, sigs, sets, held = [], [], [], 0
            for key, row in zip(part.column("row_key"), _rows_of(part.select(["text"])), strict=True):
                if not len(row):
                    continue
                keys.append(key)
                sigs.append(signature(row))
                sets.append(row.tobytes())
                held += len(sets[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sets, pa.binary())], names=["row_key", "sig", "set"])
                    keys, sigs, sets, held = [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sets, pa.binary())], names=["row_key", "sig", "set"])

    return texts.mapInArrow(run, "row_key long, sig long, set binary").join(_small(wanted), "row_key", "left_semi").drop("row_key")


def prints(sets: DataFrame) -> DataFrame:
    """The sets with two bytes for each shingle, sorted: what two of them share is at least what their sets share."""

    def run(batches):
        forget()
        for batch in batches:
            out = [np.sort(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint16)).tobytes() for x in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(out, pa.binary())], names=["sig", "set"])

    return sets.mapInArrow(run, "sig long, set binary")


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted arrays share, each as often as both have it."""
    values, n = np.unique(p, return_counts=True)
    return int(np.minimum(n, np.searchsorted(q, values, "right") - np.searchsorted(q, values, "left")).sum())


def verified(pairs: DataFrame, sets: DataFrame, width: type = np.uint64) -> DataFrame:
    """The pairs (a, b) whose sets (of values of ``width``) share enough."""

    def run(batches):
        forget()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), width), np.frombuffer(y.as_buffer(), width)
                common = shared(p, q) if len(p) <= len(q) else shared(q, p)
                keep.append(100 * common >= 80 * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    one = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), "a")
    both = one.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of ``links`` (a, b)."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        before, edges = edges, durable(small, "edges", F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        release(before)
        now = (rows_of(edges), seen_in(edges))
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose rows are in different components."""
    own = _small(roots)
    rooted = pairs.join(own.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(own.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return rooted.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def tile_links(ids: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the two chunks of a tile (or within its one chunk), as stars: enough edges to connect what links connect.

    The product of the two incidence matrices, over columns that more than one row has, a slice of columns at a time.
    """
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    keep = often[at]
    at, rows = number[at[keep]], rows[keep]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    one = len(np.unique(chunk)) == 1
    left = np.arange(len(sets)) if one else np.flatnonzero(chunk == chunk.min())
    right = left if one else np.flatnonzero(chunk != chunk.min())
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(often.sum()), TILE_COLUMNS):
        a, b = np.searchsorted(at, [first, first + TILE_COLUMNS])
        part = np.zeros((len(sets), TILE_COLUMNS), np.float32)
        part[rows[a:b], at[a:b] - first] = 1
        common += part[left] @ part[right].T
    linked_ = np.empty(common.shape, bool)
    for i in range(0, len(left), TILE_SLICE):
        met = common[i : i + TILE_SLICE].astype(np.int64)
        linked_[i : i + TILE_SLICE] = 100 * met >= 80 * (sizes[left[i : i + TILE_SLICE]][:, None] + sizes[right][None, :] - met)
    del common
    links: list[tuple[int, int]] = []
    todo = set(range(len(sets)))
    place = {int(r): k for k, r in enumerate(right)}
    spot = {int(r): k for k, r in enumerate(left)}
    while todo:
        start = todo.pop()
        front = [start]
        while front:
            r = front.pop()
            near = set()
            if r in spot:
                near |= set(right[linked_[spot[r]]].tolist())
            if r in place:
                near |= set(left[linked_[:, place[r]]].tolist())
            near &= todo
            todo -= near
            front += near
            links += [(int(ids[start]), int(ids[x])) for x in near]
    return [(min(p), max(p)) for p in links]


def grouped(met: DataFrame) -> DataFrame:
    """Rows of large columns with the pivot of every group in which they may link: pivot and a.

    A group is a column and a size band, the smaller partner's; the other's size is at most three bands up. Of each
    pair that first meets in this column, both rows are in the group: the smaller has at most a ninth of its entries
    ahead, and neither has so many that the group's least such row is out of its reach.
    """
    large = met.where("kind = 1").select("col", "a", F.col("na").alias("n"), "pos").distinct()
    unseen = large.groupBy("a").agg(F.count(F.lit(1)).alias("u"))
    band = F.floor(F.log("n") / math.log(1.1)).cast("int")
    banded = durable(large.join(_small(unseen), "a").withColumn("band", band), "large")
    # An original has all its first entries in large columns, an edited copy some of its own: the fullest is the pivot.
    fullest = F.min_by("a", F.struct(-F.col("u") / _first(F.col("n")), F.col("a")))
    least = F.min(F.when(9 * F.col("pos") <= F.col("n"), F.col("n")))
    pivots = banded.groupBy("col", "band").agg(fullest.alias("pivot"), least.alias("least")).where("least is not null")
    steps = durable(pivots.withColumn("band", F.explode(F.sequence(F.col("band"), F.col("band") + 3))), "pivots")
    near = banded.join(_small(steps), ["col", "band"]).where(4 * F.col("least") <= 5 * F.col("n") - 9 * F.col("pos"))
    groups = durable(near.select("pivot", "a").distinct(), "groups")
    release(banded)
    release(steps)
    return groups


def _stars(groups: DataFrame) -> DataFrame:
    ends = F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b")
    return groups.where("a <> pivot").select(*ends)


def still_open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Group, row (a) and root in every group that is still of several components.

    Groups whose pivots are connected are one: several columns of one large group may have chosen different pivots.
    """
    own = _small(roots.select(F.col("node").alias("a"), "root"))
    named = groups.join(own.withColumnRenamed("a", "pivot"), "pivot", "left")
    rows = named.select(F.coalesce("root", "pivot").alias("group"), "a").distinct()
    rooted = durable(rows.join(own, "a", "left").withColumn("root", F.coalesce("root", "a")), "rooted")
    several = rooted.groupBy("group").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    return durable(rooted.join(several.select("group"), "group", "left_semi"), "open")


def tiled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of each group of ``rows`` (group, a, root), found tile by tile.

    Rows of a group's largest component meet all others, but not one another.
    """
    own = sets.select(F.col("sig").alias("a"), "set").join(_small(durable(rows.select("a").distinct(), "rest")), "a", "left_semi")
    sized = durable(rows.join(own.dropDuplicates(["a"]), "a"), "sized")
    per = sized.groupBy("group", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("set")).alias("bytes"))
    top = F.max_by("root", F.struct("rows", "root")).alias("top")
    tops = per.groupBy("group").agg(top, *[F.sum(c).alias(c) for c in ("rows", "bytes")], F.max_by(F.struct("rows", "bytes"), F.struct("rows", "root")).alias("_t"))
    chunks = lambda n, size: F.ceil(F.greatest(n / TILE_ROWS, size / TILE_BYTES)).cast("int")
    tops = tops.select(
        "group", "top", chunks(F.col("_t.rows"), F.col("_t.bytes")).alias("ta"),
        chunks(F.col("rows") - F.col("_t.rows"), F.col("bytes") - F.col("_t.bytes")).alias("tb"),
    )
    dealt = sized.join(_small(durable(tops, "tops")), "group").withColumn("first", F.col("root") == F.col("top"))
    own = F.pmod(F.xxhash64("a"), F.when(F.col("first"), F.col("ta")).otherwise(F.col("tb")))
    dealt = dealt.withColumn("chunk", (own + F.when(F.col("first"), 0).otherwise(F.col("ta"))).cast("int"))
    others = F.sequence(F.when(F.col("first"), F.col("ta")).otherwise(F.lit(0)), F.col("ta") + F.col("tb") - 1)
    tiles = dealt.select("group", "a", "chunk", "set", F.explode(others).alias("other"))
    tiles = tiles.select("group", "a", "chunk", "set", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"))

    def run(pdf):
        pdf = pdf.sort_values("a", kind="stable")
        chunk = pdf["chunk"].to_numpy()
        if pdf["ti"].iloc[0] != pdf["tj"].iloc[0] and len(np.unique(chunk)) == 1:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        links = tile_links(pdf["a"].to_numpy(), chunk, [np.frombuffer(x, np.uint64) for x in pdf["set"]])
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return tiles.groupBy("group", "ti", "tj").applyInPandas(run, "a long, b long")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs``, first by two-byte prints, then by whole rows."""
    with small_batches(pairs.sparkSession, BATCH_ROWS):
        short = durable(prints(sets), "prints")  # written, so that no stage runs two kinds of Python workers at once
        near = durable(verified(pairs, short, np.uint16).distinct(), "near")
        release(short)
        links = durable(verified(near, sets).distinct(), "links")
    release(near)
    return links


def nodes(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n (shingles) and node (the same in each row of a component, null without shingles) for every row of ``docs``."""
    spark = docs.sparkSession
    texts = id_text(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = durable(signatures(texts, least_parts), "signatures")
    rows = signed.where("row_key is not null").drop("part", "heads")
    first_rows = rows.where("sig is not null").groupBy("sig").agg(F.min("row_key").alias("row_key"))

    def product(source: DataFrame, hot: np.ndarray, total: int) -> tuple[DataFrame, DataFrame]:
        """Pairs with room for a link, and groups, of the rows in ``source``."""
        parts = max(least_parts, math.ceil(total / TASK_ENTRIES))
        with small_batches(spark, DEALT_ROWS):
            met = durable(blocks(entries(source, hot, parts), parts), "blocks")
        squared, groups = durable(enough(met), "squared"), grouped(met)
        release(met)
        return squared, groups

    def whole(sigs: DataFrame) -> DataFrame:
        """sig and set of one row of each of ``sigs``."""
        wanted = durable(first_rows.join(_small(durable(sigs.distinct(), "sigs")), "sig", "left_semi").select("row_key"), "wanted")
        return durable(sets_of(texts, wanted), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("sig"))

    with small_batches(spark, DEALT_ROWS):
        hot = hot_columns(counted_heads(signed, least_parts), HOT_COLUMNS)
    squared, groups = product(texts, hot, (rows.agg(F.sum("n")).first()[0] or 0) / 5)
    # First each row with its likeliest partner and with pivots: most components form here, and their other pairs are not needed.
    likely = durable(best_partners(squared).unionByName(_stars(groups)).distinct(), "pairs")
    sets = whole(ends(likely))
    found = checked(likely, sets)
    release(sets)
    roots = components(found)
    more = _apart(squared.select("a", "b"), roots).join(likely, ["a", "b"], "left_anti")
    more = durable(more, "pairs")
    rest = still_open(groups, roots)
    members = durable(rest.select(F.col("a").alias("sig")).distinct(), "members")
    release(squared)
    release(groups)
    collected(spark)
    if rows_of(more) or rows_of(members):
        sets = whole(ends(more).unionByName(members))
        again = sets.join(_small(members), "sig", "left_semi")
        hot = hot_columns(all_halves(again), HOT_AGAIN)
        squared, groups = product(again, hot, again.agg(F.sum(F.octet_length("set") / 40)).first()[0] or 0)
        more = _apart(squared.select("a", "b").unionByName(_stars(groups)), roots).unionByName(more)
        new = checked(durable(more.join(likely, ["a", "b"], "left_anti").distinct(), "pairs"), sets)
        if rows_of(new):
            found = found.unionByName(new)
            roots = components(found)
        rest = still_open(groups, roots)
        if rows_of(rest):
            found = found.unionByName(durable(tiled(rest, sets), "tiles"))
            roots = components(found)
        release(sets)
    return rows.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("node", F.coalesce("root", "sig"))


def linked(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id and first (one row of each component) for every row of ``docs``."""
    node = nodes(docs)
    head = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    heads = node.where("node is not null").groupBy("node").agg(F.min(head).alias("head"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")
    joined = node.join(_small(durable(heads, "heads")), "node", "left")  # a row alone is its own component
    return joined.select(
        "row_key", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head")["doc_id"]).alias("component_id"),
        (F.col("head").isNull() | (F.col("head")["row_key"] == F.col("row_key"))).alias("first"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns as they were; equal rows count once, rows without shingles stay."""
    first = linked(docs).where("first").groupBy("row_key")
    keep = durable(first.agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")), "kept")
    # The columns of docs travel as one, so that no name of theirs can clash.
    keyed = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"), F.struct("*").alias("row"))
    kept = keyed.join(keep.select("row_key"), "row_key", "left_semi")
    twice = keep.where("rows > 1 and n > 0").select("row_key")
    if twice.limit(1).count():
        again = kept.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = kept.join(twice, "row_key", "left_anti").unionByName(again)
    return kept.select("row.*")
