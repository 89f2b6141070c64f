"""What the fourth round of findings asked for."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from priorline.plans import catalogue

SF = "/root/testdata/sf0.001"


def sent_rows(spark, act) -> int:
    """Rows written to shuffles while ``act`` runs."""
    status, none = spark.sparkContext._jsc.sc().statusStore(), spark._sc._gateway.new_array(spark._jvm.double, 0)

    def stages():
        every = status.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (every.apply(i) for i in range(every.size()))}

    before = stages()
    act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_strengths_send_a_line_twice_at_most(spark):
    """to its contest and to its side's span; not once more for each game ahead, nor again for every reader."""
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "orders"))
    sent = sent_rows(spark, lambda: catalogue.QUERIES["rotation_strength"](spark, SF).write.format("noop").mode("overwrite").save())
    sides = spark.read.parquet(f"{SF}/orders.parquet").select(F.year("o_orderdate")).distinct().count() * 30
    assert lines < sent <= 2 * lines + orders + 4 * sides


def plain(stints):
    """Strengths by definition, game by game."""
    sides = {}
    for season, team, ts, game, *rest in stints:
        if season is not None and team is not None:
            sides.setdefault((season, team), {}).setdefault((ts, game), []).append(rest)
    add = lambda xs: sum(known) if (known := [x for x in xs if x is not None]) else None
    out = {}
    for side, games in sides.items():
        made = []
        for _, rows in sorted(games.items()):
            made.append({p: tuple(add(r[i] for r in rows if r[0] == p) for i in (1, 2)) for p in {r[0] for r in rows}})
        for n in range(2, len(made) + 6):
            window, past = made[max(n - 6, 0) : n - 1], made[: n - 1]
            minutes = {p: add(g[p][0] for g in window if p in g) for g in window for p in g}
            total, known = add(minutes.values()), []
            for p in minutes.keys() - {None}:
                own = [g[p] for g in past if p in g]
                played, plus = add(x[0] for x in own), add(x[1] for x in own)
                quality = 0.0 if played is None or played <= 0 else None if plus is None else 36 * plus / played * len(own) / (len(own) + 20.0)
                if minutes[p] is not None and total and quality is not None:
                    known.append(minutes[p] / total * quality)
            if minutes.keys() - {None}:
                out[*side, n] = sum(known) if known else None
    return out


@pytest.mark.parametrize("seconds", [100, 2_000, 10**9])
def test_strengths_are_followed_over_spans_and_batches(spark, seconds):
    """Spans of less games than a window, empty ones, games cut by batches; equal instants, unknown values, stints, players without a name."""
    from priorline.operators import rotation

    rng = random.Random(seconds)
    some = lambda x, share=0.1: None if rng.random() < share else x
    rows = []
    for season, team, games in ((1, 1, 90), (1, 2, 1), (2, 1, 6), (-3, -7, 40), (None, 1, 5), (1, None, 5)):
        for g in range(games):
            ts = g // 3 * 70 - 500 + 3_000 * (g > 50)
            rows += [(season, team, ts, g * 7 % 90, some(rng.randrange(-3, 6)), some(float(rng.choice((0, 0, 5, 12, 31)))), some(rng.randrange(-20, 21))) for _ in range(rng.randrange(1, 6))]
    rows += [(5, 5, t, t, None, 3.0, 1) for t in range(9)] + [(6, 6, t, t, 1, 0.0, 1) for t in range(9)] + [(7, 7, t, t, 1, 4.0, None) for t in range(9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "season int, team int, ts long, game_id long, player int, minutes double, plus_minus int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = rotation.strength(df, seconds, 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, got = plain(rows), {(r.season, r.team, r.game_no): r.strength for r in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(got[k] == (None if w is None else pytest.approx(w, abs=1e-9)) for k, w in want.items())
    assert None in want.values()


@pytest.mark.parametrize("share", [0.0, 0.15])
def test_strengths_of_tables_with_gaps_equal_the_sql(spark, tmp_path, share):
    """Unknown keys, dates, numbers, quantities and prices, negative keys, lines of no order; and tables without a row."""
    con, few = duckdb.connect(), 0 if not share else 4_000
    con.execute("select setseed(0.5)")
    gap = lambda x: f"case when random() >= {share} then {x} end"
    con.execute(f"""create table orders as select o_orderkey, {gap("case when o_orderkey % 7 = 0 then -o_custkey else o_custkey end")} as o_custkey, o_orderstatus, o_totalprice,
      {gap("o_orderdate")} as o_orderdate, o_orderpriority from '{SF}/orders.parquet' order by o_orderkey limit {few}""")
    con.execute(f"""create table lineitem as select {gap("l_orderkey + 600")} as l_orderkey, {gap("case when l_partkey % 5 = 0 then -l_partkey else l_partkey end")} as l_partkey,
      {gap("l_linenumber")} as l_linenumber, {gap("l_quantity")} as l_quantity, {gap("case when l_partkey % 3 = 0 then -l_extendedprice else l_extendedprice end")} as l_extendedprice
      from '{SF}/lineitem.parquet' limit {few}""")
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    number = lambda x: None if x is None or math.isnan(x) else x
    want = {r[:3]: number(r[3]) for r in con.execute(catalogue.ORACLES["rotation_strength"]).fetchall()}
    got = {(r.season, r.team, r.game_no): number(r.strength) for r in catalogue.QUERIES["rotation_strength"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and bool(want) == bool(few)
    assert all(got[k] == (None if w is None else pytest.approx(w, abs=1.1e-6)) for k, w in want.items())


def test_rows_of_texts_hashed_together_are_those_of_each():
    """op5, op10, pipeline: empty and blank texts, words at the edges, fewer words than a shingle, texts longer than a piece."""
    from priorline.llm import jaccard

    rng = random.Random(4)
    texts = [b"".join(rng.choice([b"a", b"B", b"q" * 70, b"\xc3\xa9", b" ", b"\n", b"\t", b" a"]) for _ in range(rng.choice((0, 1, 3, 9, 40, 900)))) for _ in range(800)]
    texts[100:100] = [b"w x y z " * 9_000, b"", b" ", b"v" * (jaccard.PIECE + 3), b"u" * jaccard.PIECE, b"t s r q p " * 6_553, b"one two three four five"]
    got = list(jaccard.rows_of_texts(iter(texts)))
    assert len(got) == len(texts) and not list(jaccard.rows_of_texts([]))
    for text, row in zip(texts, got, strict=True):
        assert row.dtype == "uint64" and row.tolist() == jaccard.row_of(text).tolist()
        assert row.tolist() == sorted(set(row.tolist())) and len(row) <= max(len(text.split()) - 4, min(len(text.split()), 1))
