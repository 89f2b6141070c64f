"""Boundaries of as-of reads and every class of the matcher."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from priorline.operators import asof, match

CANDLES = "market int, ts long, bid double, ask double"


@pytest.mark.parametrize(
    ("rows", "issue", "ts"),
    [
        ([], "no_candles_returned", None),
        ([(1, 101, 0.4, 0.5)], "no_candle_at_or_before_prediction_ts", None),
        ([(1, 100, 0.4, 0.5)], None, 100),
        ([(1, 90, 0.4, 0.5), (1, 101, 0.1, 0.2)], None, 90),
        ([(1, 90, 0.4, 0.5), (1, 95, None, None)], None, 90),
        ([(1, 90, None, None)], "no_bid_or_ask_in_window", 90),
        ([(1, 40, 0.4, 0.5)], None, 40),
        ([(1, 39, 0.4, 0.5)], "stale_quote", 39),
        ([(1, 90, None, 0.5)], "missing_bid", 90),
        ([(1, 90, 0.5, None)], "missing_ask", 90),
    ],
)
def test_quote_decisions(spark, rows, issue, ts):
    anchors = spark.createDataFrame([(1, 100)], "market int, at long")
    got = asof.quote_asof(anchors, spark.createDataFrame(rows, CANDLES), "market", "at", 60).first()
    assert (got["issue"], got["quote_ts"]) == (issue, ts)


def test_time_buckets_change_nothing(spark):
    rng = random.Random(5)
    ev = spark.createDataFrame([(rng.randint(1, 3), rng.randint(0, 5000), float(i)) for i in range(400)], "k int, t long, v double").dropDuplicates(["k", "t"])
    an = spark.createDataFrame([(i, rng.randint(1, 4), rng.randint(-10, 6000)) for i in range(300)], "i int, k int, at long")
    plain = asof.latest_before(an, ev, "k", "at", "t", {"v": "v", "t0": "t"})
    cut = asof.latest_before(an, ev, "k", "at", "t", {"v": "v", "t0": "t"}, bucket_seconds=500)
    assert sorted(plain.collect(), key=str) == sorted(cut.collect(), key=str)
    events = ev.collect()
    for r in plain.collect():
        known = [e for e in events if e.k == r.k and e.t <= r.at]
        assert r.t0 == (max(known, key=lambda e: e.t).t if known else None)


def test_batch_is_taken_whole(spark):
    ev = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 20, "c"), (1, 30, "d")], "k int, t long, x string")
    assert sorted(r.x for r in asof.latest_batch(ev, ["k"], "t", 25).collect()) == ["b", "c"]
    assert [r.x for r in asof.latest_state(ev, ["k"], "t", "x", 25).collect()] == ["c"]


def matched(spark, left, right):
    kind = "{0}_id long, key string, pair string, day int"
    out = match.two_tier(spark.createDataFrame(left, kind.format("left")), spark.createDataFrame(right, kind.format("right")))
    return sorted((r.status, r.tier or "", r.left_id or 0, r.right_id or 0, r.candidates or "") for r in out.collect())


def test_matcher_classes(spark):
    left = [(1, "a", "p", 1), (2, "b", "q", 1), (3, "b", "q", 1), (4, "c", "r", 5), (5, None, "s", 9), (6, "x", "t", 1), (7, "y", "u", 5)]
    right = [(11, "a", "p", 1), (12, "b", "q", 1), (13, "c2", "r", 6), (14, "s2", "s", 11), (16, "t1", "t", 0), (17, "t2", "t", 2), (18, "u1", "u", 4)]
    assert matched(spark, left, right) == sorted([
        ("matched", "exact", 1, 11, ""), ("ambiguous", "exact", 2, 0, "12"), ("ambiguous", "exact", 3, 0, "12"), ("ambiguous", "exact", 0, 12, "2,3"), ("matched", "near", 4, 13, ""),
        ("unmatched_left", "", 5, 0, ""), ("unmatched_right", "", 0, 14, ""), ("ambiguous", "near", 6, 0, "16,17"), ("unmatched_right", "", 0, 16, ""), ("unmatched_right", "", 0, 17, ""), ("matched", "near", 7, 18, ""),
    ])


def test_matcher_ignores_order_and_empty_sides(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("abc") + str(i % 9), str(i % 5), rng.randint(0, 9)) for i in range(1, 40)]
    right = [(i, rng.choice("abc") + str(i % 7), str(i % 5), rng.randint(0, 9)) for i in range(1, 40)]
    assert matched(spark, left, right) == matched(spark, left[::-1], right[::-1])
    assert matched(spark, [], []) == []
    assert matched(spark, left[:1], []) == [("unmatched_left", "", 1, 0, "")]


def test_one_to_one_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 2)], "k int, w int")
    with pytest.raises(Exception, match="more than once"):
        match.one_to_one(a, b, ["k"]).collect()


def test_a_given_reference_ends_the_cascade(spark):
    known = spark.createDataFrame([(1, "r1", "ann", 7), (2, "r2", "bob", 7), (3, None, "cy", 8), (4, None, "cy", 8)], "id int, ref string, name string, team int")
    tiers = [
        match.Tier("reference", match.registered(known, ["ref"], "id"), ["ref"], "unknown reference"),
        match.Stop(F.trim(F.coalesce("name", F.lit(""))) == "", "blank name"),
        match.Tier("alias", match.registered(known.where("id = 1").withColumn("name", F.lit("annie")), ["name"], "id"), ["name"]),
        match.Tier("team", match.registered(known, ["team", "name"], "id", "none"), ["team", "name"], "unknown in team"),
    ]
    rows = [(1, "r2", "annie", 7), (2, "r9", "annie", 7), (3, None, " ", 7), (4, None, "annie", None), (5, None, "bob", 7), (6, None, "bob", 8), (7, None, "cy", 8), (8, None, "bob", None), (9, None, None, 7)]
    got = match.cascade(spark.createDataFrame(rows, "n int, ref string, name string, team int"), tiers, "id").orderBy("n").collect()
    assert [(r.id, r.method, r.reason) for r in got] == [
        (2, "reference", None), (None, None, "unknown reference"), (None, None, "blank name"), (1, "alias", None), (2, "team", None),
        (None, None, "unknown in team"), (None, None, "unknown in team"), (None, None, "unknown"), (None, None, "blank name"),
    ]


def test_conflicting_registrations_fail(spark):
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "id int, name string")
    assert sorted(map(tuple, match.registered(twice, ["name"], "id").collect())) == [("x", 1), ("y", 2)]
    with pytest.raises(Exception, match="several ids: x"):
        match.registered(twice.union(spark.sql("select 9, 'x'")), ["name"], "id").collect()
    assert [r.name for r in match.registered(twice.union(spark.sql("select 9, 'x'")), ["name"], "id", "none").collect()] == ["y"]
