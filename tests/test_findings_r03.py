"""Faults that larger or odder tables than the smallest ones showed."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from priorline.plans import catalogue
from tests.test_oracles import plain

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name: str, folder, **tables):
    """A query over ``tables`` (name -> DataFrame), laid into ``folder``, against its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_tickers_of_parts_beyond_five_digits(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") * 7919 + 99_990)
    same_as_sql(spark, "collapse_events", tmp_path, lineitem=lines)


def test_a_season_of_very_many_pages_is_read_whole():
    """One client, 10,500 pages: more than the cap there was; a cap that is asked for is an error."""
    from priorline.sources import paged, pages

    client = pages.Client(lambda path, params: (200, {}, {"data": [1], "meta": {"next_cursor": n if (n := int(params.get("cursor", 0)) + 1) < 10_500 else None}}))
    assert sum(1 for _ in paged.season_rows(client, 2000, {"path": "x"})) == 10_500
    with pytest.raises(pages.SourceError, match="more than 3 pages"):
        list(paged.season_rows(client, 2000, {"path": "x"}, 3))


def test_calls_to_state_grow_with_lots_not_with_rows():
    """A lot appends a batch once and takes all that is due at once, whatever its keys and instants are."""
    import pandas as pd

    from priorline.streaming import timed

    calls = []

    class Held:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendValue", "update"):
                    self.rows = self.rows + [args[0]] if name == "appendValue" else [args[0]]
                elif name == "clear":
                    self.rows = []
                return {"exists": bool(self.rows), "get": (self.rows[0] if self.rows and self is not waiting else iter(self.rows))}.get(name)

            return call

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 10_000_000)

    waiting, lot = Held(), timed._Form(["team"])
    lot.handle, lot.waiting, lot.next, lot.state = Held(), waiting, Held(), Held()
    n = 5000
    rows = pd.DataFrame({"lot_": 0, "team": [i % 1000 for i in range(n)], "nulls_": 0, "at": None, "ts": range(n), "game_id": range(n), "known": True, "wins": 1, "margin": 2.0})
    list(lot.handleInputRows((0,), iter([rows]), Clock))
    (out,) = lot.handleExpiredTimer((0,), Clock, None)
    assert len(out) == n and sorted(set(out["games_played"])) == [0, 1, 2, 3, 4] and len(calls) < 20


def test_losses_are_added_up_in_the_rating_pass(spark):
    """As from rated rows joined with their results, but contests x configurations are never rows."""
    from priorline.operators import recursive, selection
    from priorline.plans.views import contests

    c = contests(spark, SF).where("season < 2000")
    configs = [recursive.EloConfig(k, 40.0, 0.5, first, m, only) for k in (10.0, 30.0) for first in (None, 1997) for m in (None, "log") for only in ((1998,), (1996, 1999))]
    configs += [recursive.EloConfig(5.0 + i) for i in range(recursive.SIDE_BY_SIDE)]
    rated = recursive.elo(c, configs).where("home_probability is not null").join(c.select("game_id", "home_win"), "game_id")
    kept = lambda df: {(r.config_id, r.season): (r.n, pytest.approx(r.brier, abs=1e-9), pytest.approx(r.log_loss, abs=1e-9)) for r in df.collect()}
    losses = recursive.elo_losses(c, configs)
    got = {(r.config_id, r.season): (r.n, r.brier / r.n, r.log_loss / r.n) for r in losses.collect()}
    assert got == kept(selection.per_fold(rated, ["config_id"], "home_win", "home_probability"))
    assert len({k for k, _ in got}) == len(configs)


def test_load_is_counted_across_batches(spark):
    """Rows of one side far apart in batches, at equal instants, without results and without an instant."""
    from priorline.operators import sequence

    day = 86400
    rows = [(1, 1, g, (g // 3) * day // 2, g % 4 != 0) for g in range(400)] + [(1, 2, 900, 0, True), (1, 2, 901, None, True), (1, 2, 902, None, True), (2, 1, 903, 5, None)]
    df = spark.createDataFrame([(s, t, g, ts, w or None) for s, t, g, ts, w in rows], "season int, team int, game_id long, ts long, won boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.game_id: (r.games_3d, r.games_5d, r.games_7d, r.third_in_4, r.fourth_in_6) for r in sequence.load(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def n(row, days):
        s, t, g, ts, _ = row
        near = lambda x: x is None if ts is None else x is not None and ts - days * day <= x < ts
        return sum(1 for s2, t2, g2, x, w in rows if (s2, t2) == (s, t) and w and near(x))

    assert got == {r[2]: (n(r, 3), n(r, 5), n(r, 7), n(r, 4) >= 2, n(r, 6) >= 3) for r in rows}


def test_recorded_games_are_numbered_by_days(spark):
    """As one dense rank over a side's season: several games a day, equal instants, rows without an instant or a season."""
    from pyspark.sql import Window as W

    from priorline.operators import rotation

    rows = [(s, t, None if g == 5 else g // 4 * 40_000, g, p) for s in (1, None) for t in (1, 2) for g in range(30) for p in range(3)]
    df = spark.createDataFrame(rows, "season int, team int, ts long, game_id long, player int")
    want = df.withColumn("game_no", F.dense_rank().over(W.partitionBy("season", "team").orderBy("ts", "game_id")))
    numbered = rotation.numbered(df)
    assert sorted(map(str, numbered.collect())) == sorted(map(str, want.collect()))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert not [w for w in plan.splitlines() if "dense_rank" in w]  # no window sorts a side's season of appearances


def test_few_configurations_are_rated_apart(spark):
    """A task each, with the figures of a pass that many share."""
    from priorline.operators import recursive
    from priorline.plans.views import contests

    c = contests(spark, SF)
    configs = [recursive.EloConfig(k, 40.0, 0.5, first, m) for k in (10.0, 30.0) for first in (None, 1997) for m in (None, "log", "fivethirtyeight")]
    rated = recursive.elo(c, configs)
    assert rated.rdd.getNumPartitions() == len(configs)
    kept = lambda df: {(r.config_id, r.game_id): r[5:] for r in df.where(f"config_id < {len(configs)}").collect()}
    got, want = kept(rated), kept(recursive.elo(c, configs + [recursive.EloConfig()] * recursive.APART))
    assert got.keys() == want.keys()
    assert all(x == (None if y is None else pytest.approx(y, abs=1e-8)) for k, row in got.items() for x, y in zip(row, want[k], strict=True))


def test_appearances_are_added_up_in_tasks_of_bounded_size(spark, monkeypatch):
    """More order lines make more tasks, not larger ones."""
    from priorline.plans import views

    few = views.box(spark, SF)
    monkeypatch.setattr(views, "LINES_A_TASK", 500)
    many = views.box(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert many.rdd.getNumPartitions() >= lines // 500 > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_pasts_are_followed_once_and_across_batches(spark):
    """Means before each value by whole columns: nulls, an infinite value and groups that several batches cut."""
    import math

    from priorline.operators import sequence

    plan = catalogue.QUERIES["efficiency_by_contest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    x = lambda t, g: None if g % 5 == 2 else math.inf if (t, g) == (2, 70) else math.sin(g * t) * 50
    rows = [(1, t, g, g, x(t, g)) for t in (1, 2) for g in range(100)]
    df = spark.createDataFrame(rows, "season int, team int, game_id long, ts long, x double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r.team, r.game_id): r for r in sequence.trailing_means(df, {"x": "x"}, (3, 7), 5.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for (t, g), r in got.items():
        held = [v for i in range(g) if (v := x(t, i)) is not None]
        weights = [0.5 ** ((len(held) - 1 - i) / 5) for i in range(len(held))]
        mean = lambda v: sum(v) / len(v) if v else None
        want = [mean(held), mean(held[-3:]), mean(held[-7:]), sum(w * v for w, v in zip(weights, held, strict=True)) / sum(weights) if held else None]
        assert [r.x_mean, r.x_last3, r.x_last7, r.x_ewma] == [None if v is None else pytest.approx(v, abs=1e-9) for v in want]


def test_pairs_grow_with_a_group_of_near_copies_not_with_its_square(spark):
    """op5, op10, pipeline: 12 and 60 near copies; what blocks emit grows with the rows, and all are one component."""
    import random

    from priorline.llm import jaccard

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def emitted(n):
        texts = [" ".join([*base[: i * 5], "x", *base[i * 5 + 1 :]]) for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.component_id for r in jaccard.linked(docs).collect()} == {0}
        rows = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
        hot = jaccard.hot_columns(jaccard.counted_heads(jaccard.signatures(rows, 4), 4), jaccard.HOT_COLUMNS)
        return jaccard.blocks(jaccard.entries(rows, hot, 4), 4).count()

    assert emitted(60) < 7 * emitted(12)


def test_hashed_words_are_those_that_blanks_part():
    """Words hashed by whole arrays: as many as split finds, equal where they are, long words and many pieces too."""
    import random

    from priorline.llm import jaccard

    rng = random.Random(1)
    text = b"".join(rng.choice((b"a", b"B", b"b", b"\xc3\xa9", b" ", b"\n", b"\t", b"\x0b")) for _ in range(200_000))
    text = b" " + text + b" " + b"q" * 64 + b" " + b"Q" * 65 + b"\r" + b"z" * 150_000 + b"\x0c" + b"q" * 65 + b" end"
    words, hashes = text.lower().split(), jaccard.word_hashes(text).tolist()
    assert len(words) == len(hashes) and len(set(hashes)) == len(set(words)) == len(set(zip(words, hashes, strict=True)))


def test_only_lines_of_shared_leaves_are_hashed_whole(spark):
    """op5: a line alone in its leaf cannot recur; shared leaves keep every line, digits apart."""
    from priorline.llm import templates

    texts = ["one two three four five", "one two three four six", "7 two three four five", "x8 two three four five", "alone in its own leaf", "one two three four five seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key long, text string")
    assert {r.row_key for r in templates.lines_of(docs).collect()} == {0, 1, 2, 3}


def test_a_feed_ends_in_its_last_file_and_stores_write_changes(spark, tmp_path, monkeypatch):
    """no micro-batch for the end alone, and no store is written anew in every micro-batch."""
    from priorline.plans import flows
    from priorline.streaming import timed

    monkeypatch.setattr(flows, "scratch", lambda spark, kind: f"file://{tmp_path}/{kind}")
    rows = spark.range(400).selectExpr("id as game_id", "(id + 1) * 1000 as ts", "1 as season", "cast(id % 3 as int) as team", "id % 2 = 0 as won", "cast(id % 7 as int) as margin")
    feed = flows.fed(rows, "sides", "ts", {"game_id": 0, "ts": flows.END, "season": 9999, "team": 0, "margin": 0})
    parts = [spark.read.parquet(str(p)) for p in sorted(tmp_path.glob("sides/feed/part=*"))]
    assert len(parts) == 4 and [p.where("season = 9999").count() for p in parts] == [0, 0, 0, 1] and sum(p.count() for p in parts) == 401
    before = spark.conf.get(timed.CHANGES, None)
    out, refused = timed.run(timed.form_stream(feed), f"file://{tmp_path}/stream", f"file://{tmp_path}/form")
    assert out.where("season < 9999").count() == 400 and refused == 0 and spark.conf.get(timed.CHANGES, None) == before
    assert list(tmp_path.glob("stream/state/**/*.changelog"))


def test_words_of_a_line_are_counted_as_split_finds_them():
    """op5: lines, their numbers and leaves are those of words cut out, whatever blanks part them, and repeated shingles count once."""
    import random

    from priorline.llm import jaccard, templates

    def plain(text):
        for number, line in enumerate(text.split(b"\n")):
            if len(words := line.split()) >= templates.MIN_TOKENS:
                yield number, line, templates.leaf_of(words[: templates.DEPTH], len(words))

    rng = random.Random(3)
    for odd in ([], [b"  "], [b"\t", b"\x0b", b"\r", b"\x0c"]):
        text = b"".join(rng.choice([b"a", b"1", b" b", b" ", b"\n", b"\xc3\xa9", b"zz ", b"\xc2\xa0", *odd]) for _ in range(20_000))
        for own in (text, text + b"\n", b" " + text, b"", b"\n", b"1 2 3 4 5", b"1 2 3 4"):
            assert list(templates.long_lines(own)) == list(plain(own))
    row = jaccard.row_of(b"one two three four five six " * 9)
    assert len(row) == 6 and (row[1:] > row[:-1]).all()
