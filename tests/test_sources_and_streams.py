"""Requests, landed pages, stores and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from priorline.sources import pages, stores
from priorline.streaming import sequences


def client(answers):
    calls, waits = [], []
    it = iter(answers)

    def fetch(path, params):
        calls.append(params)
        got = next(it)
        if isinstance(got, Exception):
            raise got
        return got

    return pages.Client(fetch, sleep=waits.append), calls, waits


def test_retries_and_retry_after():
    c, _, waits = client([(500, {}, None), (429, {"Retry-After": "7"}, None), TimeoutError(), (200, {}, {"ok": 1})])
    assert c.get("/x") == {"ok": 1}
    assert waits == [1.0, 8.0, 4.0]


def test_errors_are_not_retried():
    c, calls, _ = client([(404, {}, None)])
    with pytest.raises(pages.SourceError):
        c.get("/x")
    assert len(calls) == 1


def test_pagination_ends_and_limits():
    body = lambda cur, items=(1,): (200, {}, {"data": list(items), "next": cur})
    c, _, _ = client([body("a"), body("b"), body(None)])
    assert len(list(c.pages("/x", {}, "data", lambda b: b["next"]))) == 3
    c, _, _ = client([body("a"), body("a")])
    assert len(list(c.pages("/x", {}, "data", lambda b: b["next"]))) == 2
    c, _, _ = client([body(str(i)) for i in range(5)])
    with pytest.raises(pages.SourceError):
        list(c.pages("/x", {}, "data", lambda b: b["next"], max_pages=3))


def test_landed_games(spark, tmp_path):
    team = lambda i, a: {"id": i, "abbreviation": a, "full_name": a}
    game = {"id": 1, "date": "2024-01-02", "season": 2023, "status": "Final", "home_team": team(1, "A"), "visitor_team": team(2, "B"), "home_team_score": 9, "visitor_team_score": 9, "datetime": "2024-01-03T00:30:00Z"}
    df = pages.land(spark, iter([{"data": [game, {**game, "id": 2, "home_team_score": 12}]}, {"data": [{**game, "status": "later"}]}, {"bad": 1}]), f"{tmp_path}/p")
    got = {r.game_id: r for r in pages.games(df).collect()}
    assert got[1].home_win is None and got[1].is_final and got[2].home_win is True and got[1].pair_key == "2024-01-02|A|B"
    with pytest.raises(Exception):
        pages.land(spark, iter([]), f"{tmp_path}/p")


def test_candles_in_both_spellings(spark):
    raw = json.dumps({"candlesticks": [{"end_period_ts": 1, "yes_bid": {"close": "0.40"}, "yes_ask": {"close_dollars": "1.5"}}, {"end_period_ts": 1, "yes_bid": {"close_dollars": "0.41"}, "volume_fp": "3"}]})
    rows = pages.candles(spark.createDataFrame([("m", 0, raw)], "market string, page int, raw string")).collect()
    assert [(r.ts, r.bid, r.ask, r.volume) for r in rows] == [(1, 0.41, None, 3.0)]


def test_snapshots_append_once(spark, tmp_path):
    cap = spark.createDataFrame([("s", 10, "r", "x"), ("s", 10, "r", "x"), ("s", 90000, "r", "y")], "source string, retrieved_ts long, request string, payload string")
    path = f"{tmp_path}/snap"
    assert stores.append_snapshots(cap, path) == 2
    assert stores.append_snapshots(cap, path) == 0
    assert [r.payload for r in stores.replay(spark, path, "s", 10, 10).collect()] == ["x"]


def test_cache_is_by_whole_request(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for want in (False, True):
        df, hit = stores.cached(spark, str(tmp_path), {"season": "2020", "kind": "a"}, make)
        assert hit is want and df.count() == 3
    assert stores.cached(spark, str(tmp_path), {"season": "2021", "kind": "a"}, make)[1] is False
    assert len(made) == 2
    # Requests that a file name could confuse are different ones.
    odd = [{"t": "a/b"}, {"t": "a-b"}, {"a": "1", "b": "2"}, {"a": "1__b=2"}]
    tables = [stores.cached(spark, str(tmp_path), r, lambda i=i: spark.range(i, i + 1))[0].first().id for i, r in enumerate(odd)]
    assert tables == [0, 1, 2, 3] and [stores.cached(spark, str(tmp_path), r, make)[1] for r in odd] == [True] * 4


def test_archive_conflicts(spark, tmp_path):
    for d, body in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.pdf").write_bytes(body)
    rows = stores.archive(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and len({r.sha256 for r in rows}) == 2 and any(r.conflict for r in rows)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    kind = "game_id long, ts long, season int, team int, won boolean, margin int"
    src = f"{tmp_path}/in"
    add = lambda *rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    replay = lambda: sequences.run_to_end(sequences.form_stream(spark.readStream.schema(kind).parquet(src)), f"{tmp_path}/ck", f"{tmp_path}/out")
    # Within a file in any order; a contest without result leaves nothing behind.
    add((2, 20, 1, 7, False, -3), (1, 10, 1, 7, True, 5), (3, 21, 1, 7, None, 0))
    replay()
    # The next file has rows before and after each other; one comes after the watermark has passed it and is refused.
    add((5, 40, 1, 7, True, 9), (4, 30, 1, 7, True, 4), (9, 5, 1, 7, True, 99))
    replay()
    add((0, 4_000, 2, 0, None, 0))
    got = replay().where("team = 7").orderBy("game_id").collect()
    assert [(r.game_id, r.games_played, r.win_rate, r.mean_margin) for r in got] == [
        (1, 0, None, None), (2, 1, 1.0, 5.0), (3, 2, 0.5, 1.0), (4, 2, 0.5, 1.0), (5, 3, pytest.approx(2 / 3), 2.0),
    ]
    assert [r.rest_days for r in got][3] == pytest.approx(10 / 86400)


def test_stream_candles_and_captures_plan(spark):
    ticks = spark.readStream.format("rate").load().select(F.col("timestamp").alias("at"), F.lit("m").alias("market"), F.col("value").cast("double").alias("price"))
    assert sequences.candles(ticks).isStreaming
    cap = ticks.select("at", F.lit("s").alias("source"), F.lit("r").alias("request"), F.col("price").cast("string").alias("payload"))
    assert sequences.captures_once(cap).isStreaming


def test_runner_outcomes():
    from priorline.sources.capture import Runner

    answers = {1: (200, b"x"), 2: (404, None), 3: (403, None), 9: (403, None)}
    tasks = [{"task_id": i, "capture_ts": i, "anchor_ts": 50} for i in (3, 1, 2, 4)] + [{"task_id": 8, "capture_ts": 60, "anchor_ts": 70}, {"task_id": 7, "capture_ts": 1, "anchor_ts": 5}]

    def fetch(task):
        if task["task_id"] == 4:
            raise OSError("gone")
        return answers[task["task_id"]]

    run = Runner(fetch, set(), {"task_id": 9}, sleep=lambda s: None)
    assert [(r["task_id"], r["outcome"], r["trustworthy"]) for r in run.run(tasks, 10)] == [(1, "captured", True), (2, "missing", True), (3, "refused", False), (4, "failed", True)]
    assert next(run.run(tasks[1:2], 10))["outcome"] == "already_captured"


def test_parse_failures_are_rows(spark):
    from priorline.sources.capture import parsed

    files = spark.createDataFrame([("a", b"1 2"), ("b", b"x"), ("c", b"")], "path string, content binary")
    rows = parsed(files, lambda b: [{"n": int(x)} for x in b.split()], "n long").collect()
    assert sorted((r.path, r.n, bool(r.error)) for r in rows if r.path == "a") == [("a", 1, False), ("a", 2, False)]
    assert [(r.path, bool(r.error)) for r in rows if r.path != "a"] == [("b", True)]


def test_season_pages_check_before_they_ask():
    c, calls, _ = client([(200, {}, {"data": [1], "meta": {"next_cursor": 5}}), (200, {}, {"data": [2], "meta": {}})])
    with pytest.raises(ValueError):
        pages.season_pages(c, 2020, 500)
    assert not calls
    assert [p["data"] for p in pages.season_pages(c, 2020, 50, ("2020-10-01", "2021-06-30"))] == [[1], [2]]
    assert calls[0] == {"seasons[]": 2020, "per_page": 50, "start_date": "2020-10-01", "end_date": "2021-06-30"} and calls[1]["cursor"] == 5


def test_season_feed_refuses_other_seasons():
    c, _, _ = client([(200, {}, {"data": [{"game": {"season": 2019}}]})])
    with pytest.raises(pages.SourceError):
        list(pages.season_feed(c, "stats", 2020))


def test_archive_falls_back_to_live_once_and_is_remembered():
    ask = pages.candle_request("T", 100, 200, 60)
    with pytest.raises(ValueError):
        pages.candle_request("T", 100, 200, 5)
    with pytest.raises(ValueError):
        pages.candle_request("T", 200, 100)
    cache = {}
    c, calls, _ = client([(404, {}, None), (200, {}, {"candlesticks": []}), (200, {}, {"a": 1}), (400, {}, None)])
    assert pages.fetched(c, ask, 300, cache) == ({"candlesticks": []}, "live")
    assert pages.fetched(c, ask, 300, cache)[1] == "cache" and len(calls) == 2
    assert pages.fetched(c, pages.candle_request("T", 100, 400), 300) == ({"a": 1}, "live")
    with pytest.raises(pages.SourceError):
        pages.fetched(c, ask, 300)


def test_cutoff_and_events():
    c, _, _ = client([(200, {}, {"cutoff_ts": "170"}), (200, {}, {}), (200, {}, {"events": [1], "cursor": ""})])
    assert (pages.historical_cutoff(c), pages.historical_cutoff(c)) == (170, None)
    assert len(list(pages.event_pages(c, "S", "open"))) == 1


def test_landings_are_read_back_by_name(spark, tmp_path):
    assert pages.latest_landing(spark, f"{tmp_path}/raw") is None
    pages.land(spark, ({"n": i} for i in range(120)), f"{tmp_path}/raw/2024-01-01T00")
    pages.land(spark, iter([]), f"{tmp_path}/raw/2024-01-02T00")
    pages.land(spark, iter([{"n": 7}]), f"{tmp_path}/raw/2024-01-02T06")
    assert [r.name for r in pages.landings(spark, f"{tmp_path}/raw").collect()] == ["2024-01-01T00", "2024-01-02T00", "2024-01-02T06"]
    assert pages.latest_landing(spark, f"{tmp_path}/raw").first().raw == '{"n": 7}'
    first = spark.read.parquet(f"{tmp_path}/raw/2024-01-01T00")
    assert first.count() == 120 and first.agg(F.max("page")).first()[0] == 119


def test_the_rest_stands_without_the_training_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "priorline", tmp_path / "priorline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    n, whole, some = out.stdout.split()
    assert int(n) > 100 and whole == "True" and some == "False"
    for path in (root / "priorline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "priorline.llm" not in path.read_text(), path


def test_declared_corrections_fail_loudly(spark):
    from priorline.operators import audit

    fix = spark.createDataFrame([(1, 90, 95)], "game_id long, expects_home_score int, new_home_score int")
    good = spark.createDataFrame([(1, 90, 91, False), (2, 80, 70, True)], "game_id long, home_score int, away_score int, home_win boolean")
    out = audit.corrected(good, fix, ["game_id"]).orderBy("game_id").collect()
    assert [(r.home_score, r.home_win, r.corrected, r.source_home_score) for r in out] == [(95, True, True, 90), (80, True, False, 80)]
    odd = spark.createDataFrame([(1, 89, 91, False)], good.schema)
    with pytest.raises(Exception, match="not as declared"):
        audit.corrected(odd, fix, ["game_id"]).collect()
    assert audit.corrected(odd, fix, ["game_id"], strict=False).first().refused


def test_eastern_slots_in_summer(spark):
    from priorline.functions import values

    df = spark.createDataFrame([("2024-07-01 16:30:00",), ("2024-01-01 16:30:00",)], "t string").select(F.unix_timestamp("t").alias("s"))
    got = df.select(values.slot_file(F.col("s")).alias("f"), values.slot_of_file(values.slot_file(F.col("s"))).alias("b"), "s").collect()
    assert [r.f for r in got] == ["Injury-Report_2024-07-01_12_30PM.pdf", "Injury-Report_2024-01-01_11_30AM.pdf"]
    assert all(r.b == r.s for r in got)
    assert df.select(values.slot_of_file(F.lit("other.pdf")).alias("b")).first().b is None


def test_verified_season(spark):
    from priorline.operators import feeds

    good = spark.sql("select 2020 as season, date '2020-10-20' as date union all select 2020, date '2021-04-01'")
    assert feeds.verified_season(good, 2020).count() == 2
    for odd in ("2021, date '2020-12-01'", "2020, date '2021-08-01'"):
        with pytest.raises(Exception, match="season 2020"):
            feeds.verified_season(good.union(spark.sql(f"select {odd}")), 2020).collect()
    from priorline.functions.values import season_list

    assert season_list("2006-2008, 2011") == [2006, 2007, 2008, 2011]
    with pytest.raises(ValueError):
        season_list(" , ")
