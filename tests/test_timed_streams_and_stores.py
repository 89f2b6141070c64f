"""Streams with timers, snapshots, the paged data source, the archive, header anchors and input order."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from priorline.sources import archive, paged, pages, report_rows, stores
from priorline.streaming import snapshots, timed

END = 4102444800


def add(spark, path, kind, *rows):
    spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(path)


def test_asof_stream_refuses_late_rows_and_goes_on_after_a_restart(spark, tmp_path):
    a, o = "k string, id long, t long", "k string, oid long, t long, v string"

    def replay():
        left = spark.readStream.schema(a).parquet(f"{tmp_path}/a")
        right = spark.readStream.schema(o).parquet(f"{tmp_path}/o")
        return timed.run(timed.asof_stream(left, right, ["k"], "t", "t", "oid"), f"{tmp_path}/ck", f"{tmp_path}/out")

    add(spark, f"{tmp_path}/a", a, ("x", 100, 50), ("x", 101, 10), ("y", 102, 30), ("x", 103, 5), (None, 104, 30))
    add(spark, f"{tmp_path}/o", o, ("x", 1, 20, "x"), ("x", 2, 10, "y"), ("x", 3, 10, "z"), ("x", 4, 49, "w"), (None, 5, 29, "n"), ("y", 6, None, "?"))
    first, refused = replay()
    # The older watermark counts: the anchor at 50 still waits, as observations up to 50 may come.
    assert refused == 0 and {r.id for r in first.collect()} == {101, 102, 103, 104}
    add(spark, f"{tmp_path}/a", a, ("x", 105, 70), ("-", 999, END))
    add(spark, f"{tmp_path}/o", o, ("x", 7, 15, "late"), ("x", 8, 60, "q"), ("-", 0, END, None))
    out, refused = replay()
    got = {r.id: (r.seen_oid, r.seen_v, r.staleness) for r in out.where("id < 999").collect()}
    assert refused == 1
    assert got == {100: (4, "w", 1), 101: (3, "z", 0), 102: (None, None, None), 103: (None, None, None), 104: (5, "n", 1), 105: (8, "q", 10)}


def test_due_captures_fire_once_through_moves_and_restarts(spark, tmp_path):
    kind = "game long, told long, starts long"
    src = f"{tmp_path}/in"

    def replay():
        feed = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
        due = timed.due_captures(feed, "game", "told", "starts", ["m", "r"], [500, 300, 100], 200)
        return sorted(map(tuple, timed.run(due, f"{tmp_path}/ck", f"{tmp_path}/out")[0].collect()))

    add(spark, src, kind, (1, 100, 1000), (2, 100, 1000), (3, 100, 1000), (4, 650, 1000), (5, 100, 1000))
    assert replay() == [(g, s, 500, 500, 800) for g in (1, 2, 3, 5) for s in "mr"]  # the watermark is at 650
    # Game 2 moves before its second capture, 3 is cancelled, 5 moves there and back; nothing is planned past the anchor.
    add(spark, src, kind, (2, 660, 2000), (3, 660, None), (5, 660, 3000), (5, 670, 1000), (-1, END, None))
    got = replay()
    assert [r for r in got if r[0] == 1] == [(1, s, b, 1000 - b, 800) for s in "mr" for b in (300, 500)]
    assert [r for r in got if r[0] == 2] == [(2, s, b, t, a) for s in "mr" for b, t, a in ((300, 1700, 1800), (500, 500, 800))]
    assert [r for r in got if r[0] == 3] == [(3, s, 500, 500, 800) for s in "mr"]
    assert [r for r in got if r[0] == 4] == [(4, s, 300, 700, 800) for s in "mr"]
    assert [r for r in got if r[0] == 5] == [(5, s, b, 1000 - b, 800) for s in "mr" for b in (300, 500)]
    assert replay() == got


def test_snapshots_are_written_once_a_batch_whatever_crashes(spark, tmp_path):
    kind = "source string, request string"
    path, src, asked = f"{tmp_path}/snaps", f"{tmp_path}/in", f"{tmp_path}/asked"

    def fetch(source, request):
        with open(asked, "a") as f:
            f.write("x")
        if source == "down":
            raise OSError("gone")
        return {"data": [1, 2]} if request == "1" else [3]

    clock = iter([1000, 2000, 3000])
    add(spark, src, kind, ("up", "1"), ("up", "1"), ("down", "1"), ("off", "1"), (None, "2"))
    feed = lambda: spark.readStream.schema(kind).parquet(src)
    assert snapshots.captured(spark, path).collect() == []
    snapshots.capture(feed(), path, f"{tmp_path}/ck", fetch, lambda: next(clock), {"off": "no contract"})
    rows = {r.source: r for r in snapshots.captured(spark, path).collect()}
    assert {(s, r.status, r.records) for s, r in rows.items()} == {("up", "captured", 2), ("down", "failed", 0), ("off", "disabled", 0), ("", "captured", 1)}
    assert "OSError: gone" in rows["down"].detail and rows["off"].detail == "no contract" and {r.observed_ts for r in rows.values()} == {1000}
    # Batch 1 dies after its rows are written but before it is complete, so it is run again; a complete one adds nothing.
    add(spark, src, kind, ("up", "2"))
    write = snapshots.batch_writer(path, fetch, lambda: next(clock))
    write(spark.createDataFrame([("up", "2")], kind), 1)
    (tmp_path / "snaps" / "batch=1" / "_SUCCESS").unlink()
    assert snapshots.captured(spark, path).count() == 4
    snapshots.capture(feed(), path, f"{tmp_path}/ck", fetch, lambda: next(clock))
    before = len(open(asked).read())
    write(spark.createDataFrame([("up", "2")], kind), 1)
    assert len(open(asked).read()) == before
    new = snapshots.captured(spark, path).where("batch = 1").collect()
    assert [(r.request, r.observed_ts) for r in new] == [("2", 3000)]
    known = snapshots.known_at(snapshots.captured(spark, path), F.lit(1500)).collect()
    assert {(r.source, r.request, r.staleness) for r in known} == {("up", "1", 500), ("", "2", 500)}


def feed_client(options):
    """Two pages a season; the archive lacks 2001, and nobody has 2009."""

    def fetch(path, params):
        season, cursor = params["seasons[]"], params.get("cursor")
        if season == 2009 or (path == "archive" and season == 2001):
            return 404, {}, None
        if season == 2003:
            return 200, {}, {"data": []}
        return 200, {}, {"data": [season * 10 + (cursor or 0)], "meta": {"next_cursor": None if cursor else 7}}

    return pages.Client(fetch)


def test_season_pages_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(paged.SeasonPages)
    options = {"client": "tests.test_timed_streams_and_stores:feed_client", "path": "archive", "fallback": "live", "seasons": "2000-2001, 2003"}
    rows = spark.read.format("season_pages").options(**options).load()
    assert rows.rdd.getNumPartitions() == 3
    want = [(s, p, n, [s * 10 + (7 if n else 0)]) for s, p in ((2000, "archive"), (2001, "live")) for n in (0, 1)]
    read = lambda df: sorted((r.season, r.source, r.page, json.loads(r.raw)["data"]) for r in df.collect())
    assert read(rows) == want
    with pytest.raises(Exception, match="status 404"):
        spark.read.format("season_pages").options(**options | {"seasons": "2009"}).load().collect()
    stream = spark.readStream.format("season_pages").options(**options).load()
    for _ in range(2):  # the second time its checkpoint says that all is read
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        assert read(spark.read.parquet(f"{tmp_path}/out")) == want


def test_season_rows_end_at_a_repeated_cursor_and_refuse_endless_feeds():
    loop = pages.Client(lambda path, params: (200, {}, {"data": [1], "meta": {"next_cursor": 5}}))
    assert len(list(paged.season_rows(loop, 2000, {"path": "p"}))) == 2
    n = iter(range(1, 100))
    endless = pages.Client(lambda path, params: (200, {}, {"data": [1], "meta": {"next_cursor": next(n)}}))
    with pytest.raises(pages.SourceError, match="more than 4"):
        list(paged.season_rows(endless, 2000, {"path": "p"}, 4))


def test_archive_of_racing_writers_and_a_rerun(spark, tmp_path):
    root = f"file://{tmp_path}/arch"
    assert archive.scan(spark, root).collect() == []
    kind = "name string, content binary, retrieved_ts long"
    first = spark.createDataFrame([("a.pdf", b"1", 10), ("b/c.pdf", b"1", 10), ("b-c.pdf", b"", 10), (None, b"x", 1), ("n", None, 1)], kind)
    late = spark.createDataFrame([("a.pdf", b"2", 20), ("a.pdf", b"1", 30)], kind)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: archive.put(first.union(late).repartition(3), root).count(), range(2)))
    assert archive.put(first.union(late), root).where("new").count() == 0
    rows = {(r.name, r.sha256[:4]): r for r in archive.scan(spark, root).collect()}
    assert len(rows) == 4 and len(list((tmp_path / "arch" / "objects").rglob("*"))) - len(list((tmp_path / "arch" / "objects").iterdir())) == 3
    assert sorted((r.name, r.conflict, r.bytes) for r in rows.values()) == [("a.pdf", False, 1), ("a.pdf", True, 1), ("b-c.pdf", False, 0), ("b/c.pdf", False, 1)]
    held = archive.contents(spark, root, archive.scan(spark, root, conflicts=False))
    assert sorted((r.name, bytes(r.content)) for r in held.collect()) == [("a.pdf", b"1"), ("b-c.pdf", b""), ("b/c.pdf", b"1")]
    damaged = next(p for p in (tmp_path / "arch" / "objects").rglob("*") if p.is_file() and p.read_bytes() == b"2")
    damaged.write_bytes(b"3")
    for crc in damaged.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="damaged or missing"):
        archive.contents(spark, root, archive.scan(spark, root)).collect()


def test_columns_by_header_rows(spark):
    head = lambda f, p, y, shift: [(f, p, y, x + shift, w) for x, w in ((10.0, "Game"), (40.0, "Date"), (100.0, "Team"), (200.0, "Player Name"), (300.0, "Note"))]
    cells = [("f", 0, 0.0, 5.0, "printed above")] + head("f", 0, 1.0, 0.0)
    cells += [("f", 0, 2.0, 9.0, "d1"), ("f", 0, 2.0, 98.5, "t1"), ("f", 0, 2.0, 201.0, "Doe,"), ("f", 0, 2.0, 250.0, "Ann"), ("f", 0, 2.0, 1.0, "x")]
    cells += [("f", 1, 0.0, 300.0, "wrapped")] + head("f", 2, 0.0, 50.0) + [("f", 2, 1.0, 148.0, "t2"), ("f", 2, 1.0, 355.0, None)]
    cells += head("g", 0, 0.0, 500.0) + [("g", 0, 1.0, 600.0, "t3")] + [("none", 0, 0.0, 10.0, "Game"), ("none", 0, 0.0, 40.0, "Team"), ("none", 0, 1.0, 10.0, "lost")]
    df = spark.createDataFrame(cells, "file string, page int, y double, x double, text string")
    labels, names = ("Game Date", "Team", "Player Name"), ("game_date", "team", "player")
    heads = report_rows.header_rows(df, labels)
    assert sorted((r.file, r.page, list(r.anchors)) for r in heads.collect()) == [("f", 0, [10.0, 100.0, 200.0]), ("f", 2, [60.0, 150.0, 250.0]), ("g", 0, [510.0, 600.0, 700.0])]
    got = sorted((r.file, r.page, r.y, r.game_date, r.team, r.player) for r in report_rows.by_headers(df, labels, names).collect())
    assert got == [("f", 0, 2.0, "x d1", "t1", "Doe, Ann"), ("f", 1, 0.0, None, None, "wrapped"), ("f", 2, 1.0, None, "t2", ""), ("g", 0, 1.0, None, "t3", None)]


def test_first_of_each_key_over_several_files(spark, tmp_path):
    for i, rows in enumerate(([(1, "a"), (2, "b"), (None, "c")], [(1, "d"), (3, "e"), (None, "f"), (3, "g")])):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    both = stores.in_order(spark, f"{tmp_path}/part=0", f"{tmp_path}/part=1").select("k", "v", "file", "ordinal")
    assert {(r.k, r.v) for r in stores.keep_first(both.repartition(5), ["k"]).collect()} == {(1, "a"), (2, "b"), (None, "c"), (3, "e")}
    assert stores.keep_first(both.where("false"), ["k"]).collect() == []
