"""Nothing that is known later may change what is said earlier; worked numbers; order of rows does not matter."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from priorline.operators import recursive, sequence

KIND = "game_id long, ts long, season int, home int, away int, home_score int, away_score int, home_win boolean"


def season(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, a = rng.sample(range(1, 7), 2)
        x, y = rng.randint(80, 120), rng.randint(80, 120)
        rows.append((i, 1_000_000 + 40_000 * (i // 2), 2000 + i // 40, h, a, x, y, None if x == y else x > y))
    return rows


def features(spark, rows):
    df = sequence.side_rows(spark.createDataFrame(rows, KIND))
    out = sequence.league_mean(sequence.load(sequence.form(df)), "scored", 100_000)
    return sequence.trailing_means(out, {"m": "margin"}).orderBy("game_id", "team").toPandas()


NOT_FEATURES = ["won", "scored", "allowed", "margin"]


def test_own_and_later_results_change_nothing_earlier(spark):
    rows = season()
    before = features(spark, rows)
    k = 30
    r = list(rows[k])
    r[5], r[6], r[7] = 200, 10, True
    after = features(spark, [*rows[:k], tuple(r), *rows[k + 1 :]])
    upto = before["game_id"] <= k
    # The other side row of contest k itself is processed with it, so the league mean may see its pair.
    cols = [c for c in before.columns if c not in [*NOT_FEATURES, "league"]]
    pd.testing.assert_frame_equal(before[upto][cols], after[upto][cols])
    assert not before[~upto][cols].equals(after[~upto][cols])


def test_row_order_does_not_matter(spark):
    rows = season()
    mixed = rows[:]
    random.Random(9).shuffle(mixed)
    pd.testing.assert_frame_equal(features(spark, rows), features(spark, mixed))


def rated(spark, rows, *configs):
    return recursive.elo(spark.createDataFrame(rows, KIND), list(configs)).orderBy("config_id", "game_id").toPandas()


def plain_elo(rows, c):
    """One game after another, in plain numbers."""
    held, season, out = {}, None, []
    for game_id, _, s, h, a, x, y, won in rows:
        if season is not None:
            for _ in range(s - season):
                held = {t: 1500 + c.kept * (r - 1500) for t, r in held.items()}
        season = s
        if c.first_season is not None and s < c.first_season:
            out.append((game_id, None, None))
            continue
        rh, ra = held.get(h, 1500.0), held.get(a, 1500.0)
        p = 1 / (1 + 10 ** (-(rh + c.advantage - ra) / 400))
        out.append((game_id, rh, p))
        if won is None:
            continue
        m, lead = abs(x - y), (rh + c.advantage - ra) * (1 if won else -1)
        by = {None: 1, "sqrt": math.sqrt(m) / math.sqrt(11), "log": math.log(m + 1) / math.log(12)}
        by["fivethirtyeight"] = by["log"] * 2.2 / (0.001 * lead + 2.2)
        step = c.k * by[c.margin] * (won - p)
        held[h], held[a] = rh + step, ra - step
    return out


@pytest.mark.parametrize(("k", "want"), [(20.0, 1510.0), (32.0, 1516.0)])
def test_elo_worked(spark, k, want):
    rows = [(1, 1, 2000, 1, 2, 100, 90, True), (2, 2, 2000, 1, 2, 100, 90, True)]
    out = rated(spark, rows, recursive.EloConfig(k=k, advantage=0.0))
    assert out["home_rating"].tolist() == [1500.0, want]
    assert out["home_probability"].iloc[0] == 0.5


@pytest.mark.parametrize(("kept", "want"), [(0.25, 1500.625), (0.5, 1502.5), (0.75, 1505.625)])
def test_elo_keeps_its_share_once_for_each_season(spark, kept, want):
    rows = [(1, 1, 2000, 1, 2, 100, 90, True), (2, 2, 2002, 1, 2, 100, 90, None)]
    out = rated(spark, rows, recursive.EloConfig(k=20, advantage=0.0, kept=kept))
    assert out["home_rating"].iloc[1] == pytest.approx(want)


def test_elo_grid_equals_one_game_after_another(spark, monkeypatch):
    rows = season(120)
    configs = [recursive.EloConfig(k, 40.0, kept, first, m) for k in (10.0, 30.0) for kept in (0.25, 0.75) for first in (None, 2001) for m in (None, "sqrt", "log", "fivethirtyeight")]
    for side_by_side in (96, 3, 1):
        monkeypatch.setattr(recursive, "SIDE_BY_SIDE", side_by_side)
        out = rated(spark, rows, *configs)
        for i, c in enumerate(configs):
            own = out[out["config_id"] == i]
            for (game_id, rating, p), got in zip(plain_elo(rows, c), own.itertuples(), strict=True):
                assert got.game_id == game_id
                if rating is None:
                    assert np.isnan(got.home_rating)
                else:
                    assert (got.home_rating, got.home_probability) == pytest.approx((rating, p))


def test_elo_leaks_nothing(spark):
    rows = season()
    changed = rows[:]
    changed[20] = (*rows[20][:5], 70, 130, False)
    a = recursive.elo(spark.createDataFrame(rows, KIND), [recursive.EloConfig(margin="sqrt")]).orderBy("game_id").toPandas()
    b = recursive.elo(spark.createDataFrame(changed, KIND), [recursive.EloConfig(margin="sqrt")]).orderBy("game_id").toPandas()
    assert a[:21].equals(b[:21]) and not a[21:].equals(b[21:])


def plain_srs(rows):
    """Every state from the start again."""
    out, done = [], []
    for game_id, _, s, h, a, x, y, _ in rows:
        past = [g for g in done if g[0] == s]
        sides = sorted({t for g in past for t in g[1:3]})
        games = {t: [(g[2], g[3]) if g[1] == t else (g[1], -g[3]) for g in past if t in g[1:3]] for t in sides}
        level = dict.fromkeys(sides, 0.0)
        for _ in range(25):
            level = {t: sum(d + level[o] for o, d in games[t]) / len(games[t]) for t in sides}
            mean = sum(level.values()) / len(level) if level else 0.0
            level = {t: v - mean for t, v in level.items()}
        out.append((game_id, *(level[t] if len(games.get(t, ())) >= 3 else None for t in (h, a))))
        if x is not None and y is not None:
            done.append((s, h, a, x - y))
    return out


@pytest.mark.parametrize("at_once", [256, 7])
def test_srs_equals_every_state_from_the_start(spark, monkeypatch, at_once):
    monkeypatch.setattr(recursive, "SOLVED_AT_ONCE", at_once)
    rows = [(*r[:5], None, *r[6:]) if r[0] % 13 == 5 else r for r in season(100)]
    got = recursive.srs(spark.createDataFrame(rows, KIND)).orderBy("game_id").collect()
    for (game_id, h, a), r in zip(plain_srs(rows), got, strict=True):
        assert (r.game_id, r.home_srs is None, r.away_srs is None) == (game_id, h is None, a is None)
        assert (r.home_srs or 0.0, r.away_srs or 0.0) == pytest.approx((h or 0.0, a or 0.0))


def test_srs_keeps_the_round_count(spark):
    """Two sides that met only each other: the iteration swings between (10, -10) and (0, 0)."""
    rows = [(i, i, 2000, 1, 2, 100, 90, True) for i in range(4)]
    got = recursive.srs(spark.createDataFrame(rows, KIND)).orderBy("game_id").collect()
    assert got[2].home_srs is None
    assert (got[3].home_srs, got[3].away_srs) == (10.0, -10.0)


def test_form_after_a_contest_without_result(spark):
    rows = [(1, 0, 2000, 1, 2, 100, 90, True), (2, 86_400, 2000, 1, 2, 95, 95, None), (3, 259_200, 2000, 1, 2, 80, 90, False)]
    rows += [(4, 345_600, 2000, 1, 2, 90, 80, True)]
    out = sequence.form(sequence.side_rows(spark.createDataFrame(rows, KIND)), (2,)).where("team = 1").orderBy("game_id").collect()
    assert [r.games_played for r in out] == [0, 1, 1, 2]
    assert [r.rest_days for r in out] == [None, 1.0, 3.0, 1.0]
    assert [r.margin_2 for r in out] == [None, 10.0, 10.0, 0.0]
    assert sequence.load(sequence.side_rows(spark.createDataFrame(rows, KIND))).where("team = 1 and game_id = 3").first().games_3d == 1


def test_trailing_means_pass_over_nulls(spark):
    rows = [(i, i, 2000, 1, 2, 100 + i if i % 3 else None, 90, True) for i in range(30)]
    df = sequence.side_rows(spark.createDataFrame(rows, KIND)).where("is_home")
    seen = []
    for r in sequence.trailing_means(df, {"x": "scored"}, (3,), 5.0).orderBy("game_id").collect():
        weights = [0.5 ** ((len(seen) - 1 - i) / 5) for i in range(len(seen))]
        want = [sum(seen) / len(seen), sum(seen[-3:]) / len(seen[-3:]), sum(w * x for w, x in zip(weights, seen, strict=True)) / sum(weights)] if seen else [None] * 3
        assert [r.x_mean, r.x_last3, r.x_ewma] == (pytest.approx(want) if seen else want)
        if r.scored is not None:
            seen.append(r.scored)


def test_box_off_by_one_point_has_no_figures(spark):
    from priorline.functions import box

    counts = dict.fromkeys(box.COUNTS, 10) | {"fga": 20}
    both = [{"game_id": 1, "team": t, "opponent": 3 - t, "team_minutes": 240.0, "trusted_pts": 10 + (t == 2), **counts} for t in (1, 2)]
    one, off = box.derived(spark.createDataFrame(both)).orderBy("team").collect()
    assert one.complete and one.possessions > 0 and one.ft_rate == 0.5 and one.net_efficiency == 0
    assert not off.complete and off.points_delta == -1
    assert all(off[c] is None for c in ("possessions", "off_efficiency", "pace", "efg", "opp_efg"))


def test_disruption_divides_by_the_games_there_are(spark):
    from priorline.operators import rotation

    played = [(2000, 1, g, 1000 * g, 7, 36.0 if g == 1 else 0.0) for g in range(1, 7)] + [(2000, 1, g, 1000 * g, 8, 30.0) for g in range(1, 7)]
    rows = rotation.numbered(spark.createDataFrame(played, "season int, team int, game_id int, ts long, player int, minutes double"))
    out = rotation.disruption(rows).where("game_no = 5").first()
    assert (out.minutes_lost, out.absent) == (36.0, 1)


def test_guarded_outcome_and_keys(spark):
    from priorline.functions import values

    df = spark.createDataFrame([(True, 1, 1), (True, 2, 1), (False, 2, 1), (True, None, 1)], "f boolean, h int, a int")
    got = [r[0] for r in df.select(values.guarded_outcome(F.col("f"), F.col("h"), F.col("a"))).collect()]
    assert got == [None, True, None, None]
    df = spark.createDataFrame([("2020-01-01", "B", "A"), (None, "B", "A"), ("2020-01-01", None, "A")], "d string, h string, a string")
    assert [r[0] for r in df.select(values.pair_key(F.col("d"), F.col("h"), F.col("a"))).collect()] == ["2020-01-01|A|B", None, None]


def test_paired_bootstrap_is_the_same_at_any_partitioning_and_near_numpy(spark):
    from priorline.operators import metrics

    rng = np.random.default_rng(0)
    a, b = rng.random(300), rng.random(300) * 0.9
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "key long, a double, b double")
    got = [metrics.paired_bootstrap(df.repartition(n), "a", "b", resamples=4003, seed=5, chunk=c).first() for n, c in ((1, 1000), (8, 64))]
    assert got[0] == got[1]
    d = a - b
    means = d[rng.integers(0, 300, (4000, 300))].mean(axis=1)
    want, error = np.quantile(means, [0.025, 0.975]), means.std() * 0.18  # three standard errors of such quantiles
    assert (got[0].n, got[0].difference) == (300, pytest.approx(d.mean()))
    assert got[0].low == pytest.approx(want[0], abs=error) and got[0].high == pytest.approx(want[1], abs=error)
    assert got[0].verdict == ("a_better" if got[0].high < 0 else "b_better" if got[0].low > 0 else "inconclusive")
    none = metrics.paired_bootstrap(df.where("false"), "a", "b", resamples=8).first()
    assert tuple(none) == (0, None, None, None, None)


def test_poisson_weights_have_mean_and_variance_one():
    from priorline.operators import metrics

    w = metrics._poisson_lanes()[metrics._mixed(np.arange(1, 200_001, dtype=np.uint64)).view(np.uint16)].astype(float)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def newton(x, y, weight, c):
    """A logistic regression in plain numpy: medians, scaling, penalised Newton steps; coefficients on the scaled features."""
    median = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), median, x)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, pull = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0) / c
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(pull), z.T @ (weight * (p - y)) + pull * w)
    return lambda new: 1 / (1 + np.exp(-np.column_stack([(np.where(np.isnan(new), median, new) - mean) / spread, np.ones(len(new))]) @ w))


def test_many_fits_in_one_pass_equal_single_ones(spark):
    from priorline.operators import learn, selection

    rng = np.random.default_rng(4)
    n = 900
    season, x = rng.integers(2000, 2008, n), rng.standard_normal((n, 3)) * [1, 5, 0.1] + [0, 3, -1]
    x[:, 2] = np.where(rng.random(n) < 0.1, np.nan, x[:, 2])
    season[season == 2003] = 2002  # a season without rows is no season of a window
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.1 * x[:, 1])))
    rows = [(i, int(s), *[None if np.isnan(v) else float(v) for v in r], None if i % 50 == 0 else bool(t)) for i, (s, r, t) in enumerate(zip(season, x, y, strict=True))]
    df = spark.createDataFrame(rows, "game_id long, season int, p double, q double, r double, home_win boolean").repartition(5)
    features, seasons = ["p", "q", "r"], [2005, 2006]
    specs = [s for t in seasons for s in selection.logistic_grid(t)] + [learn.Spec(2006, 2, None, 1.0, ("q",))]
    assert len(specs) == 81
    fits = learn.fit_many(df, features, "home_win", specs)
    got = {(r.spec, r.game_id): r.probability for r in learn.forecasts(df, fits, specs, features).collect()}
    known = np.arange(n) % 50 != 0
    for i, spec in enumerate(specs):
        past = sorted(set(season[season < spec.target]))
        past = past if spec.history is None else past[-spec.history :]
        on = known & np.isin(season, past)
        weight = np.ones(on.sum()) if spec.half_life is None else 0.5 ** ((max(past) - season[on]) / spec.half_life)
        use = [features.index(f) for f in spec.features or features]
        want = newton(x[on][:, use], y[on], weight, spec.c)(x[season == spec.target][:, use])
        assert [got[i, g] for g in np.flatnonzero(season == spec.target)] == pytest.approx(want, abs=1e-6)
        assert fits[spec].rows == on.sum() and fits[spec].steps < 20


def test_fits_without_rows_features_or_spread(spark):
    from priorline.operators import learn

    df = spark.createDataFrame([(1, 2000, 1.0, None, True), (2, 2000, 1.0, None, False), (3, 2000, 1.0, None, True), (4, 2001, 5.0, None, None)], "game_id int, season int, p double, q double, y boolean")
    none, flat, free = learn.Spec(1999), learn.Spec(2001), learn.Spec(2001, None, None, 2.0, ())
    fits = learn.fit_many(df, ["p", "q"], "y", [none, flat, free])
    assert set(fits) == {flat, free}
    out = learn.forecasts(df, fits, [flat, free], ["p", "q"]).collect()
    assert [(r.game_id, r.spec) for r in sorted(out, key=lambda r: r.spec)] == [(4, 0), (4, 1)] and out[0].probability == pytest.approx(2 / 3)
    assert learn.fit_many(df.where("false"), ["p"], "y", [flat]) == {}
    with pytest.raises(ValueError):
        learn.Spec(2001, 0)


def test_a_held_out_season_in_a_fit_fails(spark):
    from priorline.operators import learn

    df = spark.createDataFrame([(1, 1999, 1.0, True), (2, 2000, 2.0, False)], "game_id int, season int, p double, y boolean")
    with pytest.raises(Exception, match="held-out season"):
        learn.fit_many(learn.guarded(df, first=2000), ["p"], "y", [learn.Spec(2001)])


def test_tie_rules_of_ratings_and_of_logistic_settings(spark):
    from priorline.operators import selection

    rows = [(0, 3, 0.20000, 0.6), (1, None, 0.20008, 0.6), (2, None, 0.20007, 0.7), (3, 5, 0.20001, 0.5), (4, None, 0.3, 0.1)]
    df = spark.createDataFrame(rows, "candidate int, history int, mean_brier double, mean_log_loss double")
    assert selection.preferred_rating(df).first().candidate == 2
    assert selection.preferred_logistic(df).first().candidate == 0
    assert selection.preferred_logistic(df.where("history is null")).first().candidate == 2
    assert selection.preferred_rating(df.where("candidate in (0, 3, 4)")).first().candidate == 0


def test_a_blend_must_beat_the_pure_forecast_by_the_band(spark):
    from priorline.operators import selection

    rows = [(s, s % 2 == 0, 0.6 if s % 2 == 0 else 0.4, 1.0 if s % 2 == 0 else 0.0, 0.6001 if s % 2 == 0 else 0.4) for s in range(20)] + [(0, None, 0.5, 0.5, 0.5), (0, True, 0.9, None, 0.9)]
    df = spark.createDataFrame(rows, "n int, y boolean, a double, b double, c double").withColumn("season", F.col("n") % 3)
    scored = selection.blend_candidates(df, "y", "a", {"right": "b", "same": "c"})
    assert scored.count() == 11 and {r.folds for r in scored.collect()} == {3}
    best = selection.best_blend(scored).first()
    assert (best.partner, best.weight) == ("right", 0.5)
    assert selection.best_blend(scored.where("partner <> 'right'")).first().partner == "pure"


def test_phases_and_regular_seasons(spark):
    from priorline import dims
    from priorline.operators import league

    kind = "game_id int, season int, date date, home int, away int, postseason boolean, mark string"
    import datetime

    day = datetime.date.fromisoformat
    rows = [
        (1, 2024, day("2024-10-22"), 1, 2, False, None), (2, 2024, day("2025-04-16"), 1, 2, True, None), (3, 2024, day("2025-05-01"), 1, 2, True, None),
        (4, 2024, day("2024-12-17"), 1, 2, False, None), (5, 2024, None, 1, 2, False, " Championship "), (6, 2024, day("2024-10-23"), 1, 31, False, None),
        (7, 2024, day("2024-08-01"), 1, 2, False, None), (8, 1980, day("1980-01-01"), 1, 2, False, None), (9, 2024, None, 1, 2, None, None), (10, None, day("2024-11-01"), 1, None, False, None),
    ]
    out = league.with_phase(spark.createDataFrame(rows, kind), dims.seasons(spark))
    assert [r.phase for r in out.orderBy("game_id").collect()] == [
        "regular_season", "play_in", "playoffs", "nba_cup_championship", "nba_cup_championship", "other_special", "unclassified", "unclassified", "unclassified", "unclassified",
    ]
    # A league of four, two contests each; one side has a declared exception.
    dim = spark.createDataFrame([(1, "standard", 4, 2), (2, "standard", 3, 2), (3, "interrupted", None, None)], "season int, structure string, expected_games int, expected_each int")
    odd = spark.createDataFrame([(2, 1, 1), (2, 2, 1)], "season int, team int, games int")
    pairs = [(1, 1, 2), (1, 3, 4), (1, 1, 3), (1, 2, 4), (2, 1, 3), (2, 3, 4), (2, 4, 2), (3, 1, 2), (9, 1, 2)]
    games = spark.createDataFrame([(s, h, a, "regular_season") for s, h, a in pairs] + [(1, 1, 2, "playoffs")], "season int, home int, away int, phase string")
    got = {r.season: r for r in league.regular_seasons(games, dim, odd, teams=4).collect()}
    assert [(s, got[s].n_games, got[s].n_teams, got[s].n_unexpected, got[s].verified) for s in (1, 2, 3, 9)] == [(1, 4, 4, 0, True), (2, 3, 4, 0, True), (3, 1, 2, 0, False), (9, 1, 2, 0, False)]


@pytest.mark.parametrize("small", [40, 100_000])
def test_quantiles_by_selection_equal_numpy(spark, small):
    from priorline.operators import audit

    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(0, 3, 700), "b": rng.integers(0, 3, 500).astype(float), None: rng.standard_cauchy(300), "c": np.array([1.0, 2.0]), "one": np.full(200, 7.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("d", None), ("e", float("nan"))]
    rows += [("i", v) for v in (float("inf"), float("-inf"), 1.0, 2.0, 3.0, 1e308, -1e308) for _ in range(20)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.q): r.value for r in audit.quantiles_by(df, ["g"], "v", at, small=small, parts=16).collect()}
    assert {g for g, _ in got} == {*groups, "i"}
    for g, vs in groups.items():
        assert [got[g, q] for q in at] == pytest.approx(np.quantile(vs, at))
    assert (got["i", 0.0], got["i", 0.5], got["i", 1.0]) == (float("-inf"), 2.0, float("inf"))
    assert audit.quantiles(df.where("false"), "v", at).collect() == []


def test_logistic_equals_newton(spark):
    from priorline.operators import learn

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2)) * [3, 0.5] + [1, -2]
    y = rng.random(400) < 1 / (1 + np.exp(-(0.4 * x[:, 0] - x[:, 1] - 1)))
    rows = [(float(p), None if i % 17 == 3 else float(q), bool(t)) for i, ((p, q), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "p double, q double, y boolean")
    got = np.array([r.probability for r in learn.Logistic(["p", "q"], "y", 0.5).fit(df).predict(df).collect()])
    q = np.array([np.nan if r[1] is None else r[1] for r in rows])
    z = np.column_stack([x[:, 0], np.where(np.isnan(q), np.nanmedian(q), q)])
    z = np.column_stack([(z - z.mean(axis=0)) / z.std(axis=0), np.ones(400)])
    w = np.zeros(3)
    for _ in range(50):  # C = 0.5, the intercept is not penalised
        p = 1 / (1 + np.exp(-z @ w))
        pull = np.diag([1, 1, 0]) / 0.5
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pull, z.T @ (p - y) + pull @ w)
    assert got == pytest.approx(1 / (1 + np.exp(-z @ w)), abs=1e-4)
