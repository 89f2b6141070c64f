"""Queries on forecasts: losses, ranking, calibration, segments, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.functions.values import blend
from priorline.operators import learn, metrics, recursive, selection, sequence
from priorline.plans import flows, forms
from priorline.plans.forms import rounded
from priorline.plans.views import CONTESTS, contests, table

P = 0.05


def predictions(spark, d) -> DataFrame:
    """Labels with a made-up probability from a text's length, and another from its id."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("y"), F.col("toxic"))
    n = F.col("n_chars") % 997
    return lab.join(docs, "doc_id").select("doc_id", "y", "toxic", "n_chars", (0.001 + n / 1000.0).alias("p"), (0.01 + (F.col("doc_id") % 89) / 90.0).alias("q"))


PRED = "pred as (select doc_id, quality = 1 as y, toxic, n_chars, 0.001 + (n_chars % 997) / 1000.0::double as p, 0.01 + (doc_id % 89) / 90.0::double as q from labels join documents using (doc_id))"
LOSSES = "count(*) as n, round(avg(pow(p - y::int, 2)), 6) as brier, round(avg(case when y then -ln(least(greatest(p, 1e-15), 1 - 1e-15)) else -ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end), 6) as log_loss, round(avg(((p >= 0.5) = y)::int), 6) as accuracy"


def brier_logloss_accuracy(spark, d):
    return rounded(metrics.scores(predictions(spark, d), "y", "p", ["toxic"]), "brier", "log_loss", "accuracy")


def roc_auc(spark, d):
    return rounded(metrics.roc_auc(predictions(spark, d), "y", "p"), "auc")


AUC = f"""with {PRED}, r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from pred), s as (select sum(r) filter (where y) as sr, count(*) filter (where y) as np, count(*) filter (where not y) as nn from r)
select round((sr - np * (np + 1) / 2.0) / (np * nn), 6) as auc from s"""


def calibration_table(spark, d):
    return rounded(metrics.calibration(predictions(spark, d), "y", "p"), "mean_p", "rate")


CALIBRATION = f"""with {PRED}, b as (select range as bin, range / 10.0::double as low, (range + 1) / 10.0::double as high from range(10)),
g as (select case when p >= 0.9 then 9 when p >= 0.8 then 8 when p >= 0.7 then 7 when p >= 0.6 then 6 when p >= 0.5 then 5 when p >= 0.4 then 4 when p >= 0.3 then 3 when p >= 0.2 then 2 when p >= 0.1 then 1 else 0 end as bin, p, y from pred),
s as (select bin, count(*) as n, avg(p) as mean_p, avg(y::int) as rate from g group by bin)
select bin, low, high, coalesce(n, 0) as n, round(mean_p, 6) as mean_p, round(rate, 6) as rate, coalesce(n < 30, false) as sparse from b left join s using (bin)"""


def calibration_ece(spark, d):
    return rounded(metrics.ece(metrics.calibration(predictions(spark, d), "y", "p")), "ece")


def segments(spark, d):
    p = predictions(spark, d)
    rows = metrics.in_segments(p, {"short": F.col("n_chars") < 1000, "long": F.col("n_chars") >= 3000, "toxic": F.col("toxic") == 1, "sure": F.abs(F.col("p") - 0.5) > 0.3})
    return rounded(metrics.scores(rows, "y", "p", ["segment"]), "brier", "log_loss", "accuracy")


SEGMENTS = f"""with {PRED}, s as (select 'all' as segment, * from pred union all select 'short', * from pred where n_chars < 1000 union all select 'long', * from pred where n_chars >= 3000 union all select 'toxic', * from pred where toxic = 1 union all select 'sure', * from pred where abs(p - 0.5) > 0.3)
select segment, {LOSSES} from s group by segment"""


def constant_baseline(spark, d):
    """The development seasons' home rate, scored on the seasons after them."""
    c = contests(spark, d).where(F.col("home_win").isNotNull())
    rate = c.where("season < 1999").agg(F.avg(F.col("home_win").cast("double")).alias("p"))
    scored = c.where("season >= 1999").select("season", "home_win").crossJoin(F.broadcast(rate))  # one row
    return rounded(metrics.scores(scored, "home_win", "p", ["season"]), "brier", "log_loss", "accuracy")


CONSTANT = f"with {CONTESTS}, c as (select season, home_win as y, (select avg(home_win::int) from contests where season < 1999) as p from contests where season >= 1999 and home_win is not null) select season, {LOSSES} from c group by season"


def blend_search(spark, d):
    """Weights from 0 to 1 by quarters over two forecasts; the best, if it beats the pure one by the band."""
    p = predictions(spark, d)
    many = p.select("y", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), blend(F.col("p"), F.col("q"), w).alias("p")) for w in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("b")).select("y", "b.*")
    return rounded(metrics.scores(many, "y", "p", ["weight"]), "brier", "log_loss", "accuracy")


BLEND = f"with {PRED}, b as (select y, weight, (1 - weight) * p + weight * q as p from pred, (select unnest([0, 0.25, 0.5, 0.75, 1]::double[]) as weight)) select weight, {LOSSES} from b group by weight"


def blend_partners(spark, d):
    """Three partners beside a forecast, season by season, and the blend that is worth it, if one is."""
    p = predictions(spark, d).select((F.col("doc_id") % 4).cast("int").alias("season"), "y", "p", "q", (1 - F.col("q")).alias("r"), (0.5 * F.col("p") + 0.2).alias("s"))
    scored = written(selection.blend_candidates(p, "y", "p", {"q": "q", "r": "r", "s": "s"}), "blends")
    best = selection.best_blend(scored).select("partner", "weight", F.lit(True).alias("chosen"))
    out = scored.join(F.broadcast(best), ["partner", "weight"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return rounded(out, "mean_brier", "mean_log_loss")


PARTNERS = f"""with {PRED}, w as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5]::double[]) as weight), b as (
  select doc_id % 4 as season, y, 'pure' as partner, 0.0::double as weight, p from pred union all select doc_id % 4, y, 'q', weight, (1 - weight) * p + weight * q from pred, w
  union all select doc_id % 4, y, 'r', weight, (1 - weight) * p + weight * (1 - q) from pred, w union all select doc_id % 4, y, 's', weight, (1 - weight) * p + weight * (0.5 * p + 0.2) from pred, w),
f as (select partner, weight, season, avg(pow(p - y::int, 2)) as b, avg(case when y then -ln(least(greatest(p, 1e-15), 1 - 1e-15)) else -ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end) as l from b group by all),
m as (select partner, weight, avg(b) as b, avg(l) as l, count(*) as folds from f group by all),
c as (select partner, weight from m where partner = 'pure' or (select b from m where partner = 'pure') - b > 1e-4 order by b, l limit 1)
select m.partner, m.weight, round(b, 6) as mean_brier, round(l, 6) as mean_log_loss, folds, c.partner is not null as chosen from m left join c on c.partner = m.partner and c.weight = m.weight"""


def tie_band_preference(spark, d):
    """Of a season's candidates within the band of the best, the one with the least weight."""
    scored = metrics.scores(predictions(spark, d).withColumn("grp", F.col("doc_id") % 3).select("grp", "y", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), blend(F.col("p"), F.col("q"), w).alias("p")) for w in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("b")).select("grp", "y", "b.*"), "y", "p", ["grp", "weight"])
    return rounded(metrics.tie_band(scored, "brier", [F.col("weight")], 1e-2, ["grp"]), "brier", "log_loss", "accuracy")


TIE = f"""with {PRED}, b as (select doc_id % 3 as grp, y, weight, (1 - weight) * p + weight * q as p from pred, (select unnest([0, 0.25, 0.5, 0.75, 1]::double[]) as weight)),
raw as (select grp, weight, avg(pow(p - y::int, 2)) as b0 from b group by all), s as (select grp, weight, {LOSSES} from b group by grp, weight), m as (select *, min(b0) over (partition by grp) as best from raw)
select s.* from s join m using (grp, weight) where b0 - best <= 1e-2 qualify row_number() over (partition by grp order by weight) = 1"""


def features(spark, d) -> DataFrame:
    """One row a contest with what was known before it."""
    c = contests(spark, d)
    rows = sequence.form(sequence.side_rows(c), (5,))
    wide = sequence.both_sides(rows, ["win_rate", "margin_5", "rest_days"])
    return c.select("game_id", "ts", "season", "home_win").join(wide, "game_id")


FEATURES = ["diff_win_rate", "diff_margin_5", "home_rest_days", "away_rest_days"]


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a fit reads its rows once for each of its steps."""
    path = flows.scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def logistic_walk_forward(spark, d):
    """Season by season, fitted on those before; held-out seasons never come near."""
    rows = features(spark, d).select("game_id", "season", "home_win", *FEATURES)
    rows = learn.guarded(written(rows.where(F.col("season") < HOLDOUT), "features"), first=HOLDOUT)
    out = learn.walk_forward(rows, FEATURES, "home_win", DEVELOPMENT)
    return rounded(metrics.scores(out.where(F.col("home_win").isNotNull()), "home_win", "probability", ["season"]), "brier", "log_loss", "accuracy")


def logistic_selection(spark, d):
    """The 40 logistic settings on the development seasons: every candidate's mean losses, and the one preferred."""
    rows = features(spark, d).where(F.col("season") < HOLDOUT).select("game_id", "season", "home_win", *FEATURES)
    scored = written(selection.logistic_candidates(written(rows, "features"), FEATURES, "home_win", DEVELOPMENT, HOLDOUT), "candidates")
    best = selection.preferred_logistic(scored).select("candidate", F.lit(True).alias("chosen"))
    out = scored.join(F.broadcast(best), "candidate", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return rounded(out, "mean_brier", "mean_log_loss")


def grid_select_tie_rule(spark, d):
    """Rating grids with their histories on the development seasons; within the band of the best, one over all history."""
    grid = [(recursive.EloConfig(k, a), n) for k in (5.0, 10.0, 20.0) for a in (0.0, 40.0) for n in (3, None)]
    scored = selection.rating_candidates(contests(spark, d), grid, DEVELOPMENT, HOLDOUT)
    histories = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(grid)], "candidate int, history int")
    best = selection.preferred_rating(F.broadcast(histories).join(scored, "candidate"))
    return rounded(best.drop("history"), "mean_brier", "mean_log_loss")


def bootstrap_ci(spark, d):
    p = predictions(spark, d)
    y = F.col("y").cast("double")
    loss = p.select(F.col("doc_id").alias("key"), F.pow(F.col("p") - y, 2).alias("a"), F.pow(F.col("q") - y, 2).alias("b"))
    return metrics.paired_bootstrap(loss, "a", "b")


#: Development seasons, and the first season that is held out.
DEVELOPMENT, HOLDOUT = [1997, 1998, 1999], 2000


def elo_selection(spark, d):
    """The refined grid on the development seasons: every candidate's mean losses, and the one chosen."""
    grid = selection.refined_grid()
    scored = selection.rating_candidates(contests(spark, d), grid, DEVELOPMENT, HOLDOUT)
    best = selection.chosen(scored, [F.col("candidate")]).select("candidate", F.lit(True).alias("chosen"))
    out = scored.join(F.broadcast(best), "candidate", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return rounded(out, "mean_brier", "mean_log_loss")


def _selection_sql(grid) -> str:
    rated = forms._elo_sql([c for c, _ in grid]).replace(CONTESTS, f"{CONTESTS.replace('contests as (', 'every as (', 1)}, contests as (select * from every where season < {HOLDOUT})", 1)
    q = "least(greatest(p, 1e-15), 1 - 1e-15)"
    return rated + f""", f as (
  select config_id, season, avg(pow(p - home_win::int, 2)) as b, avg(case when home_win then -ln({q}) else -ln(1 - {q}) end) as l
  from r join (select game_id, season, home_win from contests) using (game_id) where season in ({", ".join(map(str, DEVELOPMENT))}) and home_win is not null group by all),
m as (select config_id as candidate, avg(b) as b, avg(l) as l, count(*) as folds from f group by all)
select cast(candidate as int) as candidate, round(b, 6) as mean_brier, round(l, 6) as mean_log_loss, folds,
  candidate = (select min(candidate) from m where b - (select min(b) from m) <= 1e-4) as chosen from m"""


def mov_selection(spark, d):
    """Ratings that take the margin in, at two advantages, on the same seasons."""
    scored = selection.rating_candidates(contests(spark, d), selection.margin_grid((40.0, 60.0)), DEVELOPMENT, HOLDOUT)
    return rounded(selection.chosen(scored, [F.col("candidate")]), "mean_brier", "mean_log_loss")


def history_selection(spark, d):
    """All 288 configurations of the coarse grid, each with its own history, on the development seasons."""
    scored = selection.rating_candidates(contests(spark, d), selection.coarse_grid(), DEVELOPMENT, HOLDOUT)
    return rounded(scored, "mean_brier", "mean_log_loss")


def league_features(spark, d) -> DataFrame:
    """Everything that is known before a contest: form, ratings, adjusted margins, scoring, venue and load."""
    c = contests(spark, d)
    rows = sequence.load(sequence.form(sequence.side_rows(c)))
    rows = sequence.trailing_means(rows.withColumns({n: sequence.settled(n) for n in ("scored", "allowed", "margin")}), {n: n for n in ("scored", "allowed", "margin")}, (5,))
    wide = sequence.both_sides(rows, ["games_played", "win_rate", "win_rate_5", "margin_5", "rest_days", "scored_mean", "allowed_mean", "margin_ewma", "games_5d", "games_7d"])
    rated = recursive.elo(c, [recursive.EloConfig(), recursive.EloConfig(margin="sqrt")])
    ratings = rated.groupBy("game_id").agg(*[
        F.max(F.when(F.col("config_id") == i, F.col("home_rating") - F.col("away_rating"))).alias(n) for i, n in enumerate(("diff_rating", "diff_margin_rating"))
    ])
    margins = recursive.srs(c).select("game_id", (F.col("home_srs") - F.col("away_srs")).alias("diff_adjusted"))
    return c.select("game_id", "season", "home_win").join(wide, "game_id").join(ratings, "game_id").join(margins, "game_id")


_A = ["diff_rating", "diff_win_rate", "diff_win_rate_5", "diff_margin_5", "diff_rest_days", "home_games_played", "away_games_played"]
_STEPS = {"A": _A, "B": ["diff_margin_rating"], "C": ["diff_adjusted"], "D": ["diff_scored_mean", "diff_allowed_mean", "diff_margin_ewma"], "E": ["diff_games_5d", "diff_games_7d"]}
#: Nested: each bundle has all that the one before has.
BUNDLES = {name: [f for step in list(_STEPS)[: i + 1] for f in _STEPS[step]] for i, name in enumerate(_STEPS)}


def bundle_ablation(spark, d):
    rows = written(league_features(spark, d).where(F.col("season") < HOLDOUT), "features")
    return rounded(selection.ablation(rows, BUNDLES, "home_win", [1998, 1999], HOLDOUT), "mean_brier", "mean_log_loss", "change")


def held_out(spark, d) -> DataFrame:
    """A frozen rating, the development rate, and how long both sides had played, on the contests held out."""
    c = contests(spark, d)
    rate = c.where(F.col("season") < HOLDOUT).agg(F.avg(F.col("home_win").cast("double")).alias("base"))
    rated = recursive.elo(c, [recursive.EloConfig(only=(HOLDOUT,))]).select("game_id", F.col("home_probability").alias("rating"))
    rows = rated.join(c.select("game_id", "home_win"), "game_id").crossJoin(F.broadcast(rate))  # one row
    return rows.withColumn("confidence", F.round(F.abs(F.col("rating") - 0.5), 9))


MODELS = {"base": "base", "rating": "rating"}


def holdout_evaluation(spark, d):
    """A frozen configuration and the development rate on the seasons held out, with paired intervals."""
    out = selection.holdout(held_out(spark, d), "home_win", MODELS, "base")
    return rounded(out, "brier", "log_loss", "accuracy", "difference", "low", "high")


def holdout_calibration(spark, d):
    return rounded(selection.holdout_calibration(held_out(spark, d), "home_win", MODELS), "mean_p", "rate", "ece")


def holdout_segments(spark, d):
    """Losses of the frozen forecasts where either side was new, by favourite, and where the rating is surest."""
    form = sequence.form(sequence.side_rows(contests(spark, d)), ())
    # Written once: a quantile reads its rows again for each of its steps, and the ratings are one ordered pass.
    rows = written(held_out(spark, d).join(sequence.both_sides(form, ["games_played", "rest_days"]), "game_id"), "held_out")
    early = (F.col("home_games_played") < 10) | (F.col("away_games_played") < 10)
    tired = (F.col("home_rest_days") < 2) | (F.col("away_rest_days") < 2)
    segments = {
        "first_10_games_either_side": early, "after_first_10_games_both": ~early, "home_favourite": F.col("rating") >= 0.5, "home_underdog": F.col("rating") < 0.5,
        "short_rest_involved": F.coalesce(tired, F.lit(False)), "no_short_rest": ~F.coalesce(tired, F.lit(False)),
    }
    return rounded(selection.holdout_segments(rows, "home_win", MODELS, segments, {"surest_quarter": "confidence"}), "rate", "brier", "log_loss")


HELD_OUT = forms._elo_sql([recursive.EloConfig()]) + f""", held as (
  select game_id, home_win, p as rating, (select avg(home_win::int) from contests where season < {HOLDOUT}) as base, round(abs(p - 0.5), 9) as confidence
  from r join contests using (game_id) where season >= {HOLDOUT} and season <= {HOLDOUT} and home_win is not null)"""
_BIN = "case " + " ".join(f"when p >= {i / 10} then {i}" for i in range(9, 0, -1)) + " else 0 end"
HOLDOUT_CALIBRATION = HELD_OUT + f""", f as (select 'base' as model, base as p, home_win as y from held union all select 'rating', rating, home_win from held),
own as (select model, {_BIN} as bin, count(*) as n, avg(p) as mean_p, avg(y::int) as rate from f group by all),
b as (select model, range as bin, range / 10.0::double as low, (range + 1) / 10.0::double as high from range(10), (select distinct model from f)),
e as (select model, sum(n * abs(mean_p - rate)) / sum(n) as ece from own group by model)
select bin::int as bin, low, high, coalesce(n, 0) as n, round(mean_p, 6) as mean_p, round(rate, 6) as rate, coalesce(n < 30, false) as sparse, round(ece, 6) as ece, model
from b left join own using (model, bin) join e using (model)"""
HOLDOUT_SEGMENTS = HELD_OUT + """, sides as (
  select game_id, ts, season, home as team, home_win as won from contests union all select game_id, ts, season, away, home_win from contests),
p as (select game_id, count(won) over w as played, (ts - max(case when won is not null then ts end) over w) / 86400.0 as rest from sides
  window w as (partition by season, team order by ts, game_id rows between unbounded preceding and 1 preceding)),
q as (select game_id, min(played) as least, coalesce(bool_or(rest < 2), false) as tired from p group by game_id),
h as (select held.*, least, tired, (select quantile_cont(confidence, 0.75) from held) as sure from held join q using (game_id)),
s as (select 'all' as segment, * from h union all select 'first_10_games_either_side', * from h where least < 10 union all select 'after_first_10_games_both', * from h where least >= 10
  union all select 'home_favourite', * from h where rating >= 0.5 union all select 'home_underdog', * from h where rating < 0.5 union all select 'short_rest_involved', * from h where tired
  union all select 'no_short_rest', * from h where not tired union all select 'surest_quarter', * from h where confidence >= sure),
f as (select segment, 'base' as model, base as p, home_win as y from s union all select segment, 'rating', rating, home_win from s)
select segment, model, count(*) as n, round(avg(pow(p - y::int, 2)), 6) as brier, round(avg(case when y then -ln(p) else -ln(1 - p) end), 6) as log_loss, round(avg(y::int), 6) as rate from f group by all"""


def points_form(spark, d):
    """Means of points for, against and margins before each contest: all, the last five and ten, decayed."""
    names = ("scored", "allowed", "margin")
    rows = sequence.side_rows(contests(spark, d)).withColumns({n: sequence.settled(n) for n in names})
    out = sequence.trailing_means(rows, {n: n for n in names}, (5, 10))
    cols = [f"{n}_{k}" for n in names for k in ("mean", "last5", "last10", "ewma")]
    return rounded(out.select("game_id", "team", *cols), *cols)


_HELD = ", ".join(f"list({c}) filter (where {c} is not null) {forms.BEFORE} as h_{n}" for n, c in (("scored", "pts"), ("allowed", "al"), ("margin", "m")))
POINTS = f"""with {forms.RESULTS}, c2 as (select *, case when won is not null then allowed end as al from counted), n as (select *, {_HELD} from c2)
select game_id, team, {", ".join(x for n in ("scored", "allowed", "margin") for x in forms.means_sql(n, f"h_{n}", (5, 10)))} from n"""


QUERIES = {f.__name__: f for f in (brier_logloss_accuracy, roc_auc, calibration_table, calibration_ece, segments, constant_baseline, blend_search, blend_partners, tie_band_preference, logistic_walk_forward, logistic_selection, grid_select_tie_rule, bootstrap_ci, elo_selection, mov_selection, history_selection, bundle_ablation, holdout_evaluation, holdout_calibration, holdout_segments, points_form)}
ORACLES = {
    "brier_logloss_accuracy": f"with {PRED} select toxic, {LOSSES} from pred group by toxic", "roc_auc": AUC, "calibration_table": CALIBRATION,
    "calibration_ece": f"select round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from ({CALIBRATION.replace('round(mean_p, 6)', 'mean_p').replace('round(rate, 6)', 'rate')})",
    "segments": SEGMENTS, "constant_baseline": CONSTANT, "blend_search": BLEND, "blend_partners": PARTNERS, "tie_band_preference": TIE,
    "elo_selection": _selection_sql(selection.refined_grid()), "points_form": POINTS,
    "mov_selection": f"select candidate, mean_brier, mean_log_loss, folds from ({_selection_sql(selection.margin_grid((40.0, 60.0)))}) where chosen",
    "holdout_calibration": HOLDOUT_CALIBRATION, "holdout_segments": HOLDOUT_SEGMENTS,
}
