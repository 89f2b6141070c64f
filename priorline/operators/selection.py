"""Choosing among forecasts on development seasons alone, and judging the frozen choice once on what was held out.

A candidate is scored season by season; what counts is the mean over seasons, each weighing the same. Differences
within the band are ties, which a stated preference decides.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions.values import blend
from priorline.operators import audit, learn, metrics
from priorline.operators.recursive import EloConfig, elo_losses

# The grids of the ratings, and how many past seasons they may start from (None: all).
K_GRID, ADVANTAGE_GRID, KEPT_GRID = (10.0, 20.0, 30.0, 40.0), (40.0, 60.0, 80.0, 100.0), (0.25, 0.50, 0.75)
HISTORY_GRID = (3, 5, 8, 10, 15, None)
REFINED_K_GRID, REFINED_ADVANTAGE_GRID = (10.0, 20.0, 30.0), (0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0)
MARGIN_KINDS, MARGIN_KEPT_GRID = ("log", "fivethirtyeight", "sqrt"), (0.50, 0.75)
#: Differences of mean Brier scores that are none, and the logistic settings that bundles are compared by.
BAND, PROBE_HISTORY, PROBE_C = 1e-4, 5, 1.0


def coarse_grid() -> list[tuple[EloConfig, int | None]]:
    """288 configurations with their history."""
    return [(EloConfig(k, a, kept), n) for k, a, kept, n in product(K_GRID, ADVANTAGE_GRID, KEPT_GRID, HISTORY_GRID)]


def refined_grid() -> list[tuple[EloConfig, int | None]]:
    """63 configurations with home advantage down to none."""
    return [(EloConfig(k, a, kept), None) for k, a, kept in product(REFINED_K_GRID, REFINED_ADVANTAGE_GRID, KEPT_GRID)]


def margin_grid(advantages: tuple[float, ...]) -> list[tuple[EloConfig, int | None]]:
    """Ratings that take the margin in, with the advantages that were chosen before."""
    return [
        (EloConfig(k, a, kept, None, m), None)
        for m, k, a, kept in product(MARGIN_KINDS, REFINED_K_GRID, advantages, MARGIN_KEPT_GRID)
    ]


def per_fold(predictions: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Losses of each candidate in each season."""
    return metrics.scores(predictions.where(F.col(y).isNotNull()), y, p, [*by, "season"])


def over_folds(folds: DataFrame, by: list[str]) -> DataFrame:
    """Mean losses over seasons, each the same weight, and how many seasons there are."""
    return folds.groupBy(*by).agg(F.avg("brier").alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"), F.count(F.lit(1)).alias("folds"))


def rating_candidates(contests: DataFrame, grid: list[tuple[EloConfig, int | None]], seasons: list[int], holdout: int) -> DataFrame:
    """candidate (its place in the grid), mean losses and folds of rating configurations on development seasons.

    Only seasons before ``holdout`` are read. A configuration with a history is rated anew for each season from its own
    start; all of them go side by side in one pass over the contests.
    """
    past = contests.where(F.col("season") < holdout)
    runs: list[tuple[int, EloConfig]] = []
    for i, (c, history) in enumerate(grid):
        if history is None:
            runs.append((i, EloConfig(c.k, c.advantage, c.kept, None, c.margin, tuple(seasons))))
        else:
            runs += [(i, EloConfig(c.k, c.advantage, c.kept, s - history, c.margin, (s,))) for s in seasons]
    names = F.element_at(F.array(*[F.lit(i) for i, _ in runs]), F.col("config_id") + 1)
    sums = elo_losses(past, [c for _, c in runs]).withColumn("candidate", names)
    folds = sums.select("candidate", "season", *[(F.col(c) / F.col("n")).alias(c) for c in ("brier", "log_loss")])
    return over_folds(folds, ["candidate"])


def chosen(candidates: DataFrame, preference: list[Column], band: float = BAND) -> DataFrame:
    """The one preferred among those within the band of the best mean Brier score."""
    return metrics.tie_band(candidates, "mean_brier", [*preference, F.col("mean_brier"), F.col("mean_log_loss")], band)


def preferred_rating(candidates: DataFrame, history: str = "history", band: float = BAND) -> DataFrame:
    """Among ratings within the band of the best: one over all history (null) if there is one, then the least losses."""
    return chosen(candidates, [F.col(history).isNotNull()], band)


#: How many past seasons a logistic model may learn from (None: all), the half-lives of its weights, and C.
LOGISTIC_HALF_LIVES, LOGISTIC_C_GRID = (2.0, 3.0, 5.0, 8.0), (0.01, 0.1, 1.0, 10.0)


def logistic_grid(season: int) -> list[learn.Spec]:
    """The 40 settings of a season's model: windows of history, and all history with weights that decay."""
    windows = [learn.Spec(season, h, None, c) for h, c in product(HISTORY_GRID, LOGISTIC_C_GRID)]
    return windows + [learn.Spec(season, None, hl, c) for hl, c in product(LOGISTIC_HALF_LIVES, LOGISTIC_C_GRID)]


def logistic_candidates(rows: DataFrame, features: list[str], label: str, seasons: list[int], holdout: int) -> DataFrame:
    """candidate, history, half_life, c, mean losses and folds of the 40 logistic settings on development seasons.

    All settings of all seasons are fitted in the same passes over ``rows`` (game_id, season, features, label). A season
    without rows to learn from or to forecast is no fold.
    """
    past = learn.guarded(rows, first=holdout)
    specs = [s for season in seasons for s in logistic_grid(season)]
    size = len(specs) // max(1, len(seasons))
    fits = learn.fit_many(past, features, label, specs)
    each = learn.forecasts(past, fits, specs, features).withColumn("candidate", F.col("spec") % size)
    scored = over_folds(per_fold(each, ["candidate"], label, "probability"), ["candidate"])
    named = [(i, s.history, s.half_life, s.c) for i, s in enumerate(specs[:size])]
    grid = rows.sparkSession.createDataFrame(named, "candidate int, history int, half_life double, c double")
    return F.broadcast(grid).join(scored, "candidate")


def preferred_logistic(candidates: DataFrame, band: float = BAND) -> DataFrame:
    """Among settings within the band of the best: a finite window first, the shortest, then the least losses."""
    return chosen(candidates, [F.col("history").isNull(), F.col("history")], band)


def ablation(rows: DataFrame, bundles: dict[str, list[str]], label: str, seasons: list[int], holdout: int) -> DataFrame:
    """bundle, its features, mean losses, and how much better or worse than the bundle before it.

    Bundles are nested and named beforehand; the model's settings are the same for all, so a difference is the features'.
    All bundles' models are fitted in the same passes over ``rows``.
    """
    past = learn.guarded(rows, first=holdout)
    every = list(dict.fromkeys(f for features in bundles.values() for f in features))
    learn.allowed(rows, every, ())
    specs = [learn.Spec(season, PROBE_HISTORY, None, PROBE_C, tuple(features)) for features in bundles.values() for season in seasons]
    fits = learn.fit_many(past, every, label, specs)
    each = learn.forecasts(past, fits, specs, every).withColumn("at", F.floor(F.col("spec") / len(seasons)).cast("int"))
    scored = over_folds(per_fold(each, ["at"], label, "probability"), ["at"])
    named = [(i, name, len(features)) for i, (name, features) in enumerate(bundles.items())]
    scored = F.broadcast(rows.sparkSession.createDataFrame(named, "at int, bundle string, n_features int")).join(scored, "at")
    before = scored.select((F.col("at") + 1).alias("at"), F.col("mean_brier").alias("_before"))
    return scored.join(F.broadcast(before), "at", "left").withColumn("change", F.col("mean_brier") - F.col("_before")).drop("at", "_before")


def improves(candidates: DataFrame, plain: Column, band: float = BAND) -> DataFrame:
    """The best candidate, but the plain one unless it is beaten by more than the band."""
    own = F.min(F.when(plain, F.col("mean_brier"))).over(metrics.whole())
    best = candidates.withColumn("_plain", own).where(plain | (F.col("_plain") - F.col("mean_brier") > band))
    return best.orderBy("mean_brier", "mean_log_loss").limit(1).drop("_plain")


#: Weights of a partner beside the pure forecast.
BLEND_WEIGHTS = (0.1, 0.2, 0.3, 0.4, 0.5)


def blend_candidates(predictions: DataFrame, y: str, pure: str, partners: dict[str, str], weights: tuple[float, ...] = BLEND_WEIGHTS) -> DataFrame:
    """partner, weight, mean losses and folds of the pure forecast (partner ``pure``, weight 0) and of every blend with a partner.

    ``predictions`` (season, y, a column for each forecast) are read once: each row is spread over the candidates. A row
    without a label, or without one of the forecasts, is scored for no candidate, so all are judged on the same rows.
    """
    columns = [pure, *partners.values()]
    known = predictions.dropna(subset=[y, *columns]).select("season", F.col(y).alias("y"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    one = lambda name, w, p: F.struct(F.lit(name).alias("partner"), F.lit(float(w)).alias("weight"), p.alias("p"))
    every = [one("pure", 0.0, F.col("_0"))] + [one(n, w, blend(F.col("_0"), F.col(f"_{i + 1}"), w)) for i, n in enumerate(partners) for w in weights]
    each = known.select("season", "y", F.explode(F.array(*every)).alias("c")).select("season", "y", "c.*")
    return over_folds(per_fold(each, ["partner", "weight"], "y", "p"), ["partner", "weight"])


def best_blend(candidates: DataFrame, band: float = BAND) -> DataFrame:
    """The blend with the least losses if it beats the pure forecast by more than the band, else the pure forecast."""
    return improves(candidates, F.col("partner") == "pure", band)


def holdout(predictions: DataFrame, y: str, models: dict[str, str], reference: str) -> DataFrame:
    """Losses of frozen forecasts (name -> column) on held-out rows, each compared with the reference row by row."""
    rows = predictions.where(F.col(y).isNotNull())
    label = F.col(y).cast("double")
    parts = []
    for name, p in models.items():
        scored = metrics.scores(rows, y, p)
        squared = rows.select(F.col("game_id").alias("key"), F.pow(F.col(p) - label, 2).alias("a"), F.pow(F.col(models[reference]) - label, 2).alias("b"))
        compared = metrics.paired_bootstrap(squared, "a", "b").select("difference", "low", "high", "verdict")
        parts.append(scored.crossJoin(F.broadcast(compared)).withColumn("model", F.lit(name)))  # one row by one row
    return reduce(DataFrame.unionByName, parts)


def holdout_calibration(predictions: DataFrame, y: str, models: dict[str, str]) -> DataFrame:
    """model, its calibration bins on held-out rows, and the expected calibration error of all of them."""
    rows = predictions.where(F.col(y).isNotNull())
    parts = []
    for name, p in models.items():
        bins = metrics.calibration(rows, y, p)
        parts.append(bins.crossJoin(F.broadcast(metrics.ece(bins))).withColumn("model", F.lit(name)))  # ten rows by one
    return reduce(DataFrame.unionByName, parts)


def holdout_segments(predictions: DataFrame, y: str, models: dict[str, str], segments: dict[str, Column], quarters: dict[str, str] | None = None) -> DataFrame:
    """segment, model, n, rate and losses on held-out rows, for diagnosis alone; an empty segment has no rows.

    ``quarters`` names segments of the rows at or above a column's 75th percentile among the held-out rows.
    """
    rows = predictions.where(F.col(y).isNotNull())
    for name, column in (quarters or {}).items():
        least = audit.quantiles(rows, column, [0.75]).select(F.col("value").alias(f"_{name}"))
        rows = rows.crossJoin(F.broadcast(least))  # one row
        segments = segments | {name: F.col(column) >= F.col(f"_{name}")}
    forecast = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(p).cast("double").alias("p")) for n, p in models.items()]))
    each = metrics.in_segments(rows, segments).select("segment", F.col(y).alias("y"), forecast.alias("f")).select("segment", "y", "f.*")
    scored = metrics.scores(each, "y", "p", ["segment", "model"]).drop("accuracy")
    rates = each.groupBy("segment", "model").agg(F.avg(F.col("y").cast("double")).alias("rate"))
    return scored.join(rates, ["segment", "model"])
