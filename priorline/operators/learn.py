"""Forecasts fitted on the past: median imputation, population scaling, L2 logistic regression, walk-forward folds, tie rules.

Many models are fitted together. A model is a ``Spec``: the season it is to forecast, how many past seasons it learns from
or how fast they lose weight, its regularisation and its features. All of them share each pass over the rows: a task adds up
every model's gradient and curvature over its rows (numpy on Arrow batches), Spark adds those sums, and the driver solves
one small system a model. So a grid of 40 settings over four seasons takes as many passes as its slowest model, some ten.
Forecasts are plain column expressions of the coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seasons from here on are held out of every fit and choice.
HOLDOUT_FROM = 2025
#: Newton steps end when no coefficient moves by more than this; most steps.
TOLERANCE, STEPS = 1e-9, 60
#: Most models whose coefficients are broadcast to the rows that they forecast.
MOST_SPECS = 20_000


def guarded(df: DataFrame, season: str = "season", first: int = HOLDOUT_FROM) -> DataFrame:
    """``df``, failing when it runs if it holds a held-out season."""
    ok = F.when(F.col(season) >= first, F.raise_error(F.lit("held-out season in a fit")).cast("boolean")).otherwise(F.lit(True))
    return df.where(ok)


def allowed(df: DataFrame, features: list[str], tripwires: tuple[str, ...] = ("score", "win", "result", "settle")) -> list[str]:
    """``features`` if all are columns and none names an outcome."""
    missing = [f for f in features if f not in df.columns]
    odd = [f for f in features if any(t in f for t in tripwires) and not f.startswith(("home_prior_", "away_prior_", "diff_prior_"))]
    if missing or odd:
        raise ValueError(f"features not allowed: missing {missing}, outcome-like {odd}")
    return features


def train_seasons(df: DataFrame, season: str, target: int, last: int | None = None) -> DataFrame:
    """Rows of seasons strictly before ``target``, the ``last`` so many of them or all."""
    past = df.where(F.col(season) < target)
    return past if last is None else past.where(F.col(season) >= target - last)


@dataclass(frozen=True)
class Spec:
    """One model: forecasts season ``target`` from the ``history`` seasons before it that have rows, or from all.

    With a ``half_life`` a season's rows weigh half as much for each so many seasons that it lies before the latest one
    learnt from. ``target`` None learns from every row. ``features`` None takes all that the fit is given.
    """

    target: int | None = None
    history: int | None = None
    half_life: float | None = None
    c: float = 1.0
    features: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.c <= 0 or (self.history is not None and self.history < 1) or (self.half_life is not None and self.half_life <= 0):
            raise ValueError(f"not a model: {self}")

    def seasons(self, there: list[int]) -> tuple[int, ...]:
        """The seasons it learns from, of those that have rows."""
        past = [s for s in sorted(there) if self.target is None or s < self.target]
        return tuple(past if self.history is None else past[-self.history :])

    def weight(self, season: int, latest: int) -> float:
        return 1.0 if self.half_life is None else 0.5 ** ((latest - season) / self.half_life)


@dataclass(frozen=True)
class Fitted:
    """A model's coefficients on the scale of its features, and the medians that stand for missing values."""

    spec: Spec
    intercept: float
    slopes: dict[str, float]
    medians: dict[str, float]
    rows: int
    steps: int

    def probability(self) -> Column:
        """The forecast as an expression of the features."""
        terms = [F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f])) * F.lit(b) for f, b in self.slopes.items()]
        return logistic(sum(terms, F.lit(self.intercept)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _summed(rows: DataFrame, columns: list[str], sums, keys: list) -> dict:
    """key -> vector, added up over all rows; ``sums(x, y, season)`` gives one batch's vectors by the key's place in ``keys``."""
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float)
            x = np.column_stack([get(c) for c in columns]) if columns else np.zeros((batch.num_rows, 0))
            for k, v in sums(x, get("_y"), get("_season")).items():
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["at", "sums"])

    parts = rows.mapInArrow(run, schema).select("at", F.posexplode("sums").alias("place", "value"))
    out: dict = {}
    for r in parts.groupBy("at", "place").agg(F.sum("value").alias("value")).collect():  # models x squared features
        out.setdefault(keys[r["at"]], {})[r["place"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _filled(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), medians, x)


def fit_many(rows: DataFrame, features: list[str], label: str, specs: list[Spec], season: str = "season") -> dict[Spec, Fitted]:
    """Every spec's model, fitted on the rows of its seasons that have a label.

    Missing values get the median of the seasons learnt from (0 where there is none at all), features are scaled by their
    mean and population deviation there (1 where constant), and the intercept is not penalised, as in the objective
    ``c * sum(weight * loss) + |b|^2 / 2``. A spec without rows is left out. ``rows`` is read once for each step: give
    a written table.
    """
    from priorline.operators.audit import quantiles_by

    x = [F.col(f).cast("double").alias(f) for f in features]
    known = rows.where(F.col(label).isNotNull()).select(*x, F.col(label).cast("double").alias("_y"), F.col(season).cast("int").alias("_season"))
    there = [r[0] for r in known.select("_season").distinct().collect() if r[0] is not None]
    sets = sorted({s.seasons(there) for s in specs if s.seasons(there)})
    if not sets:
        return {}
    long = known.select("_season", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)])).alias("_v")) if features else None
    medians = {s: np.zeros(len(features)) for s in sets}
    if features:
        in_sets = F.create_map(*[v for t in there for v in (F.lit(t), F.array(*[F.lit(i) for i, s in enumerate(sets) if t in s]).cast("array<int>"))])
        each = long.select(F.explode(F.element_at(in_sets, F.col("_season"))).alias("set"), "_v.*").where("value is not null and not isnan(value)")
        for r in quantiles_by(each, ["set", "feature"], "value", [0.5]).collect():
            medians[sets[r["set"]]][r["feature"]] = r["value"]
    held = {s: np.array(s) for s in sets}

    def moments(x, y, season):
        out = {}
        for i, s in enumerate(sets):
            own = _filled(x[np.isin(season, held[s])], medians[s]) - medians[s]
            if len(own):
                out[i] = np.concatenate([[len(own)], own.sum(axis=0), (own * own).sum(axis=0)])
        return out

    d = len(features)
    scale, mean, count = {}, {}, {}
    for s, v in _summed(known, features, moments, sets).items():
        count[s], about = v[0], v[1 : d + 1] / v[0]
        spread = np.sqrt(np.maximum(v[d + 1 :] / v[0] - about**2, 0))
        scale[s], mean[s] = np.where(spread > 1e-12 * (1 + np.abs(about)), spread, 1.0), medians[s] + about
    models = [s for s in specs if s.seasons(there) in count]
    used = {s: np.array([*[s.features is None or f in s.features for f in features], True]) for s in models}
    w = {s: np.zeros(d + 1) for s in models}
    best = {s: (np.inf, w[s]) for s in models}
    open_, steps = set(models), dict.fromkeys(models, 0)
    upper = np.triu_indices(d + 1)
    for _ in range(STEPS):
        if not open_:
            break
        todo = [s for s in models if s in open_]
        at = {s: w[s] for s in todo}

        def gram(x, y, season, todo=todo, at=at):
            out, scaled = {}, {}
            for i, spec in enumerate(todo):
                own = spec.seasons(there)
                if own not in scaled:
                    rows_ = np.isin(season, held[own])
                    z = (_filled(x[rows_], medians[own]) - mean[own]) / scale[own]
                    scaled[own] = np.column_stack([z, np.ones(len(z))]), y[rows_], season[rows_]
                z, t, when = scaled[own]
                if not len(z):
                    continue
                weight = np.array([spec.weight(s, own[-1]) for s in when]) if spec.half_life else np.ones(len(t))
                margin = z @ at[spec]
                p = 1 / (1 + np.exp(-margin))
                loss = weight @ (np.logaddexp(0, margin) - t * margin)
                out[i] = np.concatenate([[loss], z.T @ (weight * (p - t)), (z.T @ (z * (weight * p * (1 - p))[:, None]))[upper]])
            return out

        for spec, v in _summed(known, features, gram, todo).items():
            pull = np.append(np.ones(d), 0.0) / spec.c
            worth = v[0] + (pull * w[spec] ** 2).sum() / 2
            steps[spec] += 1
            if worth > best[spec][0] + 1e-9 * abs(best[spec][0]):
                w[spec] = (w[spec] + best[spec][1]) / 2  # too far: half the way back
                continue
            best[spec] = worth, w[spec]
            bent = np.zeros((d + 1, d + 1))
            bent[upper] = v[d + 2 :]
            bent = bent + np.triu(bent, 1).T + np.diag(pull)
            on = used[spec]
            move = np.zeros(d + 1)
            move[on] = np.linalg.lstsq(bent[np.ix_(on, on)], (v[1 : d + 2] + pull * w[spec])[on], rcond=None)[0]
            w[spec] = w[spec] - move
            if np.abs(move).max() < TOLERANCE:
                open_.discard(spec)
    out = {}
    for spec in models:
        own = spec.seasons(there)
        slopes = w[spec][:d] / scale[own]
        named = {f: float(b) for f, b, on in zip(features, slopes, used[spec], strict=False) if on}
        stand_ins = dict(zip(features, map(float, medians[own]), strict=True))
        out[spec] = Fitted(spec, float(w[spec][d] - slopes @ mean[own]), named, {f: stand_ins[f] for f in named}, int(count[own]), steps[spec])
    return out


def forecasts(rows: DataFrame, fits: dict[Spec, Fitted], specs: list[Spec], features: list[str], name: str = "probability") -> DataFrame:
    """``rows`` once for each model that forecasts their season, with ``spec`` (its place in ``specs``) and the forecast."""
    if len(specs) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} models at once")
    place = {s: i for i, s in enumerate(specs)}
    table = [
        (place[s], s.target, f.intercept, *[f.slopes.get(x, 0.0) for x in features], *[f.medians.get(x, 0.0) for x in features])
        for s, f in fits.items()
    ]
    columns = ["spec int", "_target int", "_b double", *[f"_w{i} double" for i in range(len(features))], *[f"_m{i} double" for i in range(len(features))]]
    models = rows.sparkSession.createDataFrame(table, ", ".join(columns))
    terms = [F.coalesce(F.col(f).cast("double"), F.col(f"_m{i}")) * F.col(f"_w{i}") for i, f in enumerate(features)]
    joined = rows.join(F.broadcast(models), rows["season"] == F.col("_target"))
    return joined.select(*rows.columns, "spec", logistic(sum(terms, F.col("_b"))).alias(name))


class Logistic:
    """One model, all statistics from the training rows."""

    def __init__(self, features: list[str], label: str, c: float = 1.0) -> None:
        self.features, self.label, self.spec = features, label, Spec(c=c)

    def fit(self, train: DataFrame) -> "Logistic":
        rows = train.select(*self.features, self.label, F.lit(0).alias("_all"))
        fits = fit_many(rows, self.features, self.label, [self.spec], "_all")
        if not fits:
            raise ValueError("no training rows")
        self.model = fits[self.spec]
        return self

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self.model.probability())


def walk_forward(df: DataFrame, features: list[str], label: str, folds: list[int], c: float = 1.0, last: int | None = None) -> DataFrame:
    """Predictions for each fold's season from a model fitted on the seasons before it."""
    specs = [Spec(season, last, None, c) for season in folds]
    return forecasts(df, fit_many(df, features, label, specs), specs, features).drop("spec")


def chosen(candidates: DataFrame, score: str, second: str, preference: list[Column], band: float = 1e-4) -> DataFrame:
    """The preferred candidate within ``band`` of the best score, then the better on ``second``."""
    from priorline.operators.metrics import tie_band

    return tie_band(candidates, score, [*preference, F.col(score), F.col(second)], band)
