"""Small market-relative models fitted as Spark aggregates: rows stay distributed, models are tables too."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import clip, expit, finite, logit
from tidemark.operators.ordered import same_key
from tidemark.session import written

SCALE_FLOOR = 1e-6
STEP_LIMIT, MAX_STEPS = 1e-9, 40
DESCENT = 1e-12
#: Fixed value: fewer training rows make no model.
LEAST_ROWS = 50
#: Steps between two written tables of models; at most so many models are broadcast, more are joined by a shuffle.
CHAINED = 2
BROADCAST_MODELS = 50_000


def moments(df: DataFrame, by: list[str], features: list[str], weight: str | None = None) -> DataFrame:
    """Population mean and floored sd of each feature per model key, from training rows only; one aggregate."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        if weight:
            total = F.sum(weight)
            mean = F.sum(F.col(weight) * x) / total
            sd = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(weight) * x * x) / total - mean * mean))
        else:
            mean, sd = F.avg(x), F.stddev_pop(x)
        aggs += [mean.alias(f"_m_{f}"), F.greatest(F.coalesce(sd, F.lit(0.0)), F.lit(SCALE_FLOOR)).alias(f"_s_{f}")]
    return df.groupBy(*by).agg(*aggs)


def _beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their key's row in a table of models or statistics.

    A few keys may hold all rows, so a shuffle by them would leave most tasks empty and give one a whole key; it is used
    only above BROADCAST_MODELS keys.
    """
    few = table.limit(BROADCAST_MODELS + 1).count() <= BROADCAST_MODELS
    return rows.join(F.broadcast(table) if few else table, by)


def standardize(df: DataFrame, stats: DataFrame, by: list[str], features: list[str], bound: float = 5.0, prefix: str = "z_") -> DataFrame:
    """z-scores clipped to +-bound, with statistics that came from training rows."""
    from tidemark.operators.temporal import scalar_join

    j = _beside(df, written(stats, "statistics"), by) if by else scalar_join(df, stats)
    return j.select(*df.columns, *[clip((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}"), -bound, bound).alias(prefix + f) for f in features])


def _projected_newton(w: np.ndarray, g: np.ndarray, h: np.ndarray, bound: float | None) -> np.ndarray:
    """One Newton step inside the box; coefficients held at a bound by their gradient stay out of the linear system."""
    free = np.ones(len(w), bool)
    if bound is not None:
        free = ~(((w >= bound) & (g < 0)) | ((w <= -bound) & (g > 0)))
    step = np.zeros_like(w)
    if free.any():
        step[free] = np.linalg.solve(h[np.ix_(free, free)], -g[free])
    new = w + step
    return new if bound is None else np.clip(new, -bound, bound)


def training_state(design: DataFrame, keys: list[str], y: str, least_rows: int) -> DataFrame:
    """keys, rows, reason: how many rows each model has, and why it cannot be fitted (too few rows, one class), else null."""
    counts = design.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    reason = F.when(F.col("rows") < least_rows, "few_rows").when(F.col("_lo") == F.col("_hi"), "one_class")
    return counts.select(*keys, "rows", reason.alias("reason"))


def _newton_tasks(keys: list[str], k: int, penalty: np.ndarray, bound: float | None):
    """For mapInPandas over models with their sums: the next coefficients of each, or half the last step if it went too far."""
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def step(row) -> tuple[np.ndarray, np.ndarray, float, int, bool]:
        c, best = (np.array([getattr(row, f"{x}{i}") for i in range(k)]) for x in ("_c", "_best"))
        least = row._least
        if row._done:
            return c, best, least, row._steps, True
        objective = row._f / row._n + float(penalty @ c**2)
        if objective > least + DESCENT * (1 + abs(objective)):
            return (c + best) / 2, best, least, row._steps + 1, False
        h = np.zeros((k, k))
        for (a, b), value in zip(pairs, row._h, strict=True):
            h[a, b] = h[b, a] = value / row._n
        new = _projected_newton(c, np.array(row._g) / row._n + 2 * penalty * c, h + np.diag(2 * penalty), bound)
        return new, c, objective, row._steps + 1, bool(np.abs(new - c).max() < STEP_LIMIT)

    def run(batches):
        for batch in batches:
            found = [step(SimpleNamespace(**row)) for row in batch.to_dict("records")]
            out = batch[keys].copy()
            for at, name in enumerate(("_c", "_best")):
                for i in range(k):
                    out[f"{name}{i}"] = [f[at][i] for f in found]
            for at, name in enumerate(("_least", "_steps", "_done"), 2):
                out[name] = [f[at] for f in found]
            yield out

    return run


def fit_market_offset(rows: DataFrame, by: list[str], features: list[str], p: str = "p", y: str = "y", l2: float | dict[str, float] = 0.1, bound: float | None = 0.25,
                      weight: str | None = None, intercept: bool = False, eps: float = 1e-6, persist: bool = True, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Market-offset logistic models, all keys of ``by`` in the same passes. Returns (by..., feature, coef, steps).

    Minimises mean(w * (log(1 + e^z) - y z)) + sum(l2 * c^2) with z = logit(p) + x.c inside |c| <= bound.
    Models are a table, written every few steps: a step joins it to the rows, adds up gradient and Hessian map-side
    (k + k(k+1)/2 numbers a model) and solves the k x k systems in tasks over models. The driver sees how many are open.
    Keys with fewer than ``least_rows`` rows or one class get no coefficients (see ``training_state``); without keys that is
    an error.
    """
    names = (["intercept"] if intercept else []) + list(features)
    penalty = np.array([l2[n] if isinstance(l2, dict) else l2 for n in names], float)
    x = [F.lit(1.0) if n == "intercept" else F.col(n).cast("double") for n in names]
    keys = list(by) or ["_model"]
    design = rows.select(
        *(by or [F.lit(0).alias("_model")]), logit(F.col(p), eps).alias("_o"), F.col(y).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), F.array(*x).alias("_x"),
    )
    if persist:
        # Folds and variants make several rows of one: a split of the input would be one large block of the cache.
        design = design.repartition(F.xxhash64("_o", "_x", "_y")).persist()
    k = len(names)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    # Single numbers, not arrays: a hash aggregate carries them along.
    zeros = [F.lit(0.0).alias(f"{x}{i}") for x in ("_c", "_best") for i in range(k)]
    state = training_state(design, keys, "_y", least_rows)
    state = written(state.select(*keys, "reason", *zeros, F.lit(float("inf")).alias("_least"), F.lit(0).alias("_steps"), F.lit(False).alias("_done")), "models")
    if not by and state.where("reason IS NOT NULL").count():
        raise ValueError("Insufficient training outcomes")
    models = state.where("reason IS NULL").drop("reason")
    few = models.limit(BROADCAST_MODELS + 1).count() <= BROADCAST_MODELS
    columns = [c for c in models.columns if c not in keys]
    solve = _newton_tasks(keys, k, penalty, bound)

    def newton(now: DataFrame) -> DataFrame:
        j = design.alias("d").join((F.broadcast(now) if few else now).alias("m"), same_key(keys, "d", "m"))
        z = F.col("_o")
        for a in range(k):
            z = z + F.col("_x")[a] * F.col(f"_c{a}")
        cost = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("_y") * z
        scored = j.select(*[F.col(f"d.{c}") for c in keys], "_y", "_w", "_x", expit(z).alias("_q"), cost.alias("_l"), *columns)
        r = F.col("_w") * (F.col("_q") - F.col("_y"))
        v = F.col("_w") * F.col("_q") * (F.lit(1.0) - F.col("_q"))
        sums = scored.groupBy(*keys).agg(
            F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_l")).alias("_f"), F.array(*[F.sum(r * F.col("_x")[a]) for a in range(k)]).alias("_g"),
            F.array(*[F.sum(v * F.col("_x")[a] * F.col("_x")[b]) for a, b in pairs]).alias("_h"), *[F.first(c).alias(c) for c in columns],
        )
        return sums.mapInPandas(solve, models.schema)

    closed, open_ = [], models
    for _ in range(MAX_STEPS // CHAINED):
        now = open_
        for _ in range(CHAINED):
            now = newton(now)
        note = Observation()
        now = written(now.observe(note, F.count_if(~F.col("_done")).alias("n")), "models")
        closed.append(now.where("_done"))
        open_ = now.where("NOT _done")
        left = note.get.get("n") or 0
        if not left:
            break
    else:
        raise ValueError(f"{left} models did not converge")
    if persist:
        design.unpersist()
    done = reduce(DataFrame.unionByName, closed)
    coefficients = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_c{i}").alias("coef")) for i, n in enumerate(names)])
    return done.select(*by, F.inline(coefficients), F.col("_steps").alias("steps"))


def score_offset(rows: DataFrame, coef: DataFrame, by: list[str], features: list[str], p: str = "p", eps: float = 1e-6, name: str = "predicted") -> DataFrame:
    """Predictions from stored coefficients: one row per model is joined to the rows; clipped to [1e-6, 1 - 1e-6]."""
    from tidemark.operators.temporal import scalar_join

    wide = coef.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("feature") == "intercept", F.col("coef"))), F.lit(0.0)).alias("_b"),
        *[F.max(F.when(F.col("feature") == f, F.col("coef"))).alias(f"_c_{f}") for f in features],
    )
    j = _beside(rows, wide, by) if by else scalar_join(rows, wide)
    z = logit(F.col(p), eps) + F.col("_b")
    for f in features:
        z = z + F.col(f) * F.col(f"_c_{f}")
    return j.withColumn(name, clip(expit(z), 1e-6, 1 - 1e-6)).drop("_b", *[f"_c_{f}" for f in features])


def _vector(df: DataFrame, features: list[str]):
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    raw = VectorAssembler(inputCols=features, outputCol="_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    return [raw, scale]


def fit_logistic(df: DataFrame, features: list[str], y: str = "y", c: float = 0.1):
    """Standardised logistic regression with inverse penalty ``c`` on the summed loss; the intercept is free."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    n = df.count()
    model = LogisticRegression(featuresCol="features", labelCol=y, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10)
    return Pipeline(stages=[*_vector(df, features), model]).fit(df.withColumn(y, F.col(y).cast("double")))


def score_logistic(df: DataFrame, fit, features: list[str], name: str = "predicted") -> DataFrame:
    """Predictions of ``fit_logistic`` as one Column expression over the raw features (scales folded into it)."""
    scaler, model = fit.stages[1], fit.stages[2]
    z = F.lit(float(model.intercept))
    for i, f in enumerate(features):
        sd = float(scaler.std[i])
        if sd > 0:
            z = z + (F.col(f) - F.lit(float(scaler.mean[i]))) * F.lit(float(model.coefficients[i]) / sd)
    return df.withColumn(name, expit(z))


def fit_trees(df: DataFrame, features: list[str], y: str = "y", trees: int = 80, depth: int = 2, min_leaf: int = 60, rate: float = 0.05, seed: int = 1729):
    """Shallow boosted trees; split finding is MLlib's, so scores are comparable but not bit-equal to other libraries."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    model = GBTClassifier(featuresCol="features", labelCol=y, maxIter=trees, maxDepth=depth, minInstancesPerNode=min_leaf, stepSize=rate, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(df.withColumn(y, F.col(y).cast("double")))


def gate_rows(df: DataFrame, p: str, distance: str, vol_ratio: str) -> DataFrame:
    """One row per side with the gate features and the realised net return of that side."""
    from tidemark.functions.money import side_features

    sides = df.withColumn("side", F.explode(F.array(F.lit("yes"), F.lit("no"))))
    f = side_features(F.col(p), F.col("bid"), F.col("ask"), F.col("spread"), F.col(distance), F.col(vol_ratio), F.col("side"))
    won = F.when(F.col("side") == "yes", F.col("y")).otherwise(F.lit(1) - F.col("y"))
    return sides.withColumn("_f", f).select("*", "_f.win", "_f.edge", F.col("_f.distance").alias("gate_distance"), F.col("_f.vol_ratio").alias("gate_vol"), (won - F.col("_f.cost")).alias("net")).drop("_f")


def fit_ridge(rows: DataFrame, by: list[str], features: list[str], target: str, alpha: float) -> DataFrame:
    """Ridge regressions, all keys of ``by`` in the same passes. Returns (by..., feature, coef) on the raw features.

    Features are standardised by their population mean and sd, ``alpha`` is on the summed squares, the intercept is free.
    Two aggregates, the second of k(k+1)/2 + k + 2 sums a model; the k x k systems are solved in tasks. Rows with a null or
    non-finite value in a feature or the target take no part; a key without rows has no model.
    """
    from tidemark.operators.temporal import scalar_join

    k = len(features)
    usable = F.lit(True)
    for c in [*features, target]:
        usable = usable & finite(F.col(c).cast("double"))
    d = rows.filter(usable).select(*by, *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    stats = moments(d, by, features)
    z = standardize(d, stats, by, features, bound=float("inf"), prefix="_z_")
    zs = [F.col(f"_z_{f}") for f in features]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    sums = z.groupBy(*by).agg(F.avg("_y").alias("_mean"), F.array(*[F.sum(x * F.col("_y")) for x in zs]).alias("_g"), F.array(*[F.sum(zs[a] * zs[b]) for a, b in pairs]).alias("_h"))
    names = ["intercept", *features]
    schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("feature", T.StringType()), T.StructField("coef", T.DoubleType())])

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                h = np.zeros((k, k))
                for (a, b), value in zip(pairs, row["_h"], strict=True):
                    h[a, b] = h[b, a] = value
                w = np.linalg.solve(h + alpha * np.eye(k), np.array(row["_g"]))
                w = w / np.array([row[f"_s_{f}"] for f in features])
                first = row["_mean"] - float(w @ np.array([row[f"_m_{f}"] for f in features]))
                out += [(*[row[c] for c in by], n, float(c)) for n, c in zip(names, [first, *w], strict=True)]
            yield pd.DataFrame(out, columns=[*by, "feature", "coef"])

    columns = ["_mean", "_g", "_h", *[f"_{x}_{f}" for x in "ms" for f in features]]
    if by:
        j = sums.alias("d").join(stats.alias("m"), same_key(by, "d", "m")).select(*[F.col(f"d.{c}") for c in by], *columns)
    else:
        j = scalar_join(sums, stats).select(*columns)
    return j.filter("_mean IS NOT NULL").mapInPandas(solve, schema)


def score_linear(rows: DataFrame, coef: DataFrame, by: list[str], features: list[str], name: str = "prediction") -> DataFrame:
    """Predictions of ``fit_ridge``: one row per model is joined to the rows; null where a feature is null."""
    from tidemark.operators.temporal import scalar_join

    pick = lambda f: F.max(F.when(F.col("feature") == f, F.col("coef")))
    wide = coef.groupBy(*by).agg(pick("intercept").alias("_b"), *[pick(f).alias(f"_c_{f}") for f in features])
    j = rows.join(wide, by) if by else scalar_join(rows, wide)
    value = F.col("_b")
    for f in features:
        value = value + F.col(f) * F.col(f"_c_{f}")
    return j.withColumn(name, value).drop("_b", *[f"_c_{f}" for f in features])


def fit_gate(rows: DataFrame, features: list[str], target: str = "net", alpha: float = 100.0) -> DataFrame:
    """Ridge on per-side realised net return: (feature, coef), to be scored by ``score_linear``."""
    return fit_ridge(rows, [], features, target, alpha)


def select_weight(df: DataFrame, by: list[str], model: str, market: str, y: str, day: str, weights: list[float], brier_guard: bool = True) -> DataFrame:
    """Blend weight with the least day-mean log loss whose Brier is not worse than the market's.

    Weight 0 (the market) is always in the grid and wins ties within 1e-8; then the smaller weight wins.
    """
    from tidemark.functions.numeric import blend_linear
    from tidemark.operators.metrics import day_mean_score
    from tidemark.operators.temporal import scenario_grid

    grid = scenario_grid(df.select(*by, model, market, y, day), weight=sorted({0.0, *[float(w) for w in weights]}))
    grid = grid.withColumn("_b", blend_linear(F.col(model), F.col(market), F.col("weight")))
    s = day_mean_score(grid, [*by, "weight"], "_b", y, day)
    base = lambda c: F.max(F.when(F.col("weight") == 0.0, F.col(c)))
    b = s.groupBy(*by).agg(base("brier").alias("_brier"), base("log_loss").alias("_loss"))
    from tidemark.operators.temporal import scalar_join

    j = s.join(b, by) if by else scalar_join(s, b)
    ok = (F.col("weight") == 0.0) | ((F.col("log_loss") < F.col("_loss") - 1e-8) & ((F.col("brier") <= F.col("_brier")) if brier_guard else F.lit(True)))
    pick = F.struct(F.when(F.col("weight") == 0.0, F.col("log_loss") - 1e-8).otherwise(F.col("log_loss")).alias("l"), "weight")
    return j.filter(ok).groupBy(*by).agg(F.min_by(F.struct("weight", "log_loss", "brier"), pick).alias("_m")).select(*by, "_m.*")


def select_penalty(scores: DataFrame, by: list[str], penalty: str = "penalty", loss: str = "log_loss") -> DataFrame:
    """Penalty with the least validation loss; the larger penalty wins ties."""
    return scores.groupBy(*by).agg(F.min_by(penalty, F.struct(F.col(loss), -F.col(penalty))).alias(penalty))


def ensemble(df: DataFrame, keys: list[str], p: str, market: str) -> DataFrame:
    """Mean and 5/95 percent quantiles over members, and the guarded probability (bounded group: one row per member)."""
    from tidemark.functions.numeric import guarded_probability

    g = df.groupBy(*keys).agg(
        F.avg(p).alias("mean"), F.percentile(p, F.lit(0.05)).alias("low"), F.percentile(p, F.lit(0.95)).alias("high"), F.max(market).alias("market"), F.count(F.lit(1)).alias("members")
    )
    return g.withColumn("guarded", guarded_probability(F.col("mean"), F.col("low"), F.col("high"), F.col("market")))


def parent_blend(rows: DataFrame, members: DataFrame, keys: list[str], weights: dict[str, float], count: int = 3, event: list[str] | None = None,
                 ticker: str = "ticker", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Fixed-weight blend of parent models, each the plain mean of its ``count`` members. Adds ``blend`` and ``reason``.

    ``members`` is long: (keys..., parent, member, p). A row whose parents do not all have exactly ``count`` different
    members with probabilities in [0, 1] gets ``missing_member`` or ``invalid_probability`` and no blend. With ``event``
    the rows are brackets of one event: each parent is divided by its own mass over the event, then blended, then divided
    again, so the weights stay what they are; an event that is no complete partition, has a bad row or no mass gets no
    blend on any of its rows (``incomplete_event``, ``bad_member_in_event``, ``no_mass``).
    """
    from tidemark.operators.brackets import partition_check

    if any(not np.isfinite(w) or w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("Weights must be shares that add up to one")
    valid = F.coalesce((F.col("p") >= 0) & (F.col("p") <= 1) & ~F.isnan("p"), F.lit(False))
    aggs = []
    for i, parent in enumerate(weights):
        own = lambda x, parent=parent: F.when(F.col("parent") == parent, x)
        aggs += [F.avg(own(F.col("p"))).alias(f"_p{i}"), F.count(own(F.lit(1))).alias(f"_n{i}"), F.count_distinct(own(F.col("member"))).alias(f"_d{i}")]
    known = members.filter(F.col("parent").isin(*weights))
    per = known.groupBy(*keys).agg(*aggs, F.count_if(~valid).alias("_bad"))
    n = range(len(weights))
    complete = F.lit(True)
    for i in n:
        complete = complete & (F.coalesce(F.col(f"_n{i}"), F.lit(0)) == count) & (F.col(f"_d{i}") == count)
    j = rows.join(per, keys, "left").withColumn("reason", F.when(~complete | F.col("_bad").isNull(), "missing_member").when(F.col("_bad") > 0, "invalid_probability"))
    mix = lambda names: sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights.values(), names)), F.lit(0.0))
    drop = ["_bad", *[f"_{x}{i}" for i in n for x in "pnd"]]
    if event is None:
        return j.withColumn("blend", F.when(F.col("reason").isNull(), mix([f"_p{i}" for i in n]))).drop(*drop)
    whole = partition_check(rows, event, lower, upper, ticker).select(*event, F.col("reason").isNotNull().alias("_open"))
    mass = j.groupBy(*event).agg(*[F.sum(f"_p{i}").alias(f"_m{i}") for i in n], F.count("reason").alias("_reasons"))
    k = j.join(mass.join(whole, event), event)
    weightless = F.lit(False)
    for i, w in enumerate(weights.values()):
        weightless = weightless | ((F.lit(float(w)) > 0) & ~F.coalesce(F.col(f"_m{i}") > 0, F.lit(False)))
    k = k.withColumn("reason", F.coalesce("reason", F.when(F.col("_open"), "incomplete_event").when(F.col("_reasons") > 0, "bad_member_in_event").when(weightless, "no_mass")))
    # Every parent has mass 1 after its own division and the weights add up to 1, so the second division is by 1.
    share = [F.when(F.col(f"_m{i}") > 0, F.col(f"_p{i}") / F.col(f"_m{i}")).otherwise(F.lit(0.0)) for i in n]
    k = k.withColumns({f"_p{i}": x for i, x in enumerate(share)})
    return k.withColumn("blend", F.when(F.col("reason").isNull(), mix([f"_p{i}" for i in n]))).drop(*drop, "_open", "_reasons", *[f"_m{i}" for i in n])


def user_model(df: DataFrame, predict, columns: list[str], name: str = "predicted") -> DataFrame:
    """Score with a caller's vectorised function (pandas Series in, Series out) in Arrow batches."""
    @F.pandas_udf("double")
    def udf(frame: pd.DataFrame) -> pd.Series:
        return predict(*[frame[c] for c in columns])

    return df.withColumn(name, udf(F.struct(*columns)))
