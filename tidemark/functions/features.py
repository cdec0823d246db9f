"""Design-matrix columns as projections; learned scales are applied by ``operators.models``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, logit

# Spline knots, interaction bound and the offsets of the what-if report.
KNOTS = [-4, -2, 0, 2, 4]
BOUND = 5.0
WHAT_IF = {"odds_step": 0.05, "spread": 0.01, "hours": 12.0, "low": 0.001, "high": 0.999}
# Fixed values of the weather designs: what an unobserved row takes, units of the columns, bound of bracket distances.
UNOBSERVED_F, UNOBSERVED_AGE = 65.0, 3.0
TEN_F, FIVE_F, THREE_HOURS, DAY_HOURS, FAR = 10.0, 5.0, 3.0, 24.0, 3.0


def market_design(df: DataFrame, series: list[str], kind: str = "context", p: str = "p", spread: str = "spread", hours: str = "hours_left") -> DataFrame:
    """Market features: log odds, p, p(1-p), spread, hours, series one-hots; the beta pair; for ``context`` also h^2,
    h*z and series*z; for ``spline`` hinges of z at fixed knots as well."""
    c = clip(F.col(p), 0.001, 0.999)
    c6, z = clip(F.col(p), 1e-6, 1 - 1e-6), logit(F.col(p))
    h = F.col(hours) / F.lit(24.0)
    flag = lambda s: (F.col("series") == s).cast("int").cast("double")
    cols = {"logit": logit(F.col(p), 0.001), "p_clipped": c, "variance": c * (F.lit(1.0) - c), "h": h, "beta_yes": F.log(c6), "beta_no": -F.log(F.lit(1.0) - c6)}
    cols |= {f"series_{s}": flag(s) for s in series}
    if kind in ("context", "spline"):
        cols |= {"h2": h * h, "hz": h * z} | {f"series_{s}_z": flag(s) * z for s in series[:-1]}
    if kind == "spline":
        cols |= {f"hinge_{'m' if k < 0 else ''}{abs(k)}": F.greatest(z - F.lit(float(k)), F.lit(0.0)) for k in KNOTS}
    return df.withColumns(cols)


def with_missing(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Scale columns and add a 0/1 indicator each; a missing value becomes 0 and stays visible in the indicator."""
    out = {}
    for name, scale in scales.items():
        out[name] = F.coalesce(F.col(name).cast("double") / F.lit(scale), F.lit(0.0))
        out[f"{name}_missing"] = F.col(name).isNull().cast("int").cast("double")
    return df.withColumns(out)


def station_design(df: DataFrame) -> DataFrame:
    """Station features around an observed peak: bounded bracket distances, open-end flags, ages and model gaps.

    Needs observed, observed_max, observed_temperature, observed_trend, observation_age_hours, local_day_hour, lower,
    upper, gfs, ecmwf; unobserved rows take UNOBSERVED_F, no trend and UNOBSERVED_AGE.
    """
    c = F.col
    ten = F.lit(TEN_F)
    peak, temp = F.coalesce(c("observed_max"), F.lit(UNOBSERVED_F)), F.coalesce(c("observed_temperature"), F.lit(UNOBSERVED_F))
    mean = (c("gfs") + c("ecmwf")) / F.lit(2.0)
    # An open end is a bound at infinity: its distance is the bound itself.
    distance = lambda end, x, open_: F.when(end.isNull(), F.lit(open_)).otherwise(clip((end - x) / ten, -FAR, FAR))
    flag = lambda x: x.cast("int").cast("double")
    return df.withColumns({
        "s_observed": flag(F.coalesce(c("observed"), F.lit(False))), "s_lower": distance(c("lower"), peak, -FAR), "s_upper": distance(c("upper"), peak, FAR),
        "s_open_low": flag(c("lower").isNull()), "s_open_high": flag(c("upper").isNull()),
        "s_drop": (peak - temp) / ten, "s_trend": F.coalesce(c("observed_trend"), F.lit(0.0)) / ten,
        "s_age": F.coalesce(c("observation_age_hours"), F.lit(UNOBSERVED_AGE)) / F.lit(THREE_HOURS), "s_hour": F.coalesce(c("local_day_hour"), F.lit(0.0)) / F.lit(DAY_HOURS),
        "s_gfs": (c("gfs") - peak) / ten, "s_ecmwf": (c("ecmwf") - peak) / ten, "s_gap": F.abs(c("gfs") - c("ecmwf")) / ten,
        "s_lower_mean": distance(c("lower"), mean, -FAR), "s_upper_mean": distance(c("upper"), mean, FAR),
    })


# The scale of each remaining-day column.
REMAINING_SCALES = {
    "forecast_revision_f": 5.0, "mean_relative_humidity": 100.0, "max_wind_mph": 30.0, "mean_cloud_cover": 100.0, "model_disagreement_f": 5.0, "gfs_dev": 5.0, "ecmwf_dev": 5.0,
}


def remaining_design(df: DataFrame) -> DataFrame:
    """Remaining-day features with missing indicators and model deviations from the blended maximum."""
    base = F.col("remaining_forecast_max")
    d = df.withColumns({
        "gfs_dev": F.col("gfs_remaining_max") - base, "ecmwf_dev": F.col("ecmwf_remaining_max") - base, "h_remaining": F.col("remaining_hours") / F.lit(DAY_HOURS),
    })
    return with_missing(d, REMAINING_SCALES)


def path_design(df: DataFrame) -> DataFrame:
    """Innovation, trend and gap features; rows without an observation, its innovation or either model are left out."""
    c, base = F.col, F.col("remaining_forecast_max")
    needed = ["observation_innovation_f", "observed_trend", "observed_temperature", "observed_max", "gfs_remaining_max", "ecmwf_remaining_max", "remaining_forecast_max"]
    return df.dropna(subset=needed).withColumns({
        "j_innovation": c("observation_innovation_f") / F.lit(FIVE_F), "j_trend": c("observed_trend") / F.lit(FIVE_F), "j_now": (c("observed_temperature") - base) / F.lit(TEN_F),
        "j_peak": (c("observed_max") - base) / F.lit(TEN_F), "j_hours": c("remaining_hours") / F.lit(DAY_HOURS), "j_models": (c("gfs_remaining_max") - c("ecmwf_remaining_max")) / F.lit(FIVE_F),
        "j_gap": c("model_disagreement_f") / F.lit(FIVE_F), "j_age": c("observation_age_hours") / F.lit(THREE_HOURS),
    })


def regional_design(df: DataFrame) -> DataFrame:
    """Second-venue distribution features; rows without a finite median are not eligible."""
    a, b, lo, hi = (F.col(n) for n in ("median_low", "median_high", "q25_low", "q75_high"))
    flag = lambda x: x.cast("int").cast("double")
    return df.filter(a.isNotNull() & b.isNotNull()).withColumns({
        "r_center": ((a + b) / F.lit(2.0) - F.col("remaining_forecast_max")) / F.lit(FIVE_F), "r_width": (b - a) / F.lit(TEN_F), "r_spread": F.coalesce("mean_spread", F.lit(0.0)),
        "r_spread_missing": flag(F.col("mean_spread").isNull()), "r_iqr": F.coalesce((hi - lo) / F.lit(TEN_F), F.lit(0.0)), "r_iqr_missing": flag(lo.isNull() | hi.isNull()),
    })


def product(a: Column, b: Column) -> Column:
    """Product of two standardised features, clipped."""
    return clip(a * b, -BOUND, BOUND)


def sign_symmetric(direction: Column, level: Column) -> Column:
    """Directional feature times the excess of a positive level over 1: flips sign with the direction."""
    return clip(direction * (level - F.lit(1.0)), -BOUND, BOUND)


def sensitivity(df: DataFrame, model, p: str = "p", spread: str = "spread", hours: str = "hours_left") -> DataFrame:
    """What-if rows scored by ``model(p, spread, hours) -> Column`` and differenced from the unchanged row."""
    w = WHAT_IF
    q, s, h = F.col(p), F.col(spread), F.col(hours)
    case = lambda n, a, b, c: F.struct(F.lit(n).alias("change"), a.alias("p"), b.alias("s"), c.alias("h"))
    cases = F.array(
        case("odds_down", F.greatest(F.lit(w["low"]), q - F.lit(w["odds_step"])), s, h), case("odds_up", F.least(F.lit(w["high"]), q + F.lit(w["odds_step"])), s, h),
        case("tight", q, F.lit(w["spread"]), h), case("twelve_hours", q, s, F.lit(w["hours"])),
    )
    out = df.withColumn("_w", F.explode(cases)).withColumn("change", F.col("_w.change"))
    out = out.withColumn("probability", model(F.col("_w.p"), F.col("_w.s"), F.col("_w.h")))
    return out.withColumn("difference", F.col("probability") - model(q, s, h)).drop("_w")
