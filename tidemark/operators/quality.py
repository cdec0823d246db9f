"""Data quality: every check yields accepted rows and rejected rows with a reason, never a silent drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.books import best, level_violations
from tidemark.functions.numeric import finite
from tidemark.operators.slicing import halo
from tidemark.operators.temporal import scalar_join


def violations(rules: dict[str, Column]) -> Column:
    """array<string> of the names of the rules that fail; a NULL rule counts as failed."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return F.filter(checks, lambda x: x.isNotNull())


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``violations``)."""
    tagged = df.withColumn("violations", violations(rules))
    return tagged.filter(F.size("violations") == 0).drop("violations"), tagged.filter(F.size("violations") > 0)


def exclusion_report(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Counts by reason next to the survivors; a map-side combined count."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def record_rules() -> Column:
    """Violations of a typed record (market, book, prediction, outcome) in the wide nullable record schema.

    A signal or eligibility that is no boolean makes the line malformed where it is parsed.
    """
    c = F.col
    kind = c("type")
    is_ = lambda k: kind == k
    when = lambda k, ok: F.when(is_(k), ok).otherwise(F.lit(True))
    yes, no = best(c("yes")), best(c("no"))
    unit = lambda x: x.between(0, 1)
    check = c("execution_check")
    return violations({
        "type": kind.isin("market", "book", "prediction", "outcome"),
        "ticker": F.length("ticker") > 0,
        "available_at": c("available_at").isNotNull(),
        "event_ticker": when("market", F.length("event_ticker") > 0),
        "close_time": when("market", c("close_time").isNotNull()),
        "fee_rate": when("market", c("fee_rate").isNull() | unit(c("fee_rate"))),
        "fee_version": when("market", c("fee_rate").isNull() | c("fee_version").isNotNull()),
        "observed_at": when("book", c("observed_at") <= c("available_at")),
        "levels": when("book", ~(level_violations(c("yes")) | level_violations(c("no")))),
        "execution_check": when("book", check.isNull() | check["signal"].isNotNull() & (F.length(check["model_id"]) > 0) & (c("observed_at") <= check["made_at"]) & (check["made_at"] <= c("available_at")) & unit(check["probability"])),
        "crossed": when("book", F.coalesce(yes + no <= 1, F.lit(True))),
        "probability": when("prediction", unit(c("probability"))),
        "feature_time": when("prediction", (c("features_available_at") <= c("made_at")) & (c("made_at") <= c("available_at"))),
        "expiry": when("prediction", c("expires_at") > c("made_at")),
        "model_id": when("prediction", F.length("model_id") > 0),
        "signal_side": when("prediction", c("signal_side").isNull() | c("signal_side").isin("yes", "no")),
        "payout": when("outcome", unit(c("yes_payout"))),
        "settled_at": when("outcome", c("settled_at") <= c("available_at")),
    })


def validate_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("violations", record_rules())
    return tagged.filter(F.size("violations") == 0).drop("violations"), tagged.filter(F.size("violations") > 0)


def sample_rules(columns: list[str], at="at", feature="feature_time", close="close_t", settled="settled_t", execution="execution_at", origin: str | None = None) -> dict[str, Column]:
    """Row rules of a feature row: leakage order, finite values, quote identities; with ``origin`` also that ``source`` is
    that one and ``synthetic`` is known to be false."""
    c = F.col
    rules = {
        "leakage": (c(feature) <= c(at)) & (c(at) < c(close)) & (c(at) < c(settled)),
        "finite": finite(c("p")) & finite(c("bid")) & finite(c("ask")) & finite(c("spread")) & finite(c("hours_left")),
        "quote": (c("bid") >= 0) & (c("bid") <= c("ask")) & (c("ask") <= 1),
        "label": c("y").isin(0, 1),
        "midpoint": F.abs(c("p") - (c("bid") + c("ask")) / 2) <= 1e-8,
        "spread": F.abs(c("spread") - (c("ask") - c("bid"))) <= 1e-8,
        "horizon": c("hours_left") > 0,
    }
    if origin is not None:
        rules["source"] = F.coalesce((c("source") == origin) & ~c("synthetic"), F.lit(False))
    if execution in columns:
        rules["execution"] = c(execution).isNull() | (c(execution) > c(at))
    return rules


def tag_samples(df: DataFrame, ticker: str = "ticker", at: str = "at", once: list[str] | None = None, **times) -> DataFrame:
    """Rows with the ``violations`` of the row rules and of two cross-row rules: one row per ``once`` (ticker, at), one label per ticker.

    One map-side combined aggregate per (ticker, at) serves both cross-row rules, so the rows are joined once; a key with a
    third of all rows collapses before any shuffle, and AQE splits the skewed side of the join.
    """
    keys = once or [ticker, at]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    labels = per.groupBy(ticker).agg((F.min("_lo") != F.max("_hi")).alias("_conflict"))
    tagged = df.join(per.join(labels, ticker).drop("_lo", "_hi"), keys)
    rules = sample_rules(df.columns, at=at, **times) | {"duplicate": F.col("_copies") == 1, "conflicting_label": ~F.col("_conflict")}
    return tagged.withColumn("violations", violations(rules)).drop("_copies", "_conflict")


def validate_samples(df: DataFrame, ticker: str = "ticker", at: str = "at", **times) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``violations``), two views of ``tag_samples``."""
    tagged = tag_samples(df, ticker, at, **times)
    return tagged.filter(F.size("violations") == 0).drop("violations"), tagged.filter(F.size("violations") > 0)


def ohlcv_rules(open="open", high="high", low="low", close="close", volume="volume", buy: str | None = "buy") -> dict[str, Column]:
    c = F.col
    rules = {
        "finite": finite(c(open)) & finite(c(high)) & finite(c(low)) & finite(c(close)) & finite(c(volume)),
        "positive": c(low) > 0,
        "low": c(low) <= F.least(open, close),
        "high": F.greatest(open, close) <= c(high),
        "volume": c(volume) >= 0,
    }
    if buy:
        rules["buy"] = (c(buy) >= 0) & (c(buy) <= c(volume))
    return rules


def contiguity_gaps(bars: DataFrame, by: list[str], t: str, step: int, width: int) -> DataFrame:
    """Bars whose distance to the previous bar of the key is not exactly ``step``, however long the gap."""
    from tidemark.operators.slicing import previous_time

    rows = previous_time(bars.select(*by, t), by, t, width)
    return rows.withColumn("gap", F.col(t) - F.col("previous_t")).filter(F.col("gap") != step).drop("previous_t")


def day_completeness(bars: DataFrame, by: list[str], t: str, day: int, expected: int) -> DataFrame:
    """Rows per key and day against the expected count, duplicates shown by the distinct count."""
    return bars.groupBy(*by, F.floor(F.col(t) / F.lit(day)).cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(t).alias("distinct_rows")
    ).withColumn("complete", (F.col("rows") == expected) & (F.col("distinct_rows") == expected))


def conflicting_duplicates(df: DataFrame, key: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per key with agreeing payloads, keys whose copies disagree).

    Copies are compared by the minimum and maximum of the payload struct, so a key with very many copies is reduced
    before the shuffle and nothing is joined back.
    """
    value = F.struct(*payload)
    g = df.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("copies"))
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    return g.filter(same).select(*key, "_lo.*"), g.filter(~same).select(*key, "copies")


def availability_gate(df: DataFrame, feature: str, available: str, at: str, max_age: int, vector: list[str]) -> DataFrame:
    """Adds ``reason``: future feature, availability before observation, stale, or a non-finite vector."""
    bad = F.lit(False)
    for v in vector:
        bad = bad | ~finite(F.col(v))
    return df.withColumn(
        "reason",
        F.when(F.col(feature).isNull(), "missing_input")
        .when(F.col(feature) > F.col(available), "availability_precedes_observation")
        .when(F.col(available) > F.col(at), "future_input")
        .when(F.col(at) - F.col(feature) > max_age, "stale_input")
        .when(bad, "invalid_vector"),
    )


def chain_links(df: DataFrame, by: list[str], seq: str, clock: str, previous: str, digest: str, width: int = 10_000) -> DataFrame:
    """Reason per journal row: bad start, skipped sequence, wrong previous hash, clock moving back.

    Only the neighbouring row matters, so the chain is checked in slices of the sequence number with one row of overlap.
    """
    rows = halo(df, seq, width, back=1)
    w = W.partitionBy(*by, "_slice").orderBy(seq, digest)
    prior = F.lag(F.struct(F.col(seq).alias("s"), F.col(digest).alias("h"), F.col(clock).alias("c"))).over(w)
    first = F.col(seq) == 0
    out = rows.withColumn("_p", prior).filter("_core").withColumn(
        "reason",
        F.when(first & (F.col(previous) != "0" * 64), "bad_start")
        .when(~first & F.col("_p").isNull(), "skipped_sequence")
        .when(F.col("_p.s") != F.col(seq) - 1, "skipped_sequence")
        .when(F.col("_p.h") != F.col(previous), "broken_link")
        .when(F.col("_p.c") > F.col(clock), "clock_moved_back"),
    )
    return out.drop("_p", "_core", "_slice")


def verify_chain(df: DataFrame, by: list[str], body: str = "body", seq: str = "sequence", clock: str = "recorded_at", previous: str = "previous", digest: str = "sha256") -> DataFrame:
    """``chain_links`` plus content: the digest must be the SHA-256 of the stored canonical body."""
    links = chain_links(df, by, seq, clock, previous, digest)
    return links.withColumn("reason", F.when(F.sha2(F.col(body), 256) != F.col(digest), "altered").otherwise(F.col("reason")))


def rollup_audit(fine: DataFrame, coarse: DataFrame, by: list[str], t: str, step: int, pieces: int | None, tolerance: dict[str, float]) -> DataFrame:
    """Coarse bars against rolled-up fine bars: absolute differences and whether all are within tolerance."""
    from tidemark.operators.windows import rollup_bars

    rolled = rollup_bars(fine, by, t, step)
    if pieces:
        rolled = rolled.filter(F.col("pieces") == pieces)
    a = rolled.select(*by, t, *[F.col(c).alias(f"_{c}") for c in tolerance])
    j = a.join(coarse.select(*by, t, *tolerance), [*by, t])
    ok = F.lit(True)
    for c, limit in tolerance.items():
        j = j.withColumn(f"diff_{c}", F.abs(F.col(f"_{c}") - F.col(c)))
        ok = ok & (F.col(f"diff_{c}") <= limit)
    return j.select(*by, t, *[f"diff_{c}" for c in tolerance], ok.alias("matches"))


def reconcile_cash(df: DataFrame, bankroll: str, realized: str, open_cost: str, cash: str) -> DataFrame:
    """Rows where bankroll + realized - open cost is not the cash, in exact decimals."""
    d = lambda c: F.col(c).cast("decimal(20,6)")
    return df.withColumn("difference", d(bankroll) + d(realized) - d(open_cost) - d(cash)).filter("difference <> 0")


def coverage_filter(df: DataFrame, scope: DataFrame, series: str, hours: str) -> DataFrame:
    """Reason a row is outside a model's scope (series, min_hours, max_hours); NULL inside."""
    j = df.join(scope.select(F.col("series").alias(series), "min_hours", "max_hours"), series, "left")
    return j.withColumn(
        "reason",
        F.when(F.col("max_hours").isNull(), "unsupported_series")
        .when(F.col(hours) > F.col("max_hours"), "too_early")
        .when(F.col(hours) < F.col("min_hours"), "too_late"),
    ).drop("min_hours", "max_hours")


def observation_scope(calibration: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: may this calibration be used? Its events are all training events, or it settled before all rows."""
    outside = calibration.join(rows.select("event").distinct(), "event", "left_anti").agg(F.count(F.lit(1)).alias("outside_events"))
    last = calibration.agg(F.max("settled_t").alias("latest_settled"))
    first = rows.agg(F.min("at").alias("first_decision"))
    return scalar_join(outside, last, first).withColumn(
        "allowed", (F.col("outside_events") == 0) | (F.col("latest_settled") < F.col("first_decision"))
    )


def validate_calibration(pairs: DataFrame, by: list[str], residual: Column, min_events: int = 80, source_hash: str | None = None, settled: str | None = None) -> DataFrame:
    """Location and scale per group with the reasons a calibration may not be used.

    With ``source_hash`` every pair must name the SHA-256 of its source (64 lowercase hex digits), with ``settled`` its
    settlement time; the latest of them is the calibration's cutoff, ``latest_settled``.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.count_distinct("event").alias("events"), F.avg(residual).alias("bias"), F.stddev_samp(residual).alias("sigma"), F.min(residual).alias("_low"), F.max(residual).alias("_high")]
    if source_hash:
        aggs.append(F.count_if(~F.coalesce(F.col(source_hash).rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("_unsourced"))
    if settled:
        aggs += [F.count_if(F.col(settled).isNull()).alias("_unsettled"), F.max(settled).alias("latest_settled")]
    # Merged partial moments of equal residuals leave a spread of some 1e-17.
    one_value = (F.col("n") > 1) & (F.col("_low") == F.col("_high"))
    reason = F.when(F.col("events") != F.col("n"), "repeated_event").when(F.col("n") < min_events, "too_few_events").when(
        ~finite(F.col("bias")) | ~finite(F.col("sigma")) | (F.col("sigma") <= 0), "invalid_scale")
    if source_hash:
        reason = reason.when(F.col("_unsourced") > 0, "missing_source_hash")
    if settled:
        reason = reason.when(F.col("_unsettled") > 0, "missing_settlement")
    out = pairs.groupBy(*by).agg(*aggs).withColumn("sigma", F.when(one_value, F.lit(0.0)).otherwise(F.col("sigma")))
    return out.withColumn("reason", reason).drop("_unsourced", "_unsettled", "_low", "_high")


def verify_payload_hash(df: DataFrame, body: str, digest: str) -> DataFrame:
    """Rows whose stored hash is not the SHA-256 of the stored body."""
    return df.filter(F.sha2(F.col(body), 256) != F.col(digest))
