"""Readers for station observations, forecast runs, daily targets and weather snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as T
from tidemark.functions.contracts import DURATION, fahrenheit, is_correction, iso_duration_seconds, metar_max6h, wind_mph, zoned_timestamp
from tidemark.operators.quality import conflicting_duplicates
from tidemark.operators.slicing import evaluated_once

TEMPERATURE = "temperature_2m_"
LOW, HIGH = -100, 150


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _utc_text(text: Column) -> Column:
    """Timestamp text without an offset whose request declared UTC; one with an offset is read as it says."""
    return zoned_timestamp(F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), text).otherwise(F.concat(text, F.lit("Z"))))


def parse_station_obs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, counts by reason) from station, valid, tmpf, metar columns.

    Retrospective corrections and unreadable temperatures are rejected rows; a time with two different readings is
    dropped as conflicting.
    """
    d = raw.select(
        "station", _micros(_utc_text(F.col("valid"))).alias("t"), F.expr("try_cast(tmpf AS double)").alias("temperature"), metar_max6h(F.col("metar")).alias("max_6h"),
        is_correction(F.col("metar")).alias("_cor"),
    )
    fine = F.col("t").isNotNull() & (F.col("temperature") > LOW) & (F.col("temperature") < HIGH) & ~F.col("_cor")
    d = d.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    good, bad = conflicting_duplicates(d.filter("_ok"), ["station", "t"], ["temperature", "max_6h"])
    counts = (
        d.filter("NOT _ok").groupBy("station").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("rejected"))
        .unionByName(bad.groupBy("station").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("conflicting_timestamp")))
        .unionByName(good.groupBy("station").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("usable")))
    )
    return good, counts


def read_station_obs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Station CSV with '#' comment lines and a header row naming station, valid, tmpf, metar; one station per file."""
    raw = spark.read.option("comment", "#").option("header", True).option("enforceSchema", False).schema(T.STATION_CSV).csv(path).withColumn("file", F.input_file_name())
    mixed = raw.groupBy("file").agg((F.min("station") != F.max("station")).alias("mixed")).filter("mixed")
    if not mixed.isEmpty():
        raise ValueError("a station file holds more than one station")
    return parse_station_obs(raw)


def forecast_long(df: DataFrame, body: Column, initialized: Column) -> DataFrame:
    """Per-station parallel arrays to long rows (run, station_index, model, valid_at, value); NULL values are kept out."""
    s = df.select("*", initialized.alias("initialized"), F.posexplode(body).alias("station_index", "_s"))
    s = s.filter(F.col("_s.utc_offset_seconds") == 0)
    models = F.filter(F.map_keys("_s.hourly"), lambda k: k.startswith(TEMPERATURE))
    m = s.withColumn("_k", F.explode(models)).filter(F.element_at("_s.hourly_units", F.col("_k")) == "°F")
    times, values = F.element_at("_s.hourly", F.lit("time")), F.element_at("_s.hourly", F.col("_k"))
    m = m.filter(F.size(times) == F.size(values)).withColumn("_h", F.explode(F.arrays_zip(times.alias("t"), values.alias("v"))))
    keep = [c for c in df.columns if c not in ("value", "body")]
    return m.select(
        *keep, "initialized", "station_index", F.substring("_k", len(TEMPERATURE) + 1, 100).alias("model"), _micros(_utc_text(F.col("_h.t"))).alias("valid_at"), F.expr("try_cast(_h.v AS double)").alias("value"),
        F.col("_s.latitude").alias("latitude"), F.col("_s.longitude").alias("longitude"),
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def read_forecast_runs(spark: SparkSession, path: str, wrapped: bool = False) -> DataFrame:
    """Saved runs: one JSON document per file, either the bare station list or wrapped with ``run_initialized_at``.

    A bare list carries no issue time: ``initialized`` stays NULL there, never guessed, and is joined from the request log.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    if wrapped:
        d = text.withColumn("_r", F.from_json("value", T.FORECAST_RUN))
        out = forecast_long(d, F.col("_r.body"), _micros(zoned_timestamp(F.col("_r.run_initialized_at"))))
        return out.drop("_r")
    d = text.withColumn("body", F.from_json("value", T.FORECAST_BODY))
    return forecast_long(d, F.col("body"), F.lit(None).cast("long"))


def station_location_gate(hours: DataFrame, stations: DataFrame, limit: float = 0.6) -> DataFrame:
    """Keep grid rows whose location is within ``limit`` degrees of the station (station_index, lat, lon, ...)."""
    near = (F.abs(F.col("latitude") - F.col("lat")) <= limit) & (F.abs(F.col("longitude") - F.col("lon")) <= limit)
    return hours.join(stations, "station_index").filter(near)


def parse_daily_targets(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(targets, counts by reason): day, high and the issue time read from the product identifier.

    A label issued on or before its own day, or without a readable high, is rejected; a repeated day with different
    values is conflicting.
    """
    r = df.select(F.explode(F.from_json(F.col(column), T.DAILY_TARGETS)["results"]).alias("_r")).select("_r.*")
    issued = F.try_to_timestamp(F.substring_index("product", "-", 1), F.lit("yyyyMMddHHmm"))
    day = F.try_to_timestamp(F.col("valid"), F.lit("yyyy-MM-dd"))
    d = r.select("station", day.cast("date").alias("day"), F.expr("try_cast(high AS double)").alias("target"), _micros(issued).alias("issued_t"), F.col("product"), _micros(day).alias("_d"))
    ok = F.coalesce((F.col("target") > LOW) & (F.col("target") < HIGH) & (F.col("issued_t") > F.col("_d")), F.lit(False))
    d = d.withColumn("_ok", ok)
    good, bad = conflicting_duplicates(d.filter("_ok"), ["station", "day"], ["target", "issued_t", "product"])
    counts = d.agg(F.count_if(~F.col("_ok")).alias("missing_or_invalid_label")).select(F.lit("missing_or_invalid_label").alias("reason"), F.col("missing_or_invalid_label").alias("n"))
    return good, counts.unionByName(bad.agg(F.lit("conflicting_day").alias("reason"), F.count(F.lit(1)).alias("n")))


def read_daily_targets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_daily_targets(spark.read.text(path, wholetext=True))


def parse_snapshots(df: DataFrame, column: str = "value") -> DataFrame:
    """Snapshots to one tall table: series, captured_t, received_t, issued_t, kind, a, b, value (Fahrenheit or percent).

    kinds: period_temperature, humidity, wind, cloud, observation and one per forecast model. Units outside the gate
    and rows that were issued after they were received are dropped.
    """
    doc = evaluated_once(df.select(column), _s=F.from_json(F.col(column), T.SNAPSHOT))
    s = doc.select(F.col("_s.series").alias("series"), _micros(zoned_timestamp(F.col("_s.captured_at"))).alias("captured_t"), F.explode("_s.sources").alias("_src"))
    props = "_src.body.properties"
    s = evaluated_once(
        s, received_t=_micros(zoned_timestamp(F.col("_src.received_at"))),
        issued_t=_micros(zoned_timestamp(F.coalesce(F.col(f"{props}.updateTime"), F.col(f"{props}.generatedAt")))),
    )
    t = lambda text: _micros(zoned_timestamp(text))
    row = lambda kind, a, b, v: F.struct(kind.alias("kind"), a.alias("a"), b.alias("b"), v.cast("double").alias("value"))
    timely = F.coalesce(F.col("issued_t") <= F.col("received_t"), F.lit(False))

    def period(p):
        span = (t(p["startTime"]), t(p["endTime"]))
        return F.array(
            row(F.lit("period_temperature"), *span, fahrenheit(p["temperature"], p["temperatureUnit"])), row(F.lit("humidity"), *span, p["relativeHumidity"]["value"]),
            row(F.lit("wind"), *span, F.array_max(wind_mph(p["windSpeed"]))),
        )

    def sky(p):
        start = t(F.element_at(F.split(p["validTime"], "/"), 1))
        length = iso_duration_seconds(F.substring_index(p["validTime"], "/", -1))
        return row(F.lit("cloud"), start, start + length * F.lit(1_000_000), p["value"])

    def seen(o):
        at = t(o["properties"]["timestamp"])
        return row(F.lit("observation"), at, at, F.when(at <= F.col("received_t"), fahrenheit(o["properties"]["temperature"]["value"], o["properties"]["temperature"]["unitCode"])))

    hourly, units = F.col("_src.body.hourly"), F.col("_src.body.hourly_units")
    models = F.filter(F.map_keys(hourly), lambda k: k.startswith(TEMPERATURE))

    def model(k):
        hour = lambda z: _micros(_utc_text(z["t"]))
        pairs = F.arrays_zip(F.element_at(hourly, F.lit("time")).alias("t"), F.element_at(hourly, k).alias("v"))
        return F.transform(pairs, lambda z: row(F.substring(k, len(TEMPERATURE) + 1, 100), hour(z), hour(z) + F.lit(3_600_000_000), fahrenheit(z["v"].try_cast("double"), F.element_at(units, k))))

    empty = F.array().cast("array<struct<kind:string,a:bigint,b:bigint,value:double>>")
    part = lambda x: F.coalesce(x, empty)
    # One array per source and one explode: the document is parsed and read once whatever it holds.
    rows = F.concat(
        part(F.when(timely, F.flatten(F.transform(F.col(f"{props}.periods"), period)))), part(F.when(timely, F.transform(F.col(f"{props}.skyCover.values"), sky))),
        part(F.transform(F.col("_src.body.features"), seen)), part(F.flatten(F.transform(models, model))),
    )
    tall = s.select("series", "captured_t", "received_t", "issued_t", F.inline(rows))
    return tall.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def read_weather_snapshots(spark: SparkSession, path: str) -> DataFrame:
    from tidemark.sources.market import read_lines

    return parse_snapshots(read_lines(spark, path))


def remaining_day(decisions: DataFrame, tall: DataFrame, by: list[str], at: str, day_start: str, day: int = 86_400_000_000, width: int = 3_600_000_000 * 6) -> DataFrame:
    """Remaining-day features of a snapshot: forecast maximum, covered length of the union of periods, humidity, wind,
    cloud, with ``complete`` true only when the periods cover the whole rest of the day."""
    from tidemark.operators.temporal import overlap_join
    from tidemark.operators.windows import covered_length

    ids = decisions.columns
    d = decisions.withColumn("_from", F.greatest(at, day_start)).withColumn("_to", F.col(day_start) + F.lit(day))
    spans = tall.filter((F.col("b") > F.col("a"))).select(*by, "kind", "a", "b", "value", "received_t")
    hit = overlap_join(d, spans, by, ("_from", "_to"), ("a", "b"), width).filter(F.col("received_t") <= F.col(at))
    pick = lambda k: F.when(F.col("kind") == k, F.col("value"))
    agg = hit.groupBy(*ids, "_from", "_to").agg(
        F.max(pick("period_temperature")).alias("remaining_forecast_max"), F.avg(pick("humidity")).alias("mean_relative_humidity"), F.max(pick("wind")).alias("max_wind_mph"), F.avg(pick("cloud")).alias("mean_cloud_cover"),
    )
    cut = hit.filter("kind = 'period_temperature'").select(*ids, F.greatest("a", "_from").alias("_a"), F.least("b", "_to").alias("_b"))
    covered = covered_length(cut, ids, "_a", "_b")
    return agg.join(covered, ids, "left").withColumn("remaining", F.col("_to") - F.col("_from")).withColumn(
        "complete", (F.col("remaining") > 0) & (F.coalesce("covered", F.lit(0)) == F.col("remaining"))
    ).drop("_from", "_to")
