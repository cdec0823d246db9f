"""Contract text, identifiers, categories, fees and record projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, interval_prob

# Bracket wording, station reports, durations and market links.
BRACKET = r"^(-?\d+)(?:-(-?\d+))?°F(?: or (below|higher|above))?$"
METAR_MAX6H = r"(?:^|\s)1([01])(\d{3})(?:\s|$)"
METAR_CORRECTION = r"\bCOR\b"
DURATION = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?)?$"
TICKER = r"^[A-Z0-9][A-Z0-9_.-]{0,119}$"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# Category rules, first match wins: (category, listed category, words in title/ticker/tags).
SPORTS = "sports"
MENTIONS = ("mentions", "mentions", ["mention", "say during"])
POSTS = ("posts", None, ["number of posts", "post count", "tweets", "how many posts"])
CLIMATE = "climate and weather"
ECONOMICS = ("economics", None, ["tsa", "gas price", "inflation", "cpi", "gdp", "jobs report"])
ENTERTAINMENT = ("entertainment", None, ["box office", "rotten tomatoes", "spotify", "billboard"])

# Fee schedule.
QUADRATIC_FEES = ["quadratic", "quadratic_with_maker_fees"]
BASE_FEE = "0.07"


def _group(text: Column, pattern: str, i: int) -> Column:
    """Regex group, NULL when absent or empty."""
    g = F.regexp_extract(text, pattern, i)
    return F.when(g != "", g)


def parse_bracket(text: Column) -> Column:
    """struct(lower, upper) of a Fahrenheit bracket with half-degree edges; NULL for any other wording."""
    s = F.trim(F.translate(text, "−–", "--"))
    lo = _group(s, BRACKET, 1).cast("double")
    hi = F.coalesce(_group(s, BRACKET, 2).cast("double"), lo)
    tail = _group(s, BRACKET, 3)
    below, above = F.coalesce(tail == "below", F.lit(False)), F.coalesce(tail.isin("higher", "above"), F.lit(False))
    half = F.lit(0.5)
    return F.when(
        s.rlike(BRACKET) & (hi >= lo),
        F.struct(F.when(~below, lo - half).alias("lower"), F.when(~above, hi + half).alias("upper")),
    )


def strike_bounds(kind: Column, floor: Column, cap: Column) -> Column:
    """struct(lower, upper) for between/greater/less strikes on whole degrees; NULL when unsupported."""
    half, none = F.lit(0.5), F.lit(None).cast("double")
    pair = lambda a, b: F.struct(a.alias("lower"), b.alias("upper"))
    return (
        F.when((kind == "between") & (floor <= cap), pair(floor - half, cap + half))
        .when((kind == "greater") & floor.isNotNull(), pair(floor + half, none))
        .when((kind == "less") & cap.isNotNull(), pair(none, cap - half))
    )


def event_date(ticker: Column) -> Column:
    """Date inside SERIES-yyMMMdd..., NULL when it is not there."""
    part = F.element_at(F.split(ticker, "-"), 2)
    pattern = r"^(\d{2})([A-Z]{3})(\d{2})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(part, pattern, 2))
    text = F.concat(F.lit("20"), F.regexp_extract(part, pattern, 1), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.regexp_extract(part, pattern, 3))
    return F.when(part.rlike(pattern) & (month > 0), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def series_of(ticker: Column) -> Column:
    return F.substring_index(ticker, "-", 1)


def parse_reference(value: Column, hosts: list[str], root: str = "markets") -> Column:
    """Ticker from a pasted https market link or from a bare ticker, upper-cased; NULL when invalid.

    A link has the root folder and one to three more parts: the ticker is the last of three, else the first.
    """
    text = F.trim(value)
    link = text.contains("/")
    url = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    parts = F.split(F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "/")
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    good = (
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & authority.isin(*hosts)
        & F.size(parts).isin(2, 3, 4) & (F.get(parts, F.lit(0)) == root)
    )
    picked = F.when(F.size(parts) == 4, F.get(parts, F.lit(3))).otherwise(F.get(parts, F.lit(1)))
    ticker = F.upper(F.when(link, F.when(good, F.try_url_decode(picked))).otherwise(text))
    return F.when(ticker.rlike(TICKER), ticker)


def _any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def category_of(title: Column, ticker: Column, tags: Column, categories: Column, frequency: Column) -> Column:
    """First matching category rule over the lower-cased title, ticker and tags; NULL when none or sports."""
    listed = F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.lower(c))
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(ticker, F.lit("")), F.coalesce(tags, F.array().cast("array<string>"))))
    has = lambda c: F.array_contains(listed, c)
    return (
        F.when(has(SPORTS), F.lit(None).cast("string"))
        .when(has(MENTIONS[1]) | _any_word(text, MENTIONS[2]), MENTIONS[0])
        .when(_any_word(text, POSTS[2]), POSTS[0])
        .when(has(CLIMATE), F.when(frequency == "daily", "weather").otherwise("climate"))
        .when(_any_word(text, ECONOMICS[2]), ECONOMICS[0])
        .when(_any_word(text, ENTERTAINMENT[2]), ENTERTAINMENT[0])
    )


def effective_fee(kind: Column, multiplier: Column, event_kind: Column, event_multiplier: Column) -> Column:
    """Fee rate with event overrides over the series; an unknown schedule or missing multiplier is NULL, not zero."""
    k = F.coalesce(F.when(event_kind != "", event_kind), kind)
    m = F.coalesce(event_multiplier, multiplier)
    return F.when(k.isin(*QUADRATIC_FEES), (F.lit(BASE_FEE).cast("decimal(5,4)") * m.cast("decimal(7,4)")).cast("decimal(12,8)"))


def metar_max6h(text: Column) -> Column:
    """Six-hour maximum in Fahrenheit from a report's remarks; NULL when absent or out of range."""
    remarks = F.regexp_extract(text, r"^.*? RMK (.*)$", 1)
    tenths = _group(remarks, METAR_MAX6H, 2).cast("double")
    sign = F.when(F.regexp_extract(remarks, METAR_MAX6H, 1) == "1", -1.0).otherwise(1.0)
    f = tenths / F.lit(10.0) * sign * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    return F.when((f > -100) & (f < 150), f)


def is_correction(text: Column) -> Column:
    return text.rlike(METAR_CORRECTION)


def iso_duration_seconds(text: Column) -> Column:
    """Seconds of PnDTnHnM; NULL for any other form."""
    part = lambda i, scale: F.coalesce(_group(text, DURATION, i).cast("long"), F.lit(0)) * F.lit(scale)
    return F.when(text.rlike(DURATION), part(1, 86400) + part(2, 3600) + part(3, 60))


def epoch_seconds(x: Column) -> Column:
    """Whole seconds from epoch milliseconds or microseconds; plain seconds and sub-second remainders are NULL."""
    unit = F.when(x >= 10**15, F.lit(1_000_000)).when(x >= 10**12, F.lit(1000))
    return F.when(x % unit == 0, (x / unit).cast("long"))


def zoned_timestamp(text: Column) -> Column:
    """UTC timestamp of an ISO string that carries an offset; naive or malformed strings are NULL."""
    whole = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2")
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(whole))


def fahrenheit(value: Column, unit: Column) -> Column:
    """Unit gate: Fahrenheit as is, Celsius converted, anything else NULL."""
    return F.when(unit.isin("F", "°F", "wmoUnit:degF"), value).when(
        unit.isin("C", "°C", "wmoUnit:degC"), value * F.lit(1.8) + F.lit(32.0)
    )


def wind_mph(text: Column) -> Column:
    """All numbers of a wind text given in mph; NULL for another unit."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.when(text.contains("mph"), F.transform(numbers, lambda x: x.cast("double")))


def standard_day_start(day: Column, offset_hours: Column) -> Column:
    """UTC microseconds at which a station's fixed-offset (no daylight saving) day begins."""
    return F.unix_micros(day.cast("timestamp")) + offset_hours.cast("long") * F.lit(3_600_000_000)


def forecast_prediction(df, required: list[str] = ("station", "rule_reference", "model_id")):
    """Reviewed mean/sd/bounds rows to prediction records with provenance. Returns (predictions, rejected)."""
    missing = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == "" for c in required])
    p = interval_prob(F.col("mean"), F.col("std"), F.col("lower"), F.col("upper"))
    tagged = df.withColumn("probability", p).withColumn(
        "reason", F.when(missing, "missing_required_field").when(F.col("probability").isNull(), "invalid_distribution")
    )
    source = F.struct(*[F.col(c) for c in df.columns])
    good = tagged.filter("reason IS NULL").select(
        F.lit("prediction").alias("type"), "ticker", "available_at", "made_at", "features_available_at", "expires_at",
        "model_id", "probability", source.alias("provenance"),
    )
    return good, tagged.filter("reason IS NOT NULL").drop("probability")


def normalize_market(raw, at: Column, fee_rate: Column):
    """Raw listing to market record; only binary contracts of one dollar. Returns (records, rejected)."""
    reason = (
        F.when(F.coalesce(F.col("market_type"), F.lit("binary")) != "binary", "not_binary")
        .when(F.col("notional_value_dollars").isNotNull() & F.coalesce(F.expr("try_cast(notional_value_dollars AS decimal(18,4))") != 1, F.lit(True)), "not_one_dollar")
        .when(F.col("event_ticker").isNull(), "missing_event")
    )
    tagged = raw.withColumn("reason", reason)
    record = tagged.filter("reason IS NULL").select(
        F.lit("market").alias("type"), "ticker", at.alias("available_at"), "event_ticker",
        F.coalesce("title", "ticker").alias("title"), "close_time", "status", fee_rate.alias("fee_rate"),
        F.when(fee_rate.isNotNull(), "flat-rate-cent-rounding").alias("fee_version"), F.to_json(F.struct(*raw.columns)).alias("raw_metadata"),
    )
    return record, tagged.filter("reason IS NOT NULL")


def normalize_outcome(raw, at: Column):
    """Outcome records: payout from the settlement value, where none is given from the result. Returns (records, rejected).

    Unsettled rows are in neither; a settlement value that is no number or outside [0, 1] is rejected, not replaced.
    """
    by_result = F.when(F.col("result") == "yes", F.lit(1.0)).when(F.col("result") == "no", F.lit(0.0))
    given = F.col("settlement_value_dollars")
    value = F.expr("try_cast(settlement_value_dollars AS double)")
    stated = given.isNotNull() & (given != "")
    payout = F.when(stated, value).otherwise(by_result)
    reason = F.when(stated & value.isNull(), "malformed_settlement").when(payout.isNull(), "no_result").when(~payout.between(0, 1), "payout_out_of_range")
    done = raw.filter(F.col("status").isin("settled", "finalized")).withColumns({"yes_payout": payout, "reason": reason})
    good = done.filter("reason IS NULL").select(
        F.lit("outcome").alias("type"), "ticker", at.alias("available_at"), F.coalesce(F.col("settlement_ts"), at).alias("settled_at"), "yes_payout"
    )
    return good, done.filter("reason IS NOT NULL").drop("yes_payout")


def recommendation(edge_yes: Column, edge_no: Column, passed: Column, quote_age: Column, closed: Column, min_edge: float = 0.04, stale: int = 180) -> Column:
    """WATCH / PASS / PAPER_YES / PAPER_NO: closed and stale quotes first, then edge, then the validation gate."""
    edge = F.greatest(edge_yes, edge_no)
    side = F.when(edge_yes >= edge_no, "YES").otherwise("NO")
    return (
        F.when(closed | edge.isNull() | (quote_age > stale) | (quote_age < 0), "WATCH")
        .when(edge < min_edge, "PASS")
        .when(~passed, "WATCH")
        .otherwise(F.concat(F.lit("PAPER_"), side))
    )


# Fixed value: how the rules of a supported average contract begin, in lower case.
OPENING_RULE = "if the simple average of the sixty seconds of cf benchmarks' brti before "


def supported_contract(df, series: str | None = None) -> Column:
    """Reason a raw 15-minute average contract is unsupported, NULL when it is usable.

    The ticker must belong to ``series`` (if given) and the rules begin with OPENING_RULE.
    The literal target in the rules must equal the strike, life is exactly 900 s, and result, settlement value and
    (if published) the final index value must agree.
    """
    rules = F.lower(F.coalesce(F.col("rules_primary"), F.lit("")))
    literal = _group(rules, r"is at least ([0-9]+(?:\.[0-9]+)?), then the market resolves to yes\.", 1)
    strike = F.col("floor_strike").try_cast("decimal(20,8)")
    index_text = F.col("expiration_value")
    plain = index_text.rlike(r"^(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?$")
    index = F.expr("try_cast(replace(expiration_value, ',', '') AS decimal(20,8))")
    named = rules.contains("is at least the simple average of the sixty seconds")
    yes = F.col("result") == "yes"
    life = F.unix_seconds(F.col("close_time")) - F.unix_seconds(F.col("open_time"))
    published = index_text.isNotNull() & (index_text != "")
    return (
        F.when(published & ~plain, "unreadable_index")
        .when(published & ((index >= strike) != yes), "index_disagrees")
        .when(F.lit(False) if series is None else ~F.coalesce(F.col("ticker").startswith(f"{series}-"), F.lit(False)), "series")
        .when(~rules.startswith(OPENING_RULE), "opening_rule")
        .when(~(named | F.coalesce(literal.try_cast("decimal(20,8)") == strike, F.lit(False))), "rule_target")
        .when(F.coalesce((F.col("strike_type") != "greater_or_equal") | ~(strike > 0), F.lit(True)), "strike")
        .when(~F.col("result").isin("yes", "no") | ~F.col("status").isin("finalized", "settled"), "not_settled")
        .when(F.coalesce(F.col("notional_value_dollars").try_cast("double") != 1, F.lit(True)), "notional")
        .when(life != 900, "life")
        .when(F.col("settlement_ts") < F.col("close_time"), "settlement_time")
        .when(F.coalesce(F.col("settlement_value_dollars").try_cast("double") != yes.cast("double"), F.lit(True)), "payout_disagrees")
    )


def settled_sample_filter(df):
    """Binary, one-dollar, settled contracts whose result agrees with the payout."""
    value = F.expr("try_cast(settlement_value_dollars AS double)")
    return df.filter(
        F.col("result").isin("yes", "no") & F.col("status").isin("settled", "finalized")
        & (F.coalesce(F.col("market_type"), F.lit("binary")) == "binary")
        & (F.coalesce(F.expr("try_cast(notional_value_dollars AS double)"), F.when(F.col("notional_value_dollars").isNull(), 1.0)) == 1)
        & F.col("settlement_ts").isNotNull()
        & (F.col("settlement_value_dollars").isNull() | (value == (F.col("result") == "yes").cast("double")))
    )


def price_cohort(horizon: Column, p: Column, hours: Column | None = None) -> Column:
    """Nominal 12, 18 and 24 hour rows with a mid of 5 to 95 cents; optionally 12 to 24 physical hours remaining."""
    keep = horizon.isin(12, 18, 24) & p.between(0.05, 0.95)
    return keep if hours is None else keep & hours.between(12, 24)
