"""Explicit schemas of records, feature rows, bars, books, candles and journals."""

from __future__ import annotations

from pyspark.sql import types as t

S, D, L, I, B, TS = t.StringType(), t.DoubleType(), t.LongType(), t.IntegerType(), t.BooleanType(), t.TimestampType()


def struct(**fields) -> t.StructType:
    return t.StructType([t.StructField(k, v, True) for k, v in fields.items()])


LEVELS_TEXT = t.ArrayType(t.ArrayType(S))
VENUE_LEVELS = t.ArrayType(struct(price=S, size=S))
RAW_BOOK = struct(yes=LEVELS_TEXT, no=LEVELS_TEXT, bids=VENUE_LEVELS, asks=VENUE_LEVELS)

RECORD_TIMES = ["available_at", "observed_at", "made_at", "features_available_at", "expires_at", "close_time", "settled_at"]
RECORD_TEXT = struct(
    type=S, ticker=S, event_ticker=S, available_at=S, observed_at=S, made_at=S, features_available_at=S, expires_at=S, close_time=S, settled_at=S,
    status=S, fee_rate=S, fee_version=S, yes=LEVELS_TEXT, no=LEVELS_TEXT, probability=S, model_id=S, signal_side=S, yes_payout=S, signal_eligible=B,
    execution_check=struct(signal=B, model_id=S, made_at=S, probability=S), _corrupt=S,
)

SAMPLE = struct(
    ticker=S, event=S, series=S, group=t.DateType(), at=TS, feature_time=TS, close_time=TS, settled_at=TS, execution_at=TS, execution_bid=D, execution_ask=D,
    bid=D, ask=D, p=D, spread=D, prior_move=D, hours_left=D, horizon=I, lower=D, upper=D, y=I, source=S, synthetic=B,
)

CANDLE_SIDE = struct(close=S, close_dollars=S)
CANDLE_PAGE = struct(markets=t.ArrayType(struct(market_ticker=S, candlesticks=t.ArrayType(struct(end_period_ts=L, yes_bid=t.StringType(), yes_ask=t.StringType())))))

JOURNAL = struct(sequence=L, recorded_at=S, kind=S, payload=S, previous=S, sha256=S)

LISTING_PAGE = struct(
    cursor=S,
    markets=t.ArrayType(struct(
        ticker=S, event_ticker=S, title=S, market_type=S, strike_type=S, floor_strike=S, cap_strike=S, open_time=S, close_time=S, settlement_ts=S, status=S,
        result=S, settlement_value_dollars=S, notional_value_dollars=S, expiration_value=S, rules_primary=S, rules_secondary=S,
    )),
)

KLINE = struct(open_time=L, open=D, high=D, low=D, close=D, volume=D, close_time=L, quote_volume=D, trades=L, taker_buy=D, taker_buy_quote=D, ignore=S)

STATION_CSV = struct(station=S, valid=S, tmpf=S, metar=S)

FORECAST_RUN = struct(
    run_initialized_at=S, url=S,
    body=t.ArrayType(struct(latitude=D, longitude=D, utc_offset_seconds=I, hourly=t.MapType(S, t.ArrayType(S)), hourly_units=t.MapType(S, S))),
)
FORECAST_BODY = t.ArrayType(struct(latitude=D, longitude=D, utc_offset_seconds=I, hourly=t.MapType(S, t.ArrayType(S)), hourly_units=t.MapType(S, S)))

DAILY_TARGETS = struct(results=t.ArrayType(struct(station=S, valid=S, high=S, product=S)))

PERIOD = struct(startTime=S, endTime=S, temperature=D, temperatureUnit=S, windSpeed=S, relativeHumidity=struct(value=D))
SKY = struct(validTime=S, value=D)
OBSERVATION = struct(properties=struct(timestamp=S, temperature=struct(value=D, unitCode=S)))
SNAPSHOT = struct(
    series=S, captured_at=S,
    sources=t.ArrayType(struct(
        source=S, received_at=S,
        body=struct(
            properties=struct(periods=t.ArrayType(PERIOD), updateTime=S, generatedAt=S, skyCover=struct(values=t.ArrayType(SKY))),
            features=t.ArrayType(OBSERVATION), hourly=t.MapType(S, t.ArrayType(S)), hourly_units=t.MapType(S, S),
        ),
    )),
)
