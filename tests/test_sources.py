"""Readers, sinks and catalogs on small files."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bars, market, sinks, weather


def kline(t, unit, **over):
    r = dict(o=100, h=102, l=99, c=101, v=10, close=(t + 60) * unit - 1, n=3, buy=4) | over
    return f"{t * unit},{r['o']},{r['h']},{r['l']},{r['c']},{r['v']},{r['close']},0,{r['n']},{r['buy']},0,0"


JAN = 1735689600  # 2025-01-01


@pytest.mark.parametrize("unit", [1000, 1_000_000])
@pytest.mark.parametrize("zipped", [False, True])
def test_minute_klines(spark, tmp_path, unit, zipped):
    lines = [kline(JAN, unit), kline(JAN + 60, unit, close=(JAN + 180) * unit - 1), kline(JAN + 90, unit), kline(JAN + 120, unit, h=100), kline(JAN + 40 * 86400, unit), kline(JAN + 240, unit), kline(JAN + 240, unit), kline(JAN + 300, 1)]
    name = "X-1m-2025-01"
    if zipped:
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", "\n".join(lines) + "\n")
    else:
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    good, bad = bars.read_minute_klines(spark, str(tmp_path), zipped)
    g = good.collect()
    assert [(r.t, r.low, r.high, r.open, r.close, r.volume, r.buy) for r in g] == [(JAN, 99.0, 102.0, 100.0, 101.0, 10.0, 4.0)]
    reasons = sorted(v for r in bad.collect() for v in r.violations)
    for want in ("close_time", "alignment", "high", "outside_period", "duplicate", "epoch_unit"):
        assert want in reasons


def test_second_klines_need_a_whole_day(spark, tmp_path):
    u = 1_000_000
    line = lambda t: f"{t * u},100,100,100,100,1,{(t + 1) * u - 1},0,1,1,0,0"
    (tmp_path / "X-1s-2025-01-01.csv").write_text("\n".join(line(JAN + i) for i in range(86400)) + "\n")
    (tmp_path / "X-1s-2025-01-02.csv").write_text("\n".join(line(JAN + 86400 + i) for i in [*range(100), 50]) + "\n")
    good, bad, complete = bars.read_second_klines(spark, str(tmp_path))
    assert {r.period: r.complete for r in complete.collect()} == {"2025-01-01": True, "2025-01-02": False}
    assert [v for r in bad.collect() for v in r.violations] == ["duplicate"]


def test_ohlc_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([[60, 99, 102, 100, 101, 10], [120, 99, 102, 100, 101, 10]]))
    (tmp_path / "b.json").write_text(json.dumps([[120, 99, 102, 100, 101, 10]]))
    assert bars.read_ohlc_arrays(spark, str(tmp_path)).count() == 2
    (tmp_path / "c.json").write_text(json.dumps([[120, 99, 102, 100, 100, 10]]))
    with pytest.raises(ValueError):
        bars.read_ohlc_arrays(spark, str(tmp_path))


def rec(**kw):
    t = "2025-01-01T00:00:00Z"
    base = dict(type="book", ticker="T", available_at=t, observed_at=t, yes=[["0.39", "1000"]], no=[["0.60", "1000"]])
    return json.dumps(base | kw)


def test_records(spark, tmp_path):
    t = "2025-01-01T00:00:00Z"
    lines = [
        rec(), "", rec(yes=[["0.50", "1"]]), rec(observed_at="2025-01-02T00:00:00Z"), rec(yes=[["0.3", "1"], ["0.3", "2"]]), rec(available_at="2025-01-01T00:00:00"), "{bad", rec(yes=[["0.99", "0"], ["0.39", "5"]]),
        json.dumps(dict(type="prediction", ticker="T", available_at=t, made_at=t, features_available_at=t, expires_at="2025-01-01T00:30:00Z", probability=".80", model_id="m")),
        json.dumps(dict(type="market", ticker="T", event_ticker="E", available_at=t, close_time=t, status="open", fee_rate="0.07")), json.dumps(dict(type="outcome", ticker="T", available_at=t, settled_at=t, yes_payout="1")),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    good, bad = market.read_records(spark, str(tmp_path))
    assert sorted(r.type for r in good.collect()) == ["book", "book", "outcome", "prediction"]
    assert sorted(",".join(r.violations) for r in bad.collect()) == ["available_at,observed_at", "crossed", "fee_version", "levels", "malformed", "observed_at"]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.jsonl").write_text("\n\n")
    with pytest.raises(ValueError):
        market.read_records(spark, str(empty))


def test_quote_candles(spark, tmp_path):
    side = lambda v: v
    c = lambda i, b, a: {"end_period_ts": i, "yes_bid": b, "yes_ask": a}
    candles = [
        c(1, {"close": "0.2000"}, {"close": "0.3000"}), c(2, {"close_dollars": "0.20"}, {"close_dollars": "0.30"}), c(3, {"close": 20}, {"close": 30}), c(4, {"close": "20"}, {"close": "30"}),
        c(5, {"close": "0.40"}, {"close": "0.30"}), c(6, {"close_dollars": "nan"}, {"close_dollars": "0.3"}), c(7, None, {"close": "0.3"}),
    ]
    (tmp_path / "p.json").write_text(json.dumps({"markets": [{"market_ticker": "T", "candlesticks": candles}]}) + "\n")
    got = {r.end_ts: (r.bid, r.ask) for r in market.read_quote_candles(spark, str(tmp_path)).collect()}
    assert got == {1: (0.2, 0.3), 2: (0.2, 0.3), **{i: (None, None) for i in range(3, 8)}}


def test_books_of_both_venues(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text(json.dumps({"yes": [["0.39", "10"]], "no": None}) + "\n" + json.dumps({"bids": [{"price": "0.1", "size": "5"}], "asks": []}) + "\n")
    r = market.read_books(spark, str(tmp_path)).collect()
    assert [len(x.yes) for x in r] == [1, 0] and [len(x.no) for x in r] == [0, 0] and [len(x.bids) for x in r] == [0, 1]


def test_journal_and_listings_and_samples(spark, tmp_path):
    j = tmp_path / "j"
    j.mkdir()
    (j / "journal.jsonl").write_text(json.dumps(dict(sequence=0, recorded_at="2025-01-01T00:00:00Z", kind="market", payload={"ticker": "T", "n": 3}, previous="0" * 64, sha256="x")) + "\n")
    v = market.journal_view(market.read_journal(spark, str(j)), "market", "ticker string, n int").first()
    assert (v.ticker, v.n) == ("T", 3)
    p = tmp_path / "p"
    p.mkdir()
    (p / "1.json").write_text(json.dumps({"markets": [{"ticker": "A", "floor_strike": 70}, {"ticker": "B"}]}) + "\n")
    assert market.read_listings(spark, str(p)).count() == 2
    (p / "2.json").write_text(json.dumps({"markets": [{"ticker": "B"}]}) + "\n")
    with pytest.raises(ValueError):
        market.read_listings(spark, str(p))
    s = tmp_path / "s.jsonl"
    s.write_text(json.dumps(dict(ticker="T", at="2025-01-01T00:00:00Z", lower=None, upper=70.5, y=1)) + "\n")
    row = market.read_samples(spark, str(s)).first()
    assert row.lower is None and row.upper == 70.5 and row.y == 1


def test_station_csv(spark, tmp_path):
    f = tmp_path / "nyc.csv"
    f.write_text("#DEBUG\nstation,valid,tmpf,metar\nNYC,2025-01-01 12:51,71.0,KNYC RMK AO2 10250\nNYC,2025-01-01 13:51,72.0,KNYC COR RMK\nNYC,2025-01-01 14:51,70.0,KNYC A\nNYC,2025-01-01 14:51,75.0,KNYC A\n")
    good, counts = weather.read_station_obs(spark, str(f))
    r = good.collect()
    assert len(r) == 1 and r[0].max_6h == pytest.approx(77.0)
    assert {x.reason: x.n for x in counts.collect()} == {"rejected": 1, "conflicting_timestamp": 1, "usable": 1}
    f2 = tmp_path / "mix.csv"
    f2.write_text("station,valid,tmpf,metar\nNYC,2025-01-01 12:51,71.0,a\nMDW,2025-01-01 12:51,71.0,a\n")
    with pytest.raises(ValueError):
        weather.read_station_obs(spark, str(f2))


def test_forecast_runs(spark, tmp_path):
    station = lambda lat: {"latitude": lat, "longitude": -73.9, "utc_offset_seconds": 0, "hourly_units": {"temperature_2m_a": "°F", "temperature_2m_b": "°F"},
                           "hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m_a": [70.5, None], "temperature_2m_b": [71, 72]}}
    (tmp_path / "r.json").write_text(json.dumps([station(40.8), station(41.8)]))
    long = weather.read_forecast_runs(spark, str(tmp_path))
    assert long.count() == 6
    assert {r.valid_at for r in long.collect()} == {JAN * 10**6, (JAN + 3600) * 10**6}
    st = spark.createDataFrame([(0, 40.779, -73.969), (1, 45.0, -87.0)], "station_index int, lat double, lon double")
    assert weather.station_location_gate(long, st).count() == 3
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_text(json.dumps({"run_initialized_at": "2025-01-01T06:00:00Z", "body": [station(40.8)]}))
    assert {r.initialized for r in weather.read_forecast_runs(spark, str(tmp_path / "w"), wrapped=True).collect()} == {(JAN + 6 * 3600) * 10**6}


def test_daily_targets(spark, tmp_path):
    res = lambda day, high, product: dict(station="KNYC", valid=day, high=high, product=product)
    (tmp_path / "t.json").write_text(json.dumps({"results": [res("2025-01-01", 40, "202501020630-KOKX-CLI"), res("2025-01-02", "M", "202501030630-K"), res("2025-01-03", 41, "202501030000-K")]}))
    good, counts = weather.read_daily_targets(spark, str(tmp_path))
    r = good.collect()
    assert [(str(x.day), x.target) for x in r] == [("2025-01-01", 40.0)]
    assert {x.reason: x.n for x in counts.collect()} == {"missing_or_invalid_label": 2, "conflicting_day": 0}


def snapshot(periods, observations=()):
    t = "2025-01-01T15:00:00Z"
    return json.dumps(dict(series="S", captured_at=t, sources=[dict(source="nws", received_at=t, body=dict(properties=dict(updateTime=t, periods=periods), features=list(observations)))]))


def test_remaining_day_from_snapshots(spark, tmp_path):
    p = dict(startTime="2025-01-01T15:00:00Z", endTime="2025-01-02T05:00:00Z", temperature=25, temperatureUnit="C", windSpeed="5 to 10 mph")
    o = dict(properties=dict(timestamp="2025-01-01T14:00:00Z", temperature=dict(value=24, unitCode="wmoUnit:degC")))
    start = (JAN + 5 * 3600) * 10**6
    d = spark.createDataFrame([("S", (JAN + 15 * 3600) * 10**6, start)], "series string, at long, day_start long")

    def ask(*periods):
        (tmp_path / "s.jsonl").write_text(snapshot(list(periods), [o]) + "\n")
        tall = weather.read_weather_snapshots(spark, str(tmp_path / "s.jsonl"))
        return weather.remaining_day(d, tall, ["series"], "at", "day_start").first(), {r.kind: r.value for r in tall.collect()}

    r, kinds = ask(p)
    assert r.remaining_forecast_max == pytest.approx(77.0) and r.covered // (3600 * 10**6) == 14 and r.complete
    assert kinds["observation"] == pytest.approx(75.2) and kinds["wind"] == 10.0
    short = dict(p, endTime="2025-01-01T16:00:00Z")
    r, _ = ask(short, short)
    assert r.covered // (3600 * 10**6) == 1 and not r.complete


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    target = str(tmp_path / "t")
    assert sinks.append_dedup(df, target, "d") == 2
    assert sinks.append_dedup(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), target, "d") == 1
    assert sinks.append_dedup(df, target, "other") == 2
    root = str(tmp_path / "u")
    assert sinks.read_latest(spark, root) is None
    sinks.write_version(sinks.upsert(None, spark.createDataFrame([(1, "old", 5)], "k int, v string, t int"), ["k"], ["t"]), root)
    sinks.write_version(sinks.upsert(sinks.read_latest(spark, root), spark.createDataFrame([(1, "new", 1), (2, "x", 1)], "k int, v string, t int"), ["k"], ["t"]), root)
    assert {(r.k, r.v) for r in sinks.read_latest(spark, root).collect()} == {(1, "new"), (2, "x")}
    a, b = sinks.data_fingerprint(df, ["k", "v"]).first(), sinks.data_fingerprint(df.orderBy(F.desc("k")), ["k", "v"]).first()
    assert a == b and sinks.data_fingerprint(df.filter("k = 2"), ["k", "v"]).first() != a


def test_file_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    m = sinks.file_manifest(spark, str(tmp_path), "*.txt")
    got = {r.name: (r.bytes, r.sha256) for r in m.collect()}
    assert got["a.txt"] == (3, hashlib.sha256(b"abc").hexdigest())
    e = spark.createDataFrame([("a.txt", 3, got["a.txt"][1]), ("b.txt", 1, "0"), ("c.txt", 1, "0")], "name string, bytes long, sha256 string")
    assert {(r.name, r.reason) for r in sinks.verify_manifest(m, e).collect()} == {("b.txt", "different"), ("c.txt", "missing")}


def test_malformed_levels_are_rejected_not_fatal(spark):
    lines = ['{"yes":[["0.40","10"]],"no":[["0.50","3"]]}', '{"yes":[["abc","10"]],"no":[]}', '{"yes":[["0.12345","10"]],"no":[]}', '{"yes":[["0.4"]],"no":[]}', '{"yes":[["0.4","x"]],"no":[]}']
    good, bad = market.split_books(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    assert [r.value for r in good.collect()] == lines[:1] and sorted(r.value for r in bad.collect()) == sorted(lines[1:])


def test_parts_of_any_size_are_written_whole(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "few").otherwise("most").alias("role"), "id")
    sinks.write_partitions(df, str(tmp_path / "parts"))
    assert {(r.role, r["count"]) for r in spark.read.parquet(str(tmp_path / "parts")).groupBy("role").count().collect()} == {("few", 300), ("most", 2700)}


def test_execution_checks_and_eligibility(spark):
    book = {"type": "book", "ticker": "T", "available_at": "2024-01-01T00:00:05Z", "observed_at": "2024-01-01T00:00:01Z", "yes": [], "no": []}
    check = {"signal": True, "model_id": "m", "made_at": "2024-01-01T00:00:02Z", "probability": "0.4"}
    forecast = {"type": "prediction", "ticker": "T", "available_at": "2024-01-01T00:00:05Z", "made_at": "2024-01-01T00:00:05Z", "features_available_at": "2024-01-01T00:00:05Z", "expires_at": "2024-01-01T01:00:00Z", "model_id": "m", "probability": "0.5"}
    lines = [
        (book, ""), (book | {"execution_check": check}, ""), (book | {"execution_check": check | {"signal": None}}, "execution_check"), (book | {"execution_check": check | {"signal": "yes"}}, "malformed"),
        (book | {"execution_check": check | {"model_id": ""}}, "execution_check"), (book | {"execution_check": check | {"made_at": "2024-01-01T00:00:00Z"}}, "execution_check"), (book | {"execution_check": check | {"probability": "1.2"}}, "execution_check"),
        (forecast | {"signal_eligible": False}, ""), (forecast | {"signal_eligible": "no"}, "malformed"),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(lines)], "i int, value string")
    got = {r.i: ",".join(r.violations) for r in market.tag_records(df).collect()}
    assert got == {i: v for i, (_, v) in enumerate(lines)}


def test_fingerprint_tells_null_from_empty_and_keeps_columns_apart(spark):
    rows = [(None, "x"), ("", "x"), ("a|b", "c"), ("a", "b|c"), ("1", "-")]
    prints = {tuple(sinks.data_fingerprint(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first()) for r in rows}
    assert len(prints) == len(rows)


def test_a_bad_level_of_the_second_venue_rejects_its_book(spark):
    from tidemark.sources import market

    lines = ['{"bids": [{"price": "0.4", "size": "3"}], "asks": []}', '{"bids": [{"price": "much", "size": "3"}], "asks": []}', '{"bids": [], "asks": [{"price": "1.4", "size": "3"}]}']
    good, bad = market.split_books(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    assert good.count() == 1 and bad.count() == 2


def test_prices_and_rates_out_of_range_have_no_cost(spark):
    from tidemark.functions import money

    df = spark.createDataFrame([(12.0, 3.0, 0.07), (0.5, 3.0, 12.0), (0.5, 1e20, 0.07), (0.123456, 2.5, 0.07)], "p double, q double, r double")
    got = [r.c for r in df.select(money.fee_and_cost(F.col("p"), F.col("q"), F.col("r"))["cost"].alias("c")).collect()]
    assert got[:3] == [None] * 3 and float(got[3]) == 0.33


def test_rejects_carry_file_and_line(spark, tmp_path):
    """Files that are read in many splits, with blank lines and lines of very different lengths."""
    import random

    from tidemark.sources import market

    rng = random.Random(2)
    want = set()
    for name in ("a", "b"):
        lines = []
        for i in range(1, 400):
            kind = rng.choice(["bad", "blank", "long", "good"])
            if kind in ("bad", "long"):
                want.add((name, i))
            lines.append({"bad": "{no json", "blank": "  ", "long": "x" * rng.randrange(3000), "good": '{"type": "outcome", "ticker": "T", "available_at": "2024-01-01T00:00:00Z", "settled_at": "2024-01-01T00:00:00Z", "yes_payout": "1"}'}[kind] or "y")
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        _, bad = market.read_records(spark, str(tmp_path))
        got = [(r.file.split("/")[-1][0], r.line) for r in bad.collect()]
        assert market.placed_lines(spark, str(tmp_path)).select("file", "_block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(set(got)) and set(got) == want
