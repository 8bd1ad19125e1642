import datetime as dt
import urllib.error

import pytest
from pyspark.sql import functions as F

from barwright.sources import files, market, store


def test_fetch_tries_again():
    calls, pauses = [], []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "slow down", {}, None)
        return [1]

    assert market.fetch("u", opener=opener, sleep=pauses.append) == [1] and pauses == [1.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        market.fetch("u", opener=lambda u: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", {}, None)), sleep=pauses.append)


def test_pages_end():
    data = [[i] for i in range(0, 25)]
    get = lambda a, b: [r for r in data if a <= r[0] < b][:10]
    assert [r[0] for r in market.pages(get, 0, 25, 10, 1)] == list(range(25))
    assert len(list(market.pages(lambda a, b: [[0]] * 10, 0, 100, 10, 0))) == 10


def test_stretches():
    r = market.MarketReader({"symbols": "A,B", "start": "0", "end": str(3_600_000 * 1500 * 45), "url": "u", "interval": "1h"})
    cut = [x for lane in r.partitions() for x in lane.stretches]
    assert len(cut) == 6 and {(x.symbol, x.start % (3_600_000 * 30_000)) for x in cut} == {("A", 0), ("B", 0)}
    assert market.SCHEMAS["funding"].startswith("series_id")


def test_store(spark, tmp_path):
    rows = [(s, dt.datetime(2024, 1, d, h), 1.0, 2.0, 0.5, 1.5, 10.0) for s in ("a", "b") for d in (1, 2, 3) for h in (0, 12)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    path = str(tmp_path / "store")
    files.write_store(df, path, "klines", "12h")
    files.write_store(df.where("series_id = 'a' and day(ts) = 2").withColumn("close", F.lit(9.0)), path, "klines", "12h")
    got = files.read_store(spark, path, "klines", "12h", "a", "2024-01-01 12:00:00", "2024-01-03 00:00:00").orderBy("ts").collect()
    assert [r.close for r in got] == [1.5, 9.0, 9.0]
    df.coalesce(1).where("series_id = 'a'").select("ts", "open", "high", "low", "close", "volume").write.csv(str(tmp_path / "x.csv"), header=True)
    assert files.read_bars(spark, str(tmp_path / "x.csv"), "a").count() == 6


def test_symbols(spark):
    df = spark.createDataFrame([("BTCUSDT",), ("xyz:TSLA",), ("ETH",)], "s string")
    got = df.select(files.venue_coin(F.col("s")), files.builder_prefix(F.col("s")), files.funding_per_bar(F.lit(None).cast("double"))).collect()
    assert [tuple(r) for r in got] == [("BTC", "", 0.0), ("xyz:TSLA", "xyz", 0.0), ("ETH", "", 0.0)]


HOUR = 3_600_000
#: What each venue was asked: when, which path, with what.
CALLS: dict[str, list] = {}


@pytest.fixture
def venue():
    """Two endpoints on this machine: arrays with a doubled row and an open bar, and objects for what the first does not know."""
    import json
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    hour = 3_600_000

    class Venue(BaseHTTPRequestHandler):
        calls: list = []

        def do_GET(self):
            at = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            Venue.calls.append((time.time(), at.path, q))
            start, end, limit = (int(q[k]) for k in ("startTime", "endTime", "limit"))
            times = [t for t in range(0, 2000 * hour, hour) if start <= t < end][:limit]
            if at.path == "/bars":
                if q["symbol"] == "C":
                    self.send_error(404)
                    return
                out = [] if q["symbol"] == "B" or (q["symbol"] == "L" and end <= 1700 * hour) else [[t, "1", "2", "0.5", "1.5", "10", t + hour - 1, "15", 3, "5", "7"] for t in times]
                out = [r for t, r in enumerate(out) for _ in range(2 if t == 1 and start == 0 else 1)][:limit]
            elif at.path == "/objects":
                out = [{"t": t, "o": "1", "h": "2", "l": "1", "c": "2", "v": "3"} for t in times]
            elif at.path == "/interest":
                out = [{"timestamp": t, "sumOpenInterest": "5", "sumOpenInterestValue": "x"} for t in times]
            else:
                out = [{"fundingTime": t, "fundingRate": "0.01"} for t in times[::8]]
            body = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Venue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}"
    CALLS[address] = Venue.calls
    yield address
    server.shutdown()


def test_market_through_spark(spark, venue):
    hour = 3_600_000
    spark.dataSource.register(market.MarketSource)
    read = lambda kind, path, **more: spark.read.format("market").options(kind=kind, url=venue + path, start=0, end=1800 * hour, pace=0, **more).load()
    bars = read("klines", "/bars", symbols="A,B", fallback=venue + "/objects", now=1600 * hour + 5)
    got = {(r.series_id, r.n, r.d) for r in bars.groupBy("series_id").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("d")).collect()}
    assert got == {("A", 1600, 1600), ("B", 1600, 1600)}  # two pages, no row twice, no open bar
    assert {tuple(r) for r in bars.select("series_id", "quote_volume", "taker_buy_quote").distinct().collect()} == {("A", 15.0, 7.0), ("B", 6.0, 0.0)}
    interest = read("open_interest", "/interest", symbols="A,x:Y", now=1800 * hour).collect()
    assert len(interest) == 29 * 24 and {(r.series_id, r.open_interest, r.open_interest_value) for r in interest} == {("A", 5.0, None)}
    assert read("funding", "/rates", symbols="A").count() > 0
    assert read("open_interest", "/interest", symbols="x:Y", now=1800 * hour).count() == 0


def test_latest_price():
    assert market.latest_price("u", "A", opener=lambda u: {"price": "1.5", "time": 7}) == (1.5, 7)


def test_the_first_bar_that_is_open():
    assert market.closed_until("1h", 10 * HOUR) == 10 * HOUR == market.closed_until("1h", 10 * HOUR + 59)
    assert market.closed_until("3d", 100 * 24 * HOUR) == 98 * 24 * HOUR  # the bar of day 97 has closed, wherever threes begin


def test_lanes_take_turns():
    """Simulated: four lanes call whenever they may, after answers of any length; a pace lies between any two calls."""
    import random

    rng, called = random.Random(1), []
    for lane in range(4):
        now = [1000.0 + rng.random()]
        slots = market.Slots(0.1, lane, 4, lambda now=now: now[0], lambda t, now=now: now.__setitem__(0, now[0] + t))
        for _ in range(50):
            slots.wait()
            called.append(now[0])
            now[0] += rng.choice((0.0, 0.01, 0.35, 0.4))
    called.sort()
    assert min(b - a for a, b in zip(called, called[1:])) > 0.1 - 1e-6


def test_tasks_keep_one_pace(spark, venue):
    spark.dataSource.register(market.MarketSource)
    CALLS[venue].clear()
    bars = spark.read.format("market").options(url=venue + "/bars", symbols="A,D,E,F", start=0, end=1999 * HOUR, pace=0.2, lanes=4).load()
    assert bars.rdd.getNumPartitions() == 4 and bars.count() == 4 * 1999
    at = sorted(t for t, _, _ in CALLS[venue])
    assert len(at) == 8 and min(b - a for a, b in zip(at, at[1:])) > 0.1


def test_one_venue_a_symbol(spark, venue):
    """C fails at the first venue, B has nothing there; L was listed late: its empty stretch isn't filled from elsewhere."""
    spark.dataSource.register(market.MarketSource)
    options = {"url": venue + "/bars", "fallback": venue + "/objects", "pace": 0, "now": 1999 * HOUR, "interval": "1h"}
    spans = '[["A", 0, 7200000], ["B", 0, 7200000], ["C", 0, 7200000], ["L", 0, 3600000], ["L", 6300000000, 6307200000]]'
    bars = spark.read.format("market").options(**options, spans=spans).load()
    got = {(r.series_id, r.volume, r.n) for r in bars.groupBy("series_id", "volume").agg(F.count("*").alias("n")).collect()}
    assert got == {("A", 10.0, 2), ("B", 3.0, 2), ("C", 3.0, 2), ("L", 10.0, 2)}


def _wanted(spark, *spans):
    return spark.createDataFrame(list(spans), store.SPAN_SCHEMA)


def test_missing_spans(spark):
    import random

    rng = random.Random(7)
    spans = lambda n: [(rng.choice("abc"), rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    for n, m in ((0, 5), (5, 0), (6, 9), (12, 30)):
        wanted, held = spans(n), spans(m)
        points = lambda xs: {(s, t) for s, a, b in xs for t in range(a, b)}
        want = points(wanted) - points(held)
        odd = [(None, 1, 5), ("a", None, 4), ("b", 3, None)]
        got = [tuple(r) for r in store.missing(_wanted(spark, *wanted, *wanted, *odd), _wanted(spark, *held, *odd)).collect()]
        assert points(got) == want and sum(b - a for _, a, b in got) == len(want)
        assert len(got) == sum((s, t - 1) not in want for s, t in want)  # as few as possible


def test_read_through(spark, venue, tmp_path):
    """A longer span fetches the difference, a gap in the middle only itself, an open bar comes once it has closed."""
    spark.dataSource.register(market.MarketSource)
    path, fetch = str(tmp_path / "through"), store.from_market(spark, url=venue + "/bars", pace="0", now=str(10**15))

    def read(now, *spans):
        CALLS[venue].clear()
        got = store.read_through(spark, path, "klines", "1h", market.SCHEMAS["klines"], _wanted(spark, *spans), fetch, now).orderBy("series_id", "ts").collect()
        asked = sorted((q["symbol"], int(q["startTime"]) // HOUR, int(q["endTime"]) // HOUR) for _, _, q in CALLS[venue])
        return got, asked

    got, asked = read(1000 * HOUR, ("A", 0, 10 * HOUR), ("A", 20 * HOUR, 30 * HOUR))
    assert len(got) == 20 and asked == [("A", 0, 10), ("A", 20, 30)]
    got, asked = read(1001 * HOUR, ("A", 0, 40 * HOUR), ("B", 0, 5 * HOUR), ("A", 0, 3 * HOUR))
    assert len(got) == 40 and asked == [("A", 10, 20), ("A", 30, 40), ("B", 0, 5)]
    assert [r.fetched // HOUR for r in got] == [1000] * 10 + [1001] * 10 + [1000] * 10 + [1001] * 10
    assert len(read(1002 * HOUR, ("A", 5 * HOUR, 35 * HOUR), ("B", 0, 5 * HOUR))[0]) == 30 and CALLS[venue] == []  # even what is empty
    got, asked = read(50 * HOUR + 7, ("A", 39 * HOUR, 90 * HOUR))
    assert len(got) == 11 and asked == [("A", 40, 50)]
    got, asked = read(52 * HOUR, ("A", 39 * HOUR, 90 * HOUR))
    assert len(got) == 13 and asked == [("A", 50, 52)]
    assert read(52 * HOUR)[0] == [] and CALLS[venue] == []
    # a read that ended between rows and spans: the rows are there twice, and counted once
    spark.read.parquet(path + "/rows").where("fetched = 3600000000").write.partitionBy("kind", "timeframe", "series_id", "month").mode("append").parquet(path + "/rows")
    assert len(read(60 * HOUR, ("A", 0, 40 * HOUR))[0]) == 40 and CALLS[venue] == []


def test_stream_goes_on_from_its_offsets(spark, venue, tmp_path):
    spark.dataSource.register(market.MarketSource)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run(now, symbols):
        CALLS[venue].clear()
        bars = spark.readStream.format("market").options(url=venue + "/bars", symbols=symbols, start=0, pace=0, now=now).load()
        q = bars.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).start(out, format="parquet")
        assert q.awaitTermination(60)
        return sorted((q["symbol"], int(q["startTime"]) // HOUR, int(q["endTime"]) // HOUR) for _, _, q in CALLS[venue])

    assert run(5 * HOUR + 9, "A") == [("A", 0, 5)]
    assert run(5 * HOUR + 10, "A") == []
    assert run(9 * HOUR, "A,D") == [("A", 5, 9), ("D", 0, 9)]  # a symbol that joins starts at the start
    rows = spark.read.parquet(out)
    assert {(r.series_id, r.n, r.d) for r in rows.groupBy("series_id").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("d")).collect()} == {("A", 9, 9), ("D", 9, 9)}
