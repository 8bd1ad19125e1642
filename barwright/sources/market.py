"""Market data over HTTP as a Spark data source, for batches and for streams.

``spark.read.format("market").option("kind", "klines")...``; register it with ``spark.dataSource.register(MarketSource)``.
Symbols are cut into stretches of time, which are dealt to a few lanes; a lane is a partition and pages through its
stretches. Calls are spaced over all lanes (``Slots``) and tried again after growing pauses. Where a second endpoint is
given, each symbol is read as a whole from it when the first has nothing for it or fails, so that no series mixes venues.
A task that fails is run again by Spark. ``spark.readStream`` goes on from an offset for each symbol.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barwright.plans.bars import TIMEFRAME_MS

#: Statuses after which a call is tried again.
RETRIED = (418, 429)
SCHEMAS = {
    "klines": "series_id string, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_quote double",
    "funding": "series_id string, ts timestamp, funding_rate double",
    "open_interest": "series_id string, ts timestamp, open_interest double, open_interest_value double",
}
#: Rows of a page, and of a page of the second endpoint.
PAGE = {"klines": 1500, "funding": 1000, "open_interest": 500}
FALLBACK_PAGE = {"klines": 5000, "funding": 500, "open_interest": 500}
#: Names in rows that are objects, in the order of the values: the time in milliseconds first. Fixed by the venues.
NAMES = {
    "klines": (("openTime", "t"), ("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"), ("quoteVolume",), ("takerBuyQuote",)),
    "funding": (("fundingTime", "time"), ("fundingRate",)),
    "open_interest": (("timestamp",), ("sumOpenInterest",), ("sumOpenInterestValue",)),
}
#: Open interest is kept for thirty days only: an earlier start counts as 29 days ago.
DAY_MS = 86_400_000
KEPT_MS = 29 * DAY_MS


def closed_until(timeframe: str, now: int) -> int:
    """The first time, in milliseconds, at which a bar may open that has not closed at ``now``; bars open on multiples of
    their timeframe, or of a day if they are longer."""
    step = TIMEFRAME_MS[timeframe]
    grid = min(step, DAY_MS)
    return (now - step) // grid * grid + grid


@dataclass
class Slots:
    """The times at which a lane may call: ``lanes`` take turns by the clock, every ``pace`` seconds.

    Lanes share nothing and still keep the spacing together, on one machine or on several (as well as their clocks agree);
    a task that runs again takes the same slots. Two reads at once each have their own spacing.
    """

    pace: float
    lane: int = 0
    lanes: int = 1
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    last: float = field(default=-math.inf)

    def wait(self) -> None:
        if self.pace <= 0:
            return
        period, now = self.pace * self.lanes, self.clock()
        turn = self.lane * self.pace
        at = math.ceil((now - turn) / period) * period + turn
        if at - self.last < period / 2:  # the slot used before, by rounding
            at += period
        self.last = at
        self.sleep(max(0.0, at - now))


def cells(row: list | dict, kind: str) -> tuple:
    """Time and values of a row, which may be an array or an object; bars without a quote volume have volume times close."""
    if isinstance(row, dict):
        got = [next((row[n] for n in names if n in row), None) for names in NAMES[kind]]
    elif kind == "klines":
        got = [*row[:6], row[7] if len(row) > 7 else None, row[10] if len(row) > 10 else None]
    else:
        got = list(row[: len(NAMES[kind])])
    values = [_double(x) for x in got[1:]]
    if kind == "klines":
        if values[5] is None and values[4] is not None and values[3] is not None:
            values[5] = values[4] * values[3]
        values[6] = values[6] or 0.0
    return (int(got[0]), *values)


def fetch(url: str, attempts: int = 5, pause: float = 1.0, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, turn: Callable[[], None] | None = None):
    """JSON from a URL, tried again after rate limits, server and transport errors, each time after twice the pause;
    ``turn`` is called before every attempt, to wait for it."""
    opener = opener or (lambda u: json.load(urllib.request.urlopen(u, timeout=30)))  # noqa: S310
    for i in range(attempts):
        if turn:
            turn()
        try:
            return opener(url)
        except urllib.error.HTTPError as e:
            if i + 1 == attempts or not (e.code in RETRIED or e.code >= 500):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if i + 1 == attempts:
                raise
        sleep(pause * 2**i)


def pages(get: Callable[[int, int], list], start: int, end: int, limit: int, step: int, key: Callable = lambda r: int(r[0])) -> Iterator:
    """Rows of [start, end) page by page; ends on a short page and when a page brings nothing new."""
    at = start
    while at < end:
        rows = get(at, end)
        yield from (r for r in rows if start <= key(r) < end)
        if len(rows) < limit or (after := max(map(key, rows)) + step) <= at:
            return
        at = after


@dataclass
class Stretch:
    """What one endpoint is asked for: a symbol in [start, end), in milliseconds."""

    symbol: str
    start: int
    end: int
    second: bool = False


@dataclass
class Lane(InputPartition):
    """The stretches of one task, and the time as of which bars have closed."""

    lane: int
    lanes: int
    stretches: list[Stretch]
    now: int

    def __init__(self, lane: int, lanes: int, stretches: list[Stretch], now: int):
        super().__init__(lane)
        self.lane, self.lanes, self.stretches, self.now = lane, lanes, stretches, now


class MarketReader(DataSourceReader):
    """Options: ``url``, ``fallback``, ``kind``, ``interval``, ``pace`` (seconds between calls), ``lanes`` (tasks at most), ``now``, and
    either ``symbols``, ``start`` and ``end`` or ``spans``, a JSON list of symbol, start and end.

    With a ``fallback`` the driver asks the first endpoint for one row of each symbol, to choose the symbol's venue.
    """

    def __init__(self, options: dict):
        self.kind, self.interval = options.get("kind", "klines"), options.get("interval", "1h")
        if "spans" in options:
            self.spans = [(s, int(a), int(b)) for s, a, b in json.loads(options["spans"])]
        else:
            self.spans = [(s, int(options["start"]), int(options.get("end", 2**62))) for s in options["symbols"].split(",")]
        if self.kind == "open_interest":
            self.spans = [x for x in self.spans if ":" not in x[0]]  # namespaced symbols have none
        self.url, self.fallback = options["url"], options.get("fallback")
        self.pace, self.lanes = float(options.get("pace", "0.1")), int(options.get("lanes", "8"))
        self.fixed_now = int(options["now"]) if "now" in options else None

    def now(self) -> int:
        return int(time.time() * 1000) if self.fixed_now is None else self.fixed_now

    def until(self, now: int) -> int:
        """The end of what is final at ``now``."""
        return closed_until(self.interval, now) if self.kind == "klines" else now

    def _limit(self, second: bool) -> int:
        return (FALLBACK_PAGE if second else PAGE)[self.kind]

    def _get(self, symbol: str, second: bool, slots: Slots, start: int, end: int, limit: int) -> list[tuple]:
        found = fetch(f"{self.fallback if second else self.url}?symbol={symbol}&interval={self.interval}&startTime={start}&endTime={end}&limit={limit}", turn=slots.wait)
        return [cells(r, self.kind) for r in found]

    def _second(self, spans: list[tuple[str, int, int]]) -> set[str]:
        """The symbols for which the first endpoint has nothing or fails."""
        if not self.fallback:
            return set()
        slots, has = Slots(self.pace), set()
        for symbol, start, end in spans:
            try:
                if symbol not in has and self._get(symbol, False, slots, start, end, 1):
                    has.add(symbol)
            except (OSError, ValueError):
                pass
        return {s for s, _, _ in spans} - has

    def lay(self, spans: list[tuple[str, int, int]], now: int) -> list[Lane]:
        """Lanes of the final part of ``spans``; a stretch has twenty pages at most, so a long history spreads over all lanes."""
        first = now - KEPT_MS if self.kind == "open_interest" else 0
        spans = [(s, max(a, first), min(b, self.until(now))) for s, a, b in spans]
        spans = [x for x in spans if x[1] < x[2]]
        second, out = self._second(spans), []
        for s, start, end in spans:
            step = TIMEFRAME_MS[self.interval] * self._limit(s in second) * 20
            out += [Stretch(s, a, min(a + step, end), s in second) for a in range(start, end, step)]
        n = min(self.lanes, len(out))
        return [Lane(i, n, out[i::n], now) for i in range(n)]

    def partitions(self) -> list[Lane]:
        return self.lay(self.spans, self.now())

    def read(self, part: Lane | None) -> Iterator[tuple]:
        """Each stretch's rows in order of time, the first of those that share one; of bars only those that have closed."""
        import datetime as dt

        if part is None:  # (what Spark asks for where there is no partition)
            return
        slots = Slots(self.pace, part.lane, part.lanes)
        span = TIMEFRAME_MS[self.interval] if self.kind == "klines" else 0
        for x in part.stretches:
            limit, first = self._limit(x.second), {}
            for r in pages(lambda a, b, x=x, n=limit: self._get(x.symbol, x.second, slots, a, b, n), x.start, x.end, limit, max(span, 1)):
                first.setdefault(r[0], r)
            for at in sorted(first):
                if at + span <= part.now:
                    yield (x.symbol, dt.datetime.fromtimestamp(at / 1000, dt.UTC), *first[at][1:])


class MarketStream(DataSourceStreamReader):
    """Bars as they close, or rates as they come: an offset is the time for each symbol up to which it has been read.

    A symbol that joins ``symbols`` later starts at ``start``; one that leaves keeps its offset.
    """

    def __init__(self, options: dict):
        self.reader = MarketReader(options)

    def initialOffset(self) -> dict:
        return {s: start for s, start, _ in self.reader.spans}

    def latestOffset(self) -> dict:
        until = self.reader.until(self.reader.now())
        return {s: max(start, min(end, until)) for s, start, end in self.reader.spans}

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        began = self.initialOffset()
        spans = [(s, start.get(s, began.get(s, at)), at) for s, at in sorted(end.items())]
        return self.reader.lay([x for x in spans if x[1] < x[2]], self.reader.now())

    def read(self, part: Lane | None) -> Iterator[tuple]:
        return self.reader.read(part)

    def commit(self, end: dict) -> None:
        """Nothing is kept that could be let go."""


def latest_price(url: str, symbol: str, **options) -> tuple[float, int]:
    """The price of a symbol now, and the server's time in milliseconds; options as for ``fetch``."""
    got = fetch(f"{url}?symbol={symbol}", **options)
    return float(got["price"]), int(got["time"])


def _double(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


class MarketSource(DataSource):
    """Klines, funding rates or open interest; rows are arrays with the time in milliseconds first, or objects (``NAMES``)."""

    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "klines")]

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options)

    def streamReader(self, schema) -> MarketStream:
        return MarketStream(self.options)
