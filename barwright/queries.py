"""One query for each operator over the driver's tables, and the SQL that says the same.

Bars come from ``events``: price = 100 + value / 100, volume = value. Floating-point results are rounded to six places.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.functions.compiler import evaluate, evaluate_bool
from barwright.operators import backtest as B
from barwright.operators import leaderboard as L
from barwright.operators import mtf, optimize, regimes, signals
from barwright.operators.definitions import parse_signal
from barwright.operators.factors import SINGLE, compute_all_factors
from barwright.plans import bars as P
from barwright.plans.blocks import lay_out
from barwright.plans.config import KNOB_BOUNDS, REGIME_WEIGHTS, BacktestConfig, Costs, PolicyConfig, RiskConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOURS_A_YEAR = 8760


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_bars(spark: SparkSession, d: str, timeframe: str = "1h", by_type: bool = True) -> DataFrame:
    e = table(spark, d, "events")
    return P.bars_from_events(e, timeframe, 100 + F.col("value") / 100, F.col("value"), F.col("event_type") if by_type else None, order="event_id")


def order_bars(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return P.bars_from_events(o, "1d", 100 + F.col("o_totalprice") / 1e5, F.col("o_totalprice"), ts="o_orderdate", order="o_orderkey")


def funding(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in: a rate every eight hours from sign-ups."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    w = F.window("ts", "8 hours")["start"]
    rates = e.groupBy(w.alias("ts")).agg(((F.avg("value") - 100) / 1e6).alias("funding_rate"))
    return rates.select(F.lit("all").alias("series_id"), "ts", "funding_rate")


def open_interest(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in: the hourly number of events, twenty minutes past the hour."""
    e = table(spark, d, "events")
    hours = e.groupBy(F.window("ts", "1 hour")["start"].alias("h")).agg(F.count("*").cast("double").alias("open_interest"))
    return hours.select(F.lit("all").alias("series_id"), (F.col("h") + F.expr("interval 20 minutes")).alias("ts"), "open_interest")


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def _bars_sql(trunc: str = "date_trunc('hour', ts)", by_type: bool = True, name: str = "b") -> str:
    series = "event_type" if by_type else "'all'"
    return f"""{name} as (select {series} as series_id, {trunc} as ts, min_by(100 + value / 100, ts) as open, max(100 + value / 100) as high, min(100 + value / 100) as low,
        max_by(100 + value / 100, ts) as close, sum(value) as volume from events group by 1, 2)"""


BARS, ALL = "with " + _bars_sql(), "with " + _bars_sql(by_type=False)
ORDERS = """with b as (select 'all' as series_id, date_trunc('day', o_orderdate) as ts, min_by(100 + o_totalprice / 1e5, (o_orderdate, o_orderkey)) as open, max(100 + o_totalprice / 1e5) as high,
    min(100 + o_totalprice / 1e5) as low, max_by(100 + o_totalprice / 1e5, (o_orderdate, o_orderkey)) as close, sum(o_totalprice) as volume from orders group by 1, 2)"""
LINE = "partition by series_id order by ts"


def over(agg: str, n: int) -> str:
    return f"{agg} over ({LINE} rows between {n - 1} preceding and current row)"


def roll(agg: str, x: str, n: int) -> str:
    return f"case when {over(f'count({x})', n)} = {n} then {over(f'{agg}({x})', n)} end"


def ewm_sql(source: str, x: str, alpha: float, name: str) -> str:
    """A common table: the exponential mean of x without gaps after its first value, written out as its weighted sum."""
    return f"""{name}_i as (select series_id, ts, {x} as x, row_number() over ({LINE}) - 1 as i from {source} where {x} is not null),
    {name} as (select n.series_id, n.ts, sum(o.x * case when o.i = 0 then pow({1 - alpha!r}, n.i) else {alpha!r} * pow({1 - alpha!r}, n.i - o.i) end) as y
        from {name}_i n join {name}_i o on o.series_id = n.series_id and o.i <= n.i group by 1, 2)"""


# --- bars and relational operators -------------------------------------------------------------------------------


def _bars(name: str, trunc: str, timeframe: str, by_type: bool) -> None:
    @query(name, f"with {_bars_sql(trunc, by_type)} select series_id, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume from b")
    def run(spark, d):
        return event_bars(spark, d, timeframe, by_type).select("series_id", "ts", *[r6(c) for c in P.BAR_COLUMNS])


_bars("bars_1h", "date_trunc('hour', ts)", "1h", False)
_bars("bars_4h", "time_bucket(interval '4 hours', ts)", "4h", False)
_bars("bars_by_type", "date_trunc('hour', ts)", "1h", True)


@query("bars_daily_orders", f"{ORDERS} select series_id, ts, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, round(volume, 4) as volume from b")
def _(spark, d):
    return order_bars(spark, d).select("series_id", "ts", *[F.round(c, 8).alias(c) for c in P.BAR_COLUMNS[:4]], F.round("volume", 4).alias("volume"))


@query("rebucket_4h", f"{BARS} select series_id, time_bucket(interval '4 hours', ts) as bar, round(min_by(open, ts), 6) as open, round(max(high), 6) as high, round(min(low), 6) as low, round(max_by(close, ts), 6) as close, round(sum(volume), 6) as volume from b group by 1, 2")
def _(spark, d):
    return P.rebucket(event_bars(spark, d), "4h").select("series_id", F.col("ts").alias("bar"), *[r6(c) for c in P.BAR_COLUMNS])


@query("dedupe_first", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1")
def _(spark, d):
    return P.first_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("closed_bar_filter", f"{BARS} select series_id, ts, round(close, 6) as close from b where ts <= timestamp '2024-01-10 12:30:00' - interval '1 hour'")
def _(spark, d):
    now = F.lit("2024-01-10 12:30:00").cast("timestamp_ntz")
    return P.closed_bars(event_bars(spark, d), "1h", now).select("series_id", "ts", r6("close"))


_FUNDING = "f as (select time_bucket(interval '8 hours', ts) as ts, (avg(value) - 100) / 1e6 as funding_rate from events where event_type = 'signup' group by 1)"
_OI = "o as (select date_trunc('hour', ts) + interval '20 minutes' as ts, cast(count(*) as double) as open_interest from events group by 1)"


@query("asof_funding", f"{ALL}, {_FUNDING} select b.ts, round(f.funding_rate, 9) as funding_rate from b asof left join f on b.ts >= f.ts")
def _(spark, d):
    df = P.asof_backward(event_bars(spark, d, by_type=False), funding(spark, d), ["funding_rate"])
    return df.select("ts", F.round("funding_rate", 9).alias("funding_rate"))


@query(
    "asof_oi_nearest",
    f"""{ALL}, {_OI}, c as (select b.ts, p.open_interest as po, b.ts - p.ts as pd, n.open_interest as no, n.ts - b.ts as nd
    from b asof left join o p on b.ts >= p.ts asof left join o n on b.ts <= n.ts)
    select ts, case when nd is not null and (pd is null or nd <= pd) and nd <= interval '1 hour' then no when pd <= interval '1 hour' then po end as open_interest from c""",
)
def _(spark, d):
    return P.asof_nearest(event_bars(spark, d, by_type=False), open_interest(spark, d), ["open_interest"], 3600).select("ts", "open_interest")


_SLOW = _bars_sql("time_bucket(interval '4 hours', ts)", False, "s")


@query("asof_slower_tf", f"{ALL}, {_SLOW}, a as (select ts + interval '4 hours' as ts, close from s) select b.ts, round(a.close, 6) as slow_close from b asof left join a on b.ts >= a.ts")
def _(spark, d):
    df = P.asof_closed(event_bars(spark, d, by_type=False), event_bars(spark, d, "4h", False), "4h", ["close"], ["slow_close"])
    return df.select("ts", r6("slow_close"))


@query(
    "build_dataset",
    f"""{ALL}, {_FUNDING}, {_OI}, c as (select b.ts, b.close, f.funding_rate, p.open_interest as po, b.ts - p.ts as pd, n.open_interest as no, n.ts - b.ts as nd
    from b asof left join f on b.ts >= f.ts asof left join o p on b.ts >= p.ts asof left join o n on b.ts <= n.ts)
    select ts, round(close, 6) as close, round(funding_rate, 9) as funding_rate,
    case when nd is not null and (pd is null or nd <= pd) and nd <= interval '1 hour' then no when pd <= interval '1 hour' then po end as open_interest from c""",
)
def _(spark, d):
    df = P.build_dataset(event_bars(spark, d, by_type=False), funding(spark, d), open_interest(spark, d))
    return df.select("ts", r6("close"), F.round("funding_rate", 9).alias("funding_rate"), "open_interest")


# --- expressions ------------------------------------------------------------------------------------------------


def _expression(name: str, text: str, value: str, base: str = BARS, limit: bool = False, ctes: str = "") -> None:
    """A query that evaluates ``text``; ``value`` is SQL over the common table b (or the last one of ``ctes``)."""
    source = "b" if not ctes else "z"
    full = f"coalesce({value}, 0)"
    if limit:
        full = f"least(greatest({full}, -1.0), 1.0)"

    @query(name, f"{base}{ctes}, v as (select series_id, ts, cast({full} as double) as value from {source}) select series_id, ts, round(value, 6) as value from v")
    def run(spark, d):
        df = evaluate(event_bars(spark, d), text, "value", limit=limit)
        return df.select("series_id", "ts", r6("value"))


def _z(x: str, n: int) -> str:
    return f"coalesce(({x} - ({roll('avg', x, n)})) / nullif(({roll('stddev_samp', x, n)}), 0), 0)"


_expression("dsl_arith", "(high - low) * 2 + -close / 4 - 3", "(high - low) * 2 - close / 4 - 3")
_expression("dsl_div_zero", "volume / (close - close) + open / close", "0.0 + open / close")
_expression("dsl_compare_bool", "if(close > open and not (volume < 100) or close == high, 1, -1)", "case when (close > open and not (volume < 100)) or close = high then 1 else -1 end")
_expression("dsl_bool_arith", "(close > open) + (high > close) + 2 * (close < open)", "cast((close > open) or (high > close) as int) + 2 * cast(close < open as int)")
_expression("dsl_if", "if(close - open, close, open)", "case when close - open <> 0 then close else open end")
_expression("dsl_clip", "clip(close - open, -0.5, 0.25)", "least(greatest(close - open, -0.5), 0.25)")
_expression("dsl_minmax", "max(open, close, low + 1) - min(open, close)", "greatest(open, close, low + 1) - least(open, close)")
_expression("dsl_minmax_missing", "max(prev(close, 5), open) - min(prev(low, 30), close, prev(high, 12))", f"greatest(lag(close, 5) over ({LINE}), open) - least(lag(low, 30) over ({LINE}), close, lag(high, 12) over ({LINE}))")
_expression("dsl_log_sqrt_tanh", "log(volume) + sqrt(close - open) + tanh(close - open, 2) + sign(close - open) + abs(open - close)", "coalesce(case when volume > 0 then ln(volume) end, 0) + sqrt(greatest(close - open, 0)) + tanh((close - open) * 2) + sign(close - open) + abs(open - close)")
_expression("dsl_prev", "prev(close, 3)", f"lag(close, 3) over ({LINE})")
_expression("dsl_time_accessors", "hour_utc * 100 + minute_utc * 10 + dayofweek_utc", "hour(ts) * 100 + minute(ts) * 10 + (isodow(ts) - 1)")
_expression("dsl_bar_index", "bar_index", f"row_number() over ({LINE}) - 1")
_expression("dsl_missing_column", "funding + oi + trend + close", "close")
_expression("dsl_score", "zscore(close, 48) * -1", f"{_z('close', 48)} * -1", limit=True)
_expression("sma", "sma(close, 20)", roll("avg", "close", 20))
_expression("stdev", "stdev(close, 20)", roll("stddev_samp", "close", 20))
_expression("zscore", "z_score(close, 30)", _z("close", 30))
_expression("highest", "highest(high, 20)", roll("max", "high", 20))
_expression("lowest", "ta_lowest(low, 20)", roll("min", "low", 20))
_expression("corr", "corr(close, volume, 24)", f"case when {over('count(close)', 24)} = 24 then {over('covar_samp(close, volume)', 24)} / nullif({over('stddev_samp(close)', 24)} * {over('stddev_samp(volume)', 24)}, 0) end")
_expression(
    "slope", "slope(close, 20)", f"coalesce(case when {over('count(close)', 20)} = 20 then {over('regr_slope(close, i)', 20)} end, 0) / nullif(close, 0)", ctes=f", z as (select *, cast(row_number() over ({LINE}) - 1 as double) as i from b)"
)
_TYPICAL = "(high + low + close) / 3"
_VWAP = f"({roll('sum', f'{_TYPICAL} * volume', 96)}) / nullif(({roll('sum', 'volume', 96)}), 0)"
_expression("vwap", "vwap(96)", f"coalesce(last_value(c ignore nulls) over ({LINE} rows unbounded preceding), close)", ctes=f", z as (select *, {_VWAP} as c from b)")
_DAY = "partition by series_id, cast(ts as date) order by ts rows unbounded preceding"
_expression("session_vwap", "session_vwap()", f"coalesce(last_value(c ignore nulls) over ({LINE} rows unbounded preceding), close)", ctes=f", z as (select *, sum({_TYPICAL} * volume) over ({_DAY}) / nullif(sum(volume) over ({_DAY}), 0) as c from b)")
_expression("bb_width", "bb_width(close, 20, 2)", f"4.0 * ({roll('stddev_samp', 'close', 20)}) / nullif(close, 0)")
_expression("bb_bands", "bb_upper(close, 20, 2) - bb_mid(close, 20) + bb_lower(close, 20, 1)", f"2.0 * ({roll('stddev_samp', 'close', 20)}) + ({roll('avg', 'close', 20)}) - ({roll('stddev_samp', 'close', 20)})")
_expression("ema", "ema(close, 20)", "y", ctes=f", {ewm_sql('b', 'close', 2 / 21, 'z')}")
_RSI = f", c as (select *, close - lag(close) over ({LINE}) as ch from b), u0 as (select series_id, ts, greatest(ch, 0) as g, greatest(-ch, 0) as l from c where ch is not null), {ewm_sql('u0', 'g', 1 / 14, 'u')}, {ewm_sql('u0', 'l', 1 / 14, 'l')}"
_RSI += ", z as (select b.*, coalesce(100 - 100 / (1 + u.y / nullif(l.y, 0)), 50) as r from b left join u using (series_id, ts) left join l using (series_id, ts))"
_expression("rsi", "rsi(close, 14)", "r", ctes=_RSI)
_TR = f", t as (select *, greatest(high - low, abs(high - lag(close) over ({LINE})), abs(low - lag(close) over ({LINE}))) as tr, high - lag(high) over ({LINE}) as up, lag(low) over ({LINE}) - low as dn from b)"
_expression("true_range_atr", "atr(14)", "y", ctes=f"{_TR}, {ewm_sql('t', 'tr', 1 / 14, 'z')}")
_ADX = f"""{_TR}, m as (select *, case when up > dn and up > 0 then up else 0 end as p, case when dn > up and dn > 0 then dn else 0 end as q from t),
    {ewm_sql('m', 'tr', 1 / 14, 'a')}, {ewm_sql('m', 'p', 1 / 14, 'pd')}, {ewm_sql('m', 'q', 1 / 14, 'qd')},
    x as (select a.series_id, a.ts, 100 * abs(100 * pd.y / nullif(a.y, 0) - 100 * qd.y / nullif(a.y, 0)) / nullif(100 * pd.y / nullif(a.y, 0) + 100 * qd.y / nullif(a.y, 0), 0) as dx
        from a join pd using (series_id, ts) join qd using (series_id, ts)), {ewm_sql('x', 'dx', 1 / 14, 'ax')},
    z as (select b.*, coalesce(ax.y, 0) as adx from b left join ax using (series_id, ts))"""
_expression("adx", "adx(14)", "adx", ctes=_ADX)
_MACD = f", {ewm_sql('b', 'close', 2 / 13, 'fa')}, {ewm_sql('b', 'close', 2 / 27, 'sl')}, li as (select fa.series_id, fa.ts, fa.y - sl.y as line from fa join sl using (series_id, ts)), {ewm_sql('li', 'line', 2 / 10, 'si')}, z as (select li.*, line - si.y as hist from li join si using (series_id, ts))"
_expression("macd", "ema(close, 12) - ema(close, 26) - ema(ema(close, 12) - ema(close, 26), 9)", "hist", ctes=_MACD)

_TOP, _BOTTOM = f"({roll('max', 'high', 14)})", f"({roll('min', 'low', 14)})"
_expression("roc", "roc(close, 12)", f"close / nullif(lag(close, 12) over ({LINE}), 0) - 1")
_expression("donchian_pos", "donchian_pos(14)", f"(close - {_BOTTOM}) / nullif({_TOP} - {_BOTTOM}, 0)")
_expression("stoch", "stoch(14)", f"100 * (close - {_BOTTOM}) / nullif({_TOP} - {_BOTTOM}, 0)")
_expression("williams_r", "williams_r(14)", f"-100 * ({_TOP} - close) / nullif({_TOP} - {_BOTTOM}, 0)")
_expression("obv", "obv()", f"sum(x) over ({LINE} rows unbounded preceding)", ctes=f", z as (select *, coalesce(sign(close - lag(close) over ({LINE})) * volume, 0) as x from b)")
_FLOW = f", y as (select *, {_TYPICAL} as tp from b), f as (select *, sign(tp - lag(tp) over ({LINE})) * tp * volume as fl from y), g as (select *, case when fl is not null then greatest(fl, 0) end as u, case when fl is not null then greatest(-fl, 0) end as d from f), z as (select *, {roll('sum', 'u', 14)} as up, {roll('sum', 'd', 14)} as dn from g)"
_expression("mfi", "mfi(14)", "coalesce(100 - 100 / (1 + up / nullif(dn, 0)), 50)", ctes=_FLOW)
_DEVIATION = f""", y as (select *, {_TYPICAL} as tp, row_number() over ({LINE}) as i from b), w as (select *, {roll('avg', 'tp', 20)} as m from y),
    dv as (select w.series_id, w.ts, avg(abs(y.tp - w.m)) as d from w join y on y.series_id = w.series_id and y.i between w.i - 19 and w.i group by 1, 2), z as (select w.*, d from w join dv using (series_id, ts))"""
_expression("cci", "cci(20)", "(tp - m) / nullif(0.015 * d, 0)", ctes=_DEVIATION)
_expression("keltner_width", "keltner_width(14, 2)", "4.0 * y / nullif(close, 0)", ctes=f"{_TR}, {ewm_sql('t', 'tr', 1 / 14, 'a')}, z as (select b.*, a.y from b join a using (series_id, ts))")

@query("dsl_condition", f"{BARS} select series_id, ts, coalesce(close > ({roll('avg', 'close', 10)}), false) as condition from b")
def _(spark, d):
    return evaluate_bool(event_bars(spark, d), "close > sma(close, 10)").select("series_id", "ts", "condition")


@query("realized_vol", f"{BARS}, l as (select *, ln(close / lag(close) over ({LINE})) as lr from b) select series_id, ts, round({roll('stddev_samp', 'lr', 24)}, 6) as vol from l")
def _(spark, d):
    df = event_bars(spark, d).withColumn("lr", W.log_return(F.col("close")))
    return df.select("series_id", "ts", r6(W.stdev(F.col("lr"), 24), "vol"))


# --- factors, regimes, signals ------------------------------------------------------------------------------------


#: SQL of each factor: its value, and the common tables that it needs.
FACTOR_SQL: dict[str, tuple[str, str]] = {}


def _factor(name: str, value: str, ctes: str = "") -> None:
    source = "z" if ctes else "b"
    FACTOR_SQL[name] = (value, ctes)

    @query(f"factor_{name}", f"{BARS}{ctes}, v as (select series_id, ts, {value} as value from {source}) select series_id, ts, round(value, 6) as value from v")
    def run(spark, d):
        return compute_all_factors(event_bars(spark, d)).select("series_id", "ts", r6(f"f_{name}", "value"))


_factor("rsi", "least(greatest((50 - r) / 50, -1), 1)", _RSI)
_factor("ema_cross", "tanh(50 * d / close)", f", {ewm_sql('b', 'close', 2 / 21, 'e1')}, {ewm_sql('b', 'close', 2 / 51, 'e2')}, z as (select b.*, e1.y - e2.y as d from b join e1 using (series_id, ts) join e2 using (series_id, ts))")
_factor("macd", "tanh(200 * hist / close)", _MACD.replace("z as (select li.*, line - si.y as hist from li join si using (series_id, ts))", "z as (select li.*, line - si.y as hist, close from li join si using (series_id, ts) join b using (series_id, ts))"))
_factor("trend", "tanh(30 * (close - e) / e) * least(greatest((adx - 15) / 25, 0), 1)", f"{_ADX.replace('z as (', 'za as (')}, {ewm_sql('b', 'close', 2 / 201, 'e3')}, z as (select za.*, e3.y as e from za join e3 using (series_id, ts))")
_DIRECTION = f", rt as (select *, coalesce(close / nullif(lag(close) over ({LINE}), 0) - 1, 0) as ret, {_z('volume', 48)} as vz from b), {ewm_sql('rt', 'ret', 2 / 5, 'di')}"
_factor("volume", "y", f"{_DIRECTION}, sg as (select rt.series_id, rt.ts, least(greatest(vz, -3), 3) / 3 * sign(di.y) as s from rt join di using (series_id, ts)), {ewm_sql('sg', 's', 2 / 5, 'z')}")


#: Bars with funding rates and open interest, as one common table.
DATASET = f"""b as (with {_bars_sql(by_type=False, name='b0')}, {_FUNDING}, {_OI}, c as (select b0.*, f.funding_rate, p.open_interest as po, b0.ts - p.ts as pd, n.open_interest as no, n.ts - b0.ts as nd
    from b0 asof left join f on b0.ts >= f.ts asof left join o p on b0.ts >= p.ts asof left join o n on b0.ts <= n.ts)
    select *, case when nd is not null and (pd is null or nd <= pd) and nd <= interval '1 hour' then no when pd <= interval '1 hour' then po end as open_interest from c)"""


def _dataset_factor(name: str, value: str, ctes: str = "") -> None:
    """A factor over bars with funding rates and open interest."""
    FACTOR_SQL[name] = (value, ctes)

    @query(f"factor_{name}", f"with {DATASET}{ctes}, v as (select series_id, ts, {value} as value from {'z' if ctes else 'b'}) select series_id, ts, round(value, 6) as value from v")
    def run(spark, d):
        df = P.build_dataset(event_bars(spark, d, by_type=False), funding(spark, d), open_interest(spark, d))
        return compute_all_factors(df).select("series_id", "ts", r6(f"f_{name}", "value"))


_dataset_factor("funding", f"0 - least(greatest({_z('funding_rate', 168)}, -3), 3) / 3")
_dataset_factor(
    "oi", "y",
    f""", st as (select *, coalesce(close / nullif(lag(close) over ({LINE}), 0) - 1, 0) as ret, open_interest - lag(open_interest) over ({LINE}) as step from b),
    rt as (select *, {_z('step', 48)} as oz from st), {ewm_sql('rt', 'ret', 2 / 5, 'di')},
    sg as (select rt.series_id, rt.ts, least(greatest(oz, -3), 3) / 3 * sign(di.y) as s from rt join di using (series_id, ts)), {ewm_sql('sg', 's', 2 / 5, 'z')}""",
)
_factor("slope_regression", "tanh(2000 * s / close)", f", i as (select *, cast(row_number() over ({LINE}) as double) as i from b), z as (select *, coalesce(case when {over('count(close)', 20)} = 20 then {over('regr_slope(close, i)', 20)} end, 0) as s from i)")
_factor("adx_strength", "least(greatest((adx - 27.5) / 12.5, -1), 1)", _ADX)
_factor("rsi_delta", f"case when lag(r) over ({LINE}) is null then 0 else least(greatest((r - lag(r) over ({LINE})) / 50, -1), 1) end", _RSI)
_factor("volume_zscore", f"least(greatest({_z('volume', 48)}, -3), 3) / 3")
_factor(
    "atr_stability", f"case when lag(y) over ({LINE}) is null then 0 else least(greatest(1 - abs(y - lag(y) over ({LINE})) / greatest(y, case when md > 0 then md * 0.0001 else 1e-6 end), 0), 1) * 2 - 1 end",
    f"{_TR}, {ewm_sql('t', 'tr', 1 / 14, 'ar')}, z as (select *, median(y) over (partition by series_id) as md from ar)",
)
_factor("bb_width", "tanh(2 * coalesce((w - md) / nullif(md, 0), 0))", f", w as (select *, 4.0 * ({roll('stddev_samp', 'close', 20)}) / nullif(close, 0) as w from b), z as (select *, case when {over('count(w)', 80)} = 80 then {over('median(w)', 80)} end as md from w)")
_factor("vwap_distance", "tanh(50 * coalesce((close - c) / nullif(c, 0), 0))", f", z as (select *, {_VWAP} as c from b)")


def _side_by_side(names: tuple[str, ...], more: dict[str, tuple[str, str]]) -> str:
    """A common table feat: the dataset's bars with the factors ``names`` as columns f_... and ``more`` columns."""
    cells = {f"f_{n}": FACTOR_SQL[n] for n in names} | more
    parts = [f"(with {DATASET}{ctes} select ts, {value} as {n} from {'z' if ctes else 'b'})" for n, (value, ctes) in cells.items()]
    return f"feat as (select *, row_number() over (order by ts) - 1 as i from (with {DATASET} select ts, close, funding_rate from b) {' '.join(f'join {x} using (ts)' for x in parts)})"


@query("dsl_funding_oi", f"with {DATASET} select ts, round(coalesce(coalesce(funding_rate, 0) * 1000000 + open_interest / 10 - open_interest, 0), 6) as value from b")
def _(spark, d):
    """The accessors of funding rate and open interest, both names of the latter, with values."""
    df = P.build_dataset(event_bars(spark, d, by_type=False), funding(spark, d), open_interest(spark, d)).withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))
    return evaluate(df, "funding * 1000000 + oi / 10 - open_interest", "value", limit=False, funding_alias=True).select("ts", r6("value"))


@query("factor_funding_oi", f"with {_side_by_side(tuple(SINGLE), {})} select ts, {', '.join(f'round(f_{n}, 6) as f_{n}' for n in SINGLE)} from feat")
def _(spark, d):
    """All factors on the dataset with funding and open interest."""
    df = P.build_dataset(event_bars(spark, d, by_type=False), funding(spark, d), open_interest(spark, d))
    return compute_all_factors(df).select("ts", *[r6(f"f_{n}") for n in SINGLE])


_REGIME = f"""{_ADX.replace('z as (', 'za as (')}, {ewm_sql('b', 'close', 2 / 201, 'e3')},
    g as (select za.series_id, za.ts, adx, e3.y as e, lag(e3.y, 24) over (partition by za.series_id order by za.ts) as e0 from za join e3 using (series_id, ts)),
    h as (select *, case when adx >= 25 and (e - e0) / nullif(e0, 0) > 0 then 'trend_up' when adx >= 25 and (e - e0) / nullif(e0, 0) < 0 then 'trend_down' else 'chop' end as raw from g),
    j as (select *, sum(ch) over ({LINE} rows unbounded preceding) as run from (select *, coalesce(cast(raw <> lag(raw) over ({LINE}) as int), 0) as ch from h)),
    k as (select *, count(*) over (partition by series_id, run) as len from j),
    z as (select series_id, ts, last_value(case when len >= 6 or run = 0 then raw end ignore nulls) over ({LINE} rows unbounded preceding) as regime from k)"""


@query("regime_classify", f"{BARS}{_REGIME} select series_id, ts, regime from z")
def _(spark, d):
    return regimes.classify(event_bars(spark, d)).select("series_id", "ts", "regime")


@query("regime_stats", f"{BARS}{_REGIME} select r.regime, count(z.regime) as bars, round(100.0 * count(z.regime) / (select count(*) from z), 1) as pct from (values ('trend_up'), ('trend_down'), ('chop')) r(regime) left join z using (regime) group by 1")
def _(spark, d):
    return regimes.regime_stats(regimes.classify(event_bars(spark, d)))


def _case_weights() -> str:
    cells = {r: " + ".join(f"coalesce({f} * {w!r}, 0)" for f, w in row.items() if f in ("rsi", "volume")) for r, row in REGIME_WEIGHTS.items()}
    return "case m " + " ".join(f"when '{r}' then {x}" for r, x in cells.items()) + " else 0 end"


@query("combine_weights", f"{BARS}, z as (select series_id, ts, case when close > open then 'trend_up' when close < open then 'trend_down' when close = high then 'chop' else 'none' end as m, (close - open) as rsi, case when volume > 200 then 0.5 end as volume from b) select series_id, ts, round(least(greatest({_case_weights()}, -1), 1), 6) as score from z")
def _(spark, d):
    c = F.col
    regime = F.when(c("close") > c("open"), "trend_up").when(c("close") < c("open"), "trend_down").when(c("close") == c("high"), "chop").otherwise("none")
    df = event_bars(spark, d).select("series_id", "ts", regime.alias("regime"), (c("close") - c("open")).alias("f_rsi"), F.when(c("volume") > 200, 0.5).alias("f_volume"))
    return signals.combine(df).select("series_id", "ts", r6("score"))


_SCORE = f"least(greatest({_z('close', 48)} * -1, -1.0), 1.0)"
_NO_HOLD = BacktestConfig(min_hold_bars=0)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(event_bars(spark, d), "zscore(close, 48) * -1")


@query("discretize_threshold", f"{BARS}, z as (select *, {_SCORE} as score from b) select series_id, ts, case when score <= -0.2 then -1 when score >= 0.2 then 1 else 0 end as signal from z")
def _(spark, d):
    return signals.discretize(scored(spark, d), _NO_HOLD).select("series_id", "ts", "signal")


@query("discretize_conditional", f"{BARS}, z as (select *, {_SCORE} as score from b) select series_id, ts, case when score >= 0.2 then 1 when close > high - 0.1 then -1 else 0 end as signal from z")
def _(spark, d):
    return signals.discretize(scored(spark, d), _NO_HOLD, short_when="close > high - 0.1").select("series_id", "ts", "signal")


_POSITION = f", z0 as (select *, {_SCORE} as score from b), z as (select *, case when score <= -0.2 then -1 when score >= 0.2 then 1 else 0 end as s, row_number() over ({LINE}) as i from z0)"
_BARS_R = BARS.replace("with ", "with recursive ", 1)


@query(
    "min_hold",
    f"""{_BARS_R}{_POSITION}, h as (select series_id, ts, i, s as now, 1 as held from z where i = 1
    union all select z.series_id, z.ts, z.i, case when z.s <> h.now and (h.now = 0 or h.held >= 8) then z.s else h.now end, case when z.s <> h.now and (h.now = 0 or h.held >= 8) then 1 else h.held + 1 end
    from h join z on z.series_id = h.series_id and z.i = h.i + 1) select series_id, ts, now as signal from h""",
)
def _(spark, d):
    return signals.discretize(scored(spark, d), BacktestConfig(min_hold_bars=8)).select("series_id", "ts", "signal")


# --- backtests ----------------------------------------------------------------------------------------------------

_PLAIN = RiskConfig(leverage=2.0, take_profit_pct=None, stop_loss_pct=None)
_COST = 6 / 1e4
_FAST = f"""{_POSITION}, p as (select *, coalesce(lag(s) over ({LINE}), 0) as side, lag(close) over ({LINE}) as pc from z),
    q as (select *, coalesce((close - pc) / pc, 0) * side * 2.0 as bar_ret, case when s <> side and side <> 0 then {_COST * 2!r} else 0 end + case when s <> side and s <> 0 then {_COST * 2!r} else 0 end as trade_cost,
        case when s <> side and side <> 0 then case when s <> 0 then 'flip' else 'flat' end else '' end as exit, cast(s <> side as int) as fl from p),
    r as (select *, greatest(bar_ret - trade_cost, -1.0) as net_ret, sum(fl) over ({LINE} rows between unbounded preceding and 1 preceding) as trade from q),
    e as (select *, product(1 + net_ret) over ({LINE} rows unbounded preceding) as equity from r)"""


def fast_bars(spark: SparkSession, d: str) -> DataFrame:
    df = signals.discretize(scored(spark, d), _NO_HOLD)
    return B.run(df, _NO_HOLD, _PLAIN)


@query("bt_fastpath_bars", f"{BARS}{_FAST} select series_id, ts, cast(side * 2.0 as double) as position, round(bar_ret, 6) as bar_ret, round(cast(trade_cost as double), 6) as trade_cost, round(net_ret, 6) as net_ret, round(equity, 6) as equity, exit from e")
def _(spark, d):
    return fast_bars(spark, d).select("series_id", "ts", "position", r6("bar_ret"), r6("trade_cost"), r6("net_ret"), r6("equity"), "exit")


_TRADES = f"""t0 as (select series_id, trade, min(ts) as start, max(ts) as "end", cast(count(*) as int) as bars, case when max(side) > 0 then 'long' else 'short' end as side, product(1 + bar_ret) as g, coalesce(max(nullif(exit, '')), 'open') as exit from e where side <> 0 group by 1, 2),
    t as (select *, {1 - 2 * _COST!r} * g * case when exit = 'open' then 1 else {1 - 2 * _COST!r} end - 1 as ret from t0)"""


@query("bt_fastpath_trades", f'{BARS}{_FAST}, {_TRADES} select series_id, start, "end", bars, side, round(ret, 6) as ret, exit from t')
def _(spark, d):
    return B.trades(fast_bars(spark, d), _COST, 2.0).select("series_id", "start", "end", "bars", "side", r6("ret"), "exit")


#: Metrics of the fast backtest, not rounded.
METRICS = f"""{BARS}{_FAST}, {_TRADES}, dd as (select *, equity / nullif(max(equity) over ({LINE} rows unbounded preceding), 0) - 1 as dd, abs(side - lag(side) over ({LINE})) * 2.0 as turn from e),
    m as (select series_id, count(*) as bars, max_by(equity, ts) as le, avg(net_ret) as mu, stddev_samp(net_ret) as sd, min(dd) as max_drawdown, sum(turn) as turnover, avg(cast(side <> 0 as double)) as exposure, sum(trade_cost) as total_cost from dd group by 1),
    n as (select series_id, count(*) as trades, avg(cast(ret > 0 as double)) as win_rate, avg(ret) as avg_trade_return, count(*) filter (exit = 'flip') as exits_flip, count(*) filter (exit = 'flat') as exits_flat from t group by 1),
    metrics as (select series_id, bars, le, le - 1 as total_return, mu * 8760 / (sd * sqrt(8760)) as sharpe, max_drawdown, trades, win_rate, avg_trade_return, cast(turnover as double) as turnover, exposure,
        cast(total_cost as double) as total_cost, exits_flip, exits_flat, cast(0 as bigint) as exits_sl, cast(0 as bigint) as exits_tp from m join n using (series_id))"""


@query(
    "bt_metrics",
    f"""{METRICS} select series_id, bars, round(total_return, 6) as total_return, round(log10(pow(le, 8760.0 / bars)), 6) as log_growth, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, trades, round(win_rate, 6) as win_rate,
    round(avg_trade_return, 6) as avg_trade_return, turnover, round(exposure, 6) as exposure, round(total_cost, 6) as total_cost, exits_flip, exits_flat, exits_sl, exits_tp from metrics""",
)
def _(spark, d):
    return _metrics_of(fast_bars(spark, d))


def _metrics_of(bars: DataFrame) -> DataFrame:
    m = B.metrics(bars, HOURS_A_YEAR, _COST, 2.0)
    m = m.withColumn("cagr", F.log10(1 + F.col("cagr"))).withColumnRenamed("cagr", "log_growth")  # (toy bars grow absurdly)
    rounded = ("total_return", "log_growth", "sharpe", "max_drawdown", "win_rate", "avg_trade_return", "exposure", "total_cost")
    return m.select(*[r6(c) if c in rounded else c for c in m.columns])


@query("buy_and_hold", f"{BARS}, r as (select *, coalesce(close / lag(close) over ({LINE}) - 1, 0) as r from b), e as (select *, product(1 + r) over ({LINE} rows unbounded preceding) as q from r), d as (select *, q / max(q) over ({LINE} rows unbounded preceding) - 1 as dd from e) select series_id, round(max_by(q, ts) - 1, 6) as total_return, round(min(dd), 6) as max_drawdown, round(avg(r) * 8760 / (stddev_samp(r) * sqrt(8760)), 6) as sharpe from d group by 1")
def _(spark, d):
    return B.buy_and_hold(event_bars(spark, d), HOURS_A_YEAR).select("series_id", r6("total_return"), r6("max_drawdown"), r6("sharpe"))


_RISK = RiskConfig(leverage=2.0, take_profit_pct=0.01, stop_loss_pct=0.008)


def full_bars(spark: SparkSession, d: str, policy: PolicyConfig | None = None) -> DataFrame:
    df = signals.discretize(scored(spark, d), _NO_HOLD)
    return B.run(df, BacktestConfig(min_hold_bars=3), _RISK, policy)


def walk_sql(fee: float, hold: int, tp: float, sl: float, lev: float, barred: str = "false", trades: int = 0, losses: int = 0) -> str:
    """A recursive common table: the state of each series of z (i, ts, close, high, low, s) from bar to bar."""
    day = "cast(z.ts as date) <> cast(st.ts as date)"
    recent = "list_filter(entries, lambda x: x >= ts - interval 1 day)"
    stop = f"""case when st.side = 1 and z.low <= st.entry * (1 - {sl}) or st.side = -1 and z.high >= st.entry * (1 + {sl}) then 'sl'
        when st.side = 1 and z.high >= st.entry * (1 + {tp}) or st.side = -1 and z.low <= st.entry * (1 - {tp}) then 'tp' else '' end"""
    price = f"case stop when 'sl' then entry * (1 - was * {sl}) when 'tp' then entry * (1 + was * {tp}) else close end"
    return f"""st as (
    select series_id, ts, i, close, 0 as was, case when go then s else 0 end as side, case when go then close else 0.0 end as entry, 0 as held, 0.0::double as pnl, 0 as lost, false as latched,
        case when go then [ts] else []::timestamp[] end as entries, 0.0::double as bar_ret, case when go then {fee!r} else 0.0 end::double as cost, '' as exit from (select *, s <> 0 and not ({barred}) as go from z where i = 1)
    union all
    select series_id, ts, i, close, was, case when go then s when ends or was = 0 then 0 else was end, case when go then close when ends or was = 0 then 0.0 else entry end, case when ends or was = 0 then 0 else held end,
        case when ends or was = 0 then 0.0 else pnl end, lost, latched, case when go then list_append({recent}, ts) else entries end, bar_ret, ({fee!r} * (ends::int + go::int))::double, case when stop <> '' then stop when ends and s <> 0 then 'flip' when ends then 'flat' else '' end
    from (select *, stop = '' and s <> 0 and (was = 0 or ends) and not bar and not latched and ({trades} = 0 or len({recent}) < {trades}) as go
    from (select * replace (latched or ({losses} > 0 and ends and lost >= {losses}) as latched)
    from (select * replace (case when ends then case when pnl < 0 then lost + 1 else 0 end else lost end as lost)
    from (select * replace (pnl + bar_ret as pnl), stop <> '' or (was <> 0 and s <> was and held >= {hold}) as ends
    from (select *, case when was = 0 then 0.0 else ({price} - before) / before * was * {lev} end as bar_ret
    from (select z.series_id, z.ts, z.i, z.close, z.s, {barred} as bar, st.side as was, st.entry, st.close as before, st.pnl, st.entries, {stop} as stop, st.held + case when st.side <> 0 then 1 else 0 end as held,
        case when {day} then 0 else st.lost end as lost, case when {day} then false else st.latched end as latched from st join z on z.series_id = st.series_id and z.i = st.i + 1)))))))"""


@query("bt_full", f"{_BARS_R}{_POSITION}, {walk_sql(_COST * 2, 3, 0.01, 0.008, 2)} select series_id, ts, cast(was * 2.0 as double) as position, round(bar_ret, 6) as bar_ret, round(cost, 6) as trade_cost, exit from st")
def _(spark, d):
    return full_bars(spark, d).select("series_id", "ts", "position", r6("bar_ret"), r6("trade_cost"), "exit")


_BARRED = "hour(z.ts) in (0, 1, 2, 3) or (z.ts between timestamp '2024-01-03 13:45:00' and timestamp '2024-01-03 14:15:00')"


@query(
    "bt_policy",
    f"""{_BARS_R}{_POSITION}, {walk_sql(_COST * 2, 3, 0.01, 0.008, 2, _BARRED, 4, 2)} select series_id, ts, cast(was * 2.0 as double) as position, round(bar_ret, 6) as bar_ret, round(cost, 6) as trade_cost,
    round(product(1 + greatest(bar_ret - cost, -1.0)) over ({LINE} rows unbounded preceding), 6) as equity, exit from st""",
)
def _(spark, d):
    """Stops, a holding time and all policies at once."""
    news = int(dt.datetime(2024, 1, 3, 14, tzinfo=dt.UTC).timestamp() * 1000)
    bars = full_bars(spark, d, PolicyConfig((0, 1, 2, 3), (news,), 15, 4, 2))
    return bars.select("series_id", "ts", "position", r6("bar_ret"), r6("trade_cost"), r6("equity"), "exit")


@query(
    "bt_exits",
    f"{_BARS_R}{_POSITION}, {walk_sql(_COST * 2, 3, 0.01, 0.008, 2)} select series_id, count(*) filter (exit = 'sl') as exits_sl, count(*) filter (exit = 'tp') as exits_tp, count(*) filter (exit = 'flip') as exits_flip, count(*) filter (exit = 'flat') as exits_flat from st group by 1",
)
def _(spark, d):
    """How trades ended, stops and targets among them."""
    found = B.metrics(full_bars(spark, d), HOURS_A_YEAR, _COST, 2.0)
    return found.select("series_id", "exits_sl", "exits_tp", "exits_flip", "exits_flat")


@query("policy_mask", f"{BARS} select series_id, ts, hour(ts) in (0, 1, 22) or (ts between timestamp '2024-01-05 13:45:00' and timestamp '2024-01-05 14:15:00') as blocked from b")
def _(spark, d):
    news = int(dt.datetime(2024, 1, 5, 14, tzinfo=dt.UTC).timestamp() * 1000)
    mask = B.policy_mask(PolicyConfig((0, 1, 22), (news,), 15))
    return event_bars(spark, d).select("series_id", "ts", mask.alias("blocked"))


# --- long series in blocks ------------------------------------------------------------------------------------------

#: Rows of a block in these queries; so few, so that the driver's series have many blocks.
_BLOCK_ROWS = 64


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    return lay_out(event_bars(spark, d), _BLOCK_ROWS)


def _in_blocks(base: str, text: str) -> None:
    """The query ``base`` over laid-out bars: the SQL is the same."""

    @query(f"{base}_blocks", SQL[base])
    def run(spark, d):
        return evaluate(laid_out(spark, d), text, "value", limit=False).select("series_id", "ts", r6("value"))


for _base, _text in (
    ("zscore", "z_score(close, 30)"), ("corr", "corr(close, volume, 24)"), ("slope", "slope(close, 20)"), ("highest", "highest(high, 20)"), ("ema", "ema(close, 20)"), ("rsi", "rsi(close, 14)"),
    ("adx", "adx(14)"), ("macd", "ema(close, 12) - ema(close, 26) - ema(ema(close, 12) - ema(close, 26), 9)"), ("vwap", "vwap(96)"), ("session_vwap", "session_vwap()"), ("obv", "obv()"),
):
    _in_blocks(_base, _text)


@query("factor_funding_oi_blocks", SQL["factor_funding_oi"])
def _(spark, d):
    """All factors over blocks, the whole-series median among them."""
    df = P.build_dataset(event_bars(spark, d, by_type=False), funding(spark, d), open_interest(spark, d))
    return compute_all_factors(lay_out(df, _BLOCK_ROWS)).select("ts", *[r6(f"f_{n}") for n in SINGLE])


@query("regime_classify_blocks", SQL["regime_classify"])
def _(spark, d):
    return regimes.classify(laid_out(spark, d)).select("series_id", "ts", "regime")


def scored_blocks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(laid_out(spark, d), "zscore(close, 48) * -1")


@query("min_hold_blocks", SQL["min_hold"])
def _(spark, d):
    return signals.discretize(scored_blocks(spark, d), BacktestConfig(min_hold_bars=8)).select("series_id", "ts", "signal")


@query("bt_full_blocks", SQL["bt_full"])
def _(spark, d):
    bars = B.run(signals.discretize(scored_blocks(spark, d), _NO_HOLD), BacktestConfig(min_hold_bars=3), _RISK)
    return bars.select("series_id", "ts", "position", r6("bar_ret"), r6("trade_cost"), "exit")


@query("bt_policy_blocks", SQL["bt_policy"])
def _(spark, d):
    policy = PolicyConfig((0, 1, 2, 3), (int(dt.datetime(2024, 1, 3, 14, tzinfo=dt.UTC).timestamp() * 1000),), 15, 4, 2)
    bars = B.run(signals.discretize(scored_blocks(spark, d), _NO_HOLD), BacktestConfig(min_hold_bars=3), _RISK, policy)
    return bars.select("series_id", "ts", "position", r6("bar_ret"), r6("trade_cost"), r6("equity"), "exit")


@query("bt_metrics_blocks", SQL["bt_metrics"])
def _(spark, d):
    return _metrics_of(B.run(signals.discretize(scored_blocks(spark, d), _NO_HOLD), _NO_HOLD, _PLAIN))


# --- timeframes, leaderboard, optimiser ----------------------------------------------------------------------------

_VOLATILITY = f"t as (select *, greatest(high - low, abs(high - lag(close) over ({LINE})), abs(low - lag(close) over ({LINE}))) as tr from b), v as (select series_id, median(a / nullif(close, 0)) as volatility from (select *, {roll('avg', 'tr', 14)} as a from t) group by 1)"


@query("tf_volatility", f"{BARS}, {_VOLATILITY} select series_id, round(volatility, 6) as volatility from v")
def _(spark, d):
    return mtf.tf_volatility(event_bars(spark, d)).select("series_id", r6("volatility"))


def _pick_sql() -> str:
    parts = []
    for place, (tf, trunc) in enumerate((("1h", "date_trunc('hour', ts)"), ("4h", "time_bucket(interval '4 hours', ts)"), ("1d", "date_trunc('day', ts)"))):
        parts.append(f"select '{tf}' as timeframe, {place} as place, series_id, volatility from (with {_bars_sql(trunc)}, {_VOLATILITY} select * from v)")
    return f"select series_id, timeframe, round(volatility, 6) as volatility from (select *, row_number() over (partition by series_id order by abs(volatility - 0.015), place) as rn from ({' union all '.join(parts)}) where volatility is not null) where rn = 1"


@query("pick_tf", _pick_sql())
def _(spark, d):
    return mtf.pick_primary_tf({tf: event_bars(spark, d, tf) for tf in ("1h", "4h", "1d")}, 0.015).select("series_id", "timeframe", r6("volatility"))


def _tiers_sql() -> str:
    """Primary bars of 4 hours with factors of the last daily and the last hourly bar that had closed."""
    tier = {"4h": "time_bucket(interval '4 hours', ts)", "1d": "date_trunc('day', ts)", "1h": "date_trunc('hour', ts)"}
    part = lambda tf, value, ctes, later: f"(with {_bars_sql(tier[tf], False)}{ctes} select ts + interval '{later}' as ts, {value} as v from z)"
    parts = {"trend": ("1d", "1 day", *FACTOR_SQL["trend"]), "rsi_slow": ("1d", "1 day", *FACTOR_SQL["rsi"]), "ema_cross_slow": ("1d", "1 day", *FACTOR_SQL["ema_cross"]), "macd_slow": ("1d", "1 day", *FACTOR_SQL["macd"]), "volume": ("1h", "1 hour", *FACTOR_SQL["volume"]), "regime": ("1d", "1 day", "regime", _REGIME)}
    value, ctes = FACTOR_SQL["vwap_distance"]
    tables = ", ".join(f"t_{n} as {part(tf, v, c, later)}" for n, (tf, later, v, c) in parts.items())
    joins = " ".join(f"asof left join t_{n} on p.ts >= t_{n}.ts" for n in parts)
    shown = ", ".join(f"coalesce(t_{n}.v, 'chop') as regime" if n == "regime" else f"round(coalesce(t_{n}.v, 0), 6) as f_{n}" for n in parts)
    return f"with p as {part('4h', value, ctes, '0 hours')}, {tables} select p.ts, round(p.v, 6) as f_vwap_distance, {shown} from p {joins}"


@query("mtf_features", _tiers_sql())
def _(spark, d):
    """Factors and the regime over three timeframes."""
    own = [event_bars(spark, d, tf, False) for tf in ("4h", "1d", "1h")]
    return mtf.build_mtf_features(own[0], "4h", own[1], own[2]).select("ts", *[r6(f"f_{n}") for n in ("trend", "rsi_slow", "ema_cross_slow", "macd_slow", "volume", "vwap_distance")], "regime")


STRATEGIES = {
    "fade": {"name": "fade", "score": "zscore(close, 48) * -1"},
    "breakout": {"name": "breakout", "score": "if(close >= prev(highest(high, 20), 1), 1, if(close <= prev(lowest(low, 20), 1), -1, 0))", "long_threshold": 0.5, "short_threshold": -0.5},
}


_RANKED = f"""{ALL.replace("with ", "with recursive ", 1)}, g as (select *, {roll('max', 'high', 20)} as hh, {roll('min', 'low', 20)} as ll, {_SCORE} as score from b),
    w as (select 'fade' as series_id, ts, close, high, low, case when score <= -0.2 then -1 when score >= 0.2 then 1 else 0 end as s from g
        union all select 'breakout', ts, close, high, low, case when close >= lag(hh) over ({LINE}) then 1 when close <= lag(ll) over ({LINE}) then -1 else 0 end from g),
    z1 as (select *, row_number() over ({LINE}) as i from w),
    h as (select series_id, i, s as now, 1 as held from z1 where i = 1 union all
        select z1.series_id, z1.i, case when z1.s <> h.now and (h.now = 0 or h.held >= 8) then z1.s else h.now end, case when z1.s <> h.now and (h.now = 0 or h.held >= 8) then 1 else h.held + 1 end
        from h join z1 on z1.series_id = h.series_id and z1.i = h.i + 1),
    z as (select z1.series_id, z1.ts, z1.i, z1.close, z1.high, z1.low, h.now as s from z1 join h using (series_id, i)), {walk_sql(_COST, 8, 0.04, 0.015, 1)},
    n as (select *, greatest(bar_ret - cost, -1.0) as net, was <> 0 and (coalesce(lag(was) over ({LINE}), 0) = 0 or lag(exit) over ({LINE}) <> '') as first from st)
    select 'all' as series_id, series_id as strategy, count(*) as bars, count(*) filter (first) as trades, round(product(1 + net) - 1, 6) as total_return, round(avg(net) * 8760 / (stddev_samp(net) * sqrt(8760)), 6) as sharpe from n group by series_id"""


@query("leaderboard", _RANKED)
def _(spark, d):
    """Strategies ranked on the same bars, with default stops and holding times."""
    found = {k: parse_signal(v) for k, v in STRATEGIES.items()}
    out = L.leaderboard(event_bars(spark, d, by_type=False), found, HOURS_A_YEAR)
    return out.select("series_id", "strategy", "bars", "trades", r6("total_return"), r6("sharpe"))


_BOARD = f"""{ALL}, z0 as (select *, {_z('close', 48)} * -1 as raw from b), z as (select *, case when raw <= -t then -1 when raw >= t then 1 else 0 end as s from z0, (values (0.2), (0.5)) v(t)),
    p as (select *, coalesce(lag(s) over (partition by t order by ts), 0) as side, lag(close) over (partition by t order by ts) as pc from z),
    q as (select *, coalesce((close - pc) / pc, 0) * side - {_COST!r} * (cast(s <> side and side <> 0 as int) + cast(s <> side and s <> 0 as int)) as net from p)
    select case t when 0.2 then 'wide' else 'narrow' end as strategy, round(avg(net) * 8760 / (stddev_samp(net) * sqrt(8760)), 6) as sharpe, rank() over (order by avg(net) / stddev_samp(net) desc) as place from q group by t"""


@query("leaderboard_fast", _BOARD)
def _(spark, d):
    from pyspark.sql import Window

    found = {n: parse_signal({"score": "zscore(close, 48) * -1", "long_threshold": t, "short_threshold": -t}) for n, t in (("wide", 0.2), ("narrow", 0.5))}
    out = L.leaderboard(event_bars(spark, d, by_type=False), found, HOURS_A_YEAR, BacktestConfig(min_hold_bars=0), RiskConfig(1.0, None, None))
    place = F.rank().over(Window.orderBy(F.desc_nulls_last("sharpe")))  # a row for each strategy
    return out.select("strategy", r6("sharpe"), place.cast("long").alias("place"))


def featured(spark: SparkSession, d: str) -> DataFrame:
    df = P.build_dataset(event_bars(spark, d, by_type=False), funding(spark, d), open_interest(spark, d))
    return regimes.features(df)


_KNOBS = tuple(KNOB_BOUNDS)


def _knobs_sql(draws: dict[int, list[dict[str, float]]]) -> str:
    """A common table k of all draws by fold and trial."""
    rows = [f"({fold}, {i}, {', '.join(f'{t[n]!r}::double' for n in _KNOBS)})" for fold, trials in draws.items() for i, t in enumerate(trials)]
    return f"k(fold, trial, {', '.join(_KNOBS)}) as (values {', '.join(rows)})"


def _tried_sql(source: str, name: str) -> str:
    """Common tables that end in ``name``: number of trades, return and Sharpe ratio of each fold and trial in ``source``."""
    score = "case regime"
    for regime, p in (("trend_up", "up"), ("trend_down", "dn"), ("chop", "cp")):
        score += f" when '{regime}' then coalesce(f_rsi, 0) * {p}_rsi + coalesce(f_funding, 0) * {p}_funding + (coalesce(f_ema_cross, 0) + coalesce(f_macd, 0) + coalesce(f_trend, 0)) * {p}_trend / 3 + (coalesce(f_volume, 0) + coalesce(f_oi, 0)) * {p}_flow / 2"
    w = "partition by fold, trial order by ts"
    return f"""{name}_s as (select *, least(greatest({score} else 0 end, -1), 1) as score from {source}),
    {name}_z as (select *, case when score <= short_thr then -1 when score >= long_thr then 1 else 0 end as s from {name}_s),
    {name}_p as (select *, coalesce(lag(s) over ({w}), 0) as side, lag(close) over ({w}) as pc from {name}_z),
    {name}_q as (select *, greatest(coalesce((close - pc) / pc, 0) * side - {_COST!r} * (cast(s <> side and side <> 0 as int) + cast(s <> side and s <> 0 as int)) - side * coalesce(funding_rate, 0) / 8, -1.0) as net, coalesce(lag(side) over ({w}), 0) as was from {name}_p),
    {name} as (select fold, trial, count(*) filter (side <> 0 and side <> was) as trades, product(1 + net) - 1 as total_return, case when stddev_samp(net) > 0 then avg(net) * 8760 / (stddev_samp(net) * sqrt(8760)) end as sharpe from {name}_q group by 1, 2)"""


_VIABLE = "case when trades >= 5 then sharpe * sqrt(least(trades, 30) / 30.0) end"
_FEATURES = _side_by_side(("rsi", "ema_cross", "macd", "trend", "volume", "oi", "funding"), {"regime": ("regime", _REGIME)})


@query(
    "random_search",
    f"with {_FEATURES}, {_knobs_sql({0: optimize.sample_knobs(300, 7)})}, x as (select feat.*, k.* from feat, k), {_tried_sql('x', 'm')} select 'all' as series_id, trial, trades, round(total_return, 6) as total_return, round({_VIABLE}, 6) as score from m",
)
def _(spark, d):
    """Three hundred trials over all bars; the SQL has the same draws as rows."""
    out = optimize.random_search(featured(spark, d), BacktestConfig(min_hold_bars=0), RiskConfig(1.0, None, None), HOURS_A_YEAR, 300, 7)
    return out.select("series_id", "trial", "trades", r6("total_return"), r6("score"))


@query(
    "walk_forward",
    f"""with {_FEATURES}, {_knobs_sql({i: optimize.sample_knobs(12, 3 + i) for i in range(12)})}, y as (select feat.*, k.*, i < fold * 120 + 240 as fit from feat join k on i >= fold * 120 and i < fold * 120 + 360 where fold * 120 + 360 <= (select count(*) from feat)),
    x as (select * from y where fit), {_tried_sql('x', 'm')}, best as (select fold, trial, score as train_score from (select *, {_VIABLE} as score, row_number() over (partition by fold order by {_VIABLE} desc nulls last, trial) as rn from m) where rn = 1 and score is not null),
    v as (select y.* from y join best using (fold, trial) where not fit), {_tried_sql('v', 'n')}, spans as (select fold, min(ts) filter (fit) as train_start, max(ts) filter (not fit) as test_end from y group by 1)
    select 'all' as series_id, fold, trial, round(train_score, 6) as train_score, round(n.total_return, 6) as total_return, train_start, test_end from best join n using (fold, trial) join spans using (fold)""",
)
def _(spark, d):
    """Twelve trials a fold; the SQL has the draws of the first twelve folds as rows."""
    folds, _ = optimize.walk_forward(featured(spark, d), 240, 120, 120, BacktestConfig(min_hold_bars=0), RiskConfig(1.0, None, None), HOURS_A_YEAR, 12, 3)
    return folds.select("series_id", "fold", "trial", r6("train_score"), r6("total_return"), "train_start", "test_end")


_OOS = f"""{ALL}, n as (select *, row_number() over (order by ts) - 1 as i from b), f as (select f.fold, n.ts, n.close, n.i from n join (values (0), (1), (2)) f(fold) on n.i >= f.fold * 100 and n.i < f.fold * 100 + 150),
    q as (select *, close / first_value(close) over (partition by fold order by ts) as equity from f),
    r as (select *, equity / coalesce(lag(equity) over (partition by fold order by ts), 1) - 1 as r, row_number() over (partition by ts order by fold) as rn from q),
    k as (select ts, r, product(1 + r) over (order by ts rows unbounded preceding) as equity from r where rn = 1),
    dd as (select *, equity / max(equity) over (order by ts rows unbounded preceding) - 1 as dd from k)
    select count(*) as bars, cast(3 as bigint) as folds, round(max_by(equity, ts) - 1, 6) as total_return, round(avg(r) * 8760 / (stddev_samp(r) * sqrt(8760)), 6) as sharpe, round(min(dd), 6) as max_drawdown from dd"""


@query("oos_aggregate", _OOS)
def _(spark, d):
    from pyspark.sql import Window

    b = event_bars(spark, d, by_type=False).withColumn("i", F.row_number().over(W.line()) - 1).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    b = b.where("i >= fold * 100 and i < fold * 100 + 150")
    w = Window.partitionBy("series_id", "fold").orderBy("ts")
    tests = b.withColumn("equity", F.col("close") / F.first("close").over(w))
    return optimize.aggregate_oos(tests, HOURS_A_YEAR).select("bars", "folds", r6("total_return"), r6("sharpe"), r6("max_drawdown"))


@query("trials_topk", "select user_id, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn = 1")
def _(spark, d):
    """The first best of each group, as the search picks its trial."""
    e = table(spark, d, "events").select(F.col("user_id"), F.col("event_id").alias("trial"), F.col("value").alias("score"), F.lit(None).cast("string").alias("knobs"))
    return optimize.best_trials(e, ["user_id"]).select("user_id", F.col("trial").alias("event_id"), r6("score", "value"))


@query("union_returns", "select 'long' as side, count(*) as n, round(sum(value), 4) as total from events where value > 100 union all select 'short', count(*), round(sum(-value), 4) from events where value <= 100")
def _(spark, d):
    e = table(spark, d, "events")
    part = lambda side, rows, sign: rows.agg(F.count("*").alias("n"), F.round(F.sum(sign * F.col("value")), 4).alias("total")).select(F.lit(side).alias("side"), "n", "total")
    return part("long", e.where("value > 100"), 1).unionByName(part("short", e.where("value <= 100"), -1))


@query("symbol_routing", "select p_name, case when contains(s, ':') then s else regexp_replace(s, '(?i)USDT$', '') end as coin, contains(s, ':') as builder from (select p_name, case when p_partkey % 3 = 0 then 'xyz:' || p_brand when p_partkey % 3 = 1 then p_brand || 'USDT' else p_brand || 'usdt' end as s from part)")
def _(spark, d):
    from barwright.sources.files import is_builder_market, venue_coin

    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("xyz:"), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit("USDT"))).otherwise(F.concat("p_brand", F.lit("usdt")))
    return table(spark, d, "part").select("p_name", venue_coin(s).alias("coin"), is_builder_market(s).alias("builder"))


_PERCENT, _NUMBER = ("total_return", "max_drawdown", "win_rate", "avg_trade_return", "exposure", "total_cost"), ("sharpe", "turnover")
_SHOWN = [f"coalesce(printf('%7.2f%%', cast({c} * 100 as double)), '  n/a') as {c}" for c in _PERCENT] + [f"coalesce(printf('%7.2f', cast({c} as double)), '    n/a') as {c}" for c in _NUMBER]


@query("overall_table", f"{METRICS} select series_id, bars, trades, exits_flip, exits_flat, exits_sl, exits_tp, {', '.join(_SHOWN)} from metrics")
def _(spark, d):
    """Metrics as text; without the growth a year, which is absurd on toy bars."""
    return L.overall_table(B.metrics(fast_bars(spark, d), HOURS_A_YEAR, _COST, 2.0).drop("cagr"))


@query("missing_spans", """with e as (select event_type as s, epoch_us(ts) // 1000 as a, epoch_us(ts) // 1000 + 180000 as b from events),
    p as (select s, a, max(b) over (partition by s order by a, b rows between unbounded preceding and 1 preceding) as was from e),
    ends as (select s, min(a) // 86400000 * 86400000 as lo, max(b) as b, (max(a) // 86400000 + 1) * 86400000 as hi from e group by s)
    select p.s as series_id, coalesce(was, lo) as "start", a as "end" from p join ends on p.s = ends.s where a > coalesce(was, lo)
    union all select s, b, hi from ends where b < hi""")
def _(spark, d):
    """What a store of three minutes from every event on would lack of all days."""
    from barwright.sources.store import millis, missing

    e = table(spark, d, "events")
    e = e.select(F.col("event_type").alias("series_id"), millis(e, "ts").alias("start"))
    day = F.floor(F.col("start") / 86_400_000)
    wanted = e.groupBy("series_id").agg((F.min(day) * 86_400_000).alias("start"), ((F.max(day) + 1) * 86_400_000).alias("end"))
    return missing(wanted, e.withColumn("end", F.col("start") + 180_000))


@query("store_read_through", f"""{BARS}, t as (select (epoch_us(min(ts)) // 1000 + epoch_us(max(ts)) // 1000) // 2 as half, epoch_us(max(ts)) // 1000 + 3600000 as last from events)
    select series_id, ts, round(close, 6) as close, round(volume, 6) as volume, case when epoch_us(ts) // 1000 + 3600000 <= half then half else last end as fetched from b, t""")
def _(spark, d):
    """Hourly bars through a store that has been read at half time: the second read gets the rest, and the bar open then."""
    from barwright.plans.shared import new_path
    from barwright.sources.store import millis, read_through

    e, bars = table(spark, d, "events"), event_bars(spark, d)
    ends = e.select(F.min(millis(e, "ts")), F.max(millis(e, "ts"))).first()
    wanted = e.select(F.col("event_type").alias("series_id")).distinct().withColumns({"start": F.lit(ends[0] - 3_600_000), "end": F.lit(ends[1] + 1)})
    schema = ", ".join(f"{n} {t}" for n, t in bars.dtypes)

    def fetch(gaps):
        at = millis(bars, "ts")
        return bars.join(gaps.withColumnRenamed("series_id", "s"), (F.col("series_id") == F.col("s")) & (at >= F.col("start")) & (at < F.col("end")), "leftsemi")

    path = new_path(spark, "store")
    for now in ((ends[0] + ends[1]) // 2, ends[1] + 3_600_000):
        got = read_through(spark, path, "klines", "1h", schema, wanted, fetch, now)
    return got.select("series_id", "ts", r6("close"), r6("volume"), "fetched")


_MEDIANS = f"{BARS} select series_id, ts, case when count(*) over w = 200 then round(median(close) over w, 6) end as mid, case when count(*) over v = 21 then round(median(volume) over v, 6) end as usual from b window w as (partition by series_id order by ts rows 199 preceding), v as (partition by series_id order by ts rows 20 preceding)"


def _medians(spark, d, rows=None):
    from barwright.functions.sequential import rolling_medians

    bars = event_bars(spark, d)
    got = rolling_medians(lay_out(bars, rows) if rows else bars, {"mid": ("close", 200), "usual": ("volume", 21)})
    return got.select("series_id", "ts", r6("mid"), r6("usual"))


@query("rolling_median", _MEDIANS)
def _(spark, d):
    """Medians of long frames, an insertion and a removal a bar."""
    return _medians(spark, d)


@query("rolling_median_blocks", _MEDIANS)
def _(spark, d):
    """The same inside blocks of fewer rows than the frame."""
    return _medians(spark, d, 64)


# --- streams ------------------------------------------------------------------------------------------------------

_GAP = f"""{BARS}, g as (select *, case when ts - lag(ts) over ({LINE}) <= interval '1 hour' then 0 else 1 end as fresh from b),
    n as (select *, sum(fresh) over ({LINE} rows unbounded preceding) as n from g), s as (select *, min(ts) over (partition by series_id, n) as session from n)"""


@query("sessions", f"{_GAP} select series_id, session, count(*) as bars, max(ts) as \"end\", round(sum(volume), 6) as volume from s group by 1, 2")
def _(spark, d):
    """Stretches of bars without a missing hour."""
    by = P.with_sessions(event_bars(spark, d), "1 hour").groupBy("series_id", "session")
    return by.agg(F.count("*").alias("bars"), F.max("ts").alias("end"), r6(F.sum("volume"), "volume"))


@query("stream_closed_bars", f"{BARS} select series_id, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume from b where ts + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)")
def _(spark, d):
    """Events as a stream: the bars that have closed when the watermark gets to the last event less ten minutes."""
    from barwright.streaming.closed_bars import stream_bars
    from barwright.streaming.processors import written

    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    bars = written(stream_bars(events, "1h", 100 + F.col("value") / 100, F.col("value"), F.col("event_type")), "closed")
    return bars.select("series_id", F.col("ts").cast(schema["ts"].dataType), *[r6(c) for c in P.BAR_COLUMNS])


@query("stream_sessions", f"""{_GAP}, k as (select series_id as series, session, series_id || n as series_id, ts, close from s), {ewm_sql('k', 'close', 0.2, 'z')}
    select k.series as series_id, k.ts, k.session, round(z.y, 6) as mean from k join z using (series_id, ts) where k.ts <= (select max(ts) - interval '2 hours' from b)""")
def _(spark, d):
    """Exponential means by session of a stream of bars that is stopped at half time and goes on from its checkpoint."""
    from barwright.plans.shared import new_path, stage
    from barwright.streaming.closed_bars import stream_ewm
    from barwright.streaming.processors import start_query

    bars = event_bars(spark, d)
    kind = bars.schema["ts"].dataType
    bars = stage(bars.select("series_id", F.col("ts").cast("timestamp"), "close"), "bars")
    half = bars.select(F.timestamp_millis(F.floor((F.unix_millis(F.min("ts")) + F.unix_millis(F.max("ts"))) / 2)).alias("half"))
    source, path, checkpoint = (new_path(spark, f"sessions-{x}") for x in ("in", "out", "checkpoint"))
    for early in (True, False):
        part = bars.join(F.broadcast(half), (F.col("ts") < F.col("half")) == F.lit(early)).select(*bars.columns)  # (half is one row)
        part.write.mode("append").parquet(source)
        means = stream_ewm(spark.readStream.schema(bars.schema).parquet(source), "close", 0.2, "mean", "2 hours", "1 hour")
        start_query(means, path, checkpoint).awaitTermination()
    return spark.read.schema(means.schema).parquet(path).select("series_id", *[F.col(c).cast(kind) for c in ("ts", "session")], r6("mean"))


FLAGSHIP = "bt_metrics"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "Costs"]
