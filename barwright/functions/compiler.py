"""From an indicator expression to DataFrame columns.

Each window or smoothing node becomes a temporary column of its own, once for equal nodes; plain arithmetic stays a
Column expression. All windows share one partitioning and order, so Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import long_windows as L
from barwright.functions import windows as W
from barwright.functions.expressions import MOST_DEPTH, EvalError, Name, Node, Number, parse
from barwright.functions.sequential import ewm, span, wilder
from barwright.plans import blocks

#: Factors (columns ``f_...``) that expressions may name.
FACTOR_NAMES = ("ema_cross", "macd", "trend", "rsi_slow", "ema_cross_slow", "macd_slow", "slope_regression", "adx_strength", "rsi_delta", "volume_zscore", "atr_stability", "vwap_distance")
ACCESSORS = ("close", "high", "low", "open", "volume", "funding", "oi", "open_interest", "bar_index", "hour_utc", "minute_utc", "dayofweek_utc", *FACTOR_NAMES)
#: Other names of functions.
ALIASES = {
    "correlation": "corr", "standard_deviation": "stdev", "std": "stdev", "z_score": "zscore", "exponential_moving_average": "ema",
    "simple_moving_average": "sma", "moving_average": "sma", "average_true_range": "atr", "bollinger_width": "bb_width",
    "bollinger_band_width": "bb_width", "bollinger_lower": "bb_lower", "bbl": "bb_lower", "lower_band": "bb_lower",
    "bollinger_upper": "bb_upper", "bbu": "bb_upper", "upper_band": "bb_upper", "bollinger_middle": "bb_mid", "bollinger_mid": "bb_mid",
    "bb_middle": "bb_mid", "bb_basis": "bb_mid", "bbm": "bb_mid", "anchored_vwap": "session_vwap",
    "session_volume_weighted_average_price": "session_vwap", "svwap": "session_vwap", "rolling_max": "highest", "max_over": "highest",
    "highest_high": "highest", "ta_highest": "highest", "rolling_min": "lowest", "min_over": "lowest", "lowest_low": "lowest",
    "ta_lowest": "lowest", "relative_strength_index": "rsi", "linear_regression_slope": "slope", "linreg_slope": "slope",
    "previous": "prev", "lag": "prev", "abs_value": "abs", "absolute": "abs", "logarithm": "log", "natural_log": "log", "ln": "log",
    "square_root": "sqrt", "maximum": "max", "minimum": "min", "where": "if",
}


@dataclass(frozen=True)
class Scalar:
    value: float | bool


@dataclass(frozen=True)
class Series:
    column: Column
    boolean: bool = False


Value = Scalar | Series


class Context:
    """The frame that an expression is compiled onto, which grows temporary columns."""

    def __init__(self, df: DataFrame, funding_alias: bool = False, reach: int | None = None):
        self.df, self.names, self.memo = df, list(df.columns), {}
        #: For a laid-out frame: the rows before a block that its windows need; None if only that is to be found out.
        self.blocks, self.reach = blocks.is_laid_out(df), reach
        if self.blocks and reach is not None:
            self.df = blocks.halo(df, reach)
        self.timed = W.TIME in df.columns and dict(df.dtypes)[W.TIME].startswith(("timestamp", "date"))
        self.funding_alias = funding_alias
        self.count = 0

    def keep(self, column: Column, key: object = None) -> Column:
        """Give a window expression a column of its own."""
        if key is not None and key in self.memo:
            return self.memo[key]
        name = self.fresh()
        self.df = self.df.withColumn(name, column)
        if key is not None:
            self.memo[key] = F.col(name)
        return F.col(name)

    def fresh(self) -> str:
        self.count += 1
        name = f"__bw_{self.count}"
        return name if name not in self.df.columns else self.fresh()

    def has(self, name: str) -> bool:
        return name in self.names

    def _endless(self, key: object, x: Column, column: Callable[[Column], Column], step: Callable[[DataFrame, str, str], DataFrame]) -> Column:
        """What looks back without an end: ``column`` over whole series, or ``step`` over the own rows of blocks."""
        if key in self.memo:
            return self.memo[key]
        if not self.blocks:
            return self.keep(column(x), key)
        name, source = self.fresh(), self.fresh()
        df = self.df.withColumn(source, x.cast("double"))
        if self.reach is None:
            self.df = df.withColumn(name, F.lit(None).cast("double"))
        else:
            self.df = blocks.halo(step(blocks.own(df), source, name).drop(source), self.reach)
        self.memo[key] = F.col(name)
        return self.memo[key]

    def smooth(self, x: Column, alpha: float, key: object) -> Column:
        """An exponential mean; equal ones are computed once."""
        if key in self.memo or self.blocks:
            return self._endless(key, x, lambda x: x, lambda df, source, name: ewm(df, {name: (source, alpha)}))
        name, source = self.fresh(), self.fresh()
        self.df = ewm(self.df.withColumn(source, x.cast("double")), {name: (source, alpha)}).drop(source)
        self.memo[key] = F.col(name)
        return self.memo[key]

    def filled(self, x: Column, key: object) -> Column:
        """The last value that is not missing."""
        return self._endless(key, x, W.forward_fill, lambda df, source, name: blocks.last_known(df, source).withColumnRenamed("__bw_value", name))

    def total(self, x: Column, key: object, daily: bool = False) -> Column:
        """The sum so far, of a bar's day or of all."""
        by = F.to_date(W.TIME) if daily else None
        return self._endless(key, x, lambda x: F.sum(x).over(W.today() if daily else W.so_far()), lambda df, source, name: blocks.running_sum(df, source, by).withColumnRenamed("__bw_value", name))

    def frame(self, kind: str, n: int, key: object, x: Column, y: Column | None = None) -> Column:
        """What the last n rows hold, for long frames (``functions.long_windows``); equal frames of one series are computed once."""
        if key not in self.memo:
            name, index = self.fresh(), self.index()
            self.df = L.with_frames(self.df, kind, n, index, name, x, y)
            self.memo[key] = F.col(name)
        return self.memo[key]

    def index(self) -> Column:
        return F.col(blocks.PLACE).cast("double") if self.blocks else self.keep(W.bar_index(), "bar_index")


def numeric(v: Value) -> Column:
    if isinstance(v, Scalar):
        return F.lit(float(v.value))
    return v.column.cast("double") if v.boolean else v.column


def truth(v: Value) -> Column:
    """Not 0; a missing number counts as true."""
    if isinstance(v, Scalar):
        return F.lit(bool(v.value))
    return v.column if v.boolean else F.coalesce(v.column != 0, F.lit(True))


def period(v: Value, name: str, lo: int = 1, hi: int = 1000) -> int:
    if not isinstance(v, Scalar):
        raise EvalError(f"{name}: the period must be a constant.")
    n = int(v.value)
    if not lo <= n <= hi:
        raise EvalError(f"{name}: the period must be within {lo}..{hi}, not {n}.")
    return n


def _scalar(args: list[Value], i: int, default: float) -> float:
    return float(args[i].value) if len(args) > i and isinstance(args[i], Scalar) else default


Builtin = Callable[[Context, list[Value], object], Value]
BUILTINS: dict[str, tuple[Builtin, int, int, str]] = {}


def register(name: str, fewest: int, most: int, usage: str) -> Callable[[Builtin], Builtin]:
    """Add a function to the language: ``fn(context, args, key)``, key equal for equal calls."""

    def add(fn: Builtin) -> Builtin:
        BUILTINS[name] = (fn, fewest, most, usage)
        return fn

    return add


def _window(name: str, make: Callable[..., Column], usage: str, kind: str, long: Callable[[Column, Column, int], Column], hi: int = 1000) -> None:
    """A rolling function of (series, n): ``make`` frame by frame, ``long`` from what a long frame holds."""

    @register(name, 2, 2, usage)
    def run(ctx, args, key):
        x, n = ctx.keep(numeric(args[0]), ("in", args_of(key))), period(args[1], name, 1, hi)
        if n >= L.LONG:
            return Series(long(ctx.frame(kind, n, (kind, n, args_of(key)), x), x, n))
        return Series(ctx.keep(make(x, n), key))


def args_of(key: object) -> object:
    """What tells the first argument of equal calls: functions of one series share its column and frames."""
    return key[1][0] if isinstance(key, tuple) and isinstance(key[1], tuple) else key


def _mean(f: Column, x: Column, n: int) -> Column:
    return L.full(f, n, f["mx"])


def _deviation(f: Column, x: Column, n: int) -> Column:
    return L.full(f, n, L.deviation(f))


_window("sma", W.sma, "sma(series, period)", "moments", _mean)
_window("stdev", W.stdev, "stdev(series, window)", "moments", _deviation)
_window("zscore", W.zscore, "zscore(series, window)", "moments", lambda f, x, n: F.coalesce(W.ratio(x - _mean(f, x, n), _deviation(f, x, n)), F.lit(0.0)))
_window("highest", W.highest, "highest(series, lookback)", "max", lambda f, x, n: L.full(f, n, f["top"]), 500)
_window("lowest", W.lowest, "lowest(series, lookback)", "min", lambda f, x, n: L.full(f, n, f["low"]), 500)


@register("ema", 2, 2, "ema(series, period)")
def _ema(ctx, args, key):
    n = period(args[1], "ema")
    return Series(ctx.smooth(numeric(args[0]), span(n), key))


@register("rsi", 1, 2, "rsi(series, period=14)")
def _rsi(ctx, args, key):
    n = period(args[1], "rsi") if len(args) == 2 else 14
    x = ctx.keep(numeric(args[0]), ("in", key))
    change = ctx.keep(x - W.previous(x), ("change", key))
    # (a missing change stays missing in both)
    up = ctx.smooth(F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), wilder(n), ("up", key))
    down = ctx.smooth(F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), wilder(n), ("down", key))
    return Series(rsi_value(up, down))


def rsi_value(up: Column, down: Column) -> Column:
    """50 where the mean loss is 0 or missing."""
    return F.coalesce(100.0 - 100.0 / (1.0 + W.ratio(up, down)), F.lit(50.0))


@register("atr", 0, 1, "atr(period=14)")
def _atr(ctx, args, key):
    n = period(args[0], "atr") if args else 14
    return Series(ctx.smooth(ctx.keep(W.true_range(), "true range"), wilder(n), ("atr", n)))


@register("adx", 0, 1, "adx(period=14)")
def _adx(ctx, args, key):
    n = period(args[0], "adx") if args else 14
    atr = _atr(ctx, [Scalar(n)], None).column
    plus = ctx.smooth(ctx.keep(W.directional(True), "up move"), wilder(n), ("+dm", n))
    minus = ctx.smooth(ctx.keep(W.directional(False), "down move"), wilder(n), ("-dm", n))
    dx = dx_value(atr, plus, minus)
    return Series(F.coalesce(ctx.smooth(dx, wilder(n), ("adx", n)), F.lit(0.0)))


def dx_value(atr: Column, plus: Column, minus: Column) -> Column:
    p, m = 100.0 * W.ratio(plus, atr), 100.0 * W.ratio(minus, atr)
    return 100.0 * W.ratio(F.abs(p - m), p + m)


@register("slope", 1, 2, "slope(series, lookback=20)")
def _slope(ctx, args, key):
    n = period(args[1], "slope") if len(args) == 2 else 20
    x = ctx.keep(numeric(args[0]), ("in", key))
    index = ctx.index()
    if n >= L.LONG:
        f = ctx.frame("pairs", n, ("slope", n, key), x, index)
        return Series(W.ratio(F.coalesce(L.full(f, n, W.ratio(f["c"], f["sy"])), F.lit(0.0)), x))
    return Series(W.ratio(ctx.keep(W.raw_slope(x, index, n), key), x))


@register("corr", 3, 3, "corr(s1, s2, window)")
def _corr(ctx, args, key):
    a, b = ctx.keep(numeric(args[0]), ("a", key)), ctx.keep(numeric(args[1]), ("b", key))
    n = period(args[2], "corr")
    if n >= L.LONG:
        f = ctx.frame("pairs", n, ("corr", n, key), a, b)
        return Series(L.full(f, n, f["c"] / F.nullif(F.sqrt(f["sx"]) * F.sqrt(f["sy"]), F.lit(0.0))))
    return Series(ctx.keep(W.corr(a, b, n), key))


@register("vwap", 0, 1, "vwap(period=96)")
def _vwap(ctx, args, key):
    core = ctx.keep(W.vwap_core(period(args[0], "vwap") if args else 96), ("core", key))
    return Series(F.coalesce(ctx.filled(core, key), F.col("close")))


@register("session_vwap", 0, 0, "session_vwap()")
def _session_vwap(ctx, args, key):
    if not ctx.timed:
        return _vwap(ctx, [], ("vwap", key))
    # since 00:00 UTC of the bar's day, on timestamps in the session's zone; the session runs in UTC
    paid, traded = ctx.total(W.typical() * F.col("volume"), ("paid", key), True), ctx.total(F.col("volume"), ("traded", key), True)
    return Series(F.coalesce(ctx.filled(ctx.keep(W.ratio(paid, traded), ("core", key)), key), F.col("close")))


def _band(name: str, pick: Callable[[Column, int, float], Column], long: Callable[[Column, Column, Column, float], Column]) -> None:
    """A band: ``pick`` frame by frame, ``long`` from the mean and deviation of a long frame."""

    @register(name, 1, 3, f"{name}(series, period=20, num_std=2)")
    def run(ctx, args, key):
        x = ctx.keep(numeric(args[0]), ("in", args_of(key)))
        n, k = period(args[1], name) if len(args) > 1 else 20, _scalar(args, 2, 2.0)
        if n >= L.LONG:
            f = ctx.frame("moments", n, ("moments", n, args_of(key)), x)
            return Series(long(x, _mean(f, x, n), _deviation(f, x, n), k))
        return Series(ctx.keep(pick(x, n, k), key))


_band("bb_width", W.bb_width, lambda x, mid, sd, k: W.ratio(2.0 * k * sd, x))
_band("bb_lower", lambda x, n, k: W.bands(x, n, k)[0], lambda x, mid, sd, k: mid - k * sd)
_band("bb_mid", lambda x, n, k: W.bands(x, n, k)[1], lambda x, mid, sd, k: mid)
_band("bb_upper", lambda x, n, k: W.bands(x, n, k)[2], lambda x, mid, sd, k: mid + k * sd)


@register("prev", 1, 2, "prev(series, n=1)")
def _prev(ctx, args, key):
    x = ctx.keep(numeric(args[0]), ("in", key))
    return Series(ctx.keep(W.previous(x, period(args[1], "prev", 1, 500) if len(args) == 2 else 1), key))


def _plain(name: str, make: Callable[[Column], Column]) -> None:
    @register(name, 1, 1, f"{name}(x)")
    def run(ctx, args, key):
        return Series(make(numeric(args[0])))


_plain("abs", F.abs)
_plain("sign", F.signum)
_plain("log", lambda x: F.coalesce(F.ln(F.when(x > 0, x)), F.lit(0.0)))
_plain("sqrt", lambda x: F.sqrt(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))))


@register("tanh", 1, 2, "tanh(x, scale=1)")
def _tanh(ctx, args, key):
    return Series(F.tanh(numeric(args[0]) * _scalar(args, 1, 1.0)))


@register("min", 2, 6, "min(a, b, ...)")
def _min(ctx, args, key):
    return Series(F.least(*map(numeric, args)))


@register("max", 2, 6, "max(a, b, ...)")
def _max(ctx, args, key):
    return Series(F.greatest(*map(numeric, args)))


@register("clip", 3, 3, "clip(x, lo, hi)")
def _clip(ctx, args, key):
    if not all(isinstance(a, Scalar) for a in args[1:]):
        raise EvalError("clip: the bounds must be constants.")
    return Series(W.clip(numeric(args[0]), float(args[1].value), float(args[2].value)))


@register("if", 3, 3, "if(cond, true_value, false_value)")
def _if(ctx, args, key):
    return Series(F.when(truth(args[0]), numeric(args[1])).otherwise(numeric(args[2])))


def _range_place(name: str, value: Callable[[Column, Column], Column], usage: str) -> None:
    """A function of the close's distance from the lowest low (first) and of the range (second) of the last n bars."""

    @register(name, 1, 1, usage)
    def run(ctx, args, key):
        n = period(args[0], name, 1, 500)
        top, bottom = ctx.keep(W.highest(F.col("high"), n), ("highest high", n)), ctx.keep(W.lowest(F.col("low"), n), ("lowest low", n))
        return Series(value(F.col("close") - bottom, top - bottom))


_range_place("donchian_pos", W.ratio, "donchian_pos(period)")
_range_place("stoch", lambda a, r: 100.0 * W.ratio(a, r), "stoch(period)")
_range_place("williams_r", lambda a, r: 100.0 * W.ratio(a, r) - W.ratio(100.0 * r, r), "williams_r(period)")


@register("roc", 2, 2, "roc(series, period)")
def _roc(ctx, args, key):
    x = ctx.keep(numeric(args[0]), ("in", key))
    return Series(W.ratio(x, ctx.keep(W.previous(x, period(args[1], "roc", 1, 500)), key)) - 1.0)


@register("cci", 1, 1, "cci(period)")
def _cci(ctx, args, key):
    n = period(args[0], "cci", 1, 500)
    x = ctx.keep(W.typical(), "typical")
    mean = ctx.keep(W.sma(x, n), ("mean", key))
    near = ctx.keep(F.collect_list(x).over(W.frame(n)), ("near", key))
    off = F.aggregate(near, F.lit(0.0), lambda total, v: total + F.abs(v - mean)) / n
    return Series(W.ratio(x - mean, 0.015 * off))


@register("obv", 0, 0, "obv()")
def _obv(ctx, args, key):
    step = ctx.keep(F.coalesce(F.signum(F.col("close") - W.previous(F.col("close"))) * F.col("volume"), F.lit(0.0)), ("step", key))
    return Series(ctx.total(step, key))


@register("mfi", 1, 1, "mfi(period)")
def _mfi(ctx, args, key):
    n = period(args[0], "mfi", 1, 500)
    x = ctx.keep(W.typical(), "typical")
    flow = ctx.keep(F.signum(x - W.previous(x)) * x * F.col("volume"), "typical flow")
    up, down = (ctx.keep(W.rolling(F.sum, F.when(flow.isNotNull(), F.greatest(f, F.lit(0.0))), n), (side, key)) for side, f in (("up", flow), ("down", -flow)))
    return Series(rsi_value(up, down))


@register("keltner_width", 1, 2, "keltner_width(period, num_atr=2)")
def _keltner_width(ctx, args, key):
    n = period(args[0], "keltner_width")
    return Series(W.ratio(2.0 * _scalar(args, 1, 2.0) * _atr(ctx, [Scalar(n)], None).column, F.col("close")))


def list_builtins() -> list[str]:
    """The names of all functions and accessors, each group sorted."""
    return sorted(BUILTINS) + sorted(ACCESSORS)


def _access(ctx: Context, name: str) -> Value:
    if name not in ACCESSORS:
        raise EvalError(f"Unknown identifier {name!r}.")
    if name == "bar_index":
        return Series(ctx.index())
    if name in ("hour_utc", "minute_utc", "dayofweek_utc"):
        if not ctx.timed:
            return Series(F.lit(0.0))
        part = {"hour_utc": F.hour, "minute_utc": F.minute, "dayofweek_utc": F.weekday}[name]
        return Series(part(W.TIME).cast("double"))
    column = "open_interest" if name == "oi" else name
    if name in FACTOR_NAMES and ctx.has(f"f_{name}"):
        column = f"f_{name}"
    if name == "funding" and ctx.funding_alias and not ctx.has("funding"):
        column = "funding_rate"
    return Series(W.finite_or_same(F.col(column).cast("double")) if ctx.has(column) else F.lit(0.0))


_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
_FOLD = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def _arithmetic(op: str, args: list[Value]) -> Value:
    if op == "neg":
        (x,) = args
        if isinstance(x, Scalar):
            return Scalar(-x.value)
        return Series(~x.column, True) if x.boolean else Series(-x.column)
    a, b = args
    if isinstance(a, Scalar) and isinstance(b, Scalar):
        if op == "/":
            if float(b.value) == 0:
                raise EvalError("Cannot divide by a literal 0.")
            return Scalar(float(a.value) / float(b.value))
        return Scalar(_FOLD[op](float(a.value), float(b.value)))
    if op == "/":
        if isinstance(b, Scalar):
            if float(b.value) == 0:
                raise EvalError("Cannot divide by a literal 0.")
            return Series(numeric(a) / F.lit(float(b.value)))
        if isinstance(a, Series) and a.boolean and b.boolean:
            raise EvalError("Conditions cannot be divided.")
        # (a missing operand, too, makes the quotient of two series 0)
        return Series(F.coalesce(W.ratio(numeric(a), numeric(b)), F.lit(0.0)))
    if all(isinstance(x, Series) and x.boolean for x in args):
        if op == "-":
            raise EvalError("Conditions cannot be subtracted.")
        return Series(a.column | b.column if op == "+" else a.column & b.column, True)
    return Series(_FOLD[op](numeric(a), numeric(b)))


def build(ctx: Context, node: Node, depth: int = 0) -> Value:
    """Compile a node; raises EvalError for unknown names, wrong arguments and too much nesting."""
    if depth > MOST_DEPTH:
        raise EvalError("Expression is nested too deeply.")
    if isinstance(node, Number):
        return Scalar(node.value)
    if isinstance(node, Name):
        return _access(ctx, node.name)
    args = [build(ctx, a, depth + 1) for a in node.args]
    if node.kind == "arith":
        return _arithmetic(node.op, args)
    if node.kind == "compare":
        if all(isinstance(a, Scalar) for a in args):
            return Scalar(bool(_ORDER[node.op](args[0].value, args[1].value)))
        return Series(F.coalesce(_ORDER[node.op](numeric(args[0]), numeric(args[1])), F.lit(node.op == "!=")), True)
    if node.kind == "logic":
        if all(isinstance(a, Scalar) for a in args):
            said = [bool(a.value) for a in args]
            return Scalar(not said[0] if node.op == "not" else all(said) if node.op == "and" else any(said))
        out = truth(args[0])
        if node.op == "not":
            return Series(~out, True)
        for a in args[1:]:
            out = out & truth(a) if node.op == "and" else out | truth(a)
        return Series(out, True)
    name = ALIASES.get(node.op, node.op)
    if name not in BUILTINS:
        raise EvalError(f"Unknown function {node.op!r}.")
    fn, fewest, most, usage = BUILTINS[name]
    if not fewest <= len(args) <= most:
        raise EvalError(usage)
    return fn(ctx, args, (name, node.args))


def _compiled(df: DataFrame, expression: str, funding_alias: bool, out: str, finish: Callable[[Value], Column]) -> DataFrame:
    """``df`` with what ``finish`` makes of the expression; the rows of a laid-out frame in their blocks, halos dropped again."""
    node = parse(expression)
    keep = [c for c in df.columns if c != out]
    if not blocks.is_laid_out(df):
        ctx = _context(df, funding_alias)
        value = finish(build(ctx, node))
        return ctx.df.withColumn(out, value).select(*keep, out)
    with W.keyed(W.SERIES, blocks.BLOCK):
        with W.noted() as seen:
            build(_context(df, funding_alias), node)
        ctx = _context(df, funding_alias, sum(seen))
        value = finish(build(ctx, node))
        return blocks.own(ctx.df.withColumn(out, value)).select(*keep, out)


def evaluate(df: DataFrame, expression: str, out: str = "score", limit: bool = True, funding_alias: bool = False) -> DataFrame:
    """``df`` (series_id, ts, open, high, low, close, volume, ...) with the expression's value in ``out``.

    Missing and infinite values become 0; ``limit`` clips to -1..1. Columns that the frame lacks count as 0. Of a laid-out
    frame (``plans.blocks``) each block is a task's work of its own.
    """

    def finish(value: Value) -> Column:
        x = F.coalesce(W.finite(numeric(value).cast("double")), F.lit(0.0))
        return W.clip(x, -1, 1) if limit else x

    return _compiled(df, expression, funding_alias, out, finish)


def evaluate_bool(df: DataFrame, expression: str, out: str = "condition", funding_alias: bool = False) -> DataFrame:
    """``df`` with the truth of an entry condition in ``out``, never NULL."""
    return _compiled(df, expression, funding_alias, out, truth)


def _context(df: DataFrame, funding_alias: bool, reach: int | None = None) -> Context:
    missing = [c for c in ("series_id", "ts", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise EvalError(f"The frame lacks the columns {missing}.")
    return Context(df, funding_alias, reach)
