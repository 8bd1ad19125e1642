"""Rolling values over long frames in a time that does not depend on the frame.

Rows are cut into runs as long as the frame. A frame then is the end of one run and the beginning of the next, so that its value
is put together from two running aggregates, one from each run's beginning and one from its end, and nothing is
subtracted that was added before: moments are joined by means and squares, without the cancellation of running sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import windows as W

#: Frames from which this pays; shorter ones are evaluated frame by frame.
LONG = 64
_NAMES = {"max": ("top",), "min": ("low",), "moments": ("n", "mx", "sx"), "pairs": ("n", "mx", "sx", "my", "sy", "c")}


def _aggregates(kind: str, x: Column, y: Column | None) -> dict[str, Callable]:
    """Aggregates over a window: sums of squares and products are about the means."""
    if kind in ("max", "min"):
        return {_NAMES[kind][0]: lambda w: (F.max if kind == "max" else F.min)(x).over(w), "n": lambda w: F.count(x).over(w)}
    if kind == "moments":
        return {"n": lambda w: F.count(x).over(w), "mx": lambda w: F.avg(x).over(w), "sx": lambda w: F.var_pop(x).over(w) * F.count(x).over(w)}
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = lambda w: F.count(a).over(w)
    return {
        "n": n, "mx": lambda w: F.avg(a).over(w), "sx": lambda w: F.var_pop(a).over(w) * n(w), "my": lambda w: F.avg(b).over(w), "sy": lambda w: F.var_pop(b).over(w) * n(w), "c": lambda w: F.covar_pop(a, b).over(w) * n(w)
    }


def _joined(kind: str, a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
    """The aggregates of two sets of rows from those of each; an empty set has NULL means."""
    n = a("n") + b("n")
    if kind in ("max", "min"):
        name = _NAMES[kind][0]
        return {name: (F.greatest if kind == "max" else F.least)(a(name), b(name)), "n": n}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = a("n") * b("n") / F.nullif(n.cast("double"), F.lit(0.0))
    off = lambda m: zero(b(m) - a(m))
    mean = lambda m: F.coalesce(a(m) + off(m) * b("n") / F.nullif(n.cast("double"), F.lit(0.0)), a(m), b(m))
    out = {"n": n, "mx": mean("mx"), "sx": zero(a("sx")) + zero(b("sx")) + zero(off("mx") ** 2 * share)}
    if kind == "pairs":
        out |= {"my": mean("my"), "sy": zero(a("sy")) + zero(b("sy")) + zero(off("my") ** 2 * share), "c": zero(a("c")) + zero(b("c")) + zero(off("mx") * off("my") * share)}
    return out


def with_frames(df: DataFrame, kind: str, n: int, index: Column, out: str, x: Column, y: Column | None = None) -> DataFrame:
    """``df`` with a struct ``out`` of what the last ``n`` rows hold: of ``kind`` max, min, moments (n, mx, sx) or pairs (and my, sy, c).

    ``index`` numbers the rows of a series from 0. ``n`` counts values that are not NULL: in pairs, rows where both have one.
    """
    keys = W.keys()
    run = f"{out}_run"
    df = df.withColumn(run, F.floor(index / n))
    parts = _aggregates(kind, x, y)
    ahead = Window.partitionBy(*keys, run).orderBy(W.TIME).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, run).orderBy(F.col(W.TIME).desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"{out}_b_{k}": f(back) for k, f in parts.items()})
    df = df.withColumns({f"{out}_a_{k}": f(ahead) for k, f in parts.items()})
    W.note(n - 1)
    df = df.withColumn(f"{out}_b", F.lag(F.struct(*[F.col(f"{out}_b_{k}").alias(k) for k in parts]), n - 1).over(W.line()))
    whole = (index + 1) % n == 0  # (the frame is a run)
    own = _joined(kind, lambda k: F.col(f"{out}_b.{k}"), lambda k: F.col(f"{out}_a_{k}"))
    df = df.withColumn(out, F.struct(*[F.when(whole, F.col(f"{out}_a_{k}")).otherwise(own[k]).alias(k) for k in parts]))
    return df.drop(run, f"{out}_b", *[f"{out}_{side}_{k}" for side in "ab" for k in parts])


def full(frame: Column, n: int, value: Column) -> Column:
    """NULL unless the frame holds ``n`` values."""
    return F.when(frame["n"] == n, value)


def deviation(frame: Column, which: str = "sx") -> Column:
    return F.sqrt(frame[which] / F.nullif((frame["n"] - 1).cast("double"), F.lit(0.0)))
