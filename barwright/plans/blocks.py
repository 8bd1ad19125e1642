"""Long series in blocks of rows, so that one series is the work of many tasks.

``lay_out`` numbers the rows of every series and cuts them into blocks. A laid-out frame has two more columns: a row's
place in its series, and its block. Windows then run over (series, block): ``halo`` gives each block the last rows of the blocks
before it, as many as the windows look back, and ``own`` drops them again. What looks back without an end (exponential
means, running sums, last known values) is done within blocks; of each block a small summary goes through a second pass over blocks,
and what that finds is joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.sequential import means
from barwright.plans.shared import stage

SERIES, TIME, PLACE, BLOCK = "series_id", "ts", "__bw_place", "__bw_block"
#: Rows of a block.
ROWS = 1 << 16
#: Stretches of series in sorted partitions up to which their table (24 bytes each) is broadcast.
MOST_STRETCHES = 1 << 16


def is_laid_out(df: DataFrame) -> bool:
    return BLOCK in df.columns and PLACE in df.columns


def rows_of(df: DataFrame) -> int:
    return df.schema[PLACE].metadata["rows"]


def lay_out(bars: DataFrame, rows: int = ROWS) -> DataFrame:
    """``bars`` (series_id, ts, ...) with places and blocks of ``rows`` rows; equal times of a series get some fixed order.

    Bars are range-partitioned by series and time and written. A place is the row's number in its partition's stretch of the
    series, plus the series' rows in partitions before: the second pass reads one row for each stretch.
    """
    if rows < 1:
        raise ValueError("a block has one row at least")
    bars = bars.drop(PLACE, BLOCK)
    sorted_ = bars.repartitionByRange(SERIES, TIME).sortWithinPartitions(SERIES, TIME).withColumn("__bw_at", F.monotonically_increasing_id())
    written = stage(sorted_, "bars").withColumn("__bw_part", F.shiftright("__bw_at", 33))
    stretches = written.groupBy(F.col(SERIES).alias("__bw_series"), F.col("__bw_part").alias("__bw_of")).agg(F.count("*").alias("n"), F.min("__bw_at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("__bw_series").orderBy("__bw_of").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stage(stretches.select("__bw_series", "__bw_of", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__bw_shift")), "stretches")
    if stretches.count() <= MOST_STRETCHES:
        stretches = F.broadcast(stretches)
    placed = written.join(stretches, F.col(SERIES).eqNullSafe(F.col("__bw_series")) & (F.col("__bw_part") == F.col("__bw_of")))
    place = F.col("__bw_at") + F.col("__bw_shift")
    return placed.select(*bars.columns, place.alias(PLACE, metadata={"rows": rows}), F.floor(place / rows).cast("long").alias(BLOCK))


def taken_up(df: DataFrame) -> DataFrame:
    """The frame without places and blocks."""
    return df.drop(PLACE, BLOCK)


def halo(df: DataFrame, reach: int, ahead: int = 0) -> DataFrame:
    """Each block with the last ``reach`` rows before it (and the first ``ahead`` after it), from however many blocks."""
    n = rows_of(df)
    if reach <= 0 and ahead <= 0:
        return df
    last = F.floor((F.col(PLACE) + max(reach, 0)) / n)
    first = F.greatest(F.floor((F.col(PLACE) - max(ahead, 0)) / n), F.lit(0))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != BLOCK], F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias(BLOCK))


def own(df: DataFrame) -> DataFrame:
    """Only the rows that belong to their block."""
    return df.where(F.floor(F.col(PLACE) / rows_of(df)) == F.col(BLOCK))


def _joined(df: DataFrame, small: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of ``small(series_id, block, ...)``, whose keys may be NULL."""
    keys = (SERIES, BLOCK, *more)
    small = small.withColumnsRenamed({k: f"__bw_j_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k).eqNullSafe(F.col(f"__bw_j_{k}")) if k != BLOCK else F.col(k) == F.col(f"__bw_j_{k}"))
    return df.join(small, on, "left").drop(*[f"__bw_j_{k}" for k in keys])


def carried(df: DataFrame, summary: Column, before: Column, local: Column, value: Column, by: Column | None = None) -> DataFrame:
    """``df`` (own rows) with ``__bw_value``: a running quantity of the whole series.

    ``summary`` is an aggregate of a block (named ``__bw_b_sum``), ``before`` an aggregate of the summaries of earlier blocks (``__bw_b_prior``),
    ``local`` the quantity within the block (``__bw_b_local``), and ``value`` combines the two. With ``by`` the quantity starts anew with each value of it.
    """
    group = F.lit(None).cast("date") if by is None else by
    df = stage(df.withColumn("__bw_b_by", group), "blocks")
    line = Window.partitionBy(SERIES, BLOCK, "__bw_b_by").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(SERIES, "__bw_b_by").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    small = df.groupBy(SERIES, BLOCK, "__bw_b_by").agg(summary.alias("__bw_b_sum"))
    small = small.select(SERIES, BLOCK, "__bw_b_by", before.over(earlier).alias("__bw_b_prior"))
    got = _joined(df.withColumn("__bw_b_local", local.over(line)), small, ("__bw_b_by",))
    return got.withColumn("__bw_value", value).drop("__bw_b_by", "__bw_b_local", "__bw_b_prior")


def last_known(df: DataFrame, column: str) -> DataFrame:
    """``__bw_value``: the last value of ``column`` that is not NULL, at or before the row."""
    return carried(
        df, F.max_by(column, F.when(F.col(column).isNotNull(), F.col(PLACE))), F.last("__bw_b_sum", ignorenulls=True), F.last(column, ignorenulls=True), F.coalesce("__bw_b_local", "__bw_b_prior")
    )


def running_sum(df: DataFrame, column: str, by: Column | None = None) -> DataFrame:
    """``__bw_value``: the sum of ``column`` up to the row; NULL before the first value."""
    both = F.when(F.col("__bw_b_local").isNull(), F.col("__bw_b_prior")).otherwise(F.col("__bw_b_local") + F.coalesce("__bw_b_prior", F.lit(0.0)))
    return carried(df, F.sum(column), F.sum("__bw_b_sum"), F.sum(column), both, by)


def running(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``__bw_value``: the ``product`` or ``max`` of ``column`` up to the row."""
    of = {"product": F.product, "max": F.max}[kind]
    both = F.greatest("__bw_b_local", "__bw_b_prior") if kind == "max" else F.coalesce("__bw_b_local", F.lit(1.0)) * F.coalesce("__bw_b_prior", F.lit(1.0))
    return carried(df, of(F.col(column)), of(F.col("__bw_b_sum")), of(F.col(column)), both)


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """The exponential means of ``sequential.ewm`` over the own rows of a laid-out frame.

    In a block a mean is an affine function of its value at the block's first input. A second pass takes the blocks of a series in
    order, a row each, and finds these values; the last step applies the functions. Its cost a series is the number of its blocks,
    with arrays of as many numbers: thousands for a billion bars.
    """
    kept = df.columns
    local = stage(means(df, specs, [SERIES, BLOCK], maps=True), "means")
    parts, folds = [F.col(BLOCK).alias("block")], []
    for i, (name, (column, alpha)) in enumerate(specs.items()):
        seen = F.when(F.col(column).isNotNull(), F.col(PLACE))
        parts += [
            F.min(seen).alias(f"f{i}"), F.max(seen).alias(f"l{i}"), F.min_by(F.col(column).cast("double"), seen).alias(f"x{i}"), F.max_by(f"v_{name}", PLACE).alias(f"v{i}"), F.max_by(f"p_{name}", PLACE).alias(f"p{i}")
        ]
        w = f"pow({1.0 - alpha!r}D, b.f{i} - s.at)"
        first = f"case when b.x{i} is null then null when s.y is null then b.x{i} else ({w} * s.y + {alpha!r}D * b.x{i}) / ({w} + {alpha!r}D) end"
        step = f"named_struct('y', if(b.x{i} is null, s.y, b.v{i} + b.p{i} * ({first})), 'at', coalesce(b.l{i}, s.at), 'out', concat(s.out, array(named_struct('before', s.y, 'first', {first}))))"
        folds.append(f"aggregate(parts, named_struct('y', cast(null as double), 'at', cast(null as bigint), 'out', cast(array() as array<struct<before:double,first:double>>)), (s, b) -> {step}, s -> s.out) as o{i}")
    small = local.groupBy(SERIES, BLOCK).agg(*[p for p in parts[1:]]).withColumnRenamed(BLOCK, "block")
    names = [c for c in small.columns if c != SERIES]
    small = small.groupBy(SERIES).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("parts"))
    small = small.selectExpr(SERIES, "transform(parts, p -> p.block) as blocks", *folds)
    small = small.selectExpr(SERIES, f"explode(arrays_zip(blocks, {', '.join(f'o{i}' for i in range(len(specs)))})) as z")
    found = [F.col(f"z.o{i}.{part}").alias(f"__bw_b_{part}{i}") for i in range(len(specs)) for part in ("before", "first")]
    got = _joined(local, small.select(SERIES, F.col("z.blocks").alias(BLOCK), *found))
    value = lambda i, n: F.when(F.col(f"v_{n}").isNull(), F.col(f"__bw_b_before{i}")).otherwise(F.col(f"v_{n}") + F.col(f"p_{n}") * F.col(f"__bw_b_first{i}"))
    return got.select(*kept, *[value(i, n).alias(n) for i, n in enumerate(specs)])


def _value_at(values: DataFrame, ranks: DataFrame, bins: int = 1024) -> DataFrame:
    """(series_id, which, value): of ``values(series_id, x)`` the order statistics ``ranks(series_id, which, rank, lo, hi)``.

    A round counts what lies in each of ``bins`` equal parts between lo and hi, and goes on in the part that holds the rank, between
    its own least and largest value, until these are one: a few rounds, each a small aggregate, no group in one place.
    """
    wanted = stage(ranks, "ranks")
    while not wanted.where("lo < hi").isEmpty():
        other = wanted.where("lo < hi").withColumnRenamed(SERIES, "__bw_of")
        near = values.join(other, F.col(SERIES).eqNullSafe(F.col("__bw_of")) & F.col("x").between(F.col("lo"), F.col("hi")))
        # (halves, so that the width of all doubles stays a double)
        part = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = near.groupBy("__bw_of", "which", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("__bw_of", "which").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        hit = hit.select(F.col("__bw_of").alias(SERIES), "which", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi")
        wanted = stage(wanted.where("lo = hi").unionByName(hit), "ranks")
    return wanted.select(SERIES, "which", F.col("lo").alias("value"))


def medians(df: DataFrame, column: str) -> DataFrame:
    """(series_id, median) of the values of ``column`` that are not NULL, exact, in bounded memory; NULL where there is none."""
    values = stage(df.select(SERIES, F.col(column).cast("double").alias("x")).where("x is not null"), "values")
    some = values.groupBy(SERIES).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranks = some.selectExpr(SERIES, "explode(array(0, 1)) as which", "n", "lo", "hi").selectExpr(SERIES, "which", "(n - 1 + which) div 2 as rank", "lo", "hi")
    return _value_at(values, ranks).groupBy(SERIES).agg((F.sum("value") / 2).alias("median"))


def with_median(df: DataFrame, column: str, out: str) -> DataFrame:
    """A laid-out frame (halos and all) with the series' median of ``column`` over own rows as ``out``."""
    df = stage(df, "rows")
    found = medians(own(df), column).select(F.col(SERIES).alias("__bw_of"), F.col("median").alias(out))
    return df.join(found, F.col(SERIES).eqNullSafe(F.col("__bw_of")), "left").drop("__bw_of")
