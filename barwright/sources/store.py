"""A store of bars that is read through: only what it lacks is fetched, and what was fetched once stays.

A store is two Parquet tables: ``rows``, partitioned by kind, timeframe, series and month, and ``spans``, the stretches of time
that have been asked for, whether or not they held rows. Times are milliseconds. Bars that have not closed are never stored,
so a later read gets them then.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.plans.shared import stage
from barwright.sources.market import DAY_MS, closed_until

SPAN_SCHEMA = "series_id string, start long, end long"
_STORED = "kind string, timeframe string, "


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a timestamp with or without a zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', `{name}`)")
    return F.unix_millis(F.col(name).cast("timestamp"))


def _month(at: Column) -> Column:
    return F.trunc(F.date_from_unix_date(F.floor(at / DAY_MS).cast("int")), "month")


def missing(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The parts of ``wanted`` spans that no ``held`` span covers: series_id, start, end, as few spans as possible.

    Spans are half open; they may overlap, repeat or touch on either side. Empty ones, ones that end before they start and
    ones with a null count for nothing. A sweep over the ends of all spans, one shuffle by series; the ends at one time
    are summed before it.
    """

    def ends(df: DataFrame, which: str) -> DataFrame:
        at = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))))
        points = df.where("series_id is not null and start < end").select("series_id", at.alias("p"))
        return points.select("series_id", "p.at", F.col("p.d").alias(which), F.lit(0).alias("held" if which == "wanted" else "wanted"))

    points = ends(wanted, "wanted").unionByName(ends(held, "held")).groupBy("series_id", "at").agg(F.sum("wanted").alias("wanted"), F.sum("held").alias("held"))
    w = Window.partitionBy("series_id").orderBy("at")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = points.select("series_id", "at", F.lead("at").over(w).alias("next"), ((F.sum("wanted").over(up_to) > 0) & (F.sum("held").over(up_to) == 0)).alias("lacks"))
    begins = F.col("lacks") & ~F.coalesce(F.lag("lacks").over(w), F.lit(False))
    runs = steps.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("long")).over(up_to)).where("lacks")
    return runs.groupBy("series_id", "run").agg(F.min("at").alias("start"), F.max("next").alias("end")).drop("run")


def _tables(spark: SparkSession, path: str, schema: str, kind: str, timeframe: str) -> tuple[DataFrame, DataFrame]:
    """The rows and spans of a kind and timeframe; a store that is not there is made, with nothing in it."""
    spans = f"{_STORED}{SPAN_SCHEMA}, fetched long"
    rows = f"{_STORED}month date, at long, fetched long, {schema}"
    for name, columns in (("spans", spans), ("rows", rows)):
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{path}/{name}")
    chosen = (F.col("kind") == kind) & (F.col("timeframe") == timeframe)
    return tuple(spark.read.schema(columns).parquet(f"{path}/{name}").where(chosen) for name, columns in (("rows", rows), ("spans", spans)))


def read_through(spark: SparkSession, path: str, kind: str, timeframe: str, schema: str, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
    """The rows of ``wanted`` spans (series_id, start, end) from a store, which gets what it lacks from ``fetch`` first.

    ``fetch`` is given the missing spans as a table and returns rows of ``schema``, with series_id and ts; it is not called
    when nothing is missing. Spans end at ``now``, those of bars (``kind`` klines) where the first bar opens that has not closed then. The
    result has the columns of ``schema`` and ``fetched``, the ``now`` of the read that brought a row.

    Rows are written before their spans: a read that is cut off leaves the spans missing, and the next one fetches them
    again. Of rows that share a series and a time the one fetched first counts, then the least; so two reads at once do no
    harm. Rows without a series or a time are left out; those that ``fetch`` gives beyond the missing spans are stored too,
    and returned where a span asks for them.
    """
    rows, held = _tables(spark, path, schema, kind, timeframe)
    until = closed_until(timeframe, now) if kind == "klines" else now
    wanted = missing(wanted.select("series_id", F.col("start").cast("long"), F.least(F.col("end"), F.lit(until)).cast("long").alias("end")), held.limit(0))
    gaps = stage(missing(wanted, held), "gaps")
    if not gaps.isEmpty():
        got = fetch(gaps)
        got = got.withColumn("at", millis(got, "ts")).where("series_id is not null and at is not null")
        named = {"kind": F.lit(kind), "timeframe": F.lit(timeframe), "fetched": F.lit(now).cast("long")}
        got.withColumns({**named, "month": _month(F.col("at"))}).repartition("series_id", "month").write.partitionBy("kind", "timeframe", "series_id", "month").mode("append").parquet(f"{path}/rows")
        gaps.withColumns(named).write.mode("append").parquet(f"{path}/spans")
        rows, _ = _tables(spark, path, schema, kind, timeframe)
    wanted = stage(wanted, "wanted")
    first, last = wanted.agg(F.min("start"), F.max("end")).first()
    in_months = F.col("month").between(*[_month(F.lit(x or 0)) for x in (first, last)])
    names = [c for c in rows.columns if c not in ("kind", "timeframe", "month")]
    spans = wanted.withColumnRenamed("series_id", "__bw_series")
    asked = (F.col("series_id") == F.col("__bw_series")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    mine = rows.where(in_months).select(*names).join(spans, asked, "leftsemi")
    values = [c for c in names if c not in ("series_id", "at", "fetched")]
    kept = mine.groupBy("series_id", "at").agg(F.min(F.struct("fetched", *values)).alias("row"))
    return kept.select("series_id", *[F.col("row")[c].alias(c) for c in values], F.col("row")["fetched"].alias("fetched"))


def from_market(spark: SparkSession, **options: str) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` for ``read_through`` that asks the market source; what the driver gets is the missing spans of the symbols asked for."""

    def fetch(gaps: DataFrame) -> DataFrame:
        spans = [[r.series_id, r.start, r.end] for r in gaps.collect()]
        return spark.read.format("market").options(**options, spans=json.dumps(spans)).load()

    return fetch
