import datetime as dt

import pytest

from barwright.functions.compiler import evaluate, evaluate_bool, list_builtins
from barwright.functions.expressions import EvalError, LexError, ParseError, parse, parse_with_repair, repair_expression

COLUMNS = "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, volumes=None):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=i), c, c, c, c, (volumes or [1.0] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, COLUMNS)


def values(df, column="score"):
    return [r[column] for r in df.orderBy("ts").collect()]


@pytest.mark.parametrize("text", ["a < b < c", "1 +", "(close", "close)", "f(1,2,3,4,5,6,7)", "close close", "2 ** 3", "a, b", "not", "f(1,)", "7 // 2", "close = 1"])
def test_unreadable(text):
    with pytest.raises((ParseError, LexError)):
        parse(text)


@pytest.mark.parametrize("text", ["__import__(1)", "lambda", "eval(1)", "clôse", "close[1]", "close.x", "1e5", "1.2.3", "x" * 4001, "'a'", "a & b"])
def test_words_outside_the_language(text):
    with pytest.raises(LexError):
        parse(text)


def test_case_and_precedence():
    assert parse("A + B * C") == parse("a + (b * c)")
    assert parse("- a * b") == parse("(-a) * b")
    assert parse("not a > b and c") == parse("(not (a > b)) and c")
    assert parse("IF(a, 1, 2)") == parse("if(a, 1, 2)")
    assert parse("a - b - c") == parse("(a - b) - c")


@pytest.mark.parametrize(
    ("text", "mended", "notes"),
    [
        ("ta.highest(high, 5", "highest(high, 5)", 2),
        ("close[20] > close[1]", "prev(close, 20) > prev(close, 1)", 1),
        ("close + open * ", "close + open", 1),
        ("close > 1 and", "close > 1", 1),
        ("abs(close))", "abs(close)", 1),
        ("(close > 1 or ) +", "(close > 1 or )", 1),
    ],
)
def test_repair(text, mended, notes):
    assert repair_expression(text)[0] == mended
    assert len(repair_expression(text)[1]) == notes


def test_repair_keeps_the_first_error():
    assert parse_with_repair("sma(close, 5")[1:] == ("sma(close, 5)", ["closed 1 bracket"])
    with pytest.raises(ParseError, match="column"):
        parse_with_repair("close close (")


@pytest.mark.parametrize("text", ["nonsense", "foo(close)", "ema(close)", "ema(close, 0)", "ema(close, volume)", "close / 0", "(close > 1) - (open > 1)", "abs()", "rsi", "highest(close, 501)"])
def test_cannot_be_compiled(spark, text):
    with pytest.raises(EvalError):
        evaluate(bars(spark, [1.0, 2.0]), text)


def test_missing_values(spark):
    df = bars(spark, [1.0, None, 4.0])
    assert values(evaluate(df, "close", limit=False)) == [1.0, 0.0, 4.0]
    assert values(evaluate_bool(df, "close > 0"), "condition") == [True, False, True]
    assert values(evaluate_bool(df, "close != 1"), "condition") == [False, True, True]
    assert values(evaluate_bool(df, "not (close > 0)"), "condition") == [False, True, False]
    assert values(evaluate_bool(df, "close"), "condition") == [True, True, True]
    assert values(evaluate(df, "if(close, 1, 0)", limit=False)) == [1.0, 1.0, 1.0]
    assert values(evaluate(df, "open / volume", limit=False)) == [1.0, 0.0, 4.0]
    assert values(evaluate(df, "clip(close, 3, 2)", limit=False)) == [2.0, 0.0, 3.0]
    assert values(evaluate(df, "close * 10")) == [1.0, 0.0, 1.0]


def test_windows_need_full_frames(spark):
    df = bars(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert values(evaluate(df, "sma(close, 2)", limit=False)) == [0.0, 1.5, 0.0, 0.0, 4.5, 5.5]
    assert values(evaluate(df, "sma(close, 50)", limit=False)) == [0.0] * 6
    flat = bars(spark, [5.0] * 4)
    assert values(evaluate(flat, "zscore(close, 2) + corr(close, open, 2) + slope(close, 2)", limit=False)) == [0.0] * 4
    assert values(evaluate(bars(spark, [1.0, 2.0, 3.0]), "rsi(close, 14)", limit=False)) == [50.0] * 3
    assert values(evaluate(bars(spark, [1.0, 2.0], [0.0, 0.0]), "session_vwap()", limit=False)) == [1.0, 2.0]


def test_smoothing_equals_pandas_over_gaps(spark):
    import pandas as pd

    x = [None, 1.0, None, None, 4.0, 5.0, None, 2.0]
    want = pd.Series(x, dtype=float).ewm(span=3, adjust=False).mean().fillna(0).tolist()
    assert values(evaluate(bars(spark, x), "ema(close, 3)", limit=False)) == pytest.approx(want)


def test_smoothing_does_not_depend_on_batches(spark):
    import math

    df = bars(spark, [math.sin(i) + 2 for i in range(500)])
    want = values(evaluate(df, "ema(ema(close, 9), 4) + rsi(close, 7)", limit=False))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert values(evaluate(df, "ema(ema(close, 9), 4) + rsi(close, 7)", limit=False)) == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_later_bars_do_not_change_earlier_values(spark):
    import math

    x = [math.sin(i / 3) + 2 for i in range(80)]
    text = "zscore(close, 10) + ema(close, 5) + adx(7) + vwap(9)"
    whole, part = (values(evaluate(bars(spark, x[:n]), text, limit=False)) for n in (80, 50))
    assert whole[:50] == pytest.approx(part)


def test_names():
    assert "session_vwap" in list_builtins() and "hour_utc" in list_builtins()
