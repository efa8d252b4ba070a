"""Rounding, bounds, ids, keys and parameters."""

import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.functions import lineage, numeric, params


def exact(v: float, d: int) -> float:
    return float(Decimal(v).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP)) + 0.0


@pytest.mark.parametrize("digits", [2, 4, 6, 8])
def test_rounding_is_that_of_the_exact_binary_value(spark, digits):
    values = [1.005, 2.675, 0.03125, -0.03125, 0.5, -0.0, 1e-12, 5 * 10.0 ** -(digits + 1), -5 * 10.0 ** -(digits + 1), 4.9 * 10.0 ** -(digits + 1), 1234567.891, 0.1 + 0.2, 1 / 3]
    values += [k / 2 ** (digits + 1) for k in range(-9, 10)] + [math.nextafter(k / 64, 1) for k in range(9)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(numeric.js_round(F.col("v"), digits)).collect()]
    assert got == [exact(v, digits) for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(numeric.js_round(F.col("v"), digits)).collect()
    assert [r[0] for r in odd] == [None] * 3
    assert math.copysign(1, got[values.index(-0.0)]) == 1


def test_wilson_and_friends(spark):
    row = spark.range(1).select(
        numeric.wilson_lower(F.lit(60), F.lit(100)).alias("w"), numeric.wilson_lower(F.lit(0), F.lit(0)).alias("none"), numeric.sigmoid(F.lit(-800.0)).alias("low"), numeric.sigmoid(F.lit(800.0)).alias("high"),
        numeric.choose2(F.lit(1)).alias("one"), numeric.choose2(F.lit(5)).alias("five"), numeric.median(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(10.0))).alias("m"), numeric.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("e"),
    ).first()
    assert row.w == pytest.approx(0.502003, abs=1e-5) and row.none is None and row.low == 0 and row.high == 1 and (row.one, row.five) == (0, 10) and row.m == 2.5 and row.e == pytest.approx(math.log(2))


def test_sql_names(spark):
    numeric.register(spark)
    assert spark.sql("SELECT wilson_lower(60D, 100D), logistic(0D)").first()[1] == 0.5


def test_ids_and_coins(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "l string, r string")
    rows = df.select(lineage.unordered_id("t", F.col("l"), F.col("r")).alias("i"), lineage.coin("s", F.col("l")).alias("c"), lineage.fixed(F.lit(-0.25)).alias("f"), lineage.rank_code(F.lit(37)).alias("q")).collect()
    assert rows[0].i == rows[1].i != rows[2].i and rows[0].i == hashlib.sha256(b"t|a|b").hexdigest()
    assert rows[0].f == "-25" and rows[0].q == "q-11"
    flips = spark.range(4000).select(lineage.coin("s", F.col("id").cast("string")).cast("int").alias("c")).agg(F.avg("c")).first()[0]
    assert 0.45 < flips < 0.55


def test_keys(spark):
    rows = [('{"a": 1, "b": {"raterId": 2}}',), ('{"a": "raterId: no", "b": 1}',), ('{"a": 1, "b": 2, "c": 3}',), ("[1]",), (None,), ('{"a": "\\"raterId\\": 1"}',)]
    df = spark.createDataFrame(rows, "j string")
    unknown, missing = lineage.key_violations(F.col("j"), ["a", "b"])
    got = df.select(unknown.alias("u"), missing.alias("m"), lineage.has_key(F.col("j"), "raterId").alias("f")).collect()
    assert [r.u for r in got] == [[], [], ["c"], [], [], []] and [len(r.m) for r in got] == [0, 0, 0, 2, 2, 1]
    assert [r.f for r in got] == [True, False, False, False, False, False]


def test_escape(spark):
    assert spark.range(1).select(lineage.escape_markup(F.lit("<a b='c'>&\""))).first()[0] == "&lt;a b=&apos;c&apos;&gt;&amp;&quot;"


@given(st.lists(st.integers(1, 512), min_size=1, max_size=32, unique=True))
def test_sizes_keep_order_and_drop_repeats(sizes):
    assert params.size_list(",".join(map(str, sizes + sizes))) == sizes


def test_parameter_errors():
    for bad in (lambda: params.size_list("0"), lambda: params.size_list("x"), lambda: params.number_in("nan", "v", 0, 1), lambda: params.integer_in(True, "v", 0, 1), lambda: params.known_only({"a": 1}, set()), lambda: params.correction_of(None, 1, None)):
        with pytest.raises(params.ParameterError):
            bad()
    assert params.correction_of(None, 2, (1.0, 3.0)) == (1.0, 2.0) and params.name_list("a, b,,") == ["a", "b"]
