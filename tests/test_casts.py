import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions import casts, maps, names, text

UTC = dt.timezone.utc


def apply(spark, values, fn, typ="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {typ}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_numbers_with_units(spark):
    texts = ["42", "+5", "-7", "42 W", " 42\tW ", "42 W x", "4.2", "abc", "", "9223372036854775808", "0x1F"]
    got = apply(spark, texts, lambda c: casts.parse_number(c, "int"))
    assert [(r.value, r.unit) if r and r.value is not None else None for r in got] == [
        (42, None), (5, None), (-7, None), (42, "W"), (42, "W"), None, None, None, None, None, None,
    ]


def test_floats(spark):
    texts = ["42", "3.14", "1.", ".5", "1e3", "1.0d", "1.0f", "71.2 W", "inf", "-Infinity", "1_0", ".", "e5", "1e400"]
    got = apply(spark, texts, lambda c: casts.parse_number(c, "float"))
    inf = float("inf")
    assert [(r.value, r.unit) if r else None for r in got] == [
        (42.0, None), (3.14, None), (1.0, None), (0.5, None), (1000.0, None), None, None, (71.2, "W"),
        (inf, None), (-inf, None), None, None, None, (inf, None),
    ]
    nan = apply(spark, ["nan", "+NaN", "-nan"], lambda c: casts.parse_number(c, "float"))
    assert all(r.value != r.value for r in nan)


def test_bool_words(spark):
    yes = ["true", "T", "yes", "Y", "ON", "Active", "1"]
    no = ["false", "f", "No", "n", "off", "inactive", "Not Active", "0"]
    assert apply(spark, yes, casts.parse_bool) == [True] * 7
    assert apply(spark, no, casts.parse_bool) == [False] * 8
    assert apply(spark, ["2", "", "not  active", None], casts.parse_bool) == [None] * 4


def at(*args, off=0):
    return dt.datetime(*args, tzinfo=dt.timezone(dt.timedelta(hours=off))).astimezone(UTC).replace(tzinfo=None)


DATETIMES = [
    ("1700000040", at(2023, 11, 14, 22, 14)),
    ("1700000040123", at(2023, 11, 14, 22, 14, 0, 123000)),
    ("1700000040123456789", at(2023, 11, 14, 22, 14, 0, 123456)),
    ("1700000040123456", None),
    ("-123456789", at(1966, 2, 2, 2, 26, 51)),
    ("2022/06/09 05:17:48.731", at(2022, 6, 9, 5, 17, 48, 731000)),
    ("2022/06/09 05:17:48", at(2022, 6, 9, 5, 17, 48)),
    ("2022-06-09 05:17:48.731", at(2022, 6, 9, 5, 17, 48, 731000)),
    ("2022-6-9 6:9:3", at(2022, 6, 9, 6, 9, 3)),
    ("2022-06-09T05:17:48", at(2022, 6, 9, 5, 17, 48)),
    ("2022-06-09T05:17:48.731", at(2022, 6, 9, 5, 17, 48, 731000)),
    ("2022-06-09T05:17:48.731+08:00", at(2022, 6, 9, 5, 17, 48, 731000, off=8)),
    ("2022-06-09t05:17:48z", at(2022, 6, 9, 5, 17, 48)),
    ("2022-06-09T05:17:48.123456789Z", at(2022, 6, 9, 5, 17, 48, 123456)),
    ("09/06/2022 05:17:48.5", at(2022, 6, 9, 5, 17, 48, 500000)),
    ("06/21/2022 05:17:48", at(2022, 6, 21, 5, 17, 48)),
    ("21-06-2022 05:17:48", at(2022, 6, 21, 5, 17, 48)),
    ("06-21-2022 05:17:48.25", at(2022, 6, 21, 5, 17, 48, 250000)),
    ("2022/06/09 05:17:48.731+08:00", at(2022, 6, 9, 5, 17, 48, 731000, off=8)),
    ("2022-06-09 05:17:48 -0500", at(2022, 6, 9, 5, 17, 48, off=-5)),
    ("09/06/2022 05:17:48+01:00", at(2022, 6, 9, 5, 17, 48, off=1)),
    ("06/21/2022 05:17:48.1+01:00", at(2022, 6, 21, 5, 17, 48, 100000, off=1)),
    ("Thu, 09 Jun 2022 05:17:48 +0800", at(2022, 6, 9, 5, 17, 48, off=8)),
    ("9 Jun 2022 05:17 GMT", at(2022, 6, 9, 5, 17)),
    ("9 jun 2022 05:17:48 EST", at(2022, 6, 9, 5, 17, 48, off=-5)),
    ("Mon, 09 Jun 2022 05:17:48 +0800", None),
    ("2022-06-09", None),
    ("2025-02-30 00:00:00", None),
    ("2022-06-09 25:00:00", None),
    ("31/31/2025 00:00:00", None),
    ("yesterday", None),
]


def test_datetimes(spark):
    got = apply(spark, [t for t, _ in DATETIMES], casts.parse_datetime)
    assert dict(zip([t for t, _ in DATETIMES], got)) == dict(DATETIMES)


def test_graphite_epochs(spark):
    texts = ["1700000040", "1700000040123", "1700000040123456", "1700000040123456789", "17000000401", "abc"]
    got = apply(spark, texts, casts.parse_epoch)
    assert got == [
        at(2023, 11, 14, 22, 14), at(2023, 11, 14, 22, 14, 0, 123000), at(2023, 11, 14, 22, 14, 0, 123456),
        at(2023, 11, 14, 22, 14, 0, 123456), None, None,
    ]


@pytest.mark.parametrize(
    "value, want",
    [
        (42.0, "42"), (3.14, "3.14"), (1e7, "10000000"), (1.5e7, "15000000"), (123456789.125, "123456789.125"),
        (1e-7, "0.0000001"), (-2.5e-5, "-0.000025"), (1e21, "1" + "0" * 21), (0.0, "0"), (-0.0, "-0"),
        (1.2345678901234567e19, "12345678901234567000"), (float("nan"), "NaN"), (float("-inf"), "-inf"),
    ],
)
def test_double_text(spark, value, want):
    assert apply(spark, [value], text.double_text, "double") == [want]


def test_value_text(spark):
    row = spark.sql(
        "select named_struct('value', 42D, 'unit', 'W') n, timestamp'2022-06-09 05:17:48.731' t, "
        "map('b', 1D, 'a', cast(null as double)) m, array(true, null) a, 7L i"
    )
    types = {f.name: f.dataType for f in row.schema}
    got = row.select(*[text.value_text(F.col(c), types[c]).alias(c) for c in types]).first()
    assert got.n == "42 W"
    assert got.t == "2022-06-09 05:17:48.731 UTC"
    assert got.m == "{a: null, b: 1}"
    assert got.a == "[true, null]"
    assert got.i == "7"
    strings = row.select(*[casts.cast_string(F.col(c), types[c]).alias(c) for c in types]).first()
    assert strings.t == "2022-06-09T05:17:48.731+00:00"
    assert strings.m is None and strings.a is None


def test_float_casts_by_type(spark):
    assert casts.cast_float(F.lit("x"), T.StringType()) is None
    assert casts.cast_float(F.lit(None), T.TimestampType()) is None
    got = spark.range(1).select(casts.cast_float(F.lit(True), T.BooleanType()).alias("b")).first().b
    assert (got.value, got.unit) == (1.0, None)


def test_map_and_array_text(spark):
    got = apply(spark, ["{a=1, b = x}", "{a=1,a=2}", "{a}", "{a=b=c}", "a=1", "{}"], maps.parse_map_text)
    assert got == [{"a": "1", "b": "x"}, {"a": "2"}, None, None, None, None]
    got = apply(spark, ["[1, two,,3 ]", "[]", "1,2"], maps.parse_array_text)
    assert got == [["1", "two", "3"], [], None]


NAMES = ["pump.flow.rate", " a b ", "a..b", "9lives", "ns:total", "cpu-usage", "", "ok_1", "a__b", "é", "a\nb", "_x"]


def test_names_dynamic_equals_static(spark):
    metric = apply(spark, NAMES, names.sanitize_metric)
    label = apply(spark, NAMES, names.sanitize_label)
    assert metric == [names.metric_name(n) for n in NAMES]
    assert label == [names.label_name(n) for n in NAMES]
    assert metric == ["pump_flow_rate", None, None, None, "ns:total", "cpu-usage", None, "ok_1", None, None, None, "_x"]
    assert label[4] is None
