import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterloom.operators.quarantine import keep_type, reject_summary, split_rejects
from meterloom.operators.samples import metric_sample_errors, metrics_to_samples, sample_errors, to_samples
from meterloom.sources.delimited import read_delimited
from meterloom.sources.graphite import read_graphite
from meterloom.sources.json_records import read_json_records
from meterloom.sources.lines import fan_in, read_lines, read_lines_after_header, stamp_origin
from meterloom.specs import FieldSpec, SeriesSpec, ValueSpec, check_fields

PEOPLE = [FieldSpec("name"), FieldSpec("age", "int"), FieldSpec("active", "bool")]
PEOPLE_TAIL = [FieldSpec("name"), FieldSpec("age", "int", optional=True), FieldSpec("active", "bool", optional=True)]


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")


def delimited(spark, texts, fields=PEOPLE, **kw):
    rows = read_delimited(lines(spark, *texts), fields, units=False, **kw).orderBy("i").collect()
    return [tuple(r[f.name] for f in fields) if r["_error"] is None else r["_error"] for r in rows]


def test_people(spark):
    assert delimited(spark, ["Mira,52,true", "Tove,19,false"]) == [("Mira", 52, True), ("Tove", 19, False)]
    assert delimited(spark, ["Mira;52;true", "Tove;19;false"], sep=";") == [("Mira", 52, True), ("Tove", 19, False)]
    assert delimited(spark, ["Mira|52|true"], sep="|") == [("Mira", 52, True)]
    assert delimited(spark, [" Mira ,52, true "]) == [("Mira", 52, True)]
    assert delimited(spark, ["Mira,52", "Tove", "Ines,,"], PEOPLE_TAIL) == [
        ("Mira", 52, None), ("Tove", None, None), ("Ines", None, None),
    ]
    many = [f"p{i},{i},true" for i in range(580)]
    assert delimited(spark, many) == [(f"p{i}", i, True) for i in range(580)]


def test_rejects_say_why(spark):
    got = delimited(spark, ["Mira,x,true", ",52,true", "Tove,,false", "Mira,19,", "Mira,52", "Mira,52,true,extra"])
    assert got == [
        "field age is not a valid int",
        "required field name is empty",
        "required field age is empty",
        "required field active is empty",
        "too few fields: 2, need 3",
        "too many fields: 4, allowed 3",
    ]


def test_blank_lines_are_skipped_and_line_breaks_cut(spark):
    assert delimited(spark, ["", "   ", "Mira,52,true\r", "Tove,1,no\r\n"]) == [("Mira", 52, True), ("Tove", 1, False)]


def test_quotes(spark):
    two = [FieldSpec("a"), FieldSpec("b")]
    got = delimited(spark, ['"x,y",z', '"a"b,c', '"open,c', 'a,"b ', '"",c', ',"q"', ' "a",b', 'a,"b"', '""","c"'], two)
    assert got == [
        ("x,y", "z"),
        "too few fields: 1, need 2",
        ('"open', "c"),
        ("a", '"b'),
        "required field a is empty",
        "required field a is empty",
        ('"a"', "b"),
        ("a", "b"),
        "too few fields: 1, need 2",
    ]


def test_five_types_units_and_origin(spark):
    fields = [FieldSpec("s"), FieldSpec("i", "int"), FieldSpec("f", "float"), FieldSpec("b", "bool"), FieldSpec("d")]
    assert delimited(spark, ["text,42,3.14,true,2020-07-19"], [
        FieldSpec("s"), FieldSpec("n", "int"), FieldSpec("f", "float"), FieldSpec("b", "bool"), FieldSpec("d")
    ]) == [("text", 42, 3.14, True, "2020-07-19")]
    with pytest.raises(ValueError):  # the test lines already have a column i
        read_delimited(lines(spark, "x"), fields)
    row = read_delimited(lines(spark, "71.2 W"), [FieldSpec("power", "float")], inbound="gpu").first()
    assert (row.power.value, row.power.unit, row["_inbound"], row["_raw"]) == (71.2, "W", "inbound:gpu", "71.2 W")
    assert delimited(spark, ["1,Mira,100", "2,Tove,ninety"], [FieldSpec("id", "int"), FieldSpec("n"), FieldSpec("score")]) == [
        (1, "Mira", "100"), (2, "Tove", "ninety"),
    ]


def test_fields_at_given_positions(spark):
    fields = [FieldSpec("c", index=2), FieldSpec("a", index=0)]
    assert delimited(spark, ["1,2,3"], fields) == [("3", "1")]


@pytest.mark.parametrize(
    "fields",
    [
        [],
        [FieldSpec("a", index=1), FieldSpec("b", index=1)],
        [FieldSpec("a", optional=True), FieldSpec("b")],
        [FieldSpec("a"), FieldSpec("a")],
    ],
)
def test_bad_declarations(fields):
    with pytest.raises(ValueError):
        check_fields(fields)


def test_bad_names_and_types():
    for bad in (lambda: FieldSpec(""), lambda: FieldSpec("a", "uuid"), lambda: check_fields([FieldSpec("a"), FieldSpec("b")], 1)):
        with pytest.raises(ValueError):
            bad()


def test_files_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,age\n"Mi, ra",52\r\nTove,19\n')
    (tmp_path / "b.csv").write_text("name,age\nInes,1")
    fields = [FieldSpec("name"), FieldSpec("age", "int")]
    rows = read_delimited(read_lines_after_header(spark, str(tmp_path)), fields, units=False)
    good, rejects = split_rejects(rows)
    assert sorted((r.name, r.age) for r in good.collect()) == [("Ines", 1), ("Mi, ra", 52), ("Tove", 19)]
    assert rejects.count() == 0 and "_file" in good.columns
    assert read_lines(spark, str(tmp_path)).count() == 5


def test_header_only_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age\n")
    assert read_lines_after_header(spark, str(tmp_path)).count() == 0


TYPES = {"int_val": "int", "float_val": "float", "bool_val": "bool"}


def graphite(spark, text, types=None):
    return read_graphite(lines(spark, text), types).first()


def test_graphite_lines(spark):
    r = graphite(spark, "pump.flow.rate 42.5 1700000040")
    assert (r.metric, r.value, r.ts, r.attrs, r["_error"]) == (
        "pump.flow.rate", 42.5, dt.datetime(2023, 11, 14, 22, 14), {}, None,
    )
    r = graphite(spark, "pump.tank.level 1024.0 1700000040 host=node-a\tregion=north  x=a=b bad more=1")
    assert r.attrs == {"host": "node-a", "region": "north", "x": "a=b"}
    r = graphite(spark, "pump.state 42.5 1700000040 int_val=0123 float_val=45.60 bool_val=on", TYPES)
    assert r.attrs == {"int_val": "123", "float_val": "45.6", "bool_val": "true"}
    assert {k: v.value for k, v in r.numbers.items()} == {"int_val": 123.0, "float_val": 45.6, "bool_val": 1.0}
    assert graphite(spark, "pump.heat -10.5 1700000040").value == -10.5
    assert graphite(spark, "pump.volume 1.2e6 1700000040").value == 1.2e6
    assert graphite(spark, "m 1 1700000040 a=1 a=2").attrs == {"a": "2"}
    assert graphite(spark, "m 1 1700000040trailing a=1").attrs == {}


@pytest.mark.parametrize(
    "text",
    [
        "pump.flow.rate abc 1700000040",
        "pump.flow.rate 42.5 timestamp",
        "pump.flow.rate 42.5 17000000401",
        " pump.flow.rate 42.5 1700000040",
        "pump.flow.rate 42.5",
        "pump.state 42.5 1700000040 int_val=not_a_number",
        "m 1 1700000040 m=x",
        "m 1 1700000040 timestamp=x",
        "m 1e 1700000040",
        "m 1 9999999999999999999",
    ],
)
def test_graphite_rejects(spark, text):
    r = graphite(spark, text, TYPES)
    assert r["_error"] is not None and r.metric is None and r["_raw"] == text


def test_graphite_blank_lines_are_skipped(spark):
    assert read_graphite(lines(spark, "", "  ")).count() == 0


def samples_of(df):
    return sorted((r.name, r.metric_type, r.value, tuple(sorted(r.labels.items()))) for r in df.collect())


def test_graphite_samples(spark):
    rows = read_graphite(
        lines(
            spark,
            "cpu.load 1 1700000040 host=a int_val=7",
            "cpu.load 2 1700000040 host=a note=text",
            "9bad 2 1700000040 host=a",
            "nonsense",
        ),
        TYPES,
    )
    spec = SeriesSpec(labels=["host"], timestamp="timestamp", extra_labels={"job": "lab"})
    labels = (("host", "a"), ("job", "lab"))
    assert samples_of(metrics_to_samples(rows, spec)) == [
        ("cpu_load", "gauge", 1.0, labels), ("int_val", "gauge", 7.0, labels),
    ]
    errors = [r["_error"] for r in metric_sample_errors(rows, spec).orderBy("i").collect()]
    assert errors == [None, "an attribute is neither label nor number", "invalid metric name", "not a metric line"]
    chosen = SeriesSpec(labels=["host", "note"], values=["counter:cpu.load", "absent"], timestamp="timestamp")
    assert samples_of(metrics_to_samples(rows, chosen)) == [
        ("cpu_load", "counter", 1.0, (("host", "a"),)), ("cpu_load", "counter", 2.0, (("host", "a"), ("note", "text"))),
    ]
    untimed = SeriesSpec(labels=["host"])
    assert metrics_to_samples(rows, untimed).count() == 0
    unknown = SeriesSpec(labels=["host"], timestamp="when")
    assert metrics_to_samples(rows, unknown).count() == 0


GPU = [
    FieldSpec("index", "int"), FieldSpec("timestamp", "datetime"), FieldSpec("utilization.gpu", "float"),
    FieldSpec("power.draw", "float"), FieldSpec("clocks_throttle_reasons.gpu_idle", "bool"),
]


def test_gpu_line_to_samples(spark):
    rows = read_delimited(lines(spark, "0, 2022/06/09 05:17:48.731, 37, 71.2 W, Not Active"), GPU)
    good, _ = split_rejects(rows.drop("i"))
    spec = SeriesSpec(labels=["index"], timestamp="timestamp", extra_labels={"job": "lab"})
    base = (("index", "0"), ("job", "lab"))
    got = to_samples(good, spec)
    assert samples_of(got) == [
        ("clocks_throttle_reasons_gpu_idle", "gauge", 0.0, base),
        ("power_draw", "gauge", 71.2, (*base, ("unit", "W"))),
        ("utilization_gpu", "gauge", 37.0, base),
    ]
    row = got.first()
    assert row.ts == dt.datetime(2022, 6, 9, 5, 17, 48, 731000)
    assert (row["_type"], row["_inbound"]) == ("TimeseriesRecord", "inbound:delimited")


def test_label_overlay_order(spark):
    df = spark.sql("select 'own' unit, 'h' host, named_struct('value', 1D, 'unit', 'W') p, 2D q, timestamp'2024-01-01' t")
    spec = SeriesSpec(labels=["unit", "host"], timestamp="t", extra_labels={"host": "fixed"})
    assert samples_of(to_samples(df, spec)) == [
        ("p", "gauge", 1.0, (("host", "fixed"), ("unit", "W"))),
        ("q", "gauge", 2.0, (("host", "fixed"), ("unit", "own"))),
    ]


def test_rows_are_taken_whole_or_not_at_all(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None, 1), ("b", 1.0, "text", 1), ("c", None, None, 1), ("d", 2.0, None, None), (None, 3.0, None, 1)],
        "host string, x double, note string, t int",
    ).withColumn("t", F.timestamp_seconds("t"))
    spec = SeriesSpec(labels=["host"], timestamp="t")
    assert [r["_error"] for r in sample_errors(df, spec).collect()] == [
        None, "field note is not a number", "no value field", "no timestamp", None,
    ]
    assert samples_of(to_samples(df, spec)) == [("x", "gauge", 1.0, (("host", "a"),)), ("x", "gauge", 3.0, ())]


def test_bad_column_names_reject_only_rows_that_have_them(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0)], "host string, x double, `a..b` double")
    spec = SeriesSpec(labels=["host"])
    assert [r["_error"] for r in sample_errors(df, spec).collect()] == [None, "invalid metric name a..b"]
    bad_label = SeriesSpec(labels=["a..b"], values=["x"])
    assert [r["_error"] for r in sample_errors(df, bad_label).collect()] == [None, "invalid label name a..b"]


def test_specs():
    assert ValueSpec.parse("counter:a:b") == ValueSpec("a:b", "counter")
    assert ValueSpec.parse("a:b") == ValueSpec("b", "gauge")
    assert ValueSpec.parse("a") == ValueSpec("a", "gauge")
    with pytest.raises(ValueError):
        SeriesSpec(labels=[])
    with pytest.raises(ValueError):
        SeriesSpec(labels=["a"], values=[])


def test_json_records(spark):
    rows = read_json_records(
        lines(
            spark,
            '{"name":"Mira","age":52,"__type__":"Worker"}',
            '{"name":"big","age":18446744073709551615,"score":"Infinity","__custom__":"x"}',
            '{"name":"odd","__type__":5}',
            "[1]", "not json", '{"age":"x"}', '{"age":1.5}',
        ),
        "name string, age bigint, score double, `__custom__` string",
    ).orderBy("i").collect()
    assert [(r.name, r.age, r["_type"]) for r in rows[:3]] == [("Mira", 52, "Worker"), ("big", -1, None), ("odd", None, None)]
    assert rows[1].score == float("inf") and rows[1]["__custom__"] == "x"
    assert [r["_error"] for r in rows] == [None, None, None] + ["not a JSON object"] * 2 + ["does not fit the schema"] * 2


def test_json_numbers_as_written(spark):
    texts = ['{"a":12,"b":3}', '{"a":"12"}', '{"b":"NaN"}', '{"b":"-Infinity"}', '{"a":1e3}', '{"a":99999999999999999999999}', '{"a":null,"b":null}', '{"b":true}']
    rows = read_json_records(lines(spark, *texts), "a bigint, b double").orderBy("i").collect()
    assert [r["_error"] is None for r in rows] == [True, False, False, True, False, False, True, False]
    assert (rows[0].a, rows[0].b, rows[3].b, rows[6].a) == (12, 3.0, float("-inf"), None)
    nested = ['{"l":[1,18446744073709551615,null],"m":{"x":2},"s":{"n":-1,"f":[0.5]}}', '{"l":["1"]}', '{"m":{"x":"2"}}', '{"s":{"n":1.5}}', '{"s":{"f":["NaN"]}}']
    rows = read_json_records(lines(spark, *nested), "l array<bigint>, m map<string,bigint>, s struct<n:bigint,f:array<double>>").orderBy("i").collect()
    assert [r["_error"] is None for r in rows] == [True, False, False, False, False]
    assert (rows[0].l, rows[0].m, rows[0].s.n, rows[0].s.f) == ([1, -1, None], {"x": 2}, -1, [0.5])


def test_origin_and_fan_in(spark):
    a = stamp_origin(spark.sql("select 1 x"), "one")
    b = stamp_origin(spark.sql("select 2 x, 'k' y, 'inbound:first' _inbound"), "two")
    assert sorted((r.x, r.y, r["_inbound"]) for r in fan_in(a, b).na.fill("", ["y"]).collect()) == [
        (1, "", "inbound:one"), (2, "k", "inbound:first"),
    ]


def test_type_filter_and_reject_counts(spark):
    df = spark.createDataFrame([("TimeseriesRecord",), ("Other",), (None,)], "_type string")
    kept, seen = keep_type(df)
    assert kept.count() == 1 and seen.get == {"kept": 1, "dropped": 2}
    rows = read_delimited(lines(spark, "a,1,true", "b", "c"), PEOPLE)
    assert [(r["_error"], r.n) for r in reject_summary(rows).collect()] == [("too few fields: 1, need 3", 2)]
