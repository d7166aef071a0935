"""Wide records to long, labelled samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_float
from ..functions.maps import map_of
from ..functions.names import label_name, metric_name, sanitize_metric
from ..functions.once import computed_once
from ..functions.text import datetime_text, double_text, ntz_as_utc, value_text
from ..specs import DEFAULT_METRIC_TYPE, SAMPLE_TYPE, SeriesSpec, ValueSpec

NO_VALUE = "no value field"
NO_TIMESTAMP = "no timestamp"


def to_samples(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One sample per measured field of each row that :func:`sample_errors` accepts.

    A row is taken whole or not at all. NULL fields are skipped. Narrow: no shuffle.
    """
    shape = _WideShape(df, spec)
    fields = df.select(
        shape.timestamp().alias("ts"),
        *[shape.label_text(n).alias(f"_l{i}") for i, n in enumerate(shape.labels)],
        shape.inbound().alias("_inbound"),
        # A rejected row explodes NULL, which gives no rows; no filter needs the error again.
        F.explode(F.when(shape.error().isNull(), F.array(*shape.measurements()))).alias("m"),
    ).where(F.col("m.number").isNotNull())
    texts = {n: F.col(f"_l{i}") for i, n in enumerate(shape.labels)}
    return _finish(fields, texts, spec)


def sample_errors(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The input rows with ``_error``: why a row gives no samples, NULL where it does."""
    return computed_once(df.withColumn("_error", _WideShape(df, spec).error()))


def _finish(fields: DataFrame, texts: dict[str, Column], spec: SeriesSpec) -> DataFrame:
    """Label overlay (record, then unit, then constants) and the fixed sample columns."""
    unit = F.col("m.number.unit")
    texts = dict(texts)
    texts["unit"] = F.coalesce(unit, texts["unit"]) if "unit" in texts else unit
    texts.update({k: F.lit(v) for k, v in spec.extra_labels.items()})
    return fields.select(
        F.col("m.name").alias("name"),
        F.col("m.metric_type").alias("metric_type"),
        "ts",
        F.col("m.number.value").alias("value"),
        map_of(texts).alias("labels"),
        "_inbound",
        F.lit(SAMPLE_TYPE).alias("_type"),
    )


class _WideShape:
    """Which columns of ``df`` are labels, values and timestamp under ``spec``."""

    def __init__(self, df: DataFrame, spec: SeriesSpec) -> None:
        self.types = {f.name: f.dataType for f in df.schema}
        public = [n for n in self.types if not n.startswith("_")]
        self.spec = spec
        self.label_columns = sorted(n for n in spec.labels if n in self.types)
        if spec.values is None:
            skip = {*spec.labels, spec.timestamp, "name"}
            self.values = [ValueSpec(n) for n in public if n not in skip]
        else:
            self.values = [v for v in spec.values if v.name in self.types and v.name not in spec.labels]
        self.labels = _by_clean_name(self.label_columns)

    def col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def label_text(self, label: str) -> Column:
        sources = reversed(self.labels[label])
        return F.coalesce(*[value_text(self.col(n), self.types[n]) for n in sources])

    def timestamp(self) -> Column:
        if self.spec.timestamp is None:
            return F.current_timestamp()
        if self.spec.timestamp not in self.types:
            return F.lit(None).cast("timestamp")
        dt = self.types[self.spec.timestamp]
        c = self.col(self.spec.timestamp)
        return ntz_as_utc(c) if isinstance(dt, T.TimestampNTZType) else c.try_cast("timestamp")

    def inbound(self) -> Column:
        return F.col("_inbound") if "_inbound" in self.types else F.lit("pipe:timeseries")

    def measurements(self) -> list[Column]:
        out = []
        for v in self.values:
            number = cast_float(self.col(v.name), self.types[v.name])
            name = metric_name(v.name)
            if number is None or name is None:
                continue
            out.append(
                F.struct(
                    F.lit(name).alias("name"), F.lit(v.metric_type).alias("metric_type"), number.alias("number")
                )
            )
        none = F.struct(
            F.lit("").alias("name"),
            F.lit(DEFAULT_METRIC_TYPE).alias("metric_type"),
            F.lit(None).cast("struct<value:double,unit:string>").alias("number"),
        )
        return out or [none]

    def error(self) -> Column:
        present = [self._present(v.name) for v in self.values]
        some = F.lit(False)
        for p in present:
            some = some | p
        error = F.when(self.timestamp().isNull(), F.lit(NO_TIMESTAMP))
        for n in self.label_columns:
            if label_name(n) is None:
                error = error.when(self.col(n).isNotNull(), F.lit(f"invalid label name {n}"))
        error = error.when(~some, F.lit(NO_VALUE))
        for v, p in zip(self.values, present):
            if metric_name(v.name) is None:
                error = error.when(p, F.lit(f"invalid metric name {v.name}"))
            elif cast_float(self.col(v.name), self.types[v.name]) is None:
                error = error.when(p, F.lit(f"field {v.name} is not a number"))
        return error

    def _present(self, name: str) -> Column:
        return self.col(name).isNotNull()


def metrics_to_samples(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Samples of the rows :func:`~meterloom.sources.graphite.read_graphite` accepted.

    The metric and every attribute that is not a label count as fields, as in
    :func:`to_samples`; without a value list a text attribute that is no label rejects its row.
    """
    fields = df.withColumn("_fields", _metric_fields(spec)).select(
        _metric_ts(spec).alias("ts"),
        *[
            F.coalesce(*map(_metric_label_source, reversed(sources))).alias(f"_l{i}")
            for i, sources in enumerate(_by_clean_name(spec.labels).values())
        ],
        "_inbound",
        F.explode(F.when(_metric_error(spec).isNull(), F.col("_fields"))).alias("f"),
    ).select(
        "*",
        F.struct(
            sanitize_metric(F.col("f.name")).alias("name"),
            _metric_type(spec, F.col("f.name")).alias("metric_type"),
            F.col("f.number").alias("number"),
        ).alias("m"),
    )
    texts = {n: F.col(f"_l{i}") for i, n in enumerate(_by_clean_name(spec.labels))}
    return _finish(fields, texts, spec)


def metric_sample_errors(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Graphite rows with ``_error``: an ingest error, or why the row gives no samples."""
    checked = df.withColumn("_fields", _metric_fields(spec)).withColumn("_error", _metric_error(spec))
    return computed_once(checked.drop("_fields"))


def _metric_error(spec: SeriesSpec) -> Column:
    """Reads the chosen fields from ``_fields``."""
    chosen = F.col("_fields")
    error = F.when(F.col("_error").isNotNull(), F.col("_error")).when(
        _metric_ts(spec).isNull(), F.lit(NO_TIMESTAMP)
    )
    for n in sorted(spec.labels):
        if label_name(n) is None:
            error = error.when(_metric_label_source(n).isNotNull(), F.lit(f"invalid label name {n}"))
    return (
        error.when(F.size(chosen) == 0, F.lit(NO_VALUE))
        .when(F.exists(chosen, lambda f: sanitize_metric(f["name"]).isNull()), F.lit("invalid metric name"))
        .when(F.exists(chosen, lambda f: f["number"].isNull()), F.lit("an attribute is neither label nor number"))
    )


def _metric_ts(spec: SeriesSpec) -> Column:
    if spec.timestamp is None:
        return F.current_timestamp()
    # The line's own time is the field called timestamp; no other field can hold one.
    return F.col("ts") if spec.timestamp == "timestamp" else F.lit(None).cast("timestamp")


def _metric_fields(spec: SeriesSpec) -> Column:
    """``array<struct<name, number>>`` of the fields of a row that count as values."""
    own = F.struct(
        F.col("metric").alias("name"),
        F.struct(F.col("value").alias("value"), F.lit(None).cast("string").alias("unit")).alias("number"),
    )
    others = F.transform(
        F.map_keys("attrs"),
        lambda k: F.struct(k.alias("name"), F.try_element_at("numbers", k).alias("number")),
    )
    fields = F.concat(F.array(own), F.filter(others, lambda f: f["name"] != F.col("metric")))
    labels = list(spec.labels)
    if spec.values is None:
        skip = labels + ["name"] + ([spec.timestamp] if spec.timestamp else [])
        chosen = F.filter(fields, lambda f: ~f["name"].isin(*skip))
        if spec.timestamp is None:
            # Then the line's time is a field like any other, and no number.
            stamp = F.struct(
                F.lit("timestamp").alias("name"),
                F.lit(None).cast("struct<value:double,unit:string>").alias("number"),
            )
            chosen = chosen if "timestamp" in labels else F.concat(chosen, F.array(stamp))
        return chosen
    wanted = [v.name for v in spec.values]
    return F.filter(fields, lambda f: f["name"].isin(*wanted) & ~f["name"].isin(*labels))


def _metric_type(spec: SeriesSpec, name: Column) -> Column:
    kinds = {v.name: v.metric_type for v in spec.values or () if v.metric_type != DEFAULT_METRIC_TYPE}
    if not kinds:
        return F.lit(DEFAULT_METRIC_TYPE)
    table = F.create_map(*[F.lit(s) for pair in kinds.items() for s in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(DEFAULT_METRIC_TYPE))


def _by_clean_name(labels: Iterable[str]) -> dict[str, list[str]]:
    """Fields by sanitised label name; of several, the last in name order holds."""
    out: dict[str, list[str]] = {}
    for n in sorted(labels):
        clean = label_name(n)
        if clean:
            out.setdefault(clean, []).append(n)
    return out


def _metric_label_source(field: str) -> Column:
    attr = F.try_element_at("attrs", F.lit(field))
    text = F.when(F.col("metric") == field, double_text(F.col("value"))).otherwise(attr)
    if field == "timestamp":
        text = F.coalesce(datetime_text(F.col("ts")), text)
    return text
