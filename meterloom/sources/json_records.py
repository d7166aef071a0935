"""JSON text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.once import computed_once
from .lines import stamp_origin


def read_json_records(
    lines: DataFrame, schema: T.StructType | str, *, line: str = "value", inbound: str = "json"
) -> DataFrame:
    """One row per line: the declared fields, ``_type``, ``_inbound``, ``_raw`` and ``_error``.

    ``__type__`` becomes ``_type`` when it is a string; any other ``__x__`` is a field like the
    rest. A bigint takes whole numbers only, and those above the signed range wrap around; a real number takes
    numbers and the texts of infinities; text is never taken for a number. A line that is not a JSON object, or
    whose values do not fit the schema, is rejected.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # Numbers come as they are written, to tell 12 from "12" and to see what exceeds the signed range.
    wire = T.StructType([T.StructField(f.name, _as_written(f.dataType)) for f in schema])
    wire = wire.add("__type__", T.VariantType()).add("_corrupt", T.StringType())
    kept = [F.col(f"`{c}`") for c in lines.columns if c != line]
    parsed = lines.select(
        *kept,
        F.col(line).alias("_raw"),
        F.from_json(F.col(line), wire, {"columnNameOfCorruptRecord": "_corrupt"}).alias("_r"),
    )
    record = F.col("_r")
    kind = record["__type__"]
    parsed = parsed.withColumn("_type", F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get(kind, "$", "string")))
    read = {f.name: _typed(record[f.name], f.dataType) for f in schema}
    misfit = F.lit(False)
    for _, bad in read.values():
        misfit = misfit | F.coalesce(bad, F.lit(False))
    is_object = F.ltrim(F.col("_raw")).startswith("{")
    error = (
        F.when(F.coalesce(~is_object, F.lit(True)), F.lit("not a JSON object"))
        .when(record["_corrupt"].isNotNull() | misfit, F.lit("does not fit the schema"))
    )
    ok = F.col("_error").isNull()
    fields = [value.alias(name) for name, (value, _) in read.items()]
    typed = computed_once(parsed.select(*kept, *fields, "_type", "_raw", error.alias("_error")))
    names = [*schema.fieldNames(), "_type"]
    rows = typed.select(*kept, *[F.when(ok, F.col(f"`{n}`")).alias(n) for n in names], "_raw", "_error")
    return stamp_origin(rows, inbound)


def _as_written(dt: T.DataType) -> T.DataType:
    """The type to read, with bigint and real numbers at any depth as variants."""
    if isinstance(dt, (T.LongType, T.DoubleType, T.FloatType)):
        return T.VariantType()
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_as_written(dt.elementType))
    if isinstance(dt, T.MapType):
        return T.MapType(dt.keyType, _as_written(dt.valueType))
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _as_written(f.dataType)) for f in dt])
    return dt


def _typed(c: Column, dt: T.DataType) -> tuple[Column, Column]:
    """The value, and whether there is one that does not fit."""
    if isinstance(dt, (T.LongType, T.DoubleType, T.FloatType)):
        kind = F.schema_of_variant(c)
        if isinstance(dt, T.LongType):
            value = F.when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$"), _wrapping_long(F.try_variant_get(c, "$", "decimal(38,0)")))
        else:
            text = F.try_variant_get(c, "$", "string")
            number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
            # The texts that stand for infinities.
            value = F.when(number | ((kind == "STRING") & text.isin("Infinity", "-Infinity")), F.try_variant_get(c, "$", "double")).cast(dt)
        return value, (kind != "VOID") & value.isNull()
    if isinstance(dt, T.ArrayType) and _as_written(dt) != dt:
        return F.transform(c, lambda x: _typed(x, dt.elementType)[0]), F.exists(c, lambda x: F.coalesce(_typed(x, dt.elementType)[1], F.lit(False)))
    if isinstance(dt, T.MapType) and _as_written(dt) != dt:
        bad = F.exists(F.map_values(c), lambda x: F.coalesce(_typed(x, dt.valueType)[1], F.lit(False)))
        return F.transform_values(c, lambda _, x: _typed(x, dt.valueType)[0]), bad
    if isinstance(dt, T.StructType) and _as_written(dt) != dt:
        members = [(f.name, *_typed(c[f.name], f.dataType)) for f in dt]
        bad = F.lit(False)
        for _, _, b in members:
            bad = bad | F.coalesce(b, F.lit(False))
        return F.when(c.isNotNull(), F.struct(*[v.alias(n) for n, v, _ in members])), c.isNotNull() & bad
    return c, F.lit(False)


def _wrapping_long(n: Column) -> Column:
    """Numbers above the signed range but within 64 bits wrap around; NULL beyond."""
    span = F.lit("18446744073709551616").cast("decimal(20,0)")
    wrapped = F.when(n >= span, F.lit(None).cast("decimal(38,0)")).when(n > F.lit("9223372036854775807").cast("decimal(20,0)"), n - span).otherwise(n)
    return wrapped.try_cast("bigint")
