"""Fit rows to a target schema before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_number_struct, ntz_as_utc, value_text

# What a field of the target schema can be.
_TARGETS = (
    T.StringType, T.IntegralType, T.FractionalType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType,
    T.BooleanType, T.ArrayType, T.MapType, T.StructType,
)


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """``df`` with exactly the fields of ``schema``.

    A missing field is NULL and an extra one is dropped. A text field takes the text of any
    value. Whole-number fields of any width take whole numbers, and bigint fields instants as epoch
    milliseconds; real-number and decimal fields take real numbers and decimals, timestamp fields instants,
    date and boolean fields their own. A value out of the field's range, or of another kind, becomes NULL.
    Units are dropped from numbers. Lists, maps and structs are fitted element by element. A
    target type beyond these is an error.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[
            (_fit(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in schema
        ]
    )


def _fit(c: Column, have: T.DataType, want: T.DataType) -> Column:
    null = F.lit(None).cast(want)
    if is_number_struct(have) and not isinstance(want, (T.StructType, T.StringType)):
        c, have = c["value"], have["value"].dataType
    if isinstance(want, T.StringType):
        return value_text(c, have)
    if not isinstance(want, _TARGETS):
        raise ValueError(f"cannot fit values into {want.simpleString()}")
    if isinstance(want, T.IntegralType):
        if isinstance(want, T.LongType) and isinstance(have, T.TimestampType):
            return F.unix_millis(c)
        if isinstance(want, T.LongType) and isinstance(have, T.TimestampNTZType):
            return F.unix_millis(ntz_as_utc(c))
        return c.try_cast(want) if isinstance(have, T.IntegralType) else null
    if isinstance(want, (T.FractionalType, T.DecimalType)):
        return c.try_cast(want) if isinstance(have, (T.FractionalType, T.DecimalType)) else null
    if isinstance(want, T.TimestampType) and isinstance(have, T.TimestampNTZType):
        return ntz_as_utc(c)
    if isinstance(want, T.TimestampNTZType) and isinstance(have, T.TimestampType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast(want))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: _fit_element(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        if have.keyType != want.keyType:
            return null
        return F.transform_values(c, lambda _, v: _fit_element(v, have.valueType, want.valueType))
    if isinstance(want, T.StructType) and isinstance(have, (T.StructType, T.MapType)):
        return _fit_struct(c, have, want)
    return c if have == want else null


def _fit_element(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """Inside a text list or map a NULL shows as the text ``null``."""
    fitted = _fit(c, have, want)
    return F.coalesce(fitted, F.lit("null")) if isinstance(want, T.StringType) else fitted


def _fit_struct(c: Column, have: T.StructType | T.MapType, want: T.StructType) -> Column:
    def member(f: T.StructField) -> Column:
        if isinstance(have, T.MapType):
            return _fit(F.try_element_at(c, F.lit(f.name)), have.valueType, f.dataType)
        if f.name in have.fieldNames():
            return _fit(c[f.name], have[f.name].dataType, f.dataType)
        return F.lit(None).cast(f.dataType)

    return F.when(c.isNotNull(), F.struct(*[member(f).alias(f.name) for f in want]))
