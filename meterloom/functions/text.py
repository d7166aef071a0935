"""Text helpers: whitespace, splitting and the label form of typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Unicode calls white space, as a regex class and as a trim set.
SPACE = r"[\s\x85\p{Z}]"
NON_SPACE = r"[^\s\x85\p{Z}]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim Unicode white space from both ends.

    Text that begins and ends with a visible ASCII character, as nearly all does, is passed through.
    """
    edges = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(edges, c).otherwise(F.trim(c, F.lit(SPACE_CHARS)))


def split_delimited(line: Column, sep: str = ",") -> Column:
    """Tokens of one delimited line.

    A field that opens with a quote runs to the next quote and is kept verbatim; there is no
    escape for a quote inside it. Any other field runs to the separator and is trimmed. Text
    between a closing quote and the separator ends the line, and so does a line break outside quotes.
    """
    if len(sep) != 1:
        raise ValueError("the separator must be a single character")
    lit_sep = "\\" + sep if not sep.isalnum() and not sep.isspace() else sep
    # The line gets a leading separator so that every match consumes at least one character and
    # \G can tie each match to the end of the one before.
    quoted = F.regexp_extract_all(
        F.concat(F.lit(sep), line),
        F.lit(rf'\G{lit_sep}("[^"]*"|[^{lit_sep}\n\r]*)'),
        F.lit(1),
    )
    plain = F.split(line, lit_sep, -1)
    has_special = line.contains('"') | line.contains("\r") | line.contains("\n")
    return F.when(has_special, quoted).otherwise(plain)


def token(tokens: Column, index: int) -> Column:
    """Token ``index`` without its quotes and outer blanks; NULL past the end."""
    t = F.get(tokens, F.lit(index))
    return strip(F.when(is_quoted(t), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))


def is_quoted(t: Column) -> Column:
    return t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)


def double_text(c: Column) -> Column:
    """Plain decimal text of a double: no exponent, no trailing ``.0``."""
    s = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(F.ltrim(s, F.lit("-")), "E", 1), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    exp = F.substring_index(s, "E", -1).try_cast("int")
    whole = exp + 1
    expanded = F.concat(
        F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit("")),
        F.when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
        .when(F.length(digits) <= whole, F.rpad(digits, whole, F.lit("0")))
        .otherwise(F.concat(F.substr(digits, F.lit(1), whole), F.lit("."), F.substr(digits, whole + 1))),
    )
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when(s.contains("E"), expanded)
        .otherwise(F.regexp_replace(s, r"\.0$", ""))
    )


def _fraction(ts: Column) -> Column:
    """Fraction of a second with 0, 3 or 6 digits, whichever loses nothing."""
    us = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return (
        F.when(us == 0, F.lit(""))
        .when(us % 1000 == 0, F.concat(F.lit("."), F.lpad((us / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(us.cast("string"), 6, "0")))
    )


def _utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def datetime_text(ts: Column) -> Column:
    """``2025-04-03 16:09:03.452 UTC``"""
    return F.concat(F.date_format(_utc(ts), "yyyy-MM-dd HH:mm:ss"), _fraction(ts), F.lit(" UTC"))


def rfc3339_text(ts: Column) -> Column:
    """``2025-04-03T16:09:03.452+00:00``"""
    return F.concat(F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss"), _fraction(ts), F.lit("+00:00"))


def is_number_struct(dt: T.DataType) -> bool:
    """Whether a type is ``struct<value, unit>``, the shape of a number with a unit."""
    return isinstance(dt, T.StructType) and dt.fieldNames() == ["value", "unit"]


def value_text(c: Column, dt: T.DataType) -> Column:
    """The text a typed value shows as a label; NULL stays NULL at the top level.

    Map entries are listed by key so that equal maps give equal text.
    """
    if isinstance(dt, (T.StringType, T.NullType)):
        return c.cast("string")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return double_text(c.cast("double"))
    if isinstance(dt, T.TimestampType):
        return datetime_text(c)
    if isinstance(dt, T.TimestampNTZType):
        return datetime_text(ntz_as_utc(c))
    if is_number_struct(dt):
        number = value_text(c["value"], dt["value"].dataType)
        return F.when(c["unit"].isNull(), number).otherwise(F.concat(number, F.lit(" "), c["unit"]))
    if isinstance(dt, T.ArrayType):
        parts = F.transform(c, lambda x: F.coalesce(value_text(x, dt.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    if isinstance(dt, T.MapType):
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
        parts = F.transform(
            entries,
            lambda e: F.concat(
                value_text(e["key"], dt.keyType),
                F.lit(": "),
                F.coalesce(value_text(e["value"], dt.valueType), F.lit("null")),
            ),
        )
        return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    if isinstance(dt, T.StructType):
        parts = [
            F.concat(F.lit(f"{f.name}: "), F.coalesce(value_text(c[f.name], f.dataType), F.lit("null")))
            for f in sorted(dt.fields, key=lambda f: f.name)
        ]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return c.cast("string")


def ntz_as_utc(c: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session zone is."""
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    )


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A time column as a timestamp; zone-less ones are read as UTC."""
    c = F.col(f"`{name}`")
    return ntz_as_utc(c) if isinstance(df.schema[name].dataType, T.TimestampNTZType) else c.cast("timestamp")


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column."""
    return F.unix_micros(as_timestamp(df, name))
