"""Text to typed values, as column expressions.

Every function returns NULL where the text does not parse; callers that need to tell
"empty" from "bad" compare with the stripped text (see :func:`cast_field`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .once import out_of_line
from .text import NON_SPACE, SPACE, is_number_struct, rfc3339_text, strip, value_text

# Number grammar, for what is not plainly a number.
FULL = {
    "int": rf"^([+-]?[0-9]+)(?:{SPACE}+({NON_SPACE}+))?\z",
    "float": (
        r"^([+-]?(?:(?i:infinity|inf|nan)|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"
        rf"(?:{SPACE}+({NON_SPACE}+))?\z"
    ),
}

# The words a boolean may be spelled with, compared in lower case.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "active", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "inactive", "not active", "0")

# Digits of an epoch -> microseconds per unit (None: nanoseconds).
DATETIME_EPOCHS = {10: 1_000_000, 13: 1_000, 19: None}
GRAPHITE_EPOCHS = {10: 1_000_000, 13: 1_000, 16: 1, 19: None}

# Datetime shapes. Groups are (date parts), time, fraction, zone.
_TIME = r"([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]+)?)"
_ZONE = r"\s*([+-][0-9]{2})[:\s]*([0-9]{2})"
RFC3339_RE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
YMD_PLAIN_RE = r"^[0-9]{4}([/-])[0-9]{1,2}\1[0-9]{1,2} " + _TIME + r"\z"
YMD_RE = r"^([0-9]{4})([/-])([0-9]{1,2})\2([0-9]{1,2})\s*" + _TIME + r"\z"
YMD_T_RE = r"^([0-9]{4})(-)([0-9]{1,2})-([0-9]{1,2})T" + _TIME + r"(?:\s*[+-][0-9]{2}[:\s]*[0-9]{2})?\z"
DMY_RE = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{4})\s*" + _TIME + r"\z"
YMD_ZONE_RE = r"^([0-9]{4})([/-])([0-9]{1,2})\2([0-9]{1,2})\s*" + _TIME + _ZONE + r"\z"
DMY_ZONE_RE = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s*" + _TIME + _ZONE + r"\z"
RFC2822_RE = (
    r"^(?:(?i:(Mon|Tue|Wed|Thu|Fri|Sat|Sun))\s*,)?\s*([0-9]{1,2})\s+"
    r"(?i:(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec))\s+([0-9]{4})\s+"
    r"([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)\s+([+-][0-9]{4}|[A-Za-z]{1,3})\z"
)

# Named zones of RFC 2822; single letters other than J count as UTC.
RFC2822_ZONES = {
    "UT": "+0000", "GMT": "+0000",
    "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}

NUMBER_INT = T.StructType([T.StructField("value", T.LongType()), T.StructField("unit", T.StringType())])
NUMBER_FLOAT = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())])


def parse_number(c: Column, kind: str) -> Column:
    """``N`` or ``N unit`` as ``struct<value, unit>``; kind is ``int`` or ``float``.

    Text that does not parse gives a NULL struct, a number out of range one with a NULL value.
    """
    return _number(strip(c), kind)


def _number(text: Column, kind: str) -> Column:
    sql_type, full = {"int": "bigint", "float": "double"}[kind], FULL[kind]

    def rarer(x: Column) -> Column:
        # Spark reads "nan" but not a signed one.
        number = F.regexp_replace(F.regexp_extract(x, full, 1), "^[+-](?=[nN])", "")
        unit = F.nullif(F.regexp_extract(x, full, 2), F.lit(""))
        return F.when(x.rlike(full), F.struct(number.try_cast(sql_type).alias("value"), unit.alias("unit")))

    # The cast is laxer than the grammar only in outer blanks, type suffixes, named values and hexadecimal digits.
    value = text.try_cast(sql_type)
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    plain = value.isNotNull() & first.between(43, 57) & (last.between(48, 57) | (last == 46))
    if kind == "float":
        plain = plain & ~text.contains("x") & ~text.contains("X")
    number = F.struct(value.alias("value"), F.lit(None).cast("string").alias("unit"))
    return F.when(plain, number).otherwise(out_of_line(text, rarer))


def is_missing(c: Column, kind: str) -> Column:
    """Whether a value that :func:`cast_field` gave stands for nothing."""
    return c["value"].isNull() if kind in ("int", "float") else c.isNull()


def parse_bool(c: Column) -> Column:
    """True or false in any of the accepted spellings."""
    return _bool(strip(c))


def _bool(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def _epoch(text: Column, widths: dict[int, int | None]) -> Column:
    n = text.try_cast("bigint")
    out = None
    for width, scale in widths.items():
        # Integer arithmetic throughout: 19 digits do not fit a double.
        us = F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000)) if scale is None else n * scale
        cond = F.length(text) == width
        out = F.when(cond, us) if out is None else out.when(cond, us)
    return F.timestamp_micros(out)


def parse_epoch(c: Column) -> Column:
    """Digits of a Graphite line: 10, 13, 16 or 19 of them are s, ms, us or ns."""
    return F.when(c.rlike(r"^[0-9]+\z"), _epoch(c, GRAPHITE_EPOCHS))


def parse_datetime(c: Column) -> Column:
    """Epoch digits, RFC 3339, RFC 2822 or one of the usual date-time shapes.

    Day-first is tried before month-first. Text without an offset is read in the session time
    zone, and so is the ``T`` form whose offset is not RFC 3339. A date alone does not parse.
    """
    return _datetime(strip(c))


def _datetime(text: Column) -> Column:
    # The commonest shape needs only a look at its separators, the next a match; then a cast reads it as it is.
    at = lambda i: F.substring(text, i, 1)
    day = at(5)
    usual = (
        (F.length(text) == 19) & day.isin("-", "/") & (at(8) == day) & (at(11) == " ") & (at(14) == ":") & (at(17) == ":")
        & F.ascii(text).between(48, 57) & F.ascii(at(19)).between(48, 57)
    )
    plain = F.translate(text, "/", "-").try_cast("timestamp")
    return F.when(usual, plain).when(text.rlike(YMD_PLAIN_RE), plain).otherwise(out_of_line(text, _rarer_datetime))


def _rarer_datetime(x: Column) -> Column:
    def moment(pattern: str, template: str) -> Column:
        return F.regexp_replace(x, pattern, template).try_cast("timestamp")

    dmy, mdy = moment(DMY_RE, "$4-$3-$1 $5"), moment(DMY_RE, "$4-$1-$3 $5")
    dmy_z, mdy_z = moment(DMY_ZONE_RE, "$3-$2-$1 $4$5:$6"), moment(DMY_ZONE_RE, "$3-$1-$2 $4$5:$6")
    return (
        F.when(x.rlike(r"^[+-]?[0-9]+\z"), _epoch(x, DATETIME_EPOCHS))
        .when(x.rlike(YMD_RE), moment(YMD_RE, "$1-$3-$4 $5"))
        .when(x.rlike(RFC3339_RE), F.upper(x).try_cast("timestamp"))
        .when(x.rlike(YMD_T_RE), moment(YMD_T_RE, "$1-$3-$4 $5"))
        .when(x.rlike(DMY_RE), F.coalesce(dmy, mdy))
        .when(x.rlike(YMD_ZONE_RE), moment(YMD_ZONE_RE, "$1-$3-$4 $5$6:$7"))
        .when(x.rlike(DMY_ZONE_RE), F.coalesce(dmy_z, mdy_z))
        .when(x.rlike(RFC2822_RE), _rfc2822(x))
    )


def _rfc2822(x: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(x, RFC2822_RE, i)

    clock = F.when(F.length(part(5)) == 5, F.concat(part(5), F.lit(":00"))).otherwise(part(5))
    zones = F.create_map(*[F.lit(s) for pair in RFC2822_ZONES.items() for s in pair])
    name = F.upper(part(6))
    zone = (
        F.when(name.rlike("^[+-]"), name)
        .when((F.length(name) == 1) & (name != "J"), F.lit("+0000"))
        .otherwise(F.try_element_at(zones, name))
    )
    date = F.concat_ws(" ", part(2), F.initcap(part(3)), part(4))
    day = F.try_to_timestamp(date, F.lit("d MMM yyyy"))
    weekday_fits = (part(1) == "") | (F.initcap(part(1)) == F.date_format(day, "EEE"))
    stamp = F.try_to_timestamp(F.concat_ws(" ", date, clock, zone), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(weekday_fits & zone.isNotNull(), stamp)


def cast_field(c: Column, kind: str, *, stripped: bool = False) -> Column:
    """Typed value of a text field; empty text is NULL for every type."""
    text = c if stripped else strip(c)
    if kind == "null":
        return F.lit(None).cast("string")
    if kind == "string":
        return F.when(text != "", text)
    if kind in ("int", "float"):
        return _number(text, kind)
    if kind == "bool":
        return _bool(text)
    if kind == "datetime":
        return _datetime(text)
    raise ValueError(f"unknown field type {kind!r}")


def cast_string(c: Column, dt: T.DataType) -> Column:
    """Typed value to text: datetimes as RFC 3339; maps, arrays and NULL give NULL."""
    if isinstance(dt, T.TimestampType):
        return rfc3339_text(c)
    if isinstance(dt, (T.MapType, T.ArrayType)) or (isinstance(dt, T.StructType) and not is_number_struct(dt)):
        return F.lit(None).cast("string")
    return value_text(c, dt)


def cast_float(c: Column, dt: T.DataType) -> Column | None:
    """``struct<value double, unit>`` of a number or boolean column; None for any other type."""
    no_unit = F.lit(None).cast("string")
    if is_number_struct(dt):
        return F.when(c["value"].isNotNull(), F.struct(c["value"].cast("double").alias("value"), c["unit"].alias("unit")))
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return F.when(c.isNotNull(), F.struct(c.cast("double").alias("value"), no_unit.alias("unit")))
    return None
