"""Text forms of typed values.

Sample text is defined by how Python prints values (``-768.25``, ``True``, ``1e-05``, ``nan``), so
the functions here rebuild that from native expressions; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

DATE_TYPES = (T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def is_number(dt: T.DataType) -> bool:
    return isinstance(dt, INT_TYPES + FLOAT_TYPES)


def _edge(c: Column, more: tuple[str, ...] = ()) -> Column:
    blanks = list(PY_WHITESPACE)
    return F.left(c, F.lit(1)).isin(blanks) | F.right(c, F.lit(1)).isin([*blanks, *more])


def strip(c: Column) -> Column:
    """Python's ``strip``. Trimming by a set of characters is costly, and most values have nothing to
    trim, so the first and last characters are looked at first."""
    return F.when(_edge(c), F.btrim(c, F.lit(PY_WHITESPACE))).otherwise(c)


def tidy(c: Column) -> Column:
    """Trimmed, then freed of one trailing full stop."""
    def slow(x):
        return drop_final_dot(F.btrim(x, F.lit(PY_WHITESPACE)))

    return F.when(_edge(c, (".",)), out_of_line(slow, c)).otherwise(c)


def _rare_float(c: Column) -> Column:
    """Numbers Java and Python print differently: infinities, very small and very large ones."""
    a = F.abs(c)
    fixed = F.rtrim(c.cast("string").try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    fixed = F.when(F.endswith(fixed, F.lit(".")), F.concat(fixed, F.lit("0"))).otherwise(fixed)

    def sci(digits):
        return F.format_string(f"%.{digits}e", c)

    pick = (
        F.when(sci(14).try_cast("double") == c, sci(14))
        .when(sci(15).try_cast("double") == c, sci(15))
        .otherwise(sci(16))
    )
    pick = F.replace(F.regexp_replace(pick, "0+e", "e"), F.lit(".e"), F.lit("e"))
    return (
        F.when(a == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((a >= 1e-4) & (a < 1e16), fixed)
        .otherwise(pick)
    )


def out_of_line(build, c: Column) -> Column:
    """``build(c)`` kept out of the generated code of the row loop.

    The JVM compiles only methods below a size limit. A row with many columns reaches it when every
    column brings its rare cases along, and the whole loop is then interpreted (five times slower,
    measured). A function applied to a one-element array is called instead of inlined.
    """
    return F.get(F.transform(F.array(c), build), F.lit(0))


def py_float(c: Column) -> Column:
    """Double as Python prints it. Java agrees with Python for 1e-3 <= |v| < 1e7."""
    c = c.cast("double")
    a = F.abs(c)
    return (
        F.when(((a >= 1e-3) & (a < 1e7)) | (c == 0.0), c.cast("string"))
        .when(c.isNull() | F.isnan(c), F.lit("nan"))
        .otherwise(out_of_line(_rare_float, c))
    )


def iso_timestamp(c: Column) -> Column:
    """ISO text; the fraction has six digits and appears only when it is not zero."""
    s = F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(s, F.lit(".")), F.rpad(s, 26, "0")).otherwise(s)


def iso_duration(c: Column) -> Column:
    """Day-time interval as ``P1DT2H3M4S``; negative values borrow from the days."""
    us = F.unix_micros(F.lit("1970-01-01 00:00:00Z").cast("timestamp") + c)
    day = F.floor(us / F.lit(86_400_000_000))
    rest = us - day * F.lit(86_400_000_000)
    sec = F.floor(rest / F.lit(1_000_000))
    frac = rest - sec * F.lit(1_000_000)
    tail = F.when(
        frac > 0,
        F.concat(F.lit("."), F.rtrim(F.lpad(frac.cast("string"), 6, "0"), F.lit("0"))),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("P"), day.cast("string"), F.lit("DT"), F.floor(sec / 3600).cast("string"), F.lit("H"),
        F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("string"), F.lit("M"),
        F.pmod(sec, F.lit(60)).cast("string"), tail, F.lit("S"),
    )


def decode_bytes(c: Column) -> Column:
    """UTF-8 where valid, else Latin-1 (which accepts every byte)."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(
        F.decode(c, "ISO-8859-1")
    )


def py_str(c: Column, dt: T.DataType) -> Column:
    """Value as text (never null): the coercion all profiling and serialization use."""
    if isinstance(dt, FLOAT_TYPES):
        return py_float(c)
    if isinstance(dt, INT_TYPES):
        return F.coalesce(c.cast("string"), F.lit("nan"))
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit("None"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(iso_timestamp(c), F.lit("NaT"))
    if isinstance(dt, T.DayTimeIntervalType):
        return F.coalesce(iso_duration(c), F.lit("NaT"))
    if isinstance(dt, T.BinaryType):
        return F.coalesce(decode_bytes(c), F.lit("None"))
    if isinstance(dt, T.ArrayType):
        quoted = py_quote if isinstance(dt.elementType, (T.StringType, T.BinaryType)) else _plain_quote
        items = F.transform(c, lambda x: quoted(py_str(x, dt.elementType)))
        return F.coalesce(
            F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), F.lit("None")
        )
    if isinstance(dt, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(c), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit("None"))


def coerce(c: Column, dt: T.DataType) -> Column:
    """Like :func:`py_str`, but arrays stay arrays (of coerced elements)."""
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: coerce(x, dt.elementType))
    return py_str(c, dt)


def _hex_escape(ch: Column, short: bool) -> Column:
    """Escape of one character; ``short`` uses two digits below 256 and eight above 65535."""
    units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    if not short:
        return F.regexp_replace(units, "(.{4})", "\\\\u$1")
    point = F.lower(F.hex(F.encode(ch, "UTF-32")))
    return (
        F.when(F.startswith(point, F.lit("000000")), F.concat(F.lit("\\x"), F.substring(point, 7, 2)))
        .when(F.startswith(point, F.lit("0000")), F.concat(F.lit("\\u"), F.substring(point, 5, 4)))
        .otherwise(F.concat(F.lit("\\U"), point))
    )


def _common_escapes(c: Column) -> Column:
    for raw, esc in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def _plain_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _escape_python(c: Column) -> Column:
    body = _common_escapes(c)
    body = F.when(
        F.regexp_like(F.regexp_replace(c, "[\\n\\r\\t]", ""), F.lit(_UNPRINTABLE)),
        F.array_join(
            F.transform(
                F.split(body, ""),
                lambda ch: F.when(F.regexp_like(ch, F.lit(_UNPRINTABLE)), _hex_escape(ch, True)).otherwise(ch),
            ),
            "",
        ),
    ).otherwise(body)
    single = F.contains(c, F.lit("'"))
    double = F.contains(c, F.lit('"'))
    return (
        F.when(~single, _plain_quote(body))
        .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(_plain_quote(F.replace(body, F.lit("'"), F.lit("\\'"))))
    )


def py_quote(c: Column) -> Column:
    """String as a Python literal; most strings just need quotes."""
    odd = F.regexp_like(c, F.lit(r"['\\\p{C}\p{Z}&&[^ ]]"))
    return F.when(odd, out_of_line(_escape_python, c)).otherwise(_plain_quote(c))


def _escape_json(c: Column) -> Column:
    body = _common_escapes(c)
    for raw, esc in (('"', '\\"'), ("\b", "\\b"), ("\f", "\\f")):
        body = F.replace(body, F.lit(raw), F.lit(esc))
    return F.when(
        F.regexp_like(body, F.lit("[^ -~]")),
        F.array_join(
            F.transform(
                F.split(body, ""),
                lambda ch: F.when(F.regexp_like(ch, F.lit("^[ -~]$")) | (ch == ""), ch).otherwise(
                    _hex_escape(ch, False)
                ),
            ),
            "",
        ),
    ).otherwise(body)


def json_quote(c: Column) -> Column:
    """String as ASCII-only JSON; most strings just need quotes."""
    odd = F.regexp_like(c, F.lit(r'[^ !#-\[\]-~]'))
    return F.concat(F.lit('"'), F.when(odd, out_of_line(_escape_json, c)).otherwise(c), F.lit('"'))


def html_escape(c: Column) -> Column:
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def drop_final_dot(c: Column) -> Column:
    """One trailing full stop removed."""
    return F.when(F.endswith(c, F.lit(".")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def py_round(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
