"""Canonical JSON as a column: sorted keys, numbers and escapes as Python's ``json.dumps(..., sort_keys=True)`` spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short escapes of a JSON string.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def quoted(text: Column) -> Column:
    """A JSON string in ASCII."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        pair = F.concat(unit(F.shiftright(code - 0x10000, 10) + 0xD800), unit((code - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
        out = F.when(code > 0xFFFF, pair).when((code < 32) | (code > 126), unit(code)).otherwise(c)
        for raw, short in ESCAPES:
            out = F.when(c == raw, F.lit(short)).otherwise(out)
        return out

    plain = ~text.rlike(r'[^\x20-\x7E]|["\\]')
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(letters, escaped), "")), F.lit('"'))


def number(x: Column) -> Column:
    """A double with the fewest digits: positional from 1e-4 up to below 1e16, else with an exponent of two digits at least."""
    text = x.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    every = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    # Place of the point, counted from the first digit that is not 0.
    leading = F.length(every) - F.length(F.regexp_replace(every, "^0+", ""))
    point = F.length(whole) + power - leading
    n = F.length(digits)
    left = F.when(n <= point, F.concat(F.rpad(digits, point, "0"), F.lit(".0"))).otherwise(
        F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1, n))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    exponent = F.concat(F.when(point > 0, "e+").otherwise("e-"), F.lpad(F.abs(point - 1).cast("string"), F.greatest(F.length(F.abs(point - 1).cast("string")), F.lit(2)), F.lit("0")))
    wide = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), n))).otherwise(""), exponent)
    body = F.when(n == 0, "0.0").when((point > 0) & (point <= 16), left).when((point <= 0) & (point > -4), small).otherwise(wide)
    odd = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    return F.coalesce(odd, F.concat(sign, body))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON of a column of the given type.

    A null field of a struct is absent, as a setting that is not given; nulls in
    arrays and maps are ``null``.  Keys are in order of their code points.
    """
    return F.coalesce(_spelled(value, kind), F.lit("null"))


def _spelled(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [
            F.when(value[f.name].isNotNull(), F.concat(quoted(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)))
            for f in sorted(kind.fields, key=lambda f: f.name)
        ]
        inner = F.concat_ws(", ", *fields) if fields else F.lit("")
        return F.when(value.isNotNull(), F.concat(F.lit("{"), inner, F.lit("}")))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        inner = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(": "), canonical_json(F.element_at(value, k), kind.valueType)))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(inner, ", "), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: canonical_json(x, kind.elementType))
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")))
    if isinstance(kind, T.BooleanType):
        return F.when(value.isNotNull(), F.when(value, "true").otherwise("false"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), number(value.cast("double")))
    if isinstance(kind, T.StringType):
        return quoted(value)
    if isinstance(kind, T.IntegralType):
        return value.cast("string")
    raise TypeError(f"no canonical form of {kind.simpleString()}")


def settings_hash(value: Column, kind: T.DataType, digits: int = 8) -> Column:
    """The first hex digits of the SHA-256 of the canonical JSON."""
    return F.left(F.sha2(canonical_json(value, kind), 256), F.lit(digits))
