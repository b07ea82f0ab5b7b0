"""Built-in functions as Column expressions.

A partial function gives NULL where it has no value, and the row goes. A multi-valued one gives an array,
which is exploded. The receiver is the first argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MIN = -(1 << 63)


def _when(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def int_div(a: Column, b: Column) -> Column:
    """Truncates; no value for a divisor of 0 or beyond the range."""
    return F.when((b != 0) & ~((a == F.lit(LONG_MIN)) & (b == -1)), F.call_function("div", a, b))


def _quoted(s: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _whole(p: Column) -> Column:
    return F.concat(F.lit("\\A(?:"), p, F.lit(")\\z"))


def _index_of(s: Column, t: Column) -> Column:
    n, m = F.length(s), F.length(t)
    return F.when(m <= n, F.filter(F.sequence(F.lit(0), (n - m).cast("int")), lambda i: F.substring(s, i + 1, m) == t)).otherwise(F.array().cast("array<int>"))


def found_at(s: Column, p: Column) -> Column:
    """Matches of p in s with their number and offset, as an array of (v, n, at)."""
    kind = "array<struct<v:string,n:bigint,at:bigint>>"
    both = F.array(F.struct(F.regexp_extract_all(s, p, F.lit(0)).alias("m"), F.split(s, p, -1).alias("g")))

    def step(x: Column):
        def one(acc: Column, i: Column) -> Column:
            at, v = acc["at"] + F.length(F.get(x["g"], i)), F.get(x["m"], i)
            item = F.struct(v.alias("v"), i.cast("bigint").alias("n"), at.cast("bigint").alias("at"))
            return F.struct((at + F.length(v)).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

        return one

    def every(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.when(F.size(x["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), start, step(x))["out"]).otherwise(F.array().cast(kind))

    return F.element_at(F.transform(both, every), 1)


#: name -> (result type, function of Columns); the receiver's type is part of the name.
SCALAR: dict[str, tuple[str, Callable[..., Column]]] = {
    "string.length": ("long", lambda s: F.length(s).cast("long")),
    "string.charAt": ("string", lambda s, i: _when((i >= 0) & (i < F.length(s)), F.substring(s, (i + 1).cast("int"), F.lit(1)))),
    "string.substring": ("string", lambda s, a, b: _when((a >= 0) & (a <= b) & (b <= F.length(s)), F.substring(s, (a + 1).cast("int"), (b - a).cast("int")))),
    "string.toUpperCase": ("string", lambda s: F.upper(s)),
    "string.toLowerCase": ("string", lambda s: F.lower(s)),
    "string.trim": ("string", lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
    "string.replaceAll": ("string", lambda s, a, b: F.replace(s, a, b)),
    "string.regexpReplaceAll": ("string", lambda s, p, r: F.regexp_replace(s, p, r)),
    "string.regexpCapture": ("string", lambda s, p, g: _when(F.rlike(s, _whole(p)), F.call_function("regexp_extract", s, p, g.cast("int")))),
    "string.splitAtIndex": ("string", lambda s, d, i: F.get(F.split(s, _quoted(d), -1), i.cast("int"))),
    "string.prefix": ("string", lambda s, n: _when((n >= 0) & (n <= F.length(s)), F.substring(s, F.lit(1), n.cast("int")))),
    "string.suffix": ("string", lambda s, n: _when((n >= 0) & (n <= F.length(s)), F.substring(s, (n + 1).cast("int"), F.length(s)))),
    "string.toInt": ("long", lambda s: s.try_cast("bigint")),
    "string.toFloat": ("double", lambda s: s.try_cast("double")),
    "string.toString": ("string", lambda s: s),
    "long.toString": ("string", lambda x: x.cast("string")),
    "long.abs": ("long", lambda x: F.when(x != F.lit(LONG_MIN), F.abs(x))),
    "long.minimum": ("long", lambda x, y: F.least(x, y)),
    "long.maximum": ("long", lambda x, y: F.greatest(x, y)),
    "long.bitAnd": ("long", lambda x, y: x.bitwiseAND(y)),
    "long.bitOr": ("long", lambda x, y: x.bitwiseOR(y)),
    "long.bitXor": ("long", lambda x, y: x.bitwiseXOR(y)),
    "long.bitNot": ("long", lambda x: F.bitwise_not(x)),
    "long.bitShiftLeft": ("long", lambda x, n: F.call_function("shiftleft", x, n.cast("int"))),
    "long.bitShiftRight": ("long", lambda x, n: F.call_function("shiftrightunsigned", x, n.cast("int"))),
    "long.bitShiftRightSigned": ("long", lambda x, n: F.call_function("shiftright", x, n.cast("int"))),
    "long.toFloat": ("double", lambda x: x.cast("double")),
    "double.toString": ("string", lambda x: x.cast("string")),
    "double.abs": ("double", lambda x: F.abs(x)),
    "double.floor": ("long", lambda x: F.floor(x)),
    "double.ceil": ("long", lambda x: F.ceil(x)),
    "double.sqrt": ("double", lambda x: F.when(x >= 0, F.sqrt(x))),
    "double.log": ("double", lambda x: F.when(x > 0, F.ln(x))),
    "double.minimum": ("double", lambda x, y: F.least(x, y)),
    "double.maximum": ("double", lambda x, y: F.greatest(x, y)),
    "boolean.toString": ("string", lambda x: x.cast("string")),
    "boolean.booleanNot": ("boolean", lambda x: ~x),
    "boolean.booleanAnd": ("boolean", lambda x, y: x & y),
    "boolean.booleanOr": ("boolean", lambda x, y: x | y),
    "boolean.booleanXor": ("boolean", lambda x, y: x != y),
    "toUrl": ("string", lambda p, a, b, c, d: F.concat_ws(":", F.concat(F.lit("file://"), p), *(x.cast("string") for x in (a, b, c, d)))),
    "underlyingElement": ("same", lambda x: x),
    "mkElement": ("same", lambda x: x),
    "unresolveElement": ("same", lambda x: x),
    "newtypeId": ("long", lambda *xs: F.xxhash64(*xs)),
}
#: Tests: true or false.
TESTS: dict[str, Callable[..., Column]] = {
    "string.regexpMatch": lambda s, p: F.rlike(s, _whole(p)),
    "string.matches": lambda s, p: F.like(s, p),
    "string.isLowercase": lambda s: s == F.lower(s),
    "string.isUppercase": lambda s: s == F.upper(s),
}
MULTI: dict[str, tuple[str, Callable[..., Column]]] = {
    "string.indexOf": ("long", lambda s, t: _index_of(s, t).cast("array<bigint>")),
    "string.splitAt": ("string", lambda s, d: F.split(s, _quoted(d), -1)),
    "string.regexpFind": ("string", lambda s, p: F.regexp_extract_all(s, p, F.lit(0))),
}
