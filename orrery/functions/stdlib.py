"""The standard library as Spark expressions: operators, casts, aggregates, and functions by namespace.

A function takes columns and `kind`, which tells a column's type where overloads differ by it. All are built-in
expressions; none runs Python on rows.
"""

from __future__ import annotations

import decimal
import inspect

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError
from . import postgis
from .types import FLOATS, INTEGERS, is_integer, spark_type


def _error(text) -> Column:
    return F.raise_error(text if isinstance(text, Column) else F.lit(text))


def literal(value, kind: str) -> Column:
    if kind in ("decimal", "bigint"):
        return F.lit(decimal.Decimal(value)).cast(spark_type(kind))
    if kind == "int64":
        return F.lit(value).cast("bigint")
    return F.lit(value)


# --- operators


def _floor_div(a: Column, b: Column, kind) -> Column:
    if is_integer(kind(a)) and is_integer(kind(b)):
        q = F.call_function("div", a, b)
        wrong = (a % b != 0) & ((a < 0) != (b < 0))
        return q - F.when(wrong, 1).otherwise(0)
    return F.floor(a / b).cast("double")


def _concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def operator(op: str, a: Column, b: Column, kind) -> Column:
    if op == "/":
        return a.cast("double") / b if isinstance(kind(a), INTEGERS) else a / b
    if op == "//":
        return _floor_div(a, b, kind)
    simple = {
        "=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        "?=": lambda: a.eqNullSafe(b), "?!=": lambda: ~a.eqNullSafe(b), "and": lambda: a & b, "or": lambda: a | b,
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "**": lambda: F.pow(a, b),
        "++": lambda: _concat(a, b), "??": lambda: F.coalesce(a, b), "like": lambda: F.call_function("like", a, b), "ilike": lambda: F.call_function("ilike", a, b),
    }
    if op in ("=", "!=") and isinstance(ta := kind(a), T.StringType) != isinstance(tb := kind(b), T.StringType) and not isinstance(ta, T.NullType) and not isinstance(tb, T.NullType):
        raise QueryError(f"operator '{op}' cannot be applied to '{ta.simpleString()}' and '{tb.simpleString()}'")
    if op not in simple:
        raise QueryError(f"unknown operator '{op}'")
    return simple[op]()


def cast(c: Column, name: str, kind) -> Column:
    """Casts by the language's rules: floats round half to even to integers, decimals half up."""
    to, own = spark_type(name), kind(c)
    if to in ("smallint", "int", "bigint", "decimal(38,0)"):
        if isinstance(own, FLOATS):
            return F.rint(c).cast(to)
        if isinstance(own, T.DecimalType) and own.scale:
            return F.round(c).cast(to)
        if isinstance(own, T.VariantType):
            return c.cast(to)
        if isinstance(own, T.StringType):
            return F.trim(c).cast(to)
    if name.removeprefix("std::") == "duration" and isinstance(own, T.StringType):
        return _duration_of(c)
    if name == "cal::local_time":
        return c if isinstance(own, T.StringType) else F.date_format(c, "HH:mm:ss")
    if to == "variant":
        if isinstance(own, T.StringType):
            return F.parse_json(c)
        return F.to_variant_object(c) if isinstance(own, T.StructType | T.ArrayType) else c.cast("variant")
    if to == "string":
        if isinstance(own, T.TimestampType):
            base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
            return F.concat(base, micros, F.lit("+00:00"))
        if isinstance(own, T.TimestampNTZType):
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""))
        if isinstance(own, T.VariantType):
            return F.variant_get(c, "$", "string")
    return c.cast(to)


def _duration_of(c: Column) -> Column:
    """ISO 8601 durations of days and less, hours:minutes:seconds, and numbers with units."""
    text = F.lower(F.trim(c))
    iso, clock = text.rlike("^-?p"), text.rlike(r"^-?\d+:\d+")
    time_part = F.substring_index(text, "t", -1)

    def amount(short: str, unit: str, clock_group: int | None) -> Column:
        of = F.when(text.contains("t"), time_part).otherwise(F.lit("")) if short != "d" else F.substring_index(text, "t", 1)
        found = F.when(iso, F.regexp_extract(of, rf"(-?[0-9.]+){short}", 1))
        if clock_group:
            found = found.when(clock, F.regexp_extract(text, r"(\d+):(\d+)(?::([0-9.]+))?", clock_group))
        found = found.otherwise(F.regexp_extract(text, rf"(-?[0-9.]+)\s*{unit}", 1))
        return F.coalesce(F.nullif(found, F.lit("")).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))

    seconds = amount("d", "d(?:ay|$)", None) * 86400 + amount("h", "h(?:our|$)", 1) * 3600 + amount("m", "min", 2) * 60 + amount("s", "s(?:ec|$)", 3)
    good = iso | clock | text.rlike(r"[0-9.]+\s*(d|h|min|s)")
    return F.when(good, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(text.startswith("-") & (iso | clock), -seconds).otherwise(seconds).cast("decimal(18,6)"))).otherwise(_error(F.concat(F.lit("invalid duration "), c)).cast("interval day to second"))


def indexed(base: Column, at: Column, kind) -> Column:
    own = kind(base)
    if isinstance(own, T.VariantType):
        if isinstance(kind(at), T.StringType):
            return F.try_variant_get(base, F.concat(F.lit("$."), at), "variant")
        return F.try_variant_get(base, F.concat(F.lit("$["), at.cast("string"), F.lit("]")), "variant")
    if isinstance(own, T.ArrayType):
        n, what = F.size(base), "array"
        value = F.get(base, F.when(at < 0, n + at).otherwise(at).cast("int"))
    else:
        binary = isinstance(own, T.BinaryType)
        n, what = F.octet_length(base) if binary else F.char_length(base), "bytes" if binary else "string"
        value = F.substring(base, F.when(at < 0, n + at).otherwise(at).cast("int") + 1, F.lit(1))
    text = F.concat(F.lit(f"{what} index "), at.cast("string"), F.lit(" is out of bounds"))
    return F.when((at >= n) | (at < -n), _error(text)).otherwise(value)


def sliced(base: Column, lo: Column | None, hi: Column | None, kind) -> Column:
    own = kind(base)
    array = isinstance(own, T.ArrayType)
    n = F.size(base) if array else F.octet_length(base) if isinstance(own, T.BinaryType) else F.char_length(base)
    start = F.lit(0) if lo is None else F.greatest(F.when(lo < 0, n + lo).otherwise(lo), F.lit(0))
    end = n if hi is None else F.least(F.when(hi < 0, n + hi).otherwise(hi), n)
    length = F.greatest(end - start, F.lit(0)).cast("int")
    return F.slice(base, start.cast("int") + 1, length) if array else F.substring(base, start.cast("int") + 1, length)


# --- aggregates and set-returning functions


def _count(c: Column, distinct: bool) -> Column:
    return F.count_distinct(c) if distinct else F.count(c)


def _plain(f, of_distinct=None):
    def run(c: Column, distinct: bool) -> Column:
        if distinct:
            if of_distinct is None:
                return f(c)
            return of_distinct(c)
        return f(c)

    return run


AGGREGATES = {
    "count": _count, "sum": _plain(F.sum, F.sum_distinct), "min": _plain(F.min), "max": _plain(F.max), "mean": _plain(F.avg),
    "all": _plain(lambda c: F.coalesce(F.bool_and(c), F.lit(True))), "any": _plain(lambda c: F.coalesce(F.bool_or(c), F.lit(False))),
    "array_agg": _plain(lambda c: F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"]), F.collect_set),
    "math::mean": _plain(F.avg), "math::stddev": _plain(F.stddev_samp), "math::stddev_pop": _plain(F.stddev_pop), "math::var": _plain(F.var_samp), "math::var_pop": _plain(F.var_pop),
    **postgis.AGGREGATES,
}


def of_nothing(name: str, c: Column) -> Column:
    """The aggregate where its set was empty."""
    if name in ("count", "sum"):
        return F.coalesce(c, F.lit(0))
    if name in ("all", "any"):
        return F.coalesce(c, F.lit(name == "all"))
    return F.coalesce(c, F.array()) if name == "array_agg" else c


SET_RETURNING = {
    "array_unpack": lambda a: F.explode(a),
    "range_unpack": lambda r, step=None: F.explode(_range_points(r, step)),
    "json_array_unpack": lambda j: F.explode(F.variant_get(j, "$", "array<variant>")),
    "multirange_unpack": lambda m: F.explode(m),
    "re_match_all": lambda p, s: F.explode(_all_matches(p, s)),
    "json_object_unpack": lambda j: F.explode(F.map_entries(F.variant_get(j, "$", "map<string,variant>"))),
}


def _all_matches(p: Column, s: Column) -> Column:
    """The groups of each match, or the whole match of a pattern without groups."""
    n = _groups(p)
    lists = [F.call_function("regexp_extract_all", s, _java(p), F.lit(k)) for k in (range(1, n + 1) if n else (0,))]
    return F.transform(lists[0], lambda x, k: F.array(*[F.get(one, k) for one in lists]))


#: Set-returning functions as arrays, for where a row needs the whole set.
AS_ARRAY = {
    "array_unpack": lambda a: a,
    "range_unpack": lambda r, step=None: _range_points(r, step),
    "json_array_unpack": lambda j: F.variant_get(j, "$", "array<variant>"),
    "multirange_unpack": lambda m: m,
    "re_match_all": lambda p, s: _all_matches(p, s),
    "json_object_unpack": lambda j: F.map_entries(F.variant_get(j, "$", "map<string,variant>")),
}


def _range_points(r: Column, step: Column | None) -> Column:
    by = F.lit(1).cast("bigint") if step is None else step
    lo = F.when(r["inc_lower"], r["lower"]).otherwise(r["lower"] + by)
    hi = F.when(r["inc_upper"], r["upper"]).otherwise(r["upper"] - 1)
    return F.when(r["empty"] | (lo > hi), F.array().cast("array<bigint>")).otherwise(F.sequence(lo, hi, by))


# --- ranges


def _range(a, named, kind) -> Column:
    names = ["lower", "upper", "inc_lower", "inc_upper", "empty"]
    given = dict(zip(names, a, strict=False)) | named
    lower, upper = given.get("lower", F.lit(None)), given.get("upper", F.lit(None))
    own = kind(lower) if not isinstance(kind(lower), T.NullType) else kind(upper)
    lower, upper = lower.cast(own), upper.cast(own)
    il, iu = given.get("inc_lower", F.lit(True)), given.get("inc_upper", F.lit(False))
    if is_integer(own):  # discrete ranges are kept as [lower, upper)
        lower, upper = F.when(il, lower).otherwise(lower + 1), F.when(iu, upper + 1).otherwise(upper)
        il, iu = F.lit(True), F.lit(False)
    il, iu = il & lower.isNotNull(), iu & upper.isNotNull()
    none = given.get("empty", F.lit(False)) | F.coalesce((lower > upper) | (lower == upper) & ~(il & iu), F.lit(False))
    wrong = F.coalesce(lower > upper, F.lit(False))
    none = F.when(wrong, _error("range lower bound must be less than or equal to range upper bound").cast("boolean")).otherwise(none)
    return F.struct(lower.alias("lower"), upper.alias("upper"), il.alias("inc_lower"), iu.alias("inc_upper"), none.alias("empty"))


def _merged_ranges(rs: Column) -> Column:
    """Sorted, without empty ranges, those that overlap or touch as one."""
    sorted_ = F.array_sort(F.filter(rs, lambda r: ~r["empty"]))

    def add(done, r):
        last = F.element_at(done, -1)
        meets = last["upper"].isNull() | r["lower"].isNull() | (r["lower"] < last["upper"]) | (r["lower"] == last["upper"]) & (last["inc_upper"] | r["inc_lower"])
        further = r["upper"].isNull() & last["upper"].isNotNull() | (r["upper"] > last["upper"]) | (r["upper"] == last["upper"]) & r["inc_upper"]
        both = F.when(F.coalesce(further, F.lit(False)), last.withField("upper", r["upper"]).withField("inc_upper", r["inc_upper"])).otherwise(last)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))
        return F.when(F.size(done) == 0, F.array(r)).when(F.coalesce(meets, F.lit(False)), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(sorted_, F.slice(sorted_, F.lit(1), F.lit(0)), add)


def _has_point(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (x > r["lower"]) | (r["inc_lower"] & (x == r["lower"]))
    high = r["upper"].isNull() | (x < r["upper"]) | (r["inc_upper"] & (x == r["upper"]))
    return ~r["empty"] & low & high


def _below(a: Column, b: Column) -> Column:
    """Whether all of a lies before all of b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["upper"] < b["lower"]) | (a["upper"] == b["lower"]) & ~(a["inc_upper"] & b["inc_lower"]), F.lit(False))


def _pairs(f):
    """A test of two ranges, or of any two of two multiranges."""

    def run(a: Column, b: Column, kind) -> Column:
        if isinstance(kind(a), T.ArrayType):
            return F.exists(a, lambda x: F.exists(b, lambda y: f(x, y)))
        return f(a, b)

    return run


def _every(f):
    def run(a: Column, b: Column, kind) -> Column:
        if isinstance(kind(a), T.ArrayType):
            return F.forall(a, lambda x: F.forall(b, lambda y: f(x, y)))
        return f(a, b)

    return run


def _overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~_below(a, b) & ~_below(b, a)


def _covers(a: Column, b: Column) -> Column:
    low = a["lower"].isNull() | F.coalesce((b["lower"] > a["lower"]) | (b["lower"] == a["lower"]) & (a["inc_lower"] | ~b["inc_lower"]), F.lit(False))
    high = a["upper"].isNull() | F.coalesce((b["upper"] < a["upper"]) | (b["upper"] == a["upper"]) & (a["inc_upper"] | ~b["inc_upper"]), F.lit(False))
    return b["empty"] | ~a["empty"] & low & high


def _adjacent(a: Column, b: Column) -> Column:
    meet = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["inc_upper"] != y["inc_lower"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meet(a, b) | meet(b, a))


def _contains(a, kind) -> Column:
    own, other = kind(a[0]), kind(a[1])
    if isinstance(own, T.StructType):
        return _covers(a[0], a[1]) if isinstance(other, T.StructType) else _has_point(a[0], a[1])
    if isinstance(own, T.ArrayType) and isinstance(own.elementType, T.StructType):
        if isinstance(other, T.StructType):
            return F.exists(a[0], lambda r: _covers(r, a[1]))
        if isinstance(other, T.ArrayType):
            return F.forall(a[1], lambda s: F.exists(a[0], lambda r: _covers(r, s)))
        return F.exists(a[0], lambda r: _has_point(r, a[1]))
    if isinstance(own, T.ArrayType):
        return F.coalesce(F.array_contains(a[0], a[1]), F.lit(False))
    return F.contains(a[0], a[1])


# --- text, numbers, bytes, arrays


def _split(s: Column, d: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), d, F.lit("\\E"))
    return F.when(s == "", F.array().cast("array<string>")).when(d == "", F.array(s)).otherwise(F.split(s, quoted, -1))


def _str_slice(s: Column, lo: Column, hi: Column | None = None) -> Column:
    start = F.greatest(lo, F.lit(0))
    if hi is None:
        return F.substring(s, start.cast("int") + 1, F.char_length(s))
    return F.when(hi < lo, _error("negative substring length not allowed")).otherwise(F.substring(s, start.cast("int") + 1, F.greatest(hi - start, F.lit(0)).cast("int")))


def _java(pattern: Column) -> Column:
    """A POSIX pattern in Java's dialect."""
    for old, new in (("\\m", "\\b"), ("\\M", "\\b"), ("\\y", "\\b"), ("[[:alpha:]]", "\\p{Alpha}"), ("[[:digit:]]", "\\p{Digit}"), ("[[:space:]]", "\\s"), ("[[:alnum:]]", "\\p{Alnum}")):
        pattern = F.replace(pattern, F.lit(old), F.lit(new))
    return pattern


def _re_replace(a, named, kind) -> Column:
    pattern, sub, s = a[:3]
    flags = a[3] if len(a) > 3 else named.get("flags", F.lit(""))
    pattern = F.concat(F.when(F.contains(flags, F.lit("i")), F.lit("(?i)")).otherwise(F.lit("")), _java(pattern))
    sub = F.regexp_replace(F.replace(sub, F.lit("$"), F.lit("\\$")), r"\\(\d)", r"\$$1")
    every = F.regexp_replace(s, pattern, sub)
    first = F.regexp_replace(s, F.concat(F.lit("(?s)^(.*?)(?:"), pattern, F.lit(")(.*)$")), F.concat(F.lit("$1"), sub, F.lit("$2")))
    simple = ~F.contains(sub, F.lit("$")) & ~pattern.contains("(")
    return F.when(F.contains(flags, F.lit("g")), every).when(simple, first).otherwise(every)


def _groups(p: Column) -> int:
    """How many groups a literal pattern has."""
    import re

    try:
        return re.compile(_text_of(p)).groups
    except re.error:
        return 0


def _re_match(p: Column, s: Column) -> Column:
    n = _groups(p)
    got = [F.call_function("regexp_extract", s, _java(p), F.lit(k)) for k in (range(1, n + 1) if n else (0,))]
    return F.when(F.rlike(s, _java(p)), F.array(*got)).otherwise(F.array().cast("array<string>"))


def _length(c: Column, kind) -> Column:
    own = kind(c)
    if isinstance(own, T.ArrayType):
        return F.nullif(F.size(c), F.lit(0)).cast("bigint")
    return (F.octet_length(c) if isinstance(own, T.BinaryType) else F.char_length(c)).cast("bigint")


def _find(a, kind) -> Column:
    own = kind(a[0])
    if isinstance(own, T.ArrayType):
        if len(a) > 2:
            rest = F.slice(a[0], a[2].cast("int") + 1, F.size(a[0]))
            at = F.array_position(rest, a[1])
            return F.when(at > 0, at - 1 + a[2]).otherwise(-1).cast("bigint")
        return (F.coalesce(F.array_position(a[0], a[1]), F.lit(0)) - 1).cast("bigint")
    if isinstance(own, T.BinaryType):
        at = F.instr(F.hex(a[0]), F.hex(a[1]))
        return (F.when(at > 0, (at - 1) / 2).otherwise(-1)).cast("bigint")
    return (F.instr(a[0], a[1]) - 1).cast("bigint")


def _guard(wrong: Column, text: str, value: Column) -> Column:
    return F.when(wrong, _error(text)).otherwise(value)


def _same_type(c: Column, value: Column, kind) -> Column:
    return value.cast(kind(c))


def _round(a, kind) -> Column:
    if isinstance(kind(a[0]), FLOATS):
        if len(a) > 1:
            raise QueryError("no overload of 'round' takes a float and digits; cast to decimal first")
        return F.rint(a[0])
    return F.round(a[0], a[1] if len(a) > 1 else 0)


def _log(a, named, kind) -> Column:
    base = a[1] if len(a) > 1 else named.get("base")
    bad = a[0] <= 0
    text = "cannot take logarithm of a non-positive number"
    return _guard(bad, text, F.log10(a[0]) if base is None else F.ln(a[0].cast("double")) / F.ln(base.cast("double")))


def _bit_count(c: Column, kind) -> Column:
    own = kind(c)
    if isinstance(own, T.BinaryType):
        digits = F.split(F.hex(c), "")
        ones = F.transform(digits, lambda d: F.bit_count(F.conv(F.when(d == "", F.lit("0")).otherwise(d), 16, 10).cast("int")))
        return F.aggregate(ones, F.lit(0), lambda s, x: s + x).cast("bigint")
    if isinstance(own, T.ShortType):
        c = c.cast("int").bitwiseAND(0xFFFF)
    elif isinstance(own, T.IntegerType):
        c = c.cast("bigint").bitwiseAND(0xFFFFFFFF)
    return F.bit_count(c).cast("bigint")


def _to_bytes(a, named, kind) -> Column:
    own = kind(a[0])
    if isinstance(own, T.StringType):
        return F.encode(a[0], "UTF-8")
    if isinstance(own, INTEGERS):
        width = {T.ShortType: 4, T.IntegerType: 8}.get(type(own), 16)
        digits = F.substring(F.lpad(F.hex(a[0].cast("bigint")), 16, "0"), 17 - width, width)
        big = F.unhex(digits)
        little = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"))), ""))
        return F.when(a[1] == "Big", big).otherwise(little)
    if isinstance(own, T.VariantType):
        return F.encode(F.to_json(a[0]), "UTF-8")
    raise QueryError("no overload of 'to_bytes' takes this argument")


def _base64(a, named, kind, back: bool = False) -> Column:
    alphabet = a[1] if len(a) > 1 else named.get("alphabet", F.lit("standard"))
    padding = a[2] if len(a) > 2 else named.get("padding", F.lit(True))
    if back:
        return F.unbase64(F.translate(a[0], "-_", "+/"))
    out = F.base64(a[0])
    out = F.when(alphabet == "urlsafe", F.translate(out, "+/", "-_")).otherwise(out)
    return F.when(padding, out).otherwise(F.rtrim(out, F.lit("=")))


def _json_get(a, named, kind) -> Column:
    path = F.lit("$")
    for step in a[1:]:
        path = F.concat(path, F.when(step.rlike(r"^\d+$"), F.concat(F.lit("["), step, F.lit("]"))).otherwise(F.concat(F.lit("['"), step, F.lit("']"))))
    got = F.try_variant_get(a[0], path, "variant")
    return F.coalesce(got, named["default"]) if "default" in named else got


def _json_typeof(j: Column) -> Column:
    s = F.schema_of_variant(j)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    )


# --- dates and durations

# Units of truncation and the names of date parts.
UNITS = {"microseconds": "microsecond", "milliseconds": "millisecond", "seconds": "second", "minutes": "minute", "hours": "hour", "days": "day", "weeks": "week", "months": "month", "quarters": "quarter", "years": "year"}
PARTS = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minutes": "minute", "minute": "minute", "quarter": "quarter", "week": "week", "doy": "doy"}


def _text_of(c: Column) -> str:
    """The value of a literal column, which units and parts must be."""
    plan = c._jc.toString()
    return plan.strip("'\"")


def _truncate(a, kind) -> Column:
    unit = _text_of(a[1])
    if unit in ("decades", "centuries"):
        size = 10 if unit == "decades" else 100
        first = (F.floor(F.year(a[0]) / size) * size).cast("int") if size == 10 else (F.floor((F.year(a[0]) - 1) / size) * size + 1).cast("int")
        return F.make_timestamp(first, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast(kind(a[0]))
    if unit not in UNITS:
        raise QueryError(f"invalid unit '{unit}'")
    return F.date_trunc(UNITS[unit], a[0]).cast(kind(a[0]))


def _part(a, kind) -> Column:
    part, d = _text_of(a[1]), a[0]
    if isinstance(kind(d), T.StringType):  # a time of day
        h, m, s = (F.split(d, ":")[k].cast("double") for k in range(3))
        times = {"hour": h, "hours": h, "minutes": m, "minute": m, "seconds": s, "second": s, "midnightseconds": h * 3600 + m * 60 + s}
        if part not in times:
            raise QueryError(f"invalid unit '{part}'")
        return times[part]
    if part in PARTS:
        return F.extract(F.lit(PARTS[part]), d).cast("double")
    if part == "dow":
        return (F.dayofweek(d) - 1).cast("double")
    if part == "isodow":
        return (F.weekday(d) + 1).cast("double")
    if part in ("seconds", "second"):
        return F.extract(F.lit("second"), d).cast("double")
    if part in ("epoch", "epochseconds"):
        return (F.unix_micros(d.cast("timestamp")) / 1e6).cast("double")
    if part == "decade":
        return F.floor(F.year(d) / 10).cast("double")
    if part == "century":
        return F.ceil(F.year(d) / 100).cast("double")
    if part == "millennium":
        return F.ceil(F.year(d) / 1000).cast("double")
    raise QueryError(f"invalid unit '{part}'")


def _duration_seconds(d: Column) -> Column:
    return F.extract(F.lit("day"), d) * 86400 + F.extract(F.lit("hour"), d) * 3600 + F.extract(F.lit("minute"), d) * 60 + F.extract(F.lit("second"), d)


def _to_duration(a, named, kind) -> Column:
    get = lambda k: named.get(k, F.lit(0))
    secs = get("seconds").cast("decimal(18,6)") + get("microseconds").cast("decimal(18,6)") / 1000000
    return F.make_dt_interval(F.lit(0), get("hours").cast("int"), get("minutes").cast("int"), secs.cast("decimal(18,6)"))


def _to_datetime(a, named, kind) -> Column:
    if len(a) >= 7:
        i = [x.cast("int") for x in a[:5]]
        return F.make_timestamp(*i, a[5].cast("decimal(16,6)"), a[6])
    own = kind(a[0])
    if isinstance(own, T.TimestampNTZType):
        return F.to_utc_timestamp(a[0].cast("timestamp"), a[1])
    if isinstance(own, INTEGERS + FLOATS + (T.DecimalType,)):
        return F.timestamp_micros((a[0].cast("decimal(38,6)") * 1000000).cast("bigint"))
    return a[0].cast("timestamp")


def _local(a, kind, to: str) -> Column:
    own = kind(a[0])
    if isinstance(own, T.TimestampType) and len(a) > 1:
        return F.from_utc_timestamp(a[0], a[1]).cast(to)
    if len(a) == 3 and to == "date":
        return F.make_date(*[x.cast("int") for x in a])
    if len(a) == 6:
        return F.make_timestamp_ntz(*[x.cast("int") for x in a[:5]], a[5].cast("decimal(16,6)"))
    return a[0].cast(to)


def _uuid_version(u: Column) -> Column:
    return F.conv(F.substring(u, 15, 1), 16, 10).cast("bigint")


def _to_uuid(b: Column) -> Column:
    h = F.lower(F.hex(b))
    parts = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return _guard(F.octet_length(b) != 16, "uuid needs 16 bytes", parts)


def _numeric(to: str):
    def run(a, named, kind) -> Column:
        if len(a) > 1:
            if isinstance(kind(a[0]), T.BinaryType):
                digits = F.hex(a[0])
                back = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"))), "")
                width = {"int16": 16, "int32": 32, "int64": 64}[to]
                n = F.conv(F.when(a[1] == "Big", digits).otherwise(back), 16, 10).cast("decimal(38,0)")
                return F.when(n >= 2 ** (width - 1), n - 2**width).otherwise(n).cast(spark_type(to))
            return F.to_number(a[0], F.lit(_text_of(a[1]).replace("FM", ""))).cast(spark_type(to))
        if isinstance(kind(a[0]), T.BooleanType):
            return a[0].cast("int").cast(spark_type(to))
        return cast(a[0], to, kind)

    return run


def _to_str(a, named, kind) -> Column:
    if len(a) > 1:
        own = kind(a[0])
        if isinstance(own, T.ArrayType):
            return F.array_join(a[0], _text_of(a[1]))
        if isinstance(own, INTEGERS + FLOATS + (T.DecimalType,)):
            fmt = _text_of(a[1])
            shown = F.to_char(a[0].cast("decimal(38,10)"), F.lit(fmt.replace("FM", "")))
            return F.trim(shown) if "FM" in fmt else F.concat(F.when(a[0] < 0, "").otherwise(" "), shown)
        return F.date_format(a[0], _java_dates(_text_of(a[1])))
    return cast(a[0], "str", kind)


def _java_dates(fmt: str) -> str:
    for old, new in (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("DD", "dd"), ("Mon", "MMM"), ("AM", "a"), ("PM", "a")):
        fmt = fmt.replace(old, new)
    return fmt


def _array_set(a: Column, at: Column, v: Column, drop: int) -> Column:
    return F.concat(F.slice(a, F.lit(1), at.cast("int")), F.array(v), F.slice(a, at.cast("int") + 1 + drop, F.size(a)))


def _rotate(a: Column, n: Column) -> Column:
    k = F.pmod(n, F.greatest(F.size(a), F.lit(1))).cast("int")
    return F.concat(F.slice(a, k + 1, F.size(a)), F.slice(a, F.lit(1), k))


def _array_get(a, named, kind) -> Column:
    got = F.when(a[1] < 0, F.lit(None)).otherwise(F.get(a[0], a[1].cast("int")))
    default = a[2] if len(a) > 2 else named.get("default")
    return got if default is None else F.coalesce(got, default)


def _json_set(a, named, kind) -> Column:
    """json_set(target, path…, value := j): the target with the value at the path."""
    create = named.get("create_if_missing", F.lit(True))
    treat = named.get("empty_treatment", F.lit("ReturnEmpty"))
    value = named["value"]
    path = F.array(*[p.cast("string") for p in a[1:]])

    def run(target, path, value, create, treat):
        import json

        if target is None:
            return None
        if value is None:
            if treat == "ReturnEmpty":
                return None
            if treat == "ReturnTarget":
                return target
            if treat == "Error":
                raise ValueError("json_set: the value is empty")
        root = json.loads(target)
        at = root
        for k, step in enumerate(path):
            last = k == len(path) - 1
            if isinstance(at, list):
                n = int(step) if step.lstrip("-").isdigit() else None
                if n is None:
                    return target
                n = n + len(at) if n < 0 else n
                there = 0 <= n < len(at)
                step = n
            elif isinstance(at, dict):
                there = step in at
            else:
                return target
            if not last:
                if not there:
                    return target
                at = at[step]
            elif value is None and treat == "DeleteKey":
                if there:
                    del at[step]
            elif there:
                at[step] = None if value is None else json.loads(value)
            elif create:
                if isinstance(at, list):
                    at.append(None if value is None else json.loads(value))
                else:
                    at[step] = None if value is None else json.loads(value)
        return json.dumps(root)

    return F.parse_json(F.udf(run, "string", useArrow=True)(F.to_json(a[0]), path, F.to_json(value), create, treat))


def _duration_truncate(a, kind) -> Column:
    unit = _text_of(a[1])
    # Microseconds of the units of durations, months of the longer ones.
    sizes = {"microseconds": 1, "milliseconds": 1000, "seconds": 10**6, "minutes": 6 * 10**7, "hours": 36 * 10**8}
    months = {"months": 1, "quarters": 3, "years": 12, "decades": 120, "centuries": 1200}
    if isinstance(kind(a[0]), T.StructType):
        m, d, u = a[0]["months"], a[0]["days"], a[0]["micros"]
        if unit in months:
            return _span(F.expr("0") + F.call_function("div", m, F.lit(months[unit])) * months[unit], F.lit(0), F.lit(0))
        if unit in ("days", "weeks"):
            n = 7 if unit == "weeks" else 1
            return _span(m, F.call_function("div", d, F.lit(n)) * n, F.lit(0))
        return _span(m, d, F.call_function("div", u, F.lit(sizes[unit])) * sizes[unit])
    if unit not in sizes:
        raise QueryError(f"invalid unit '{unit}'")
    micros = (_duration_seconds(a[0]).cast("decimal(30,6)") * 10**6).cast("bigint")
    whole = F.call_function("div", micros, F.lit(sizes[unit]).cast("bigint")) * sizes[unit]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole / 10**6).cast("decimal(18,6)"))


def _uuid7() -> Column:
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    parts = [F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(rest, 14, 3)), F.substring(rest, 17, 4), F.substring(rest, 21, 12)]
    return F.concat_ws("-", *parts)


def _to_local_time(a, named, kind) -> Column:
    """Times of day are text, HH:MM:SS with the fraction that there is."""
    if len(a) == 3:
        secs = F.lpad(F.regexp_replace(F.format_number(a[2].cast("double"), 6), r"\.?0+$", ""), 2, "0")
        return F.concat_ws(":", F.lpad(a[0].cast("string"), 2, "0"), F.lpad(a[1].cast("string"), 2, "0"), F.when(F.length(F.substring_index(secs, ".", 1)) < 2, F.concat(F.lit("0"), secs)).otherwise(secs))
    own = kind(a[0])
    if isinstance(own, T.TimestampType) and len(a) > 1:
        return F.date_format(F.from_utc_timestamp(a[0], a[1]), "HH:mm:ss")
    if isinstance(own, T.StringType):
        return F.date_format(F.to_timestamp(a[0], F.lit(_java_dates(_text_of(a[1])) if len(a) > 1 else "HH:mm:ss")), "HH:mm:ss")
    return F.date_format(a[0], "HH:mm:ss")


def _span(months: Column, days: Column, micros: Column) -> Column:
    """Relative and date durations: months, days and microseconds apart."""
    return F.struct(months.cast("bigint").alias("months"), days.cast("bigint").alias("days"), micros.cast("bigint").alias("micros"))


def _relative(a, named, kind) -> Column:
    names = ("years", "months", "days", "hours", "minutes", "seconds", "microseconds")
    given = dict(zip(names, a, strict=False)) | named
    get = lambda k: given.get(k, F.lit(0))
    micros = (get("hours") * 3600 + get("minutes") * 60) * F.lit(10**6).cast("bigint") + F.round(get("seconds").cast("double") * 1e6).cast("bigint") + get("microseconds")
    return _span(get("years") * 12 + get("months"), get("days"), micros)


def _normal_hours(d: Column) -> Column:
    day = F.lit(86_400_000_000).cast("bigint")
    more = F.call_function("div", d["micros"], day)
    return _span(d["months"], d["days"] + more, d["micros"] - more * day)


def _normal_days(d: Column) -> Column:
    more = F.call_function("div", d["days"], F.lit(30).cast("bigint"))
    return _span(d["months"] + more, d["days"] - more * 30, d["micros"])


def _hmac(data: Column, key: Column, name: Column) -> Column:
    how = _text_of(name)
    if how not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        raise QueryError(f"unknown digest '{how}'")

    def run(data, key):
        import hashlib
        import hmac

        return None if data is None or key is None else hmac.new(bytes(key), bytes(data), getattr(hashlib, how)).digest()

    return F.udf(run, "binary", useArrow=True)(data.cast("binary"), key.cast("binary"))


def _gen_salt(a, named, kind) -> Column:
    if not a or _text_of(a[0]) != "md5":
        raise QueryError("'crypto::gen_salt' makes 'md5' salts only: the others need a library")
    return F.concat(F.lit("$1$"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def _crypt(password: Column, salt: Column) -> Column:
    """The md5-based scheme, salts $1$….

    Fixed values: its alphabet, its thousand rounds and the order in which it writes the digest's bytes."""
    letters = "./0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    written = ((0, 6, 12), (1, 7, 13), (2, 8, 14), (3, 9, 15), (4, 10, 5))

    def run(password, salt):
        from hashlib import md5

        if password is None or salt is None:
            return None
        if not salt.startswith("$1$"):
            raise ValueError("crypt takes salts that begin with $1$ only")
        p, s = password.encode(), salt[3:].split("$")[0][:8].encode()
        mixed = md5(p + s + p).digest()
        start = p + b"$1$" + s + (mixed * (len(p) // 16 + 1))[: len(p)]
        n = len(p)
        while n:
            start += b"\0" if n & 1 else p[:1]
            n >>= 1
        d = md5(start).digest()
        for k in range(1000):
            d = md5((p if k & 1 else d) + (s if k % 3 else b"") + (p if k % 7 else b"") + (d if k & 1 else p)).digest()
        out = ""
        for v, count in [*[((d[a] << 16) | (d[b] << 8) | d[c], 4) for a, b, c in written], (d[11], 2)]:
            for _ in range(count):
                out, v = out + letters[v & 63], v >> 6
        return "$1$" + s.decode() + "$" + out

    return F.udf(run, "string", useArrow=True)(password, salt)


def _distance(kind_of: str):
    def run(a: Column, b: Column) -> Column:
        zero = F.lit(0.0)
        pairs = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), zero, lambda s, v: s + v)
        if kind_of == "l2":
            return F.sqrt(pairs(lambda x, y: (x - y) * (x - y)))
        if kind_of == "l1":
            return pairs(lambda x, y: F.abs(x - y))
        dot = pairs(lambda x, y: x * y)
        if kind_of == "ip":
            return -dot
        norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, lambda s, x: s + x))
        size = norm(a) * norm(b)
        return F.when(size == 0, F.lit(float("nan"))).otherwise(1 - dot / F.nullif(size, F.lit(0.0)))

    return run


def _n(f):
    """A function of its positional arguments alone."""

    def run(a, named, kind):
        return f(*a)

    run.takes = f
    return run


def _k(f):
    """A function of its arguments' list and the types."""
    return lambda a, named, kind: f(a, kind)


FUNCTIONS = {
    "str_lower": _n(F.lower), "str_upper": _n(F.upper), "str_title": _n(F.initcap), "str_reverse": _n(F.reverse),
    "str_pad_start": _n(lambda s, n, f=None: F.lpad(s, n.cast("int"), F.lit(" ") if f is None else f)), "str_pad_end": _n(lambda s, n, f=None: F.rpad(s, n.cast("int"), F.lit(" ") if f is None else f)),
    "str_trim": _n(lambda s, c=None: F.btrim(s, F.lit(" ") if c is None else c)), "str_trim_start": _n(lambda s, c=None: F.ltrim(s, F.lit(" ") if c is None else c)),
    "str_trim_end": _n(lambda s, c=None: F.rtrim(s, F.lit(" ") if c is None else c)), "str_repeat": _n(lambda s, n: F.repeat(s, n.cast("int"))), "str_replace": _n(F.replace),
    "str_split": _n(_split), "str_contains": _n(F.contains), "str_starts_with": _n(F.startswith), "str_ends_with": _n(F.endswith), "str_slice": _n(_str_slice), "str_len": _n(lambda s: F.char_length(s).cast("bigint")),
    "re_match": _n(_re_match), "re_replace": _re_replace, "re_test": _n(lambda p, s: F.rlike(s, _java(p))), "find": _k(_find), "len": lambda a, n, k: _length(a[0], k), "contains": _k(_contains),
    "abs": _n(F.abs), "ceil": lambda a, n, k: _same_type(a[0], F.ceil(a[0]), k), "floor": lambda a, n, k: _same_type(a[0], F.floor(a[0]), k), "round": _k(_round), "sign": lambda a, n, k: _same_type(a[0], F.sign(a[0]), k),
    "sqrt": _n(lambda x: _guard(x < 0, "cannot take square root of a negative number", F.sqrt(x))), "random": _n(F.rand),
    "uuid_generate_v4": _n(F.uuid), "uuid_extract_version": _n(_uuid_version), "to_uuid": _n(_to_uuid),
    "uuid_extract_timestamp": _n(lambda u: F.timestamp_millis(F.conv(F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint"))),
    "to_json": _n(F.parse_json), "json_typeof": _n(_json_typeof), "json_get": _json_get, "json_array_length": _n(lambda j: F.size(F.variant_get(j, "$", "array<variant>")).cast("bigint")),
    "bit_and": _n(lambda a, b: a.bitwiseAND(b)), "bit_or": _n(lambda a, b: a.bitwiseOR(b)), "bit_xor": _n(lambda a, b: a.bitwiseXOR(b)), "bit_not": _n(F.bitwise_not), "bit_count": lambda a, n, k: _bit_count(a[0], k),
    "bit_lshift": lambda a, n, k: _same_type(a[0], F.call_function("shiftleft", a[0], a[1].cast("int")), k), "bit_rshift": lambda a, n, k: _same_type(a[0], F.call_function("shiftright", a[0], a[1].cast("int")), k),
    "to_hex": _n(lambda n: F.lower(F.hex(n.cast("bigint")))), "from_hex": _n(F.unhex), "bytes_get": _n(lambda b, n: F.conv(F.hex(F.substring(b, n.cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")),
    "bytes_get_bit": _n(lambda b, n: F.call_function("getbit", F.conv(F.hex(F.substring(b, F.floor(n / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), (n % 8).cast("int")).cast("bigint")),
    "to_bytes": _to_bytes, "enc::base64_encode": _base64, "enc::base64_decode": lambda a, n, k: _base64(a, n, k, back=True),
    **{f"to_{t}": _numeric(t) for t in ("int16", "int32", "int64", "float32", "float64", "decimal", "bigint")}, "to_bool": lambda a, n, k: a[0].cast("boolean"), "to_str": _to_str,
    "array_get": _array_get, "array_join": _n(lambda a, d: F.array_join(a, _text_of(d))), "array_slice": lambda a, n, k: sliced(a[0], a[1], a[2] if len(a) > 2 else None, k),
    "array_index_of": _n(lambda a, x: (F.coalesce(F.array_position(a, x), F.lit(0)) - 1).cast("bigint")), "array_fill": _n(lambda x, n: F.array_repeat(x, n.cast("int"))),
    "array_replace": _n(lambda a, old, new: F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))), "array_reverse": _n(F.reverse),
    "array_set": _n(lambda a, i, v: _array_set(a, i, v, 1)), "array_insert": _n(lambda a, i, v: _array_set(a, i, v, 0)), "array_rotate": _n(_rotate),
    "range": _range, "range_get_lower": _n(lambda r: r["lower"]), "range_get_upper": _n(lambda r: r["upper"]), "range_is_empty": _n(lambda r: r["empty"]), "range_is_inclusive_lower": _n(lambda r: r["inc_lower"]), "range_is_inclusive_upper": _n(lambda r: r["inc_upper"]),
    "overlaps": lambda a, n, k: _pairs(_overlaps)(a[0], a[1], k), "adjacent": lambda a, n, k: _pairs(_adjacent)(a[0], a[1], k), "strictly_below": lambda a, n, k: _every(_below)(a[0], a[1], k), "strictly_above": lambda a, n, k: _every(_below)(a[1], a[0], k),
    "bounded_above": _n(lambda a, b: ~a["empty"] & ~b["empty"] & F.coalesce(b["upper"].isNull() | (a["upper"] < b["upper"]) | (a["upper"] == b["upper"]) & (b["inc_upper"] | ~a["inc_upper"]), F.lit(False))),
    "bounded_below": _n(lambda a, b: ~a["empty"] & ~b["empty"] & F.coalesce(b["lower"].isNull() | (a["lower"] > b["lower"]) | (a["lower"] == b["lower"]) & (b["inc_lower"] | ~a["inc_lower"]), F.lit(False))),
    "multirange": _n(lambda rs: _merged_ranges(rs)),
    "datetime_current": _n(F.current_timestamp), "datetime_of_statement": _n(F.current_timestamp), "datetime_of_transaction": _n(F.current_timestamp),
    "datetime_get": _k(_part), "cal::date_get": _k(_part), "cal::time_get": _k(_part), "datetime_truncate": _k(_truncate), "datetime_shift": _n(lambda d, by: d + by),
    "duration_to_seconds": _n(lambda d: _duration_seconds(d).cast("decimal(38,6)")), "to_duration": _to_duration, "to_datetime": _to_datetime,
    "duration_get": _n(lambda d, el: _duration_seconds(d).cast("double") if _text_of(el) in ("totalseconds", "epoch") else F.extract(F.lit({"hours": "hour", "minutes": "minute", "seconds": "second", "hour": "hour", "day": "day"}[_text_of(el)]), d).cast("double")),
    "cal::to_local_date": lambda a, n, k: _local(a, k, "date"), "cal::to_local_datetime": lambda a, n, k: _local(a, k, "timestamp_ntz"),
    "math::pi": _n(F.pi), "math::e": _n(F.e), "math::exp": _n(F.exp), "math::ln": _n(lambda x: _guard(x <= 0, "cannot take logarithm of a non-positive number", F.ln(x))), "math::log": _log, "math::log10": _log, "math::lg": _log, "math::log2": _n(F.log2),
    **{f"math::{f}": _n(getattr(F, f)) for f in ("sin", "cos", "tan", "cot", "asin", "acos", "atan", "atan2", "abs")},
    "math::ceil": lambda a, n, k: _same_type(a[0], F.ceil(a[0]), k), "math::floor": lambda a, n, k: _same_type(a[0], F.floor(a[0]), k), "math::sqrt": _n(lambda x: _guard(x < 0, "cannot take square root of a negative number", F.sqrt(x))),
    "assert": lambda a, n, k: F.when(a[0], F.lit(True)).otherwise(_error(a[1] if len(a) > 1 else n.get("message", F.lit("assertion failed"))).cast("boolean")),
    "sys::get_current_database": _n(F.current_database), "sys::get_version_as_str": _n(lambda: F.lit("0.1.0")),
    "crypto::digest": _n(lambda d, t: {"md5": F.unhex(F.md5(d)), "sha1": F.unhex(F.sha1(d)), "sha224": F.unhex(F.sha2(d, 224)), "sha256": F.unhex(F.sha2(d, 256)), "sha384": F.unhex(F.sha2(d, 384)), "sha512": F.unhex(F.sha2(d, 512))}[_text_of(t)]),
    "pgvector::l2_distance": _n(_distance("l2")), "pgvector::euclidean_distance": _n(_distance("l2")), "pgvector::neg_inner_product": _n(_distance("ip")),
    "json_set": _json_set, "duration_truncate": _k(_duration_truncate), "uuid_generate_v7": _n(_uuid7), "sys::get_version": _n(lambda: F.struct(F.lit(0).cast("bigint").alias("0"), F.lit(1).cast("bigint").alias("1"), F.lit("final").alias("2"), F.lit(0).cast("bigint").alias("3"), F.array().cast("array<string>").alias("4"))),
    "cal::to_local_time": _to_local_time, "cal::to_relative_duration": _relative, "cal::to_date_duration": _relative, "cal::duration_normalize_hours": _n(_normal_hours), "cal::duration_normalize_days": _n(_normal_days),
    "crypto::hmac": _n(_hmac), "crypto::gen_salt": _gen_salt, "crypto::crypt": _n(_crypt), "pgvector::l1_distance": _n(_distance("l1")), "pgvector::inner_product": _n(lambda a, b: -_distance("ip")(a, b)), "pgvector::cosine_distance": _n(_distance("cosine")), "pgvector::vector_dims": _n(lambda v: F.size(v).cast("bigint")),
}


FUNCTIONS |= postgis.functions()


def call(name: str, args: list[Column], named: dict[str, Column], kind) -> Column:
    fn = FUNCTIONS.get(name)
    if fn is None:
        import difflib

        near = difflib.get_close_matches(name, [*FUNCTIONS, *AGGREGATES, *SET_RETURNING], 1)
        raise QueryError(f"unknown function '{name}'" + (f"; did you mean '{near[0]}'?" if near else ""))
    if takes := getattr(fn, "takes", None):
        try:
            inspect.signature(takes).bind(*args)
        except TypeError as e:
            raise QueryError(f"no overload of '{name}' takes {len(args)} arguments") from e
    try:
        return fn(args, named, kind)
    except IndexError as e:
        raise QueryError(f"no overload of '{name}' takes {len(args)} arguments") from e
