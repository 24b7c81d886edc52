"""Scalar functions as Columns: numbers are doubles, empty values are false, sequences are strings, arrays or bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = float("inf"), float("nan")


def truthy(c: Column, kind: T.DataType) -> Column:
    """Whether a value of the given type is true: not 0, not empty."""
    if isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        test = F.size(c) > 0
    elif isinstance(kind, T.StructType):
        test = F.lit(len(kind) > 0)
    else:
        test = F.length(c) > 0
    return F.coalesce(test, F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is an infinity with the sign of x and of the zero, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    signed = F.when(b.cast("string") == "-0.0", -a).otherwise(a)
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(NAN)).when(signed > 0, F.lit(INF)).otherwise(F.lit(-INF))


def floor_divide(a: Column, b: Column) -> Column:
    q = divide(a, b)
    finite = ~F.isnan(q) & (F.abs(q) != INF)
    return F.when(finite & (F.abs(q) < 2.0**53), F.floor(q).cast("double")).otherwise(q)


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; NaN for 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b))


def round_down(a: Column, b: Column) -> Column:
    return a.cast("double") - modulo(a, b)


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def bit_set(n: Column) -> Column:
    """Positions of the bits of a whole number, rising."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(n.cast("long"), i) == 1)


def bit_mask(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(2.0), x.cast("double")))


# sequences: (pattern, subject); strings here, arrays in the functions that begin with a_
def split(delimiter: str, s: Column) -> Column:
    """Parts between delimiters; an empty delimiter splits characters, and '' into none."""
    if delimiter == "":
        return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(s, quoted)


def sub(old: Column, new: Column, s: Column) -> Column:
    return F.replace(s, old, new)


def trim_prefix(p: Column, s: Column) -> Column:
    return F.when(F.startswith(s, p), s.substr(F.length(p) + 1, F.length(s))).otherwise(s)


def trim_suffix(p: Column, s: Column) -> Column:
    return F.when(F.endswith(s, p), s.substr(F.lit(1), F.length(s) - F.length(p))).otherwise(s)


def title(s: Column) -> Column:
    """The first letter of each word in upper case; the others, and white space of any kind, stay."""
    return F.array_join(F.transform(F.split(s, r"(?<=\s)"), lambda w: F.concat(F.upper(w.substr(1, 1)), F.substring(w, 2, 2**31 - 1))), "")


def char_at(s: Column, i: Column | int) -> Column:
    """The code point at a 0-based place."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.ascii(s.substr(at.cast("int") + 1, F.lit(1))).cast("double")


def a_contains(sub_array: Column, a: Column) -> Column:
    """Whether ``sub_array`` stands in ``a`` as one stretch."""
    n = F.size(sub_array)
    places = F.sequence(F.lit(0), F.size(a) - n)
    return F.when(n == 0, F.lit(True)).when(n > F.size(a), F.lit(False)).otherwise(F.exists(places, lambda i: F.slice(a, i + 1, n) == sub_array))


def a_prefix(p: Column, a: Column) -> Column:
    return (F.size(p) <= F.size(a)) & (F.slice(a, F.lit(1), F.size(p)) == p)


def a_suffix(p: Column, a: Column) -> Column:
    n = F.size(p)
    return F.when(n == 0, F.lit(True)).otherwise((n <= F.size(a)) & (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == p))


def a_repeat(n: Column, a: Column) -> Column:
    return F.flatten(F.array_repeat(a, n.cast("int")))


def a_trim_prefix(p: Column, a: Column) -> Column:
    return F.when(a_prefix(p, a), F.slice(a, F.size(p) + 1, F.size(a))).otherwise(a)


def a_trim_suffix(p: Column, a: Column) -> Column:
    return F.when(a_suffix(p, a), F.slice(a, F.lit(1), F.size(a) - F.size(p))).otherwise(a)


def a_join(separator: Column, arrays: Column) -> Column:
    """The elements of an array of arrays with a separator (an array) between."""
    return F.flatten(F.transform(arrays, lambda x, i: F.when(i == 0, x).otherwise(F.concat(separator, x))))


def seq_map(a: Column, f) -> Column:
    return F.transform(a, f)


def matches(pattern: str, groups: int, s: Column) -> Column:
    """All matches: an array of (whole match and groups)."""
    parts = [F.regexp_extract_all(s, F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
    return F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]), lambda x: F.array(*[x[f"g{i}"] for i in range(groups + 1)]))


# sets in columns: sorted arrays without repeats
def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def s_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def s_minus(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def s_common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def s_symmetric(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def s_subset(a: Column, b: Column, proper: bool = False) -> Column:
    inside = F.size(F.array_except(a, b)) == 0
    return inside & (F.size(F.array_distinct(b)) > F.size(F.array_distinct(a))) if proper else inside


# tuples and dictionaries (arrays of key and value, sorted by key)
def tuple_map(c: Column, kind: T.StructType, f) -> Column:
    return F.struct(*[f(c[n]).alias(n) for n in kind.names])


def tuple_merge(a: Column, a_names: list[str], b: Column, b_names: list[str]) -> Column:
    own = [a[n].alias(n) for n in a_names if n not in b_names]
    return F.struct(*own, *[b[n].alias(n) for n in b_names])


def to_dict(c: Column, names: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("key"), c[n].alias("value")) for n in sorted(names)])


def lookup(entries: Column, key: Column, fallback: Column | None = None) -> Column:
    """The one value of a key; without one, or with several, the fallback or an error."""
    found = F.filter(entries, lambda e: e["key"] == key)
    missing = F.raise_error(F.lit("expected one result")) if fallback is None else fallback
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))["value"]).otherwise(missing)


def dict_merge(a: Column, b: Column) -> Column:
    keys = F.transform(b, lambda e: e["key"])
    return F.array_sort(F.concat(F.filter(a, lambda e: ~F.array_contains(keys, e["key"])), b))


def cond(*cases: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    made = reduce(lambda w, ce: w.when(*ce), cases[1:], F.when(*cases[0]))
    return made if otherwise is None else made.otherwise(otherwise)


def shown(c: Column, kind: T.DataType, form: str = "") -> Column:
    """A value in a text: strings as they are, whole numbers without a fraction; ``form`` as in printf."""
    if form and isinstance(kind, T.NumericType):
        return F.format_string(f"%{form}", c.cast("double") if form[-1] in "fgGeE" else c.cast("long"))
    if isinstance(kind, T.FractionalType):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    return F.format_string(f"%{form}", c) if form else c.cast("string")
