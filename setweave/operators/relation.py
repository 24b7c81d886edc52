"""Relations: DataFrames with set semantics, a heading of attribute names, and knowledge of what identifies rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges into which distinct keys are dealt for a rank over a whole relation.
RANGES = 128


class RelationError(ValueError):
    """A heading doesn't fit, or a value is missing where one is needed."""


def _least(keys: Iterable[Iterable[str]]) -> frozenset[frozenset[str]]:
    """The keys that hold no other, 8 at most (knowledge that may be given up)."""
    out: list[frozenset[str]] = []
    for k in sorted({frozenset(k) for k in keys}, key=lambda k: (len(k), sorted(k))):
        if not any(o <= k for o in out):
            out.append(k)
    return frozenset(out[:8])


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _fields(ddl: str) -> list[str]:
    """Names of the fields of a DDL string, or of plain names; types may be nested."""
    flat, before = ddl, ""
    while flat != before:
        before, flat = flat, re.sub(r"[<(][^<>()]*[>)]", "", flat)
    return [x.strip().split(" ")[0] for x in flat.split(",")]


@dataclass(frozen=True)
class Key:
    """What to order by, and whether it falls."""

    column: Column
    down: bool = False

    def order(self) -> Column:
        return self.column.desc() if self.down else self.column.asc()


def down(c: Column | str) -> Key:
    return Key(_expr(c), True)


def _expr(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def _ordered(c: Column, kind: T.DataType) -> Column | None:
    """A number that never falls where ``c`` rises, for ranges; None if there is none for the type."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.substring(F.rpad(F.encode(c, "utf-8"), 6, F.lit(b"\0")), 1, 6)), 16, 10).cast("double")
    if isinstance(kind, T.StructType) and len(kind):
        return _ordered(c[kind[0].name], kind[0].dataType)
    if isinstance(kind, T.ArrayType):
        return _ordered(F.get(c, F.lit(0)), kind.elementType)
    return None


class Rel:
    """A relation. ``keys`` are sets of attributes of which each is known to differ in all rows; with any, no distinct is
    needed to make the rows a set. ``unique`` may be given as such sets, or as True: all attributes together.

    Relations without attributes are ``true`` (one empty row) and ``false`` (none).
    """

    def __init__(self, df: DataFrame, unique: bool | Iterable[Iterable[str]] = False):
        self._raw = df
        self.keys = _least([df.columns] if unique is True else unique or ())

    @property
    def unique(self) -> bool:
        return bool(self.keys)

    # sources
    @classmethod
    def of(cls, spark: SparkSession, heading: str | Sequence[str], rows: Sequence[tuple]) -> Rel:
        """A relation literal; every row must have as many values as the heading has names (or DDL fields)."""
        names = _fields(heading) if isinstance(heading, str) else list(heading)
        if any(len(r) != len(names) for r in rows):
            raise RelationError(f"every row needs {len(names)} values")
        return cls(spark.createDataFrame(list(rows), heading if isinstance(heading, str) else names))

    @classmethod
    def parquet(cls, spark: SparkSession, path: str, unique: bool | Iterable[Iterable[str]] = False) -> Rel:
        return cls(spark.read.parquet(path), unique)

    @classmethod
    def truth(cls, spark: SparkSession, value: bool) -> Rel:
        return cls(spark.range(1 if value else 0).select(), True)

    @property
    def names(self) -> list[str]:
        return self._raw.columns

    @property
    def spark(self) -> SparkSession:
        return self._raw.sparkSession

    @property
    def df(self) -> DataFrame:
        """The rows, each once."""
        if self.unique:
            return self._raw
        return self._raw.distinct() if self.names else self._raw.limit(1)

    def _need(self, names: Sequence[str]) -> None:
        if missing := set(names) - set(self.names):
            raise RelationError(f"no attributes {sorted(missing)} in {self.names}")

    def _without(self, names: Iterable[str]) -> list[frozenset[str]]:
        """The keys that none of the names is in."""
        return [k for k in self.keys if not k & set(names)]

    # projection, filter, map
    def where(self, pred: Column | str) -> Rel:
        return Rel(self._raw.where(pred), self.keys)

    def project(self, *names: str) -> Rel:
        self._need(names)
        return Rel(self._raw.select(*[F.col(f"`{n}`") for n in names]), [k for k in self.keys if k <= set(names)])

    def without(self, *names: str) -> Rel:
        self._need(names)
        return self.project(*[n for n in self.names if n not in names])

    def rename(self, **new: str) -> Rel:
        """``old=new`` names."""
        self._need(list(new))
        return Rel(self._raw.withColumnsRenamed(new), [[new.get(n, n) for n in k] for k in self.keys])

    def map(self, injective: bool = False, **columns: Column | str) -> Rel:
        """A relation of computed attributes; a set, so rows that fall together are one. A name alone stands for that
        attribute as it is, and keys whose attributes all stand so stay keys."""
        made = [(F.col(f"`{c}`") if isinstance(c, str) and c in self.names else _expr(c)).alias(n) for n, c in columns.items()]
        as_is = {c: n for n, c in columns.items() if isinstance(c, str) and c in self.names}
        kept = [[as_is[n] for n in k] for k in self.keys if k <= set(as_is)]
        return Rel(self._raw.select(*made), [list(columns), *kept] if self.unique and injective else kept)

    def merge(self, **columns: Column | str) -> Rel:
        """Adds or replaces attributes; the right side wins."""
        return Rel(self._raw.withColumns({n: _expr(c) for n, c in columns.items()}), self._without(columns))

    def choose(self, *cases: tuple[Column, Column], name: str = "value") -> Rel:
        """Rows that any condition holds for, mapped by the first that does."""
        conds = [c for c, _ in cases]
        value = reduce(lambda w, ce: w.when(*ce), cases[1:], F.when(*cases[0]))
        return Rel(self._raw.where(reduce(lambda a, b: a | b, conds)).select(value.alias(name)))

    def _row(self, values: Sequence) -> Rel:
        """A relation of one row, of this one's types."""
        kinds = self._raw.schema
        return Rel(self.spark.range(1).select(*[F.lit(v).cast(kinds[n].dataType).alias(n) for n, v in zip(self.names, values, strict=True)]), True)

    def with_row(self, *values) -> Rel:
        return self.union(self._row(values))

    def without_row(self, *values) -> Rel:
        kept = reduce(lambda a, b: a & b, [same(self._raw[n], F.lit(v)) for n, v in zip(self.names, values, strict=True)])
        return Rel(self._raw.where(~kept), self.keys)

    # joins
    def _common(self, other: Rel) -> tuple[list[str], list[str], list[str]]:
        common = [n for n in self.names if n in other.names]
        return [n for n in self.names if n not in common], common, [n for n in other.names if n not in common]

    def _matched(self, other: Rel, how: str) -> DataFrame:
        """Rows of this relation with (or without) a partner; nulls equal nulls."""
        _, common, _ = self._common(other)
        if not common:
            some = other._raw.limit(1).select(F.lit(1).alias("__some"))
            return self._raw.join(some, how=how) if how == "left_semi" else self._raw.join(some, F.lit(True), how)
        keys = other._raw.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in common])
        on = reduce(lambda a, b: a & b, [same(self._raw[f"`{c}`"], keys[f"`__r_{c}`"]) for c in common])
        return self._raw.join(keys, on, how)

    def join(self, other: Rel) -> Rel:
        """Natural join; without common attributes, all pairs. Keys of both sides together are one, and a side's own
        stay if the common attributes hold a key of the other."""
        left, common, right = self._common(other)
        keys = [a | b for a in self.keys for b in other.keys]
        keys += [k for mine, theirs in ((self.keys, other.keys), (other.keys, self.keys)) if any(k <= set(common) for k in theirs) for k in mine]
        if not common:
            return Rel(self._raw.crossJoin(other._raw), keys)
        theirs = other._raw.withColumnsRenamed({c: f"__r_{c}" for c in common})
        on = reduce(lambda a, b: a & b, [same(self._raw[f"`{c}`"], theirs[f"`__r_{c}`"]) for c in common])
        return Rel(self._raw.join(theirs, on).select(*[F.col(f"`{n}`") for n in (*self.names, *right)]), keys)

    def compose(self, other: Rel) -> Rel:
        left, _, right = self._common(other)
        return self.join(other).project(*left, *right)

    def common(self, other: Rel) -> Rel:
        _, common, _ = self._common(other)
        if not common:
            return self.exists(other)
        return Rel(self._raw.select(*common).intersect(other._raw.select(*common)), True)

    def exists(self, other: Rel) -> Rel:
        return Rel(self._matched(other, "left_semi").select().limit(1), True)

    def left_match(self, other: Rel) -> Rel:
        return Rel(self._matched(other, "left_semi"), self.keys)

    def right_match(self, other: Rel) -> Rel:
        return other.left_match(self)

    def left_residue(self, other: Rel) -> Rel:
        left, _, _ = self._common(other)
        return self.left_match(other).project(*left)

    def right_residue(self, other: Rel) -> Rel:
        return other.left_residue(self)

    def anti(self, other: Rel) -> Rel:
        """Rows without a partner: one anti join."""
        return Rel(self._matched(other, "left_anti"), self.keys)

    # set operators
    def _aligned(self, other: Rel) -> tuple[DataFrame, DataFrame]:
        if set(self.names) != set(other.names):
            raise RelationError(f"headings differ: {self.names} and {other.names}")
        return self._raw, other._raw.select(*self.names)

    def union(self, *others: Rel) -> Rel:
        return Rel(reduce(lambda a, b: a.unionByName(b), [o._aligned(self)[0].select(*self.names) for o in (self, *others)]))

    @staticmethod
    def mixed(*parts: Rel) -> Rel:
        """A union of relations with any headings: one attribute ``value``, each tuple as JSON with its attributes in order."""
        rows = [r._raw.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(r.names)]), {"ignoreNullFields": "false"}).alias("value")) for r in parts]
        return Rel(reduce(DataFrame.unionAll, rows))

    def intersect(self, *others: Rel) -> Rel:
        if self.unique:
            return reduce(lambda a, o: a.left_match(Rel(a._aligned(o)[1])), others, self)
        return Rel(reduce(lambda a, b: a.intersect(b), [self._aligned(o)[1] for o in (self, *others)]), True)

    def minus(self, other: Rel) -> Rel:
        a, b = self._aligned(other)
        return self.anti(Rel(b)) if self.unique and self.names else Rel(a.subtract(b), True)

    def symmetric(self, other: Rel) -> Rel:
        """Rows of one side only: both sides marked, and one grouped aggregation."""
        a, b = self._aligned(other)
        both = a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(2)))
        names = [F.col(f"`{n}`") for n in self.names]
        return Rel(both.groupBy(*names).agg(F.bit_or("__s").alias("__s")).where("__s <> 3").select(*names), True)

    def subset(self, other: Rel) -> bool:
        return self.minus(other)._raw.isEmpty()

    def proper_subset(self, other: Rel) -> bool:
        return self.subset(other) and not other.subset(self)

    def equals(self, other: Rel) -> bool:
        return set(self.names) == set(other.names) and self.symmetric(other)._raw.isEmpty()

    def has(self, *values) -> bool:
        return not self._raw.where(reduce(lambda a, b: a & b, [same(F.col(f"`{n}`"), F.lit(v)) for n, v in zip(self.names, values, strict=True)], F.lit(True))).isEmpty()

    def power_set(self, most: int = 20) -> Rel:
        """All subsets, each a sorted array; at most ``most`` elements."""
        one = self._raw.select(F.sort_array(F.collect_set(F.struct(*self.names))).alias("s"))
        checked = one.select(F.when(F.size("s") <= most, F.col("s")).otherwise(F.raise_error(F.lit("power set of too many elements"))).alias("s"))
        masks = checked.select("s", F.explode(F.expr("sequence(0L, shiftleft(1L, size(s)) - 1)")).alias("m"))
        return Rel(masks.select(F.expr("filter(s, (x, i) -> (shiftright(m, i) & 1L) = 1L)").alias("subset")), True)

    # folds and grouping
    def count(self) -> int:
        return self.df.count()

    def single(self) -> tuple:
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise RelationError("too many elements" if rows else "empty set")
        return tuple(rows[0])

    def fold(self, **folds: Column) -> Rel:
        """Folds over all tuples. ``sum_of`` of nothing is 0; the other folds of nothing are errors."""
        return Rel(self.df.agg(*[c.alias(n) for n, c in folds.items()]), True)

    def median(self, c: Column | str, name: str = "median") -> Rel:
        """The exact median of the whole relation, by ranges of distinct values: no task holds all of them. Of nothing it is an error."""
        keyed = self.df.select(_expr(c).cast("double").alias("__k")).where("__k IS NOT NULL")
        ranks = _ranks_of_keys(keyed, False)
        total = F.broadcast(keyed.agg(F.count(F.lit(1)).alias("__t")))
        middle = [F.floor((F.col("__t") - d) / 2).between(F.col("__r"), F.col("__r") + F.col("__n") - 1) for d in (1, 0)]
        found = ranks.crossJoin(total).where(middle[0] | middle[1])
        return Rel(found.agg(F.when(F.count(F.lit(1)) > 0, F.avg("__k")).otherwise(F.raise_error(F.lit("median of an empty set"))).alias(name)), True)

    def group(self, *keys: str, **folds: Column) -> Rel:
        """Nest by ``keys`` and fold each group, as one grouped aggregation; groups are never empty."""
        self._need(keys)
        return Rel(self.df.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()]), [keys])

    def reduce(self, *keys: str, **folds: tuple[Callable, str]) -> Rel:
        """A fold of one's own: for each group, what functions make of its rows (a pandas DataFrame), as (function, type).

        A group is in one task and in memory there; ``group`` with built-in folds is for groups of any size.
        """
        import pandas as pd

        self._need(keys)
        kinds = {n: self._raw.schema[n].dataType.simpleString() for n in keys}
        schema = ", ".join(f"`{n}` {t}" for n, t in (*kinds.items(), *((n, t) for n, (_, t) in folds.items())))

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{n: rows[n].iloc[:1].reset_index(drop=True) for n in keys}, **{n: [f(rows)] for n, (f, _) in folds.items()}})

        return Rel(self.df.groupBy(*keys).applyInPandas(one, schema), [keys])

    def expand(self, rows: Column) -> Rel:
        """The tuples of an array column that a function gives for each row: the union of all such sets."""
        return Rel(self._raw.select(F.explode(rows).alias("__x")).select("__x.*"))

    def nest(self, *names: str, into: str) -> Rel:
        """Groups by the other attributes; ``into`` is the sorted set of the tuples of ``names``."""
        self._need(names)
        keys = [n for n in self.names if n not in names]
        return Rel(self._raw.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*sorted(names)))).alias(into)), [keys])

    def nest_by(self, *keys: str, into: str) -> Rel:
        if not set(keys) < set(self.names):
            raise RelationError("nest needs some, but not all, attributes")
        return self.nest(*[n for n in self.names if n not in keys], into=into)

    def nest_single(self, name: str) -> Rel:
        """A set of plain values in place of the attribute."""
        self._need([name])
        keys = [n for n in self.names if n != name]
        return Rel(self._raw.groupBy(*keys).agg(F.sort_array(F.collect_set(name)).alias(name)), [keys])

    def unnest(self, name: str) -> Rel:
        """The inverse of nest; rows with an empty group vanish."""
        self._need([name])
        keys = [n for n in self.names if n != name]
        return Rel(self._raw.select(*keys, F.explode(name).alias("__x")).select(*keys, "__x.*"))

    # order
    def rank(self, by: Sequence[str] = (), **keys: Column | Key | str) -> Rel:
        """0-based competition ranks, one for each key, of the whole relation or within groups ``by``.

        A rank over the whole relation is the number of rows with a lesser key. Those are counted by key, the distinct keys dealt
        into ranges of about the same number, and counts added up within the ranges and over them. So no task gets all rows, and a
        key of very many rows is one row. Keys whose type has no ranges, and plain sort columns, are ranked in one task.
        """
        base, made = self.df, {}
        for name, key in keys.items():
            key = key if isinstance(key, Key) else Key(_expr(key))
            if not by and (ranked := _rank_by_ranges(base, name, key)) is not None:
                base = ranked
            else:
                made[name] = (F.rank().over(Window.partitionBy(*by).orderBy(key.order() if key.down else key.column)) - 1).cast("double")
        return Rel(base.withColumns(made) if made else base, self._without(keys) or not set(keys) & set(self.names))

    def top(self, k: int, name: str, key: Column | Key, by: Sequence[str] = ()) -> Rel:
        """``rank`` and rank < k: filters on the raw rank, so that partial limits apply before the shuffle."""
        order = key.order() if isinstance(key, Key) else key
        ranked = self.df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(order))).where(F.col(name) <= k)
        return Rel(ranked.withColumn(name, (F.col(name) - 1).cast("double")), self._without([name]) or name not in self.names)

    def order_by(self, *keys: Column | str) -> DataFrame:
        """Rows in order; ties by all attributes."""
        return self.df.orderBy(*keys, *self.names)

    def order_array(self, *keys: str, into: str = "items", less: Callable[[Column, Column], Column] | None = None) -> Rel:
        """The relation as one array of its tuples in order of ``keys``, or of a comparison of two tuples.

        An array is one value in one row, so it is for relations that a task can hold; ``order_by`` is for those of any size."""
        row = F.struct(*[F.col(f"`{n}`") for n in self.names])
        if less is not None:
            made = F.array_sort(F.sort_array(F.collect_list(row)), lambda a, b: F.when(less(a, b), F.lit(-1)).when(less(b, a), F.lit(1)).otherwise(F.lit(0)))
            return Rel(self.df.agg(made.alias(into)), True)
        tagged = F.struct(F.struct(*[F.expr(k) for k in keys]).alias("k"), row.alias("v"))
        return Rel(self.df.agg(F.sort_array(F.collect_list(tagged)).alias("s")).select(F.transform("s", lambda x: x["v"]).alias(into)), True)

    def concat(self, other: Rel, *more: Rel) -> Rel:
        """Sequence relations (attribute ``@``): the right one's positions move up by the left one's count."""
        if more:
            return self.concat(other).concat(*more)
        shift = self.df.agg(F.count("*").alias("__n"))
        moved = other.df.crossJoin(F.broadcast(shift)).withColumn("@", F.col("@") + F.col("__n")).drop("__n")
        return Rel(self._raw.unionByName(moved.select(*self.names)))


def _rank_by_ranges(base: DataFrame, name: str, key: Key) -> DataFrame | None:
    if " ASC NULLS " in (shown := str(key.column)) or " DESC NULLS " in shown:
        return None
    keyed = base.withColumn("__k", key.column)
    ranks = _ranks_of_keys(keyed, key.down)
    if ranks is None:
        return None
    ranks = ranks.select(F.col("__k").alias("__j"), F.col("__r").cast("double").alias("__r"))
    return keyed.join(ranks, F.col("__k").eqNullSafe(F.col("__j"))).drop(*{"__k", "__j", name} & {*keyed.columns, "__j"}).withColumnRenamed("__r", name)


def _ranks_of_keys(keyed: DataFrame, falls: bool) -> DataFrame | None:
    """Each distinct ``__k`` with its number of rows ``__n`` and that of rows before it ``__r``; None for types without ranges."""
    place = _ordered(F.col("__k"), keyed.schema["__k"].dataType)
    if place is None:
        return None
    counts = keyed.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).withColumn("__x", place)
    cuts = F.broadcast(counts.agg(F.percentile_approx("__x", [i / RANGES for i in range(1, RANGES)], 1000).alias("__b")))
    dealt = counts.crossJoin(cuts).withColumn("__p", F.when(F.col("__x").isNull(), -1).otherwise(F.size(F.filter("__b", lambda b: b < F.col("__x"))))).drop("__b", "__x")
    sums = dealt.groupBy("__p").agg(F.sum("__n").alias("__m")).agg(F.collect_list(F.struct("__p", "__m")).alias("__s"))
    inside = Window.partitionBy("__p").orderBy(F.desc("__k") if falls else F.asc("__k")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.filter("__s", lambda s: (s["__p"] > F.col("__p")) if falls else (s["__p"] < F.col("__p")))
    over = F.aggregate(earlier, F.lit(0).cast("long"), lambda total, s: total + s["__m"])
    return dealt.crossJoin(F.broadcast(sums)).select("__k", "__n", (F.coalesce(F.sum("__n").over(inside), F.lit(0)) + over).alias("__r"))


def sum_of(c: Column | str) -> Column:
    return F.coalesce(F.sum((F.expr(c) if isinstance(c, str) else c).cast("double")), F.lit(0.0))


def _some(kind: Callable[[Column], Column], c: Column | str, name: str) -> Column:
    column = F.expr(c) if isinstance(c, str) else c
    return F.when(F.count(F.lit(1)) > 0, kind(column)).otherwise(F.raise_error(F.lit(f"{name} of an empty set")))


def max_of(c: Column | str) -> Column:
    return _some(F.max, c, "max")


def min_of(c: Column | str) -> Column:
    return _some(F.min, c, "min")


def mean_of(c: Column | str) -> Column:
    return _some(lambda x: F.avg(x.cast("double")), c, "mean")


def median_of(c: Column | str) -> Column:
    """Exact: a group's distinct values are in one buffer. ``Rel.median`` is for whole relations, ``median_near`` for groups of any size."""
    return _some(lambda x: F.median(x.cast("double")), c, "median")


def median_near(c: Column | str, accuracy: int = 10_000) -> Column:
    """A value whose share of lesser ones is off 1/2 by 1/accuracy at most, in bounded memory."""
    return _some(lambda x: F.percentile_approx(x.cast("double"), 0.5, accuracy), c, "median")
