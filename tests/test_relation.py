import datetime
import random
import statistics

import pytest
from pyspark.sql import Window

from setweave.functions import scalar as S
from setweave.operators.relation import Rel, RelationError, down, max_of, median_near, sum_of
from setweave.plans import recursion
from setweave.sources import formats
from setweave.streaming.observe import Reactor
from pyspark.sql import functions as F


def rows(rel):
    return sorted(tuple(r) for r in rel.df.collect())


def test_sets_and_laws(spark):
    a = Rel.of(spark, "x int, y int", [(1, 2), (3, 4), (5, 6), (1, 2)])
    b = Rel.of(spark, "y int, x int", [(2, 1), (9, 9)])
    assert a.count() == 3 and rows(a.intersect(b)) == [(1, 2)]
    assert rows(a.symmetric(b)) == [(3, 4), (5, 6), (9, 9)]
    assert rows(a.join(b)) == [(1, 2)] and a.minus(b).union(a.intersect(b)).equals(a)
    assert a.has(3, 4) and not a.has(4, 3)
    nested = a.nest("y", into="g")
    assert nested.unnest("g").equals(a)
    with pytest.raises(RelationError):
        a.project("z")
    with pytest.raises(RelationError):
        a.single()


def test_zero_columns(spark):
    a = Rel.of(spark, "x int", [(1,)])
    assert Rel.truth(spark, True).join(a).count() == 1 and Rel.truth(spark, False).join(a).count() == 0
    assert a.exists(a).count() == 1 and a.exists(a.where("x > 1")).count() == 0


def test_folds_of_nothing(spark):
    empty = Rel.of(spark, "x double", [])
    assert empty.fold(s=sum_of("x")).single() == (0.0,)
    with pytest.raises(Exception, match="max of an empty set"):
        empty.fold(m=max_of("x")).single()


def test_rank_ties(spark):
    """Ranks of whole relations, by ranges, are the numbers of rows with lesser keys; nulls come first, and last if the key falls."""
    rng = random.Random(7)
    kinds = {
        "double": lambda: rng.choice([0.0, -0.0, 1.5, float("nan"), -3.0, None, rng.random()]), "string": lambda: rng.choice(["", "b", "bb", "é", "zz", None, f"k{rng.randrange(99)}"]),
        "date": lambda: rng.choice([None, datetime.date(2020, 1, 1 + rng.randrange(28))]), "struct<a: int, b: string>": lambda: (rng.randrange(3), rng.choice("xy")), "array<int>": lambda: [rng.randrange(3) for _ in range(rng.randrange(3))],
        "binary": lambda: rng.choice([b"a", b"b"]),
    }
    for kind, make in kinds.items():
        df = spark.createDataFrame([(i, make()) for i in range(60)], f"i int, x {kind}").repartition(5)
        for falls in (False, True):
            got = Rel(df, [["i"]]).rank(r=down("x") if falls else "x").df
            want = df.withColumn("r", (F.rank().over(Window.orderBy(F.desc("x") if falls else F.asc("x"))) - 1).cast("double"))
            assert sorted((r.i, r.r) for r in got.collect()) == sorted((r.i, r.r) for r in want.collect()), (kind, falls)
    both = Rel(df, [["i"]]).rank(r="i % 4", s=down("i")).df
    assert sorted((t.i % 4, t.r, t.s) for t in both.collect())[0] == (0, 0.0, 3.0) and Rel(df.limit(0), [["i"]]).rank(r="i").df.count() == 0


@pytest.mark.parametrize("values", [[3.0], [4.0, 1.0], [1.0] * 5 + [9.0] * 4, [2.0, 2.0, 7.0, 7.0], [random.Random(1).random() for _ in range(400)]])
def test_median_by_ranges(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, x double").repartition(3)
    got = Rel(df, [["i"]]).median("x").single()[0]
    near = Rel(df, [["i"]]).fold(m=median_near("x")).single()[0]
    assert abs(got - statistics.median(values)) < 1e-12 and near in values


def test_mixed_and_folds_of_ones_own(spark):
    a, b = Rel.of(spark, "x int, y string", [(1, "p"), (1, "p"), (2, None)]), Rel.of(spark, "z double", [(0.5,)])
    assert rows(Rel.mixed(a, b)) == [('{"x":1,"y":"p"}',), ('{"x":2,"y":null}',), ('{"z":0.5}',)]
    c = Rel.of(spark, "k string, x int", [("a", 1), ("a", 2), ("b", 5), ("b", 5)])
    assert rows(c.reduce("k", p=(lambda g: float(g["x"].prod()), "double"), n=(len, "int"))) == [("a", 2.0, 2), ("b", 5.0, 1)]
    assert rows(c.expand(F.array(F.struct(F.col("k").alias("w")), F.struct(F.lit("z").alias("w"))))) == [("a",), ("b",), ("z",)]
    seq = Rel.of(spark, "`@` int, v string", [(0, "a"), (1, "b")])
    assert rows(seq.concat(seq, seq)) == [(i, "ab"[i % 2]) for i in range(6)]


def test_keys(spark):
    """What is known to be unique, through operators; and no distinct in plans where it is."""
    a = Rel(spark.createDataFrame([(1, 7, "x"), (2, 7, "y")], "i int, j int, k string"), [["i"]])
    b = Rel(spark.createDataFrame([(7, "p")], "j int, z string"), [["j"]])
    key = frozenset(["i"])
    assert key in a.project("i", "k").keys and not a.project("j").keys and a.rename(i="n").keys == {frozenset(["n"])}
    assert a.join(b).keys == {key} and a.left_match(b).keys == a.anti(b).keys == a.where("i > 1").keys == {key}
    assert a.map(n="i", m="j + 1").keys == {frozenset(["n"])} and not a.map(n="i + 0").keys and not a.merge(i="1").keys and a.merge(q="1").keys == {key}
    assert a.group("j", n=F.count("*")).keys == {frozenset(["j"])} and a.rank(r="j").keys == {key} and not a.union(a).keys
    assert a.join(Rel(b._raw)).keys == frozenset() and a.nest_by("j", into="g").keys == {frozenset(["j"])}
    plan = a.join(b).project("i", "z").df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and rows(a.join(b).project("i", "z")) == [(1, "p"), (2, "p")]
    c = Rel(spark.createDataFrame([(1, 7, "x"), (3, 7, "x")], "i int, j int, k string"), [["i"]])
    assert rows(a.symmetric(c)) == [(2, 7, "y"), (3, 7, "x")] and rows(a.minus(c)) == [(2, 7, "y")] and rows(a.intersect(c)) == [(1, 7, "x")]


def test_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (-7.0, 2.0)], "a double, b double")
    got = [tuple(r) for r in df.select(S.divide(df.a, df.b), S.floor_divide(df.a, df.b), S.modulo(df.a, df.b)).collect()]
    assert got[0][0] == float("inf") and got[1][0] == -float("inf") and got[2] == (-3.5, -4.0, -1.0)


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert {r[0] for r in recursion.explore(spark.createDataFrame([(1,)], "node int"), edges).collect()} == {1, 2, 3}
    assert recursion.closure(edges).count() == 10
    assert recursion.topsort(edges.where("src > 3")).count() == 2


def test_explore_whole(spark, monkeypatch):
    monkeypatch.setattr(recursion, "TABLES", 2, raising=False)
    start, edges = spark.createDataFrame([(0,)], "node int"), spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    assert sorted(r[0] for r in recursion.explore(start, edges).collect()) == list(range(7))
    assert recursion.explore(start, edges, rounds=6).count() == 7
    with pytest.raises(ValueError, match="more nodes"):
        recursion.explore(start, edges, rounds=3)


def test_formats(tmp_path):
    assert formats.decode_csv(b"a,b,c\nx,y,z") == (("a", "b", "c"), ("x", "y", "z"))
    assert formats.decode_json('{"a": [1, "", null]}', strict=False)["a"][0] == 1.0
    assert formats.encode_json(formats.decode_json('{"a":[1,"",null,true]}')) == b'{"a":[1,"",null,true]}'
    formats.write_dir({"d": {"f": "x"}}, str(tmp_path / "o"))
    assert formats.read_file(str(tmp_path / "o/d/f")) == b"x"
    with pytest.raises(ValueError):
        formats.write_dir({"..": "x"}, str(tmp_path / "p"))


def test_reactor():
    seen, closed = [], []
    r = Reactor(root=1)
    stop = r.observe("$ + 1", seen.append)
    r.observe("$ * 'a'", seen.append, closed.append)
    r.update("$ + 5")
    stop()
    r.update("$ + 5")
    assert seen == [2.0, 7.0] and len(closed) == 1
