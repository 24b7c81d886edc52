"""Queries written in the language, over the driver's tables, and their SQL; and texts of plain values with what they must give."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.catalogue import ORACLE_SQL, QUERIES, query, rel
from setweave.lang import values as V
from setweave.lang.engine import Engine
from setweave.operators.relation import Rel
from setweave.plans import recursion
from setweave.plans.storage import new_name, shared_dir
from setweave.sources import formats
from setweave.streaming import observe


def engine_over(spark: SparkSession, sf: str, *tables: str) -> Engine:
    engine = Engine(spark)
    for name in tables:
        engine.bind(name, rel(spark, sf, name))
    return engine


def frame(spark: SparkSession, x: Any) -> DataFrame:
    """A result as a DataFrame: a relation's rows, a tuple as one row, any other value as ``value``."""
    if isinstance(x, Rel):
        return x.df
    if isinstance(x, DataFrame):
        return x
    if isinstance(x, V.Tup):
        x = {k: v == V.TRUE if v in (V.TRUE, V.FALSE) else v for k, v in x.items()}
        return spark.createDataFrame([tuple(x.values())], list(x))
    return spark.createDataFrame([(x if isinstance(x, float | str) else V.show(x),)], ["value"])


def text(name: str, tables: str, code: str, sql: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Registers a text over some tables."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return then(frame(spark, engine_over(spark, sf, *tables.split()).eval(code)))

    run.__name__ = run.__qualname__ = name
    run.__doc__ = code
    QUERIES[name], ORACLE_SQL[name] = run, sql


# joins
C = "(customer => (k: .c_custkey, n: .c_nationkey, s: .c_mktsegment))"
N = "(nation => (n: .n_nationkey, name: .n_name))"
RICH = "(orders where .o_totalprice > 300000 => (k: .o_custkey, p: .o_totalprice))"
_C = "(SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer)"
_N = "(SELECT n_nationkey AS n, n_name AS name FROM nation)"
_K = "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"
text("text_join", "customer nation", f"{C} <&> {N}", f"SELECT * FROM {_C} JOIN {_N} USING (n)")
text("text_compose", "customer nation", f"({C} => .~|k|) <-> {N}", f"SELECT DISTINCT s, name FROM {_C} JOIN {_N} USING (n)")
text("text_common", "customer orders", f"{C} -&- {RICH}", f"SELECT k FROM {_C} INTERSECT {_K[1:-1]}")
text("text_exists", "customer orders", f"{C} --- {RICH}", f"SELECT EXISTS(SELECT 1 FROM {_C} WHERE k IN {_K}) AS found", lambda df: df.agg((F.count(F.lit(1)) > 0).alias("found")))
text("text_left_match", "customer orders", f"{C} <&- {RICH}", f"SELECT * FROM {_C} WHERE k IN {_K}")
text("text_right_match", "customer orders", f"{RICH} -&> {C}", f"SELECT * FROM {_C} WHERE k IN {_K}")
text("text_left_residue", "customer orders", f"({C} => .|k,s|) <-- {RICH}", f"SELECT DISTINCT s FROM {_C} WHERE k IN {_K}")
text("text_right_residue", "customer orders", f"{RICH} --> ({C} => .|k,s|)", f"SELECT DISTINCT s FROM {_C} WHERE k IN {_K}")
text("text_anti", "customer orders", f"let c = {C}; c &~ (c <&- {RICH})", f"SELECT * FROM {_C} WHERE k NOT IN {_K}")
text(
    "text_theta", "region nation", "((region => (r: .r_regionkey, rn: .r_name)) <&> (nation => (q: .n_regionkey, nn: .n_name))) where .r < .q => (:.rn, :.nn)",
    "SELECT r_name AS rn, n_name AS nn FROM region, nation WHERE r_regionkey < n_regionkey",
)
text("text_cross", "region nation", "(region => (:.r_name)) <&> (nation => (:.n_name))", "SELECT r_name, n_name FROM region, nation")
text(
    "text_sequence_join", "region nation", "(nation => (@: .n_nationkey, @item: .n_name)) <&- (region => (@: .r_regionkey))",
    'SELECT n_nationkey AS "@", n_name AS "@item" FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region)',
)

# sets
A, B = "(lineitem where .l_quantity > 45 => (k: .l_partkey))", "(lineitem where .l_discount > 0.08 => (k: .l_partkey))"
_A, _B = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45", "SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08"
for _name, _op, _sql in (("union", "|", f"{_A} UNION {_B}"), ("intersect", "&", f"{_A} INTERSECT {_B}"), ("minus", "&~", f"{_A} EXCEPT {_B}"), ("symmetric", "~~", f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})")):
    text(f"text_{_name}", "lineitem", f"{A} {_op} {B}", _sql)
text("text_rel_union", "lineitem part", f"//rel.union({{{A}, {B}, part where .p_size < 5 => (k: .p_partkey)}})", f"{_A} UNION {_B} UNION SELECT p_partkey FROM part WHERE p_size < 5")
text("text_mixed", "region nation", "//rel.mixed({region => (name: .r_name, a: .r_regionkey), nation => (k: .n_regionkey)})", """SELECT '{"a":' || r_regionkey || ',"name":"' || r_name || '"}' AS value FROM region UNION SELECT '{"k":' || n_regionkey || '}' FROM nation""")
text("text_with_without", "nation", "(nation => (k: .n_nationkey)) with (k: 99) with (k: 3) without (k: 4)", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> 4 UNION SELECT 99")
text(
    "text_set_tests", "lineitem",
    f"let a = {A}; let b = {B}; let c = a & b; (eq: a = a && a != b, sub: c (<=) a && c (<) (a | b) && !(a (<) c), sup: (a | b) (>=) b && (a | b) (>) c, any: (c (<>) (a | b)) && (a (<>=) a), "
    "none: a !(<=) c && a !(<>) a && c !(>) c, member: (k: (a min .k)) <: a && (k: -1) !<: a)",
    'SELECT TRUE AS eq, TRUE AS sub, TRUE AS sup, TRUE AS "any", TRUE AS none, TRUE AS member',
)
text("text_concat", "region nation", "(region => (@: .r_regionkey, v: .r_name)) ++ (nation => (@: .n_nationkey, v: .n_name))", 'SELECT r_regionkey AS "@", r_name AS v FROM region UNION SELECT n_nationkey + (SELECT count(*) FROM region), n_name FROM nation')
text("text_power_set", "region", "^(region => (:.r_name))", "SELECT n::BIGINT AS n, count(*) AS c FROM (SELECT bit_count(m) AS n FROM (SELECT unnest(range(32)) AS m)) GROUP BY 1", lambda df: df.groupBy(F.size("subset").cast("long").alias("n")).agg(F.count("*").alias("c")))

# projections, filters, maps
text("text_project", "lineitem", "lineitem => .|l_returnflag,l_linestatus|", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
text("text_project_away", "nation", "nation => .~|n_nationkey,n_name|", "SELECT DISTINCT n_regionkey FROM nation")
text("text_merge", "customer", "customer => . +> (c_mktsegment: //str.upper(.c_name), debt: .c_acctbal * 2)", "SELECT * REPLACE (upper(c_name) AS c_mktsegment), c_acctbal * 2 AS debt FROM customer")
text(
    "text_nested_merge", "nation", "nation => (k: .n_nationkey, t: (a: (x: .n_name, y: 1), b: 2)) => . +> (t+>: (a+>: (y: .k, z: .k + 1)))",
    "SELECT n_nationkey AS k, n_name AS x, n_nationkey AS y, n_nationkey + 1.0::DOUBLE AS z, 2.0::DOUBLE AS b FROM nation", lambda df: df.select("k", "t.a.x", "t.a.y", "t.a.z", "t.b"),
)
text("text_where", "customer", "customer where .c_acctbal > 0 && !(.c_mktsegment = 'BUILDING') || .c_nationkey % 5 = 2 => (:.c_custkey)", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' OR c_nationkey % 5 = 2")
text(
    "text_conditions", "part", "part => (k: .p_partkey, a: cond {.p_size < 10: 'small', .p_size > 40: 'large', _: .p_brand}, b: (1 if (.p_size // 2 * 2 = .p_size) else 0), c: .p_size % 2 && .p_partkey, d: .p_size % 2 || 7)",
    "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size > 40 THEN 'large' ELSE p_brand END AS a, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS b, "
    "CASE WHEN p_size % 2 <> 0 THEN p_partkey::DOUBLE ELSE 0 END AS c, CASE WHEN p_size % 2 <> 0 THEN 1.0::DOUBLE ELSE 7 END AS d FROM part",
    lambda df: df.withColumns({n: F.col(n).cast("double") for n in "bcd"}),
)
text("text_filter_control", "orders", "orders filter .o_orderstatus {'F': (k: .o_orderkey, w: 'done'), ('O', 'P'): (k: .o_orderkey, w: .o_orderstatus)}", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS w FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
text(
    "text_array_patterns", "part", "part => (k: .p_partkey, w: //seq.split(' ', .p_name)) filter .w {[a, b]: (k: .k, a: a, b: b, n: 0), [a, ...t]: (k: .k, a: a, b: 'more', n: t count)}",
    "SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, CASE WHEN len(string_split(p_name, ' ')) = 2 THEN string_split(p_name, ' ')[2] ELSE 'more' END AS b, CASE WHEN len(string_split(p_name, ' ')) = 2 THEN 0 ELSE len(string_split(p_name, ' ')) - 1 END::DOUBLE AS n FROM part",
)
text("text_safe_tails", "nation", "nation => (k: .n_nationkey, t: (a: .n_name)) => (:.k, p: .t.b?.c?:'none', q: .t.a?:'x', r: .z?.y?:.k)", "SELECT n_nationkey AS k, 'none' AS p, n_name AS q, n_nationkey AS r FROM nation")
text("text_sequence_map", "nation", "(nation => (@: .n_nationkey, v: .n_regionkey)) >>> \\i \\v i * 10 + v", 'SELECT n_nationkey AS "@", n_nationkey * 10.0::DOUBLE + n_regionkey AS v FROM nation')
text("text_sequence_values", "nation", "(nation => (@: .n_nationkey, v: .n_name)) >> //str.lower(.)", 'SELECT n_nationkey AS "@", lower(n_name) AS v FROM nation')
text("text_tuple_map", "nation", "nation => (k: .n_nationkey, t: (a: .n_regionkey, b: .n_nationkey) :> . * 2)", "SELECT n_nationkey AS k, n_regionkey * 2.0::DOUBLE AS a, n_nationkey * 2.0::DOUBLE AS b FROM nation", lambda df: df.select("k", "t.a", "t.b"))
text("text_bind", "nation", "let half = \\x x / 2; nation -> \\r (r where .n_regionkey > 1) => (k: .n_nationkey, h: half(.n_nationkey), s: .n_name -> //str.lower(.))", "SELECT n_nationkey AS k, n_nationkey / 2 AS h, lower(n_name) AS s FROM nation WHERE n_regionkey > 1")
text("text_literal_join", "nation", "(nation => (r: .n_regionkey, name: .n_name)) <&> {|r, w| (0, 'zero'), (3, 'three')}", "SELECT n_regionkey::DOUBLE AS r, n_name AS name, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'three' END AS w FROM nation WHERE n_regionkey IN (0, 3)", lambda df: df.withColumn("r", F.col("r").cast("double")))
text("text_dynamic", "nation", "let f = \\x x + @shift; let (@shift: 100); nation => (k: f(.n_nationkey))", "SELECT n_nationkey + 100.0::DOUBLE AS k FROM nation")

# folds, nests, order
text(
    "text_folds", "orders", "(n: orders count, s: orders sum .o_totalprice, hi: orders max .o_totalprice, lo: orders min .o_totalprice, mean: orders mean .o_totalprice, mid: orders median .o_totalprice, kinds: (orders => (:.o_orderpriority)) count)",
    "SELECT count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS s, max(o_totalprice) AS hi, min(o_totalprice) AS lo, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS mid, count(DISTINCT o_orderpriority)::DOUBLE AS kinds FROM orders",
    lambda df: df.withColumns({"s": F.round("s", 2), "mean": F.round("mean", 4), "mid": F.round("mid", 4)}),
)
text("text_single", "nation", "(nation where .n_name = (nation max .n_name)) single -> .|n_nationkey,n_name|", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation ORDER BY n_name DESC LIMIT 1")
text("text_lookup", "nation", "let names = nation => (@: .n_nationkey, v: .n_name); (a: names(3), b: names(77)?:'nobody')", "SELECT n_name AS a, 'nobody' AS b FROM nation WHERE n_nationkey = 3")
text("text_group", "orders", "orders => (k: .o_custkey, o: .o_orderkey, p: .o_totalprice) nest ~|k|g => (:.k, n: .g count, s: .g sum .p, m: .g max .p) where .n > 12", "SELECT o_custkey AS k, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS s, max(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) > 12", lambda df: df.withColumn("s", F.round("s", 2)))
text("text_nest", "nation", "nation nest |n_nationkey,n_name|g => (k: .n_regionkey, n: .g count, names: .g => .n_name, mid: .g => .n_nationkey median .)", "SELECT n_regionkey AS k, count(*)::DOUBLE AS n, string_agg(n_name, ',' ORDER BY n_name) AS names, median(n_nationkey)::DOUBLE AS mid FROM nation GROUP BY 1", lambda df: df.withColumn("names", F.array_join("names", ",")))
text("text_nest_inverse", "nation", "nation nest ~|n_regionkey|g => (k: .n_regionkey, keys: (.g orderby -.n_nationkey) >> .n_nationkey)", "SELECT n_regionkey AS k, string_agg(n_nationkey, ',' ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY 1", lambda df: df.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",")))
text("text_nest_single", "nation", "(nation => .|n_regionkey,n_name|) nest n_name", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS n_name FROM nation GROUP BY 1", lambda df: df.withColumn("n_name", F.array_join("n_name", ",")))
text("text_unnest", "nation", "nation nest |n_nationkey,n_name|g unnest g", "SELECT * FROM nation")
text("text_rank", "orders", "orders rank (r: -.o_totalprice, d: .o_orderdate) => (:.o_orderkey, :.r, :.d)", "SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice DESC) - 1)::DOUBLE AS r, (rank() OVER (ORDER BY o_orderdate) - 1)::DOUBLE AS d FROM orders")
text("text_rank_string", "customer", "customer rank (r: .c_name) => (:.c_custkey, :.r)", "SELECT c_custkey, (rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS r FROM customer")
text(
    "text_rank_in_groups", "orders", "(orders => (k: .o_custkey, o: .o_orderkey, p: .o_totalprice) nest ~|k|g => (:.k, g: .g rank (r: -.p))) unnest g => (:.o, :.r)",
    "SELECT o_orderkey AS o, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) - 1)::DOUBLE AS r FROM orders",
)
text("text_top", "orders", "orders rank (r: -.o_totalprice) where .r < 10 => (:.o_orderkey, :.r)", "SELECT * FROM (SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice DESC) - 1)::DOUBLE AS r FROM orders) WHERE r < 10")
text("text_orderby", "nation", "nation orderby -.n_name", "SELECT * FROM nation")
text("text_order", "nation", "nation order \\a \\b a.n_regionkey > b.n_regionkey || a.n_regionkey = b.n_regionkey && a.n_name < b.n_name", "SELECT string_agg(n_name, ',' ORDER BY n_regionkey DESC, n_name) AS names FROM nation", lambda df: df.select(F.array_join(F.transform("items", lambda x: x["n_name"]), ",").alias("names")))

# scalars
text(
    "text_arithmetic", "lineitem",
    "lineitem => (o: .l_orderkey, n: .l_linenumber, p: .l_quantity + .l_tax, d: .l_quantity - 60, m: .l_quantity * .l_discount, q: .l_extendedprice / .l_quantity, f: .l_extendedprice // 7, r: .l_quantity % 7, s: .l_quantity -% 7, e: .l_discount ^ 2, u: -.l_tax, i: +.l_tax)",
    "SELECT l_orderkey AS o, l_linenumber AS n, l_quantity + l_tax AS p, l_quantity - 60 AS d, l_quantity * l_discount AS m, l_extendedprice / l_quantity AS q, floor(l_extendedprice / 7.0::DOUBLE) AS f, l_quantity % 7.0::DOUBLE AS r, "
    "l_quantity - l_quantity % 7.0::DOUBLE AS s, power(l_discount, 2.0::DOUBLE) AS e, -l_tax AS u, l_tax AS i FROM lineitem WHERE l_tax <> 0",
    lambda df: df.where("i <> 0"),
)
text("text_division", "part", "part => (k: .p_partkey, a: $'${.p_size / 0}', b: $'${-.p_size / 0}', c: $'${(.p_size - .p_size) / 0}')", "SELECT p_partkey AS k, 'Infinity' AS a, '-Infinity' AS b, 'NaN' AS c FROM part")
text("text_comparisons", "part", "part => (k: .p_partkey, a: 5 < .p_size <= 20, b: .p_size != 7 && .p_size >= 3, c: .p_brand > 'Brand#3', d: .p_size <: {1, 5, 9}, e: .p_size !<: {2, 4})", "SELECT p_partkey AS k, 5 < p_size AND p_size <= 20 AS a, p_size <> 7 AND p_size >= 3 AS b, p_brand > 'Brand#3' AS c, p_size IN (1, 5, 9) AS d, p_size NOT IN (2, 4) AS e FROM part")
text(
    "text_subsets", "part", "part => (k: .p_partkey, s: {.p_size % 4, 1}) => (:.k, a: .s (<=) {0, 1, 2}, b: .s (<) {1, 3}, c: .s (>=) {3}, d: .s (<>) {1}, e: .s (<>=) {1}, f: .s !(<=) {1, 2}, u: (.s | {9}) count, v: (.s & {1, 2}) count, w: (.s &~ {1}) count, x: (.s ~~ {1, 2}) count)",
    "SELECT p_partkey AS k, m IN (0, 1, 2) AS a, m = 1 AS b, m = 3 AS c, m <> 1 AS d, TRUE AS e, m IN (0, 3) AS f, CASE m WHEN 1 THEN 2 ELSE 3 END::DOUBLE AS u, CASE m WHEN 2 THEN 2 ELSE 1 END::DOUBLE AS v, CASE m WHEN 1 THEN 0 ELSE 1 END::DOUBLE AS w, "
    "CASE m WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END::DOUBLE AS x FROM (SELECT p_partkey, p_size % 4 AS m FROM part)",
)
text("text_math", "part", "part => (k: .p_partkey, s: //math.sin(.p_size), c: //math.cos(.p_size), t: 2 * //math.pi, e: //math.e)", f"SELECT p_partkey AS k, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, {2 * math.pi!r}::DOUBLE AS t, {math.e!r}::DOUBLE AS e FROM part", lambda df: df.withColumns({"s": F.round("s", 9), "c": F.round("c", 9)}))
text("text_bits", "part", "part => (k: .p_partkey, b: //bits.set(.p_partkey), m: //bits.mask(//bits.set(.p_partkey)))", "SELECT p_partkey AS k, coalesce(list_aggregate(list_filter(range(0, 63), lambda i: ((p_partkey >> i) & 1) = 1), 'string_agg', ','), '') AS b, p_partkey::DOUBLE AS m FROM part", lambda df: df.withColumn("b", F.array_join("b", ",")))
text(
    "text_strings", "part",
    "part => (k: .p_partkey, a: //seq.contains('col', .p_name), b: //seq.has_prefix('s', .p_name), c: //seq.has_suffix('t', .p_name), d: //seq.trim_prefix('Brand#', .p_brand), e: //seq.trim_suffix('Y', .p_type), f: //seq.sub('o', '0', .p_name), "
    "g: //str.lower(.p_type), h: //str.upper(.p_name), i: //str.title(.p_name), j: //seq.repeat(2, .p_type), l: //seq.join('-', //seq.split(' ', .p_name)), m: //seq.contains(.p_type, 'PROMO ECONOMY'), n: //seq.concat([.p_type, '/', .p_brand]), o: .p_name ++ '!')",
    "SELECT p_partkey AS k, contains(p_name, 'col') AS a, starts_with(p_name, 's') AS b, suffix(p_name, 't') AS c, replace(p_brand, 'Brand#', '') AS d, regexp_replace(p_type, 'Y$', '') AS e, replace(p_name, 'o', '0') AS f, lower(p_type) AS g, upper(p_name) AS h, "
    "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i, p_type || p_type AS j, replace(p_name, ' ', '-') AS l, contains('PROMO ECONOMY', p_type) AS m, p_type || '/' || p_brand AS n, p_name || '!' AS o FROM part",
)
text(
    "text_arrays", "part", "part => (k: .p_partkey, s: .p_size, a: [.p_size, 1, 2]) => (:.k, c: //seq.contains([1, 2], .a), p: //seq.has_prefix([7], .a), q: //seq.has_suffix([2], .a), r: //seq.repeat(2, .a) count, t: //seq.trim_prefix([7], .a) count, f: .a(0) + .a(2), z: .a(9)?:-1)",
    "SELECT p_partkey AS k, TRUE AS c, p_size = 7 AS p, TRUE AS q, 6.0::DOUBLE AS r, CASE WHEN p_size = 7 THEN 2 ELSE 3 END::DOUBLE AS t, p_size + 2.0::DOUBLE AS f, -1.0::DOUBLE AS z FROM part", lambda df: df.withColumns({"f": F.col("f").cast("double"), "z": F.col("z").cast("double")}),
)
text("text_json", "events", "events => (k: .event_id, n: //json.number('$.k', .props), t: //json.text('$.none', .props) ++ '!')", "SELECT event_id AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n, '!' AS t FROM events")
text("text_characters", "part", "part => (k: .p_partkey, a: .p_name(0), b: .p_name(0) = %c, z: .p_name(999)?:-1, s: //re.sub(`[0-9]+`, '<$0>', .p_brand))", "SELECT p_partkey AS k, unicode(p_name)::DOUBLE AS a, unicode(p_name) = 99 AS b, -1.0::DOUBLE AS z, regexp_replace(p_brand, '([0-9]+)', '<\\1>') AS s FROM part")
text("text_templates", "part", "part => (k: .p_partkey, t: $'${.p_brand:s}|${.p_size:04d}|${.p_retailprice:.1f}|${//seq.split(\" \", .p_name)::+}')", "SELECT p_partkey AS k, p_brand || '|' || printf('%04d', p_size) || '|' || printf('%.1f', p_retailprice) || '|' || replace(p_name, ' ', '+') AS t FROM part")


@query("SELECT p_partkey AS k, p_size * p_size + 1.0::DOUBLE AS v FROM part")
def text_native_function(spark, sf):
    """A function of the host, on columns where a text uses it inside a relation."""
    engine = engine_over(spark, sf, "part")
    engine.register("bump", lambda x: x * x + 1, lambda x: x * x + F.lit(1.0))
    return engine.eval("part => (k: .p_partkey, v: bump(.p_size))").df


@query("SELECT n_regionkey, sum(n_nationkey * length(n_name))::DOUBLE AS v FROM nation GROUP BY 1")
def fold_primitive(spark, sf):
    """A fold of one's own over groups: what a function makes of a group's rows, in Arrow batches."""
    import pandas as pd

    def weigh(group: pd.DataFrame) -> float:
        return float((group["n_nationkey"] * group["n_name"].str.len()).sum())

    return rel(spark, sf, "nation").reduce("n_regionkey", v=(weigh, "double")).df


@query("SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS word FROM part")
def table_function(spark, sf):
    """Rows from a function that gives a set for each row."""
    return rel(spark, sf, "part").expand(F.transform(F.split("p_name", " "), lambda w: F.struct(F.col("p_partkey").alias("k"), w.alias("word")))).df


def _edges(spark, sf):
    return rel(spark, sf, "part").map(src="p_size", dst="p_size * 2").where("dst <= 50").df


_EDGES = "(SELECT DISTINCT p_size AS src, p_size * 2 AS dst FROM part WHERE p_size * 2 <= 50)"


@query(f"WITH RECURSIVE e AS {_EDGES}, r(src, dst) AS (SELECT * FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def closure(spark, sf):
    return recursion.closure(_edges(spark, sf))


@query(
    f"WITH RECURSIVE e AS {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) "
    "UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(level)::INTEGER AS level FROM r GROUP BY 1"
)
def topsort(spark, sf):
    return recursion.topsort(_edges(spark, sf))


# sources and sinks
def _through(fmt: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{shared_dir(spark)}/setweave/{new_name()}.{fmt}"
        nations = rel(spark, sf, "nation").df
        formats.write(nations, path, fmt, **options)
        back = formats.read(spark, path, fmt, **options, **({"multiLine": False} if fmt == "json" else {}))
        return back.select(*[back[n].cast(t).alias(n) for n, t in nations.dtypes])

    run.__doc__ = f"Nations written and read again as {fmt}."
    return run


for _fmt, _options in {"csv": {"header": True, "sep": "|"}, "json": {}, "orc": {}, "xml": {"rowTag": "ROW"}, "parquet": {}}.items():
    QUERIES[f"through_{_fmt}"], ORACLE_SQL[f"through_{_fmt}"] = _through(_fmt, **_options), "SELECT * FROM nation"


@query("SELECT upper(r_name) AS t, r_regionkey::DOUBLE AS k FROM region")
def import_file(spark, sf):
    """A text that imports a table by its path, below the engine's folder."""
    folder, _, _ = f"{sf}/region.parquet".rpartition("/")
    engine = Engine(spark, folder=folder) if "://" not in folder else None
    relation = engine.eval("//{./region.parquet}") if engine else Rel(formats.read(spark, f"{sf}/region.parquet"))
    (engine := engine or Engine(spark)).bind("r", relation)
    return engine.eval("r => (t: //str.upper(.r_name), k: .r_regionkey * 1)").df.withColumn("k", F.col("k").cast("double"))


@query("SELECT string_agg(lower(r_name), '|' ORDER BY r_name) AS v FROM region")
def decode_in_text(spark, sf):
    """JSON of a column, decoded and folded by a text."""
    rows = rel(spark, sf, "region").df.agg(F.to_json(F.sort_array(F.collect_list("r_name"))).alias("j")).first()["j"]
    engine = Engine(spark, j=rows)
    return frame(spark, V.Tup(v=engine.eval("//seq.join('|', //json.simplify(//encoding.json.decode(j)) >> //str.lower(.))")))


@query("SELECT r_regionkey AS k, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def wire_rows(spark, sf):
    df = rel(spark, sf, "region").df
    made = formats.wire(df)
    return made.select(F.get_json_object("json", "$.r_regionkey").cast("int").alias("k"), "json")


# streams
@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_windows(spark, sf):
    """Events as a stream of files, in tumbling windows with a watermark; the last result of the watcher."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    base = f"{shared_dir(spark)}/setweave/stream-{new_name()}"
    folds = observe.windowed(stream, "ts", "1 day", "2 hours", n=F.count("*"), total=F.round(F.sum("value"), 2))
    seen: list[str] = []

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{n}")
        seen.append(f"{base}/{n}")

    observe.observe_stream(folds, lambda df: df, keep, f"{base}/state", "complete").awaitTermination()
    return spark.read.parquet(seen[-1])


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * s AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS s) GROUP BY 1")
def sliding_windows(spark, sf):
    return observe.windowed(rel(spark, sf, "events").df, "ts", "1 hour", "10 minutes", "30 minutes", n=F.count("*"))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, part"
)
def session_windows(spark, sf):
    return observe.sessions(rel(spark, sf, "events").df, "ts", "6 hours", "10 minutes", "user_id", n=F.count("*"))


@query("SELECT 0::BIGINT AS step, 25.0::DOUBLE AS n UNION ALL SELECT 1, (SELECT count(*) FROM nation WHERE n_regionkey < 3) UNION ALL SELECT 2, (SELECT count(*) FROM nation WHERE n_regionkey < 3 AND n_nationkey > 5)")
def observed_root(spark, sf):
    """A watcher's values as the root is replaced."""
    reactor, seen = observe.Reactor(spark, rel(spark, sf, "nation")), []
    reactor.observe("$ count", seen.append)
    reactor.update("$ where .n_regionkey < 3")
    reactor.update("$ where .n_nationkey > 5")
    return spark.createDataFrame(list(enumerate(seen)), "step long, n double")


# plain values
#: Texts of plain values by kind, each with the text of what it must give.
VALUES: dict[str, list[tuple[str, str]]] = {
    "sets": [("{3, 1, 2, 1}", "{1, 2, 3}"), ("{1, 2} | {3}", "{1, 2, 3}"), ("{1, 2, 3} & {2, 9}", "{2}"), ("{1, 2} &~ {2}", "{1}"), ("{1, 2} ~~ {2, 3}", "{1, 3}"), ("(^{1, 2}) count", "4"), ("{5} with 6 without 5", "{6}"), ("{4} single", "4"),
             ("{1, 'a', (x: 1), [2], {3}} count", "5"), ("//rel.union({{1}, {2, 3}})", "{1, 2, 3}"), ("{1, 2} (<) {1, 2, 3}", "true"), ("3 !<: {1, 2}", "true"), ("{} count", "0")],
    "order": [("{[2], 1, 'b', {}, true, (a: 1), {7}} orderby .", "[1, {}, true, {7}, 'b', [2], (a: 1)]"), ("{3, 1, 2} order \\a \\b a > b", "[3, 2, 1]"), ("1 < 2 < 3 && 'a' <= 'b'", "true"), ("[1, 2] < [1, 3]", "true"), ("(a: 1, b: 2) < (a: 1, c: 0)", "true")],
    "sequences": [("2\\[5, 6]", "2\\[5, 6]"), ("[1, , 3] count", "2"), ("'abc' ++ 'd'", "'abcd'"), ("[1] ++ [2]", "[1, 2]"), ("[1, 2, 3] >> . * 2", "[2, 4, 6]"), ("[5, 6] >>> \\i \\v i * v", "[0, 6]"), ("'ab' >> . + 1", "'bc'"), ("<<1, 'a', %b>>", "<<1, 97, 98>>"),
                  ("'abcd' where .@ > 1", "2\\'cd'"), ("[7, 8](1)", "8"), ("'ab'(0)", "97"), ("//seq.concat([[1], [2, 3]])", "[1, 2, 3]"), ("//seq.split('-', 'a-b--c')", "['a', 'b', {}, 'c']"), ("//seq.join(', ', ['x', 'y'])", "'x, y'"), ("//seq.sub([1], [9, 9], [1, 2, 1])", "[9, 9, 2, 9, 9]"),
                  ("//seq.contains([2, 3], [1, 2, 3])", "true"), ("//seq.has_suffix('', 'a')", "true"), ("//seq.repeat(3, [1])", "[1, 1, 1]"), ("//seq.trim_prefix('a', 'aab')", "'ab'"), ("//util.reduce(\\a \\x a * 10 + x, 0, [1, 2, 3])", "123"),
                  ("{|@, @item| (0, 'a'), (1, 'b')}", "['a', 'b']"), ("[1, 2] <&> ['p', 'q']", "{}"), ("(['a', 'b'] => (:.@, w: .@item)) <&> ('xy' => (:.@, c: .@char))", "{(@: 0, c: 120, w: 'a'), (@: 1, c: 121, w: 'b')}")],
    "tuples": [("(a: 1, b: 2) +> (b: 3)", "(a: 1, b: 3)"), ("(a: 1, b: 2) :> . + 1", "(a: 2, b: 3)"), ("(a: 1, b: 2).~|a|", "(b: 2)"), ("(a: (b: 3)).a?.c?:9", "9"), ("//dict((a: 1))", "{'a': 1}"), ("//tuple({'a': 1})", "(a: 1)"), ("{'a': 1} +> {'b': 2}", "{'a': 1, 'b': 2}"),
               ("{'a': 1}('b')?:0", "0"), ("//util.merge((a: (b: 1)), (a: (c: 2)))", "(a: (b: 1, c: 2))"), ("(a: 1, &b: 1 + 1).b", "2"), ("*&(1 + 2)", "3"), ("-{1}", "(@neg: {1})"), ("(n: (y: 2)) +> (n+>: (x: 1))", "(n: (x: 1, y: 2))")],
    "patterns": [("let [a, ...t] = [1, 2, 3]; t", "[2, 3]"), ("let (x: p, y?: q: 7) = (x: 1); [p, q]", "[1, 7]"), ("let {'k': v, ...r} = {'k': 1, 'z': 2}; r", "{'z': 2}"), ("let {1, ...r} = {1, 2}; r", "{2}"), ("cond 5 {(4, 5): 'in', _: 'out'}", "'in'"), ("cond [1, 1] {[a, a]: a}", "1"),
                 ("cond (a: 2) {(a: 1): 'one'}", "{}"), ("{1, 2, 3} filter . % 2 {1: .}", "{1, 3}"), ("(\\(a: x) x * 2)((a: 4))", "8"), ("//fn.fix(\\f \\n cond {n < 2: n, _: f(n - 1) + f(n - 2)})(10)", "55"),
                 ("//fn.fixt((e: \\t \\n cond {n = 0: 1, _: t.o(n - 1)}, o: \\t \\n cond {n = 0: 0, _: t.e(n - 1)})).e(4)", "1"), ("let f = \\x x + @d; let (@d: 2); f(1)", "3")],
    "numbers": [("7 // 2 + 7 % 2 * 2 ^ 3 ^ 1", "11"), ("-7 // 2", "-4"), ("-7 % 3", "-1"), ("7 -% 3", "6"), ("!0 && 'x'", "'x'"), ("0 || {} || 3", "3"), ("{} => . && 1", "{}"), ("//bits.set(10)", "{1, 3}"), ("//bits.mask({0, 4})", "17"), ("1 / 0 > 1e308", "true"), ("{1, 2, 3, 10} median .", "2.5"), ("{1, 2, 6} mean .", "3"), ("{'b', 'a'} max .", "'b'")],
    "texts": [("$'${1 + 1:03d}-${[1, 2]::/}'", "'002-1/2'"), ("$'\n  a\n    b'", "'a\\n  b'"), ("//str.title('ab cd')", "'Ab Cd'"), ("//str.repr([1, 'a'])", "'[1, \\'a\\']'"), ("//str.expand('02d', 7, '', '!')", "'07!'"), ("//re.compile('(a)|(b)').match('xab')", "[[1\\'a', 1\\'a'], [2\\'b', , 2\\'b']]"),
              ("//re.compile('[0-9]').sub('#')('a1b2')", "'a#b#'"), ("//re.compile('[a-z]+').subf(//str.upper, '1 ab')", "'1 AB'"), ("//fmt.pretty([(a: 1)])", "'[\\n  (\\n    a: 1,\\n  ),\\n]'"), ("%a", "97"), ("//log.print(3)", "3")],
    "formats": [("//encoding.json.decode('{\"a\": [1, null, true]}')", "{'a': (a: [1, (), (b: true)])}"), ("//encoding.json.encode({'a': [1]})", "<<123, 34, 97, 34, 58, 91, 49, 93, 125>>"), ("//encoding.csv.decode('a,b\n1,\"x, y\"\n')", "[['a', 'b'], ['1', 'x, y']]"),
                ("$'${//encoding.csv.encode([[\"p\", \"q r\"]])}'", "'p,q r\\n'"), ("//encoding.yaml.decode('a: [1, x]')", "{'a': (a: [1, (s: 'x')])}"), ("$'${//encoding.yaml.encode({\"a\": 1})}'", "'a: 1\\n'"), ("//encoding.xml.decode('<r><!--c--><e k=\"v\"/></r>')", "[(children: [(comment: 'c'), (attrs: {(name: 'k', value: 'v')}, elem: 'e')], elem: 'r')]"),
                ("$'${//encoding.xml.encode([(elem: \"r\", children: [\"a<b\"])])}'", "'<r>a&lt;b</r>'"), ("//encoding.bytes.decode('ab')", "<<97, 98>>"), ("//json.tuplify({'a': {'b': 1}})", "(a: (b: 1))"), ("//xml.to_tuple(//encoding.xml.decode('<r><e>1</e></r>'))", "(r: (e: '1'))"),
                ("//table.markdown({|a| (1)})", "'| a |\\n|---|\\n| 1 |\\n'"), ("//flag.parser({'n': (type: 'number')}).parse(['--n', '2']).n", "2"), ("//eval.value('1 + 1')", "2"), ("//eval.evaluator((scope: (x: 4))).eval('x * 2')", "8"), ("//test.assert.equal(1, 1)", "true"), ("//archive.zip.zip({'a': 'b'}) count > 50", "true")],
}


def _values(kind: str) -> None:
    texts = VALUES[kind]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = Engine()
        return spark.createDataFrame([(i, V.show(engine.eval(code))) for i, (code, _) in enumerate(texts)], "i int, value string")

    run.__name__, run.__doc__ = f"values_{kind}", f"Plain {kind}: what texts of them give."
    rows = ", ".join(f"({i}, '{want.replace(chr(39), chr(39) * 2)}')" for i, (_, want) in enumerate(texts))
    QUERIES[f"values_{kind}"], ORACLE_SQL[f"values_{kind}"] = run, f"SELECT i::INTEGER AS i, value FROM (VALUES {rows}) AS t(i, value)"


for _kind in VALUES:
    _values(_kind)


#: A tree of files, written first, and texts that read them: imports by extension, by decoder and of scripts, and functions of the system.
TREE = "{'a.json': '{\"n\": [1, 2]}', 'b.csv': 'k,v\\nx,1\\n', 'c.yaml': 'a: [1, x]', 'd.xml': '<r>t</r>', 'e.bin': <<1, 2>>, 'f.txt': '[5]', 'lib': {'twice.sw': '\\\\x x * 2'}, 'g': (ifExists: 'replace', dir: {'h': 'i'}), 'gone': (ifExists: 'remove')}"
FILES = [
    ("//{./a.json}", "{'n': (a: [1, 2])}"), ("//{./b.csv}", "[['k', 'v'], ['x', '1']]"), ("//{./c.yaml}", "{'a': (a: [1, (s: 'x')])}"), ("//{./d.xml}", "[(children: ['t'], elem: 'r')]"), ("//{./e.bin}", "<<1, 2>>"),
    ("//[//encoding.json]{./f.txt}", "(a: [5])"), ("//[//encoding.csv.decoder((comma: %;))]{./f.txt}", "[['[5]']]"), ("//{./lib/twice}(21)", "42"), ("//{/lib/twice}(4)", "8"), ("//os.file(dir ++ '/f.txt')", "<<91, 53, 93>>"),
    ("//os.exists(dir ++ '/gone')", "{}"), ("//os.exists(dir ++ '/g/h')", "true"), ("((//os.tree(dir) where .is_dir) count) - 1", "2"), ("//os.tree(dir) where .name = 'e.bin' => .size", "{2}"), ("//os.path_separator", "'/'"),
    ("cond (//os.get_env('no such name')) {{}: 'unset'}", "'unset'"), ("//eval.value('//math.pi > 3')", "true"),
]


@query(f"SELECT i::INTEGER AS i, value FROM (VALUES {', '.join(f'({i}, {chr(39)}{want.replace(chr(39), chr(39) * 2)}{chr(39)})' for i, (_, want) in enumerate(FILES))}) AS t(i, value)")
def values_files(spark, sf):
    """Files of the driver, written as a tree and read by texts."""
    with tempfile.TemporaryDirectory(prefix="setweave-") as folder:
        formats.write_dir(Engine().eval(TREE), folder)
        engine = Engine(folder=folder, dir=folder)
        return spark.createDataFrame([(i, V.show(engine.eval(code))) for i, (code, _) in enumerate(FILES)], "i int, value string")


@query("SELECT i::INTEGER AS i, refused FROM (VALUES (0, TRUE), (1, TRUE), (2, TRUE), (3, FALSE)) AS t(i, refused)")
def safe_texts(spark, sf):
    """Texts that a safe engine refuses, and one that it doesn't."""
    rows = []
    for i, code in enumerate(("//os.file('/etc/hosts')", "//{./a.json}", "//net.http.get((), 'http://127.0.0.1/')", "//math.pi")):
        try:
            Engine(safe=True).eval(code)
            rows.append((i, False))
        except V.EvalError:
            rows.append((i, True))
    return spark.createDataFrame(rows, "i int, refused boolean")
