"""Queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions import scalar as S
from setweave.operators.relation import Rel, down, max_of, mean_of, median_of, min_of, sum_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Column that identifies the rows of a table, so that it is a set as it is.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rel(spark: SparkSession, sf: str, name: str, **renamed: str) -> Rel:
    return Rel.parquet(spark, f"{sf}/{name}.parquet", [[KEYS[name]]] if name in KEYS else False).rename(**renamed)


def customers(spark: SparkSession, sf: str) -> Rel:
    return rel(spark, sf, "customer", c_custkey="custkey", c_nationkey="nationkey")


def nations(spark: SparkSession, sf: str) -> Rel:
    return rel(spark, sf, "nation", n_nationkey="nationkey", n_regionkey="regionkey")


def rich_orders(spark: SparkSession, sf: str) -> Rel:
    return rel(spark, sf, "orders", o_custkey="custkey").where("o_totalprice > 300000")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders joined with customers, folded by market segment, ranked by revenue."""
    orders = rel(spark, sf, "orders", o_custkey="custkey").project("o_orderkey", "custkey", "o_totalprice")
    joined = orders.join(customers(spark, sf).project("custkey", "c_mktsegment"))
    return joined.group("c_mktsegment", revenue=F.round(sum_of("o_totalprice"), 2)).rank(place=down("revenue")).df


_SEG = "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
query(f"SELECT *, CAST(rank() OVER (ORDER BY revenue DESC) - 1 AS DOUBLE) AS place FROM ({_SEG})")(flagship)

_C = "SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_name, c_mktsegment FROM customer"
_RICH = "SELECT o_custkey FROM orders WHERE o_totalprice > 300000"


def _c(spark: SparkSession, sf: str) -> Rel:
    return customers(spark, sf).project("custkey", "nationkey", "c_name", "c_mktsegment")


@query(f"SELECT c.*, n_name, n_regionkey AS regionkey FROM ({_C}) c JOIN nation ON nationkey = n_nationkey")
def join_natural(spark, sf):
    return _c(spark, sf).join(nations(spark, sf)).df


@query("SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_compose(spark, sf):
    return customers(spark, sf).project("nationkey", "c_mktsegment").compose(nations(spark, sf).project("nationkey", "n_name")).df


@query(f"SELECT c_custkey AS custkey FROM customer INTERSECT {_RICH}")
def join_common(spark, sf):
    return customers(spark, sf).common(rich_orders(spark, sf)).df


@query(f"SELECT EXISTS(SELECT 1 FROM customer WHERE c_custkey IN ({_RICH})) AS found")
def join_exists(spark, sf):
    return customers(spark, sf).exists(rich_orders(spark, sf)).df.agg((F.count(F.lit(1)) > 0).alias("found"))


@query(f"SELECT * FROM ({_C}) WHERE custkey IN ({_RICH})")
def join_left_match(spark, sf):
    return _c(spark, sf).left_match(rich_orders(spark, sf)).df


@query(f"SELECT * FROM ({_C}) WHERE custkey IN ({_RICH})")
def join_right_match(spark, sf):
    return rich_orders(spark, sf).right_match(_c(spark, sf)).df


@query(f"SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey IN ({_RICH})")
def join_left_residue(spark, sf):
    return customers(spark, sf).project("custkey", "c_mktsegment").left_residue(rich_orders(spark, sf)).df


@query(f"SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey IN ({_RICH})")
def join_right_residue(spark, sf):
    return rich_orders(spark, sf).right_residue(customers(spark, sf).project("custkey", "c_mktsegment")).df


@query(f"SELECT * FROM ({_C}) WHERE custkey NOT IN ({_RICH})")
def join_anti(spark, sf):
    return _c(spark, sf).anti(rich_orders(spark, sf)).df


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, sf):
    return rel(spark, sf, "region").project("r_name").join(rel(spark, sf, "nation").project("n_name")).df


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
def join_theta(spark, sf):
    both = rel(spark, sf, "region").join(rel(spark, sf, "nation"))
    return both.where("r_regionkey < n_regionkey").project("r_name", "n_name").df


_A = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45"
_B = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08"


def _ab(spark, sf):
    items = rel(spark, sf, "lineitem")
    return (items.where(p).map(k="l_partkey") for p in ("l_quantity > 45", "l_discount > 0.08"))


@query(f"{_A} UNION {_B}")
def set_union(spark, sf):
    a, b = _ab(spark, sf)
    return a.union(b).df


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf):
    a, b = _ab(spark, sf)
    return a.intersect(b).df


@query(f"{_A} EXCEPT {_B}")
def set_minus(spark, sf):
    a, b = _ab(spark, sf)
    return a.minus(b).df


@query(f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})")
def set_symmetric(spark, sf):
    a, b = _ab(spark, sf)
    return a.symmetric(b).df


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def project_distinct(spark, sf):
    return rel(spark, sf, "lineitem").project("l_returnflag", "l_linestatus").df


@query("SELECT DISTINCT n_regionkey * 2 AS d, length(n_name) AS n FROM nation")
def map_computed(spark, sf):
    return rel(spark, sf, "nation").map(d="n_regionkey * 2", n="length(n_name)").df


@query("SELECT * REPLACE (upper(c_mktsegment) AS c_mktsegment), c_acctbal < 0 AS debt FROM customer WHERE c_acctbal > 5000 OR c_acctbal < 0")
def where_merge(spark, sf):
    return rel(spark, sf, "customer").where("c_acctbal > 5000 OR c_acctbal < 0").merge(c_mktsegment="upper(c_mktsegment)", debt="c_acctbal < 0").df


@query("SELECT DISTINCT CASE WHEN p_size < 10 THEN 'small' ELSE p_brand END AS value FROM part WHERE p_size < 10 OR p_size > 45")
def filter_cases(spark, sf):
    cases = (F.col("p_size") < 10, F.lit("small")), (F.col("p_size") > 45, F.col("p_brand"))
    return rel(spark, sf, "part").choose(*cases).df


_FOLD = "round(sum(l_quantity), 2) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS mid, count(*) AS n"


def _folds():
    q = "l_quantity"
    return dict(s=F.round(sum_of(q), 2), lo=min_of(q), hi=max_of(q), mean=F.round(mean_of(q), 6), mid=median_of(q), n=F.count(F.lit(1)))


def _items(spark, sf):
    return rel(spark, sf, "lineitem").project("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")


_ITEMS = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem)"


@query(f"SELECT l_returnflag, {_FOLD} FROM {_ITEMS} GROUP BY 1")
def fold_grouped(spark, sf):
    return _items(spark, sf).group("l_returnflag", **_folds()).df


@query(f"SELECT {_FOLD} FROM {_ITEMS}")
def fold_all(spark, sf):
    return _items(spark, sf).fold(**_folds()).df


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def fold_having(spark, sf):
    return rel(spark, sf, "orders").group("o_custkey", n=F.count(F.lit(1))).where("n > 12").df


@query("SELECT count(DISTINCT o_orderpriority) AS n FROM orders")
def count_distinct(spark, sf):
    return rel(spark, sf, "orders").project("o_orderpriority").fold(n=F.count(F.lit(1))).df


@query("SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS n_name FROM nation GROUP BY 1")
def nest_single(spark, sf):
    return rel(spark, sf, "nation").project("n_regionkey", "n_name").nest_single("n_name").df


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def nest_unnest(spark, sf):
    return rel(spark, sf, "nation").nest_by("n_regionkey", into="g").unnest("g").df


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def nest_multi(spark, sf):
    nested = rel(spark, sf, "nation").nest("n_name", "n_nationkey", into="g")
    names = F.array_join(F.sort_array(F.transform("g", lambda x: x["n_name"])), ",")
    return nested.map(n_regionkey="n_regionkey", n=F.size("g").cast("long"), names=names).df


@query("SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_orderdate) - 1 AS DOUBLE) AS r FROM orders")
def rank_global(spark, sf):
    return rel(spark, sf, "orders").project("o_orderkey", "o_orderdate").rank(r="o_orderdate").project("o_orderkey", "r").df


@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) - 1 AS DOUBLE) AS r FROM orders")
def rank_partitioned(spark, sf):
    return rel(spark, sf, "orders").rank(by=["o_custkey"], r=down("o_totalprice")).project("o_orderkey", "r").df


@query("SELECT * FROM (SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_totalprice DESC) - 1 AS DOUBLE) AS r FROM orders) WHERE r < 10")
def top_k(spark, sf):
    return rel(spark, sf, "orders").top(10, "r", down("o_totalprice")).project("o_orderkey", "r").df


@query("SELECT string_agg(n_name, ',' ORDER BY n_regionkey, n_name) AS names FROM nation")
def order_array(spark, sf):
    made = rel(spark, sf, "nation").project("n_name", "n_regionkey").order_array("n_regionkey", "n_name")
    return made.map(names=F.array_join(F.transform("items", lambda x: x["n_name"]), ",")).df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS d, floor(l_extendedprice / 7.0) AS f, (-l_quantity) % 7.0::DOUBLE AS m, power(l_discount, 2.0) AS p FROM lineitem")
def arithmetic(spark, sf):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    made = dict(d=S.divide(e, q), f=S.floor_divide(e, F.lit(7.0)), m=S.modulo(-q, F.lit(7.0)), p=S.power(F.col("l_discount"), F.lit(2.0)))
    return rel(spark, sf, "lineitem").map(l_orderkey="l_orderkey", l_linenumber="l_linenumber", **made).df


@query("SELECT p_partkey, upper(string_split(p_name, ' ')[1]) AS first, len(string_split(p_name, ' ')) AS n, replace(p_brand, 'Brand', 'B') AS b, starts_with(p_type, 'S') AS s, unicode(p_name) AS c FROM part")
def sequences(spark, sf):
    words = S.split(" ", F.col("p_name"))
    made = dict(first=F.upper(F.get(words, F.lit(0))), n=F.size(words).cast("long"), b=S.sub(F.lit("Brand"), F.lit("B"), F.col("p_brand")), s=F.col("p_type").startswith("S"))
    return rel(spark, sf, "part").map(p_partkey="p_partkey", c=S.char_at(F.col("p_name"), 0).cast("int"), **made).df


@query("SELECT p_partkey, list_aggregate(regexp_extract_all(p_name, '[a-z]+'), 'string_agg', '-') AS w, regexp_replace(p_brand, '[0-9]', '#', 'g') AS b FROM part")
def regular_expressions(spark, sf):
    found = F.array_join(F.transform(S.matches("[a-z]+", 0, F.col("p_name")), lambda x: x[0]), "-")
    w = F.when(found != "", found)
    return rel(spark, sf, "part").map(p_partkey="p_partkey", w=w, b=F.regexp_replace("p_brand", "[0-9]", "#")).df


@query("SELECT p_partkey, coalesce(list_aggregate(list_filter(range(0, 63), lambda i: ((p_partkey >> i) & 1) = 1), 'string_agg', ','), '') AS bits, p_partkey::DOUBLE AS mask FROM part")
def bits(spark, sf):
    positions = S.bit_set(F.col("p_partkey"))
    return rel(spark, sf, "part").map(p_partkey="p_partkey", bits=F.array_join(positions, ","), mask=S.bit_mask(positions)).df


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_get(spark, sf):
    return rel(spark, sf, "events").map(event_id="event_id", k=F.get_json_object("props", "$.k").cast("long")).df


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def tumbling_window(spark, sf):
    made = rel(spark, sf, "events").df.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("window.start").alias("start"), "n", "total")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, p_size + 7 AS dst FROM part), r(node) AS (SELECT 1 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r"
)
def explore(spark, sf):
    from setweave.plans.recursion import explore as reach

    edges = rel(spark, sf, "part").map(src="p_size", dst="p_size + 7").df
    return reach(spark.createDataFrame([(1,)], "node int"), edges)


@query("SELECT n, count(*) AS c FROM (SELECT unnest(range(32)) AS m) t, (SELECT unnest(range(0, 6)) AS n) s WHERE bit_count(m) = n GROUP BY n")
def power_set(spark, sf):
    subsets = rel(spark, sf, "region").project("r_name").power_set()
    return subsets.df.groupBy(F.size("subset").cast("long").alias("n")).agg(F.count("*").alias("c"))


#: A query in the language, as text; it lowers to the same plans as the methods.
TEXT = "orders => (k: .o_custkey, p: .o_totalprice) where .p > 300000 nest ~|k|g => (k: .k, s: .g sum .p)"


@query("SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS s FROM (SELECT DISTINCT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) GROUP BY 1")
def language_text(spark, sf):
    from setweave.lang.engine import Engine

    engine = Engine(spark)
    engine.bind("orders", rel(spark, sf, "orders"))
    return engine.eval(TEXT).df.select("k", F.round("s", 2).alias("s"))


def _texts(spark, sf: str, *names: str):
    from setweave.lang.engine import Engine

    engine = Engine(spark)
    for name in names:
        engine.bind(name, rel(spark, sf, name))
    return engine


@query("SELECT c_custkey AS k, c_name || ': ' || printf('%.2f', c_acctbal) || ' of ' || printf('%03d', c_nationkey) AS t FROM customer")
def language_templates(spark, sf):
    return _texts(spark, sf, "customer").eval("customer => (k: .c_custkey, t: $'${.c_name}: ${.c_acctbal:.2f} of ${.c_nationkey:03d}')").df


@query(
    "SELECT DISTINCT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS state, CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0 END AS p "
    "FROM orders WHERE o_orderstatus IN ('F', 'O')"
)
def language_filter(spark, sf):
    cases = "{(o_orderstatus: 'F', o_custkey: c, o_totalprice: t, ...): (k: c, state: 'done', p: t), (o_orderstatus: 'O', o_custkey: c, ...): (k: c, state: 'open', p: 0)}"
    return _texts(spark, sf, "orders").eval(f"orders filter . {cases}").df


@query("SELECT DISTINCT c_nationkey AS n, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'HOUSEHOLD' THEN 'h' ELSE c_mktsegment || '!' END AS s FROM customer")
def language_match(spark, sf):
    return _texts(spark, sf, "customer").eval("customer => (n: .c_nationkey, s: cond .c_mktsegment {'BUILDING': 'b', 'HOUSEHOLD': 'h', other: $'${other}!'})").df
