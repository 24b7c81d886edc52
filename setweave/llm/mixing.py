"""Mixing sources to target weights: repetition rates from token totals, then whole copies plus a hash-seeded coin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setweave.llm.common import cut, table

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
_WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def coin(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and id: the same on each run and on any machine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source.

    Sources stand in order of code point, null last, and weigh ``weights`` in turn. Together they share
    all of ``size``; a target ends at ``most`` times its source's size, and what is over is shared by weight among the
    others until none is above. That is target = least(weight * level, most * size), with one level: in order of
    size over weight, the ended sources come first, and the level is that of the first source that doesn't end. One row
    a source is gathered for this, after sums on the executors.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(weights)
    weighed = by.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int")))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, all_rows = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = (F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
    left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", rest / left).withColumn("ends", F.col("level") * F.col("weight") > most * F.col("source_size"))
    first = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level")
    final = F.min(F.when(~F.col("ends"), first)).over(all_rows)["level"]
    target = F.least(F.col("weight") * F.coalesce(final, F.lit(0.0)), (most * F.col("source_size")).cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``n_copies`` of each row.

    The rate of a source is target / source_size; a document is taken floor(rate) times, and once more
    if its coin is below the fraction. A null text has size 0; a source without words has target 0 and its
    documents are not taken; null is a source of its own; rows with the same id have the same coin, so
    repeated rows are taken alike; an empty table gives no rows.
    """
    sized = cut(df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), n_words(df[text_col]).alias("size")))
    goal = targets(sized, weights, most).withColumnRenamed("source", "goal_source")
    joined = sized.join(goal, sized["source"].eqNullSafe(goal["goal_source"])).drop("goal_source")
    return _with_copies(joined, F.col("doc_id"), seed)


def _with_copies(joined: DataFrame, id_col: Column, seed: str) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = F.floor(rate) + F.when(coin(id_col, seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("n_copies", n.cast("long"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED
) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, all columns as they are. Targets as in ``copies``."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    source, text, own = (F.col(f"c{names.index(c)}") for c in (source_col, text_col, id_col))
    goal = targets(plain.select(source.alias("source"), n_words(text).alias("size")), weights, most)
    goal = cut(goal.withColumnRenamed("source", "goal_source"))
    taken = _with_copies(plain.join(goal, source.eqNullSafe(F.col("goal_source"))), own, seed)
    repeated = taken.where("n_copies > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return repeated.select(*plain.columns).toDF(*names)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = copies(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
l AS (SELECT *, source_size::DOUBLE / weight AS ratio,
 (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lev
 FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lev FROM l WHERE lev * weight <= {MOST} * source_size ORDER BY ratio, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(weight * coalesce((SELECT lev FROM f), 0), ({MOST} * source_size)::DOUBLE) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
 ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {16**13}::DOUBLE AS coin
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken FROM r
"""
