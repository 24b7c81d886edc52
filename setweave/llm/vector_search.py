"""Exact top-k search by multi-resolution segment statistics: bounds from coarse to fine, then exact distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setweave.llm.common import cut, drop, likely_first, table

K, EVERY, SCALE = 5, 50, 256.0
#: Queries that are sent to the executors at once (bytes: times dimension and 8), and candidates in one numpy step.
BLOCK, STEP = 4096, 4096
#: Candidates by whose scores first thresholds are set; they change what is computed, never what is found.
SEEDS = 4096
#: Segments of a vector at each resolution, and steps after which a resolution that pruned little is tried again.
LEVELS, RETRY = (4, 16, 32), 32
#: Doubles add whole numbers exactly below this.
EXACT = 2.0**53
LONG = 2**63
#: Stands for no id (a row with it is found as any other, but after those of the same score).
NOBODY = np.iinfo(np.int64).max


class Block:
    """A block of queries of one dimension, with their segment statistics.

    ``floor`` holds scores that each query's k-th best is known to reach. ``pairs`` and ``exact`` count the pairs that were
    met and those whose exact scores were computed.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.floor = np.full(len(ids), -LONG, dtype=np.int64) if floor is None else floor
        self.norms = np.linalg.norm(vectors, axis=1)
        self.levels = [n for n in levels if n < vectors.shape[1]]
        unit = vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.stats = [statistics(unit, n).astype(np.float32) for n in self.levels]
        self.pruned, self.steps, self.pairs, self.exact = [1.0] * len(self.levels), 0, 0, 0

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of nothing yet."""
        n = len(self.ids)
        return np.full((n, self.k), -LONG, dtype=np.int64), np.full((n, self.k), NOBODY)

    def near(self, floor: np.ndarray, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may reach ``floor``.

        |q-x|^2 = |q|^2 + |x|^2 - 2qx, and at every resolution |q-x|^2 >= sum over segments of
        length * ((mean_q-mean_x)^2 + (deviation_q-deviation_x)^2), so qx <= sum of length * (mean mean + deviation
        deviation): a pair goes on to the next resolution only while that can reach the k-th best score. Bounds are in
        single precision, of vectors of length 1 at most, with a margin over their rounding. While most pairs are left they are
        one matrix product; a coarse resolution that pruned under a tenth is left out for some steps.
        """
        most = max(float(norms.max(initial=0.0)), 1e-300)
        with np.errstate(over="ignore"):
            need = np.where(floor > -LONG, floor / np.maximum(self.norms * most, 1e-300), -np.inf)
        size, rows, cols, open_pairs = len(self.ids) * len(x), None, None, None
        for level, (n, mine) in enumerate(zip(self.levels, self.stats, strict=True)):
            last = level == len(self.levels) - 1
            if not last and self.pruned[level] < 0.1 and self.steps % RETRY:
                continue
            least = (need - (2 * n + 8) * 2.0**-22).astype(np.float32)
            theirs = statistics(x / most, n).astype(np.float32)
            if rows is None:
                passed = mine @ theirs.T >= least[:, None]
                before = size if open_pairs is None else np.count_nonzero(open_pairs)
                open_pairs = passed if open_pairs is None else open_pairs & passed
                now = np.count_nonzero(open_pairs)
                if now <= size // 16:
                    rows, cols = np.nonzero(open_pairs)
            else:
                before = len(rows)
                passed = np.einsum("ij,ij->i", mine[rows], theirs[cols]) >= least[rows]
                rows, cols = rows[passed], cols[passed]
                now = len(rows)
            self.pruned[level] = 1 - now / max(1, before)
        self.steps += 1
        if rows is None:
            rows, cols = np.nonzero(np.ones((len(self.ids), len(x)), bool) if open_pairs is None else open_pairs)
        self.pairs, self.exact = self.pairs + size, self.exact + len(rows)
        return rows, cols

    def scores(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Exact inner products: by doubles while no sum reaches 2**53, else by longs while none leaves their range, else
        by whole numbers of any size, which are then cut to that range."""
        high = self.norms[rows] * norms[cols]
        if len(rows) * 8 > len(self.ids) * len(x):
            out = (self.vectors @ x.T)[rows, cols]
        else:
            out = np.empty(len(rows))
            for a in range(0, len(rows), 1 << 16):
                out[a : a + (1 << 16)] = np.einsum("ij,ij->i", self.vectors[rows[a : a + (1 << 16)]], x[cols[a : a + (1 << 16)]])
        large = np.flatnonzero(high >= EXACT)
        out[large] = 0
        out = out.astype(np.int64)
        for i in large.tolist():
            q, c = self.vectors[rows[i]], x[cols[i]]
            if high[i] < LONG / 2:
                out[i] = q.astype(np.int64) @ c.astype(np.int64)
            else:
                out[i] = min(max(sum(int(a) * int(b) for a, b in zip(q.tolist(), c.tolist(), strict=True)), -LONG), LONG - 1)
        return out

    def update(self, best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of each query, after these candidates too."""
        scores, found = best
        for a in range(0, len(ids), STEP):
            own, x = ids[a : a + STEP], vectors[a : a + STEP]
            norms, floor = np.linalg.norm(x, axis=1), np.maximum(scores[:, -1], self.floor)
            rows, cols = self.near(floor, x, norms)
            exact = self.scores(rows, cols, x, norms)
            keep = (self.ids[rows] != own[cols]) & (exact >= floor[rows])
            rows, cols, exact = rows[keep], cols[keep], exact[keep]
            if not len(rows):
                continue
            order = np.lexsort((own[cols], ~exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            top = place < self.k
            rows, place = rows[top], place[top]
            new_s, new_i = self.start()
            new_s[rows, place], new_i[rows, place] = exact[top], own[cols[top]]
            touched = np.unique(rows)
            s = np.concatenate([scores[touched], new_s[touched]], axis=1)
            i = np.concatenate([found[touched], new_i[touched]], axis=1)
            by = np.lexsort((i, ~s, i == NOBODY), axis=1)[:, : self.k]
            scores[touched], found[touched] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        return scores, found


def statistics(x: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of n segments, times the root of the segment's length: products of two rows bound scores."""
    edges = np.linspace(0, x.shape[1], n + 1).astype(int)
    size = np.diff(edges).astype(float)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    mean = total / size
    var = np.maximum(np.add.reduceat(x**2, edges[:-1], axis=1) / size - mean**2, 0)
    return np.concatenate([mean, np.sqrt(var)], axis=1) * np.sqrt(np.concatenate([size, size]))


def _scaled(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``i`` and ``v``: ids and scaled vectors of doubles with whole values, without those that take no part."""
    v = F.transform(df[vector_col], lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    bad = F.exists(df[vector_col], lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df[id_col].isNotNull() & df[vector_col].isNotNull() & ~F.coalesce(bad, F.lit(True))
    return df.where(good).select(df[id_col].alias("i"), v.alias("v"))


def matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _blocks(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by dimension."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ids, vectors = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(vectors))
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        out[int(dim)] = (ids[at], matrix(vectors, at, int(dim)))
    return out


def top_k(
    df: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, seeds: int = SEEDS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k rows of greatest inner product for each query.

    Vectors are floor(scale * x). Queries are the rows whose id is divisible by ``every``; candidates are all rows of the
    same dimension but those with the query's own id; ties go to the smaller id. Null ids, null vectors and those with a
    null or non-finite component take no part. If rows repeat an id, its smallest vector is the query, and
    each row counts as a candidate. Fewer candidates give fewer rows; empty vectors score 0; an empty table
    gives no rows. Components (as doubles) and scores beyond a long's range are cut to it; an id of 2**63 - 1 is never found.

    Blocks of about ``block`` queries go to the executors one after the other; of each only the current one is on the driver and
    broadcast. Its pass over all candidates shuffles no vectors, and each task keeps k rows a query at most. It starts from
    the k-th best scores among ``seeds`` candidates at most, chosen by a hash of the id: a lower bound of the final ones, so that bounds prune from
    the first step on and tasks give only rows that may be final. Each pass is written to the shared folder.
    """
    spark = df.sparkSession
    scaled = _scaled(df, id_col, vector_col, scale)
    asked = cut(scaled.where(F.col("i") % every == 0).groupBy("i").agg(F.min("v").alias("v")))
    total = asked.count()
    if not total:
        drop(asked)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = _blocks(likely_first(scaled, seeds, "first thresholds", "i")[0].limit(seeds).toArrow())
    n_blocks, passes = -(-total // block), []
    numbered = asked.withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "i"), F.lit(n_blocks)))
    for b in range(n_blocks):
        rows = numbered.where(F.col("b") == b).select("i", "v").toArrow()
        if rows.num_rows:
            passes.append(_pass(scaled, _blocks(rows), first, k))
    drop(asked)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = reduce(DataFrame.unionAll, passes).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pass(scaled: DataFrame, blocks: dict[int, tuple[np.ndarray, np.ndarray]], first: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """What the candidates of each task have for one block of queries, written."""
    with_floors = {}
    for dim, (ids, vectors) in blocks.items():
        made = Block(ids, vectors, k)
        seen = made.update(made.start(), *first[dim]) if dim in first else made.start()
        with_floors[dim] = ids, vectors, seen[0][:, -1]
    sent = scaled.sparkSession.sparkContext.broadcast(with_floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            own, column = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.asarray(pa.compute.list_value_length(column))
            for dim, (ids, vectors, floor) in sent.value.items():
                at = np.flatnonzero(lengths == dim)
                if not len(at):
                    continue
                if dim not in state:
                    made = Block(ids, vectors, k, floor=floor)
                    state[dim] = made, made.start()
                made, best = state[dim]
                state[dim] = made, made.update(best, own[at], matrix(column, at, dim))
        for made, (scores, found) in state.values():
            r, c = np.nonzero(found != NOBODY)
            cols = [made.ids[r], found[r, c], scores[r, c]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    out = cut(scaled.mapInArrow(run, "query_id long, vec_id long, score long"))
    sent.destroy()
    return out


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE:g} * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
 FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= {K}
"""
