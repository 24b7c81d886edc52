"""Quality classifier by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated class prior."""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import cut, drop, fold, map_texts, table

THRESHOLD = 0.7
#: Weight of half the squared weights (but the bias) in what is minimised.
DECAY = 0.01
#: Rows in which the sums of all tasks meet before they go to the driver.
MEET = 64
#: Bins of a preliminary score in which all documents are counted for the class prior.
SCORE_BINS = 200
FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "upper", "digits", "symbols", "shouts", "pipes", "stops", "spaces", "other_marks", "non_ascii",
    "distinct", "most_common", "next_to_itself", "distinct_pairs", "duplicate_lines", "short_lines", "end_in_symbol", "byte_entropy", "capitalised", "empty",
)
_SYMBOLS, _ENDS = list(b"#*$%&<>"), (b"*", b"#", b"%", b"&", b"$", b"!", b"|")
_OTHER = [c for c in range(33, 127) if not chr(c).isalnum() and c not in b"#*$%&<>!|.,"]


def features(texts: list[str]) -> np.ndarray:
    """Surface statistics of whole texts, a row each."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        if not n:
            out[i, -1] = 1
            continue
        b = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(float)
        size, share = len(raw), b / len(raw)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        kinds = Counter(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        some = share[share > 0]
        letters = max(1.0, b[65:91].sum() + b[97:123].sum())
        pairs = len(set(zip(words, words[1:], strict=False)))
        out[i] = (
            np.log1p(n), lengths.mean(), (lengths > 20).mean(), (lengths < 3).mean(), b[65:91].sum() / letters, share[48:58].sum(), share[_SYMBOLS].sum(), share[33],
            share[124], share[[46, 44]].sum(), 1 - lengths.sum() / size, share[_OTHER].sum(), share[128:].sum(),
            len(kinds) / n**0.8, max(kinds.values()) / n, sum(map(operator.eq, words, words[1:])) / n, pairs / max(1, n - 1), (len(lines) - len(set(lines))) / len(lines),
            sum(len(x) < 40 for x in lines) / len(lines), sum(w.endswith(_ENDS) for w in words) / n, float(-(some * np.log(some)).sum()),
            sum(w[:1].isupper() for w in words) / n, 0,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(shape(x, self.mean, self.scale) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def shape(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, np.maximum(z - 1.5, 0), np.maximum(-z - 1.5, 0)], axis=1)


@dataclass
class Curve:
    """Sums over one side's rows at some weights: rows, logistic losses as negatives and as positives, rows themselves, rows by
    probability, and rows' products by its variance."""

    n: float
    negative: float
    positive: float
    rows: np.ndarray
    pulled: np.ndarray
    bent: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray) -> Curve:
        z = x @ w
        s = _sigmoid(z)
        return cls(len(x), np.logaddexp(0, z).sum(), np.logaddexp(0, -z).sum(), x.sum(axis=0), s @ x, (x * (s * (1 - s))[:, None]).T @ x)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n, self.negative, self.positive], self.rows, self.pulled, self.bent.ravel()])

    @classmethod
    def from_flat(cls, v: np.ndarray, width: int) -> Curve:
        return cls(*v[:3], v[3 : 3 + width], v[3 + width : 3 + 2 * width], v[3 + 2 * width :].reshape(width, width))

    def risk(self, positive: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean logistic loss of all rows as positives or as negatives, with gradient and Hessian."""
        value, pull = (self.positive, self.pulled - self.rows) if positive else (self.negative, self.pulled)
        return value / self.n, pull / self.n, self.bent / self.n


Curves = Callable[[np.ndarray], tuple[Curve, Curve]]
Risk = tuple[float, np.ndarray, np.ndarray]


def _sum(*parts: tuple[float, Risk], w: np.ndarray, decay: float) -> Risk:
    """A weighted sum of risks and the decay of weights."""
    d = np.append(np.full(len(w) - 1, decay), 0.0)
    value, slope, bend = (sum(a * r[k] for a, r in parts) for k in range(3))
    return value + 0.5 * (d * w * w).sum(), slope + d * w, bend + np.diag(d + 1e-9)


def separate(curves: Curves, width: int, decay: float = DECAY, rounds: int = 30) -> np.ndarray:
    """A logistic model of positives against unlabelled, both sides weighing the same, by damped Newton steps."""
    w = np.zeros(width)

    def at(w: np.ndarray) -> Risk:
        p, u = curves(w)
        return _sum((0.5, p.risk(True)), (0.5, u.risk(False)), w=w, decay=decay)

    now, step = at(w), 1.0
    for _ in range(rounds):
        move = np.linalg.solve(now[2], now[1])
        if now[1] @ move < 1e-5:
            break
        new = at(w - step * move)
        if new[0] <= now[0]:
            w, now, step = w - step * move, new, 1.0
        else:
            step /= 2
    return w


def nn_pu(curves: Curves, prior: float, width: int, decay: float = DECAY, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Minimises prior * R_p(+) + max(0, bracket), bracket = R_u(-) - prior * R_p(-), with the logistic loss and decay.

    With this loss both prior * R_p(+) and its sum with the bracket are convex, so the risk is the greater of two convex functions. At its
    least, prior * R_p(+) + share * bracket is least too, for some share in [0, 1]: 1 if the bracket is positive there, else
    that at which the bracket is 0. Newton steps on the weights; whenever they have settled, one on the logarithm of the share, inside the
    interval that the brackets' signs leave. Returns the weights and the bracket.
    """
    w, share, low, high, step = np.zeros(width), 0.3, 0.0, 1.0, 1.0

    def at(w: np.ndarray) -> tuple[Risk, Risk]:
        p, u = curves(w)
        good, bad, whole = p.risk(True), p.risk(False), u.risk(False)
        bracket = tuple(whole[k] - prior * bad[k] for k in range(3))
        return (prior * good[0], prior * good[1], prior * good[2]), bracket

    def total(now: tuple[Risk, Risk], w: np.ndarray) -> Risk:
        return _sum((1.0, now[0]), (share, now[1]), w=w, decay=decay)

    now = at(w)
    for _ in range(rounds):
        value, slope, bend = total(now, w)
        move = np.linalg.solve(bend, slope)
        if slope @ move > 1e-5 * share:
            new = at(w - step * move)
            if total(new, w - step * move)[0] <= value:
                w, now, step = w - step * move, new, 1.0
            else:
                step /= 2
            continue
        bracket = now[1][0]
        low, high = (share, high) if bracket > 0 else (low, share)
        if abs(bracket) < 1e-3 or bracket > 0 and share == 1.0 or high - low < 1e-3 * high or high < 1e-9:
            break
        fall = share * (now[1][1] @ np.linalg.solve(bend, now[1][1]))
        to = share * math.exp(min(3.0, max(-3.0, bracket / fall))) if fall > 0 else 0.0
        share = 1.0 if bracket > 0 and to >= 1.0 else to if low < to < high else math.sqrt(low * high) if low else high / 10
    return w, now[1][0]


def class_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio U(S) / P(S) over the sets S of scores above a threshold
    that hold nine tenths of the positives at least (so that chance moves it little). Both are counts by score bin, rising."""
    u, p = unlabelled[::-1].cumsum() / max(1, unlabelled.sum()), positive[::-1].cumsum() / max(1, positive.sum())
    wide = p >= 0.9
    return float(np.clip((u[wide] / p[wide]).min(), 0.02, 0.98)) if wide.any() else 0.5


def summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``sums`` gives for the features and flags of some rows, added up over all rows of ``rows``: in each task, then among the tasks
    by their number modulo MEET, and of these rows on the driver."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                total = total + sums(x, np.asarray(batch.column(0)).astype(bool))
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MEET], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    def some(t: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([sum(map(np.frombuffer, t.column("v").to_pylist())).tobytes()], pa.binary())})

    made = rows.select("good", "x").mapInArrow(one, "k int, v binary").groupBy("k").applyInArrow(some, "v binary").toArrow()
    return sum(map(np.frombuffer, made.column(0).to_pylist()))


def fit(rows: DataFrame, decay: float = DECAY) -> Model | None:
    """``rows``: ``x`` (features) and ``good`` (true for a trusted positive), of all documents that may be learned from.

    All rows count as unlabelled, and all of them, with all positives, are in every sum: of features' means and deviations (of positives), of
    the class prior, and of each Newton step's risk, slope and curvature, which executors add up. None without any positive row.
    """
    n = len(FEATURES)
    totals = summed(rows, lambda x, good: np.concatenate([[good.sum()], x[good].sum(axis=0), (x[good] ** 2).sum(axis=0)]))
    if not isinstance(totals, np.ndarray) or not totals[0]:
        return None
    mean = totals[1 : n + 1] / totals[0]
    scale = np.sqrt(np.maximum(totals[n + 1 :] / totals[0] - mean**2, 0)) + 1e-3
    width = 3 * n + 1

    def curves(w: np.ndarray) -> tuple[Curve, Curve]:
        def sums(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            wide = np.concatenate([shape(x, mean, scale), np.ones((len(x), 1))], axis=1)
            return np.concatenate([Curve.of(wide[good], w).flat(), Curve.of(wide, w).flat()])

        p, u = np.split(summed(rows, sums), 2)
        return Curve.from_flat(p, width), Curve.from_flat(u, width)

    first = separate(curves, width, decay)
    model = Model(mean, scale, first[:-1], float(first[-1]), prior=0.5)
    counts = summed(rows, lambda x, good: _binned(model.scores(x), good)).reshape(2, SCORE_BINS)
    prior = class_prior(*counts)
    w, _ = nn_pu(curves, prior, width, decay)
    return Model(mean, scale, w[:-1], float(w[-1]), prior=prior)


def _binned(scores: np.ndarray, good: np.ndarray) -> np.ndarray:
    at = np.minimum((scores * SCORE_BINS).astype(int), SCORE_BINS - 1)
    return np.concatenate([np.bincount(at, minlength=SCORE_BINS), np.bincount(at[good], minlength=SCORE_BINS)]).astype(float)


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``x``, the features of each row's text (null: empty)."""
    return map_texts(df, lambda: lambda texts: {"x": list(features(texts))}, "x array<float>", [id_col], text_col)


def classify(df: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out`` and ``score`` (0 to 1, higher: good quality) of each row of ``df``.

    ``labels`` has ``doc_id`` and ``quality``. Positives are rows labelled 1 outside the held-out fold of crc32(id); all rows
    outside it count as unlabelled, whatever their labels. Null labels count as none; if labels repeat an id, one 1 suffices. A
    null or empty text has features of its own and a score; a null id is never a positive; repeated rows have
    equal scores; without anything to learn from all scores are 0.5. Texts are read once, into a table of features.
    """
    x = cut(featured(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("good", F.lit(True))
    outside = x.where(fold(F.col("doc_id"), parts) != held_out)
    rows = cut(outside.join(good, "doc_id", "left").select("x", F.coalesce("good", F.lit(False)).alias("good")))
    model = fit(rows)
    drop(rows)
    return apply(x, model).withColumn("held_out", fold(F.col("doc_id"), parts) == held_out)


def apply(x: DataFrame, model: Model | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = model.scores(v) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
