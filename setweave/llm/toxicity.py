"""Toxicity by noisy-channel deobfuscation: Viterbi over character lattices under a character model, then scores of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm import near_dedup
from setweave.llm.common import cut, drop, filter_texts, fold, give_back, likely_first, map_texts, steps, table, texts_of

THRESHOLD = 0.3
#: Labelled rows that words are learned from, at most; the character model counts all documents.
SAMPLE = 20_000
#: Least share of toxic texts among those with a word or stem that is evidence. How many texts with it that
#: takes follows from the number of candidates: chance may bring about exp(-MARGIN) pieces of evidence.
LEAST_SHARE, MARGIN = 0.3, 2.0
#: Letters of the stems that stand for words of several endings.
STEMS = (4, 5, 6)
#: Share of toxic texts from which a piece of evidence suffices by itself, whatever others stood beside it.
CLEAR = 0.9
#: Tokens that a task remembers, and bytes of texts whose characters are counted at once.
CACHED, COUNTED = 200_000, 1 << 19

# Letters that stand for others in obfuscated words.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "€": "e", "(": "c"}
GAPS = " .-_*~·\t"

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x180, dtype=np.int64)
for _c, _i in CODE.items():
    _TABLE[ord(_c)] = _i
_SPACED = re.compile(rf"(?<![^\W_])(?:[^\s][{re.escape(GAPS)}]{{1,2}}){{2,}}[^\s](?![^\W_])")
#: Wherever _SPACED matches, this does, near the end of the match; it only is faster.
_SINGLES = re.compile(rf"[{re.escape(GAPS)}][^\s][{re.escape(GAPS)}]{{1,2}}[^\s](?![^\W_])")
#: A token without letters that may be a word: two or more that stand for letters, with gaps, between other marks.
_LEET_ONLY = re.compile(rf"(?:[^\w{re.escape(''.join(LEET))}]|_)*+((?:[{re.escape(''.join(LEET))}][{re.escape(GAPS)}]*+){{2,}}+)[\W_]*")
_HIDDEN = re.compile(rf"(.)\1\1|(?:[^\s][{re.escape(GAPS)}]){{2}}|[^\W\d_][{re.escape(GAPS)}](?=[^\W\d_])|[{re.escape(''.join(LEET))}]")
_TAIL = re.compile(r"[!|(]+$|([*#%&$])\1\1+$")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_DOUBLE, _SQUEEZE = re.compile(r"(.)\1"), re.compile(r"(.)\1+")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of character triples; all but the known letters are one and the same boundary."""
    codes = np.frombuffer(("\n\n".join(["", *texts, ""])).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = _TABLE[np.where(codes < len(_TABLE), codes, 0)]
    return np.bincount((own[:-2] * SIZE + own[1:-1]) * SIZE + own[2:], minlength=SIZE**3)


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a character after two others, from the counts of all texts: one partial sum a task,
    added up on the executors; at most a row for each triple of the fixed alphabet comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column(0)).fill_null(0), dtype=np.int64)
            for a, b in steps(lengths, COUNTED):
                total += trigram_counts(texts_of(batch.column(0).slice(a, b - a)))
        at = np.flatnonzero(total)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["g", "n"])

    counts = df.select(df[text_col]).mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(SIZE**3)
    three[counts.column("g").to_numpy()] = counts.column("n").to_numpy()
    three = three.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 10 * p1) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log((three + 10 * p2[None]) / (three.sum(axis=2, keepdims=True) + 10)).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """What each stretch of an observed token may stand for, with log probabilities of the channel."""
    i, low = 0, token.lower()
    while i < len(low):
        c, j = low[i], i + 1
        while j < len(low) and low[j] == c:
            j += 1
        n = j - i
        if c in CODE:
            own = [(c, math.log(0.4 if n > 1 else 0.99))]
            if n > 1:
                own.append((c * 2, math.log(0.6 if n == 2 else 0.5)))
            yield own
        elif c in LEET:
            options = [(x, math.log(0.6 / len(LEET[c]))) for x in LEET[c]]
            options += [(x * 2, math.log(0.3 / len(LEET[c]))) for x in LEET[c]] if n > 1 else []
            mark = i == 0 or j == len(low)
            yield options if c.isdigit() else [*options, (" ", math.log(0.3 if mark else 0.01))]
        elif c in GAPS:
            yield [("", math.log(0.6)), (" ", math.log(0.4))]
        else:
            yield [(" ", 0.0)]
        i = j


def decode(token: str, model: list[float]) -> str:
    """The likeliest letters behind a token: Viterbi with the last two letters as state, a boundary on either side.

    Each state keeps what was emitted last and what came before it as a chain, so time and memory are linear in the
    token, whatever its length. Likely paths soon meet, and what no state leads back to is freed.
    """
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in chain(lattice(token), [[(" ", 0.0)]]):
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, before) in states.items():
            for emitted, channel in options:
                at, total = state, score + channel
                for c in emitted:
                    z = CODE.get(c, 0)
                    total += model[at * SIZE + z]
                    at = at % SIZE * SIZE + z
                old = new.get(at)
                if old is None or total > old[0]:
                    new[at] = (total, (before, emitted) if emitted else before)
        states = new
    best = max(score for score, _ in states.values())
    return max(_spelled(last) for score, last in states.values() if score == best).strip()


def _spelled(last: tuple | None) -> str:
    out = []
    while last is not None:
        last, emitted = last
        out.append(emitted)
    return "".join(reversed(out))


def evidence_of(word: str) -> list[str]:
    """Keys of a restored word: it with a mark, and its stems, with runs of a letter as one."""
    short = _SQUEEZE.sub(r"\1", word) if _DOUBLE.search(word) else word
    return [short + "=", *[short[:k] for k in STEMS if len(short) > k]]


class Restorer:
    """Restored words of texts. Only tokens that are obfuscated in some way have a lattice with a choice."""

    def __init__(self, letters: np.ndarray):
        self.model = letters.ravel().tolist()

    def token(self, token: str) -> list[str]:
        low = token.lower()
        if low.isalpha():
            return [*_WORD.findall(low), *decode(low, self.model).split()] if _HIDDEN.search(low) else [low]
        words = _WORD.findall(low)
        core = _TAIL.sub("", low)
        if words and _HIDDEN.search(core):
            words += decode(core, self.model).split()
        elif not words and (m := _LEET_ONLY.fullmatch(low)):
            # What _TAIL takes for marks may be letters here.
            for x in {m[1], _TAIL.sub("", m[1])}:
                words += decode(x, self.model).split()
        return words

    def spaced(self, text: str) -> list[str]:
        """Words written letter by letter, with spaces."""
        if not _SINGLES.search(text):
            return []
        return [w for m in _SPACED.finditer(text) for w in decode(m[0], self.model).split() if len(w) > 2]

    def words(self, text: str) -> set[str]:
        return {w for t in set(text.split()) for w in self.token(t)} | set(self.spaced(text))


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from texts to scores. It keeps which tokens have evidence; most have none."""
        restorer, weights = Restorer(self.letters), self.weights
        clean: set[str] = set()
        known: dict[str, frozenset[str]] = {}

        def scores(texts: list[str]) -> np.ndarray:
            if len(clean) > CACHED:
                clean.clear()
                known.clear()
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                keys: set[str] = set()
                for t in set(text.split()) - clean:
                    own = known.get(t)
                    if own is None:
                        own = frozenset(k for w in restorer.token(t) for k in evidence_of(w) if k in weights)
                        if not own:
                            clean.add(t)
                            continue
                        known[t] = own
                    keys |= own
                keys.update(k for w in restorer.spaced(text) for k in evidence_of(w) if k in weights)
                out[i] = self.bias + sum(weights[k] for k in sorted(keys))
            return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

        return scores


def regress(texts: list[list[int]], toxic: np.ndarray, width: int, rounds: int = 500, decay: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of evidence, by Adam; weights are decayed and not below 0."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    col = np.array([k for t in texts for k in t], dtype=np.int64)
    w, b = np.zeros(width + 1), -3.0
    w[-1] = b
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], minlength=len(texts))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic
        g = np.append(np.bincount(col, error[row], minlength=width) + decay * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The character model over all of ``df``, and words learned from its rows labelled in ``labels`` (``doc_id``, ``toxic``).

    At most ``sample`` labels, chosen by a hash of the id, are used. Near copies among their texts with one label (components of
    near-dedup: five-word shingles, similarity 0.8 or more; texts without words are one) count once, so that a copied text's words are no evidence by themselves. Keys are counted
    on the executors; all those with a share of LEAST_SHARE toxic texts, more than chance brings about among so many
    keys (likelihood ratio), come to the driver, and a logistic regression on the sampled texts weighs them; their number is bounded by
    the words of ``sample`` texts. Null labels count as none; one 1 among repeated labels suffices.
    """
    letters = language_model(df, text_col)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    likely, h = likely_first(known, sample, "toxicity sample", "doc_id")
    some = likely.orderBy(h, "doc_id").limit(sample)
    texts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).join(F.broadcast(some), "doc_id")
    texts = cut(texts.withColumn("doc_id", F.xxhash64("doc_id")))

    def kernel():
        restorer = Restorer(letters)

        def work(texts: list[str]) -> dict:
            return {"keys": [sorted({k for w in restorer.words(t) for k in evidence_of(w)}) for t in texts]}

        return work

    made = cut(map_texts(texts, kernel, "keys array<string>", ["doc_id", "toxic"]))
    near = near_dedup.near_duplicates(texts).groupBy("id").agg(F.min(F.when(F.col("n_shingles") > 0, F.col("component"))).alias("copy"))
    once = cut(made.join(near.withColumnRenamed("id", "doc_id"), "doc_id").groupBy("copy", "toxic").agg(F.min("keys").alias("keys")))
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    keyed = once.select(F.explode("keys").alias("k"), (F.col("toxic") == 1).cast("int").alias("t"))
    kinds = keyed.agg(F.approx_count_distinct("k")).first()[0]
    counts = keyed.groupBy("k").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    share, part = F.col("t") / (F.col("n") + 0.5), F.col("t") / F.col("n")
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - rate))).otherwise(0.0)
    surprise = F.col("n") * (part * F.log(part / rate) + rest)
    strong = cut(counts.where((F.col("t") > 0) & (share >= LEAST_SHARE) & (surprise >= math.log(kinds + 1) + MARGIN)).select("k", share.alias("share")))
    shares = {r["k"]: r["share"] for r in strong.collect()}
    top = sorted(shares)
    held = once.select("copy", "toxic", F.explode("keys").alias("k")).join(strong.select("k"), "k")
    seen = held.groupBy("copy", "toxic").agg(F.collect_set("k").alias("keys")).select("toxic", "keys").collect() if top else []
    number = {k: i for i, k in enumerate(top)}
    without = [n_toxic - sum(r["toxic"] == 1 for r in seen), n_clean - sum(r["toxic"] != 1 for r in seen)]
    rows = [[number[k] for k in r["keys"]] for r in seen] + [[]] * sum(without)
    toxic = np.array([float(r["toxic"] == 1) for r in seen] + [1.0] * without[0] + [0.0] * without[1])
    for x in (texts, made, once, strong):
        drop(x)
    if not len(toxic):
        return Model(letters, {}, -3.0)
    weights, bias = regress(rows, toxic, len(top))
    alone = {k: math.log(p / (1 - p)) - bias for k, p in shares.items() if p >= CLEAR}
    made = {k: max(float(w), alone.get(k, 0.0)) for k, w in zip(top, weights, strict=True)}
    return Model(letters, {k: w for k, w in made.items() if w > 0.01}, bias)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of each row. A null or empty text has the rate of texts without evidence;
    null ids and repeated rows stay. Whole texts, no shuffle."""

    def kernel():
        scores = model.scorer()
        return lambda texts: {"score": scores(texts)}

    return map_texts(df, kernel, "score double", [id_col], text_col)


def learnable(df: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), parts) != held_out)


def keep_civil(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, all columns as they are."""
    model = fit(df, learnable(df, labels), id_col, text_col)

    def kernel():
        scores = model.scorer()
        return lambda texts: scores(texts) < threshold

    return filter_texts(df, kernel, text_col)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    made = score(docs, fit(docs, learnable(docs, labels)))
    out = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return made.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", out)
