"""Language identification: nearest of several clustered TF-IDF centroids per language, by cosine, with rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import STEP_BYTES, cut, drop, fold, map_texts, steps, table, texts_of

#: Hashed character n-grams (two and three characters), centroids per language, and sampled training rows per language.
BINS, CENTROIDS, SAMPLE = 4096, 6, 400
#: Share of its own language's training rows that a centroid's rejection distance leaves out.
LEFT_OUT = 0.002
SHARPNESS = 30.0
UNKNOWN = "und"
#: Characters of texts that are turned into one matrix at once.
CHARS = 1 << 20


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((codes < 97) | ((codes > 122) & (codes < 192)), np.uint32(32), codes)


def _bins(codes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the pairs that begin at each place, and of the triples."""
    one = codes * np.uint32(0x9E3779B1)
    two = one[1:] + codes[:-1] * np.uint32(0x85EBCA77)
    three = two[1:] + codes[:-2] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - bins.bit_length() + 1)
    return tuple(((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for g in (two, three))


def n_grams(texts: list[str], bins: int = BINS) -> np.ndarray:
    """A row of n-gram counts for each text; anything but letters counts as one and the same character."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower)) + 1
    row = np.repeat(np.arange(len(lower)), sizes) * bins
    out = np.zeros(len(lower) * bins, dtype=np.int64)
    for k, found in enumerate(_bins(_codes(" ".join([*lower, ""])), bins), 1):
        out += np.bincount((row[k:] + found)[row[k:] == row[: len(row) - k]], minlength=len(out))
    return out.reshape(-1, bins)


def long_n_grams(text: str, bins: int = BINS, chars: int = CHARS) -> np.ndarray:
    """The row of ``n_grams`` of one text, from pieces: each n-gram counts in the piece in which it ends."""
    low, out = text.lower() + " ", np.zeros(bins, dtype=np.int64)
    for a in range(0, len(low), chars):
        b = max(0, a - 2)
        for k, found in enumerate(_bins(_codes(low[b : a + chars]), bins), 1):
            out += np.bincount(found[max(0, a - b - k) :], minlength=bins)
    return out[None]


def counted(texts: list[str], bins: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of some rows), so many rows at once as memory allows; a text may be of any length."""
    for a, b in steps(np.array([len(t) for t in texts]), CHARS):
        for c in range(a, b, 256):
            part = texts[c : min(b, c + 256)]
            yield c, long_n_grams(part[0], bins) if len(part) == 1 and len(part[0]) > CHARS else n_grams(part, bins)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> dict:
        n = len(texts)
        lang, score, near, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        for first, counts in counted(texts, len(self.idf)) if self.languages else ():
            cos = self.weigh(counts) @ self.centroids.T
            best = np.full((len(cos), len(self.languages)), -1.0)
            for k in range(len(self.languages)):
                best[:, k] = cos[:, self.owner == k].max(axis=1)
            top, nearest = best.argmax(axis=1), cos.argmax(axis=1)
            sharp = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
            for i in range(len(cos)):
                if has_letter(texts[first + i]):
                    lang[first + i] = self.languages[top[i]]
                    score[first + i] = sharp[i, top[i]] / sharp[i].sum()
                    near[first + i] = min(1.0, max(0.0, float(cos[i, nearest[i]])))
                    rejected[first + i] = cos[i, nearest[i]] < self.least[nearest[i]]
        return {"lang_pred": lang, "score": score, "cosine": near, "rejected": rejected}


def clusters(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Spherical k-means from far-apart first rows; centroids have length 1."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    return c[sizes >= min(3, sizes.max())]


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bins: int = BINS, centroids: int = CENTROIDS, sample: int = SAMPLE
) -> Model:
    """Learns from the rows of ``df`` that have a language and a letter.

    Document frequencies are counted over all of them, on the executors; about ``sample`` rows of each language, chosen by
    a hash of the id, are clustered on the driver. Rows without a language are not learned from; an
    empty table gives a model that knows no language.
    """
    known = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(known[lang_col]).count().collect()}
    if not totals:
        return Model(np.zeros(bins, np.float32), [], np.zeros((0, bins), np.float32), np.zeros(0, int), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, sample / n))]), known[lang_col])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), known[id_col], known[text_col]), F.lit(1 << 30)) / float(1 << 30)
    source = known.select(known[lang_col].alias("l"), (draw < share).alias("s"), known[text_col].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(bins, dtype=np.int64), 0
        names = ["l", "bins", "n"]

        def row(lang: str | None, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([at], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))], names=names)

        for batch in batches:
            langs, drawn = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lengths = np.asarray(pa.compute.binary_length(batch.column(2)).fill_null(0), dtype=np.int64)
            for a, b in steps(lengths, STEP_BYTES):
                texts = texts_of(batch.column(2).slice(a, b - a))
                for first, counts in counted(texts, bins):
                    fine = np.array([has_letter(t) for t in texts[first : first + len(counts)]])
                    seen += (counts[fine] > 0).sum(axis=0)
                    docs += int(fine.sum())
                    for i in np.flatnonzero(fine):
                        if drawn[a + first + i]:
                            at = np.flatnonzero(counts[i])
                            yield row(langs[a + first + i], at.astype(np.int32), counts[i, at])
        if docs:
            at = np.flatnonzero(seen)
            yield row(None, np.append(at, -1).astype(np.int32), np.append(seen[at], docs))

    made = cut(source.mapInArrow(run, "l string, bins array<int>, n array<long>"))
    pairs = made.where("l IS NULL").select(F.explode(F.arrays_zip("bins", "n")).alias("x")).select("x.*")
    seen = {r["bins"]: r["n"] for r in pairs.groupBy("bins").agg(F.sum("n").alias("n")).collect()}
    docs = seen.pop(-1, 0)
    idf = np.full(bins, np.log(1 + docs), dtype=np.float32)
    for b, n in seen.items():
        idf[b] = np.log((1 + docs) / (1 + n)) + 0.1
    rows = made.where("l IS NOT NULL").select("l", "bins", "n").toArrow()
    drop(made)
    model = Model(idf, sorted(set(rows.column("l").to_pylist())), np.zeros((0, bins), np.float32), np.zeros(0, int), np.zeros(0))
    counts = np.zeros((rows.num_rows, bins), dtype=np.float32)
    for i, (at, n) in enumerate(zip(rows.column("bins").to_pylist(), rows.column("n").to_pylist(), strict=True)):
        counts[i, at] = n
    x, langs = model.weigh(counts), np.array(rows.column("l").to_pylist())
    order = np.lexsort((counts.sum(axis=1), langs)) if len(langs) else []
    x, langs = x[order], langs[order]
    for k, lang in enumerate(model.languages):
        own = x[langs == lang]
        c = clusters(own, centroids)
        cos = own @ c.T
        near = cos.argmax(axis=1)
        least = [float(np.quantile(cos[near == j, j], LEFT_OUT)) if (near == j).any() else 0.0 for j in range(len(c))]
        model.centroids = np.concatenate([model.centroids, c])
        model.owner = np.concatenate([model.owner, np.full(len(c), k)]).astype(int)
        model.least = np.concatenate([model.least, least])
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``cosine`` and ``rejected`` of each row.

    ``lang_pred`` is the language of the nearest centroid, ``und`` (score 0) for a null text or one without a letter, or if
    the model knows no language. ``score`` compares the nearest centroids of all languages (a softmax of cosines);
    ``rejected`` is true where the text is further from its centroid than nearly all of its training rows were,
    and for ``und``. Ties go to the language that sorts first. Null ids and repeated rows stay. No shuffle.
    """
    schema = "lang_pred string, score double, cosine double, rejected boolean"
    return map_texts(df, lambda: model.predict, schema, [id_col], text_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    made = identify(docs, model)
    return made.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
