"""MinHash near-dedup: universal hash minima in bands, signature and exact verification, components by star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import cut, drop, give_back, map_texts, raw_of, table
from setweave.plans.storage import at

WIDTH, SIMILAR = 4, 80
#: Bands and minima in each: at similarity 0.8 a pair shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Least share of equal minima that goes on to the exact check: at similarity 0.8, 3.9 deviations below the mean.
SIGNATURE = 0.70
#: Rows of one side of a block in which the members of a bucket meet.
BLOCK = 512
#: Rounds in which each member is offered one partner, before blocks.
OFFERS = 2
#: Characters of texts whose sets a task keeps while it confirms pairs.
KEPT = 4_000_000
#: Bits of the filter that keeps texts nobody asks for out of the shuffle; its table has a fixed size of BITS / 64 rows.
BITS = 1 << 23
SEED = 20_240_229


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(x: int, n: int) -> np.ndarray:
    """1, x, x**2, ... modulo 2**64."""
    out = np.full(n, x, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of all words of an array of texts, A-Z lower-cased, without a Python object for a word.

    A word's hash is the polynomial of random codes of its bytes, from prefix sums over the bytes of some texts; words over
    LONG bytes, in which a polynomial modulo 2**64 might be made to collide, are hashed one by one. Works on BYTES bytes at once.
    """

    LONG, BYTES = 255, 1 << 18
    SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        code = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        code[ord("A") : ord("Z") + 1] = code[ord("a") : ord("z") + 1]
        base = int(rng.integers(0, 2**61)) * 8 + 5
        self.code, n = code, self.BYTES + self.LONG + 1
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 2**64), n)
        self.salt = mix64(np.arange(self.LONG + 1, dtype=np.uint64) + np.uint64(base))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of all texts, one text after the other, and how many each text has."""
        raw, at = raw_of(texts)
        hashes, first, last, n = [], np.zeros(len(raw) + 1, dtype=bool), np.zeros(len(raw) + 1, dtype=bool), len(raw)
        inside = ~self.SPACE[raw]
        first[0], first[1:n] = True, ~inside[: n - 1]
        first[at] = True
        last[n], last[: n - 1] = True, ~inside[1:]
        last[at[at > 0] - 1] = True
        starts, stops = np.flatnonzero(first[:n] & inside), np.flatnonzero(last[:n] & inside) + 1
        for a in range(0, n, self.BYTES):
            lo, hi = np.searchsorted(starts, (a, a + self.BYTES))
            if lo < hi:
                hashes.append(self._some(raw, a, starts[lo:hi], stops[lo:hi]))
        return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.diff(np.searchsorted(starts, at))

    def _some(self, raw: np.ndarray, a: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        sizes = stops - starts
        short = sizes <= self.LONG
        part = raw[a : a + self.BYTES + self.LONG]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(self.code[part] * self.up[: len(part)], out=sums[1:])
        i, j = starts[short] - a, stops[short] - a
        out = np.empty(len(starts), dtype=np.uint64)
        out[short] = mix64((sums[j] - sums[i]) * self.down[i] + self.salt[sizes[short]])
        for k in np.flatnonzero(~short).tolist():
            out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : stops[k]].tobytes().lower())
        return out


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of texts; A-Z lower-cased."""

    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()
        self.factors = mix64(np.arange(1, width + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        hashes, sizes = self.words(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        w, n = self.width, len(hashes)
        total = np.zeros(max(0, n - w + 1), dtype=np.uint64)
        for k in range(w):
            total += hashes[k : k + len(total)] * self.factors[k]
        total, out, start = mix64(total), [], 0
        for size in sizes.tolist():
            if size >= w:
                out.append(np.unique(total[start : start + size - w + 1]))
            elif size:
                own = np.append(hashes[start : start + size], np.uint64(size)) * np.append(self.factors[:size], self.factors[w])
                out.append(mix64(own.sum(dtype=np.uint64, keepdims=True)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            start += size
        return out


class Minima:
    """Minima of ``n`` universal (multiply-add-shift) hashes of a set, and the hash of each band of them."""

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]
        self.salt = mix64(rng.integers(0, 2**63, bands * rows, dtype=np.uint64)).reshape(bands, rows)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x, out = shingles & np.uint64(0xFFFFFFFF), None
        for k in range(0, len(x), 256):
            part = x[None, k : k + 256] * self.a
            part += self.b
            least = part.min(axis=1)
            out = least if out is None else np.minimum(out, least)
        return out >> np.uint64(32)

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit hash a band, for a matrix with a row of minima a set."""
        own = minima.reshape(len(minima), self.bands, self.rows)
        return mix64(mix64(own + self.salt).sum(axis=2, dtype=np.uint64) + self.salt[:, 0]).view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``n`` (set size), ``set_hash`` (128 bits), ``bands`` and ``minima`` of each row."""

    def kernel():
        shingle, minima = Shingler(width), Minima(bands, rows)

        def work(texts: pa.Array) -> dict:
            sets = shingle(texts)
            some = [s for s in sets if len(s)]
            least = np.stack([minima(s) for s in some]) if some else np.zeros((0, bands * rows), dtype=np.uint64)
            hashes, small = minima.band_hashes(least), least.astype(np.uint8)
            band, low, k = [], [], 0
            for s in sets:
                band.append(hashes[k] if len(s) else None)
                low.append(small[k].tobytes() if len(s) else None)
                k += len(s) > 0
            return {
                "n": np.array([len(s) for s in sets], dtype=np.int64),
                "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "bands": band,
                "minima": low,
            }

        return work

    keyed = df.select(df[id_col].alias("id"), text_hash(df[text_col]).alias("h"), df[text_col].alias("text"))
    return map_texts(keyed, kernel, "n long, set_hash binary, bands array<long>, minima binary", ["id", "h"], arrow=True)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _agree(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (``id``, ``h``, ``pid``, ``ph``) whose signatures agree on a share of ``least`` or more."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in (4, 5))
                yield batch.filter(pa.array((a == b).mean(axis=1) >= least)).select([0, 1, 2, 3])

    return pairs.select("id", "h", "pid", "ph", "minima", "p_minima").mapInArrow(run, f"id {kind}, h long, pid {kind}, ph long")


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may be in ``wanted`` (``id``, ``h``), by a bitmap of fixed size that is broadcast.

    It only spares the shuffle texts that nobody asks for; a join must follow. Once very many are asked
    for, the bitmap is full and lets all pass.
    """

    def bit() -> Column:
        return F.pmod(F.xxhash64("id", "h"), F.lit(BITS))

    words = wanted.select(F.floor(bit() / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, h), {BITS}) % 64 as int))").alias("b"))
    bitmap = F.broadcast(words.groupBy("w").agg(F.bit_or("b").alias("b")))
    tested = texts.withColumn("w", F.floor(bit() / 64)).join(bitmap, "w")
    return tested.where(F.expr(f"(shiftright(b, cast(pmod(xxhash64(id, h), {BITS}) % 64 as int)) & 1) = 1")).select("id", "h", "text")


class Sets:
    """The shingle sets of texts; those at hand are kept, up to a bound of characters."""

    def __init__(self, width: int, bound: int):
        self.shingle, self.bound, self.known, self.held = Shingler(width), bound, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        got = self.known.get(text)
        if got is None:
            self.held += len(text)
            if self.held > self.bound:
                self.known.clear()
                self.held = len(text)
            self.known[text] = got = self.shingle([text])[0]
        return got

    def similar(self, a: str | None, b: str | None, percent: int) -> bool:
        mine, theirs = self(a), self(b)
        if 100 * min(len(mine), len(theirs)) < percent * max(len(mine), len(theirs)):
            return False
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        return 100 * both >= percent * (len(mine) + len(theirs) - both)


def _asked(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of ``wanted`` (distinct ``id``, ``h``), written once."""
    # An inner join: a semi join would be pushed below the filter, and all texts be shuffled.
    return cut(_likely(texts, wanted).join(wanted, ["id", "h"]).dropDuplicates(["id", "h"]))


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    """Links ``u``, ``v`` of the pairs whose full shingle sets are similar. ``texts``: ``id``, ``h``, ``text``."""
    wanted = pairs.select("id", "h").unionAll(pairs.select("pid", "ph")).distinct()
    some = _asked(wanted, texts)
    theirs = some.select(F.col("id").alias("pid"), F.col("h").alias("ph"), F.col("text").alias("p_text"))
    joined = pairs.join(some, ["id", "h"]).join(theirs, ["pid", "ph"]).select("id", "pid", "text", "p_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(width, KEPT)
        for batch in batches:
            two = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            yield batch.filter(pa.array([sets.similar(x, y, similar) for x, y in two], pa.bool_())).select([0, 1])
        del sets
        give_back()

    kind = pairs.schema["id"].dataType.simpleString()
    links = joined.mapInArrow(run, f"id {kind}, pid {kind}").select(F.greatest("id", "pid").alias("u"), F.least("id", "pid").alias("v"))
    made = cut(links.where("u <> v").distinct())
    drop(some)
    return made


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest id) of every id in ``links`` (``u``, ``v``; u > v), by alternating steps.

    Large-star: each node links its greater neighbours to its least one (or itself). Small-star: each node links its
    smaller neighbours, and itself, to the least of them. Both are a grouped minimum and a join, so a node with very many
    links is pre-aggregated and its rows can be split among tasks. Each step's links are written to the
    shared folder. They are done when they are stars: each greater end has one link, and no end is both.
    """
    edges = links
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = cut(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        ends = made.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(made.select("v", F.lit(0), F.lit(1)))
        several = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).agg(F.count_if(F.col("out") + F.col("into") * F.signum("out") > 1)).first()[0]
        if edges is not links:
            drop(edges)
        edges = made
        if not several:
            return at(getattr(edges, "_setweave_path", None), edges.select(F.col("u").alias("id"), F.col("v").alias("component")))


def _near_in_block(t: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a block (``id``, ``p``, ``b``, ``component``, ``bands``, ``minima``) whose signatures agree.

    A pair counts in one bucket only: that of the first band whose hash, the one buckets are made of, is the same in
    both. The low bytes in ``minima`` may agree in a band in whose bucket the two never meet. Whether a pair counts
    depends on its two rows alone.
    """
    comp, p = t.column("component").to_numpy(), t.column("p").to_numpy()
    sig = np.frombuffer(b"".join(t.column("minima").to_pylist()), dtype=np.uint8).reshape(len(comp), -1)
    hashes = np.concatenate([c.flatten().to_numpy() for c in t.column("bands").chunks]).reshape(len(comp), -1)
    band = t.column("b")[0].as_py()
    same = t.column("i")[0] == t.column("j")[0]
    left = np.arange(len(comp)) if same else np.flatnonzero(p == p.min())
    right = np.arange(len(comp)) if same else np.flatnonzero(p != p.min())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in left:
        b = right[(comp[right] != comp[a]) & ((right > a) if same else True)]
        b = b[(sig[b] == sig[a]).mean(axis=1) >= least]
        whole = hashes[b] == hashes[a]
        b = b[(whole.argmax(axis=1) == band) | ~whole[:, band]]
        found.append((np.full(len(b), a), b))
    a, b = (np.concatenate([x[k] for x in found] or [np.zeros(0, int)]).astype(int) for k in (0, 1))
    return a, b


def _block_links(members: DataFrame, texts: DataFrame, least: float, block: int, width: int, similar: int) -> DataFrame:
    """Links ``u``, ``v`` between members of one bucket but different components, found block against block.

    ``members``: ``bucket``, ``b`` (its band), ``id``, ``h``, ``component``, ``bands``, ``minima``. A bucket's members are dealt over ceil(size / block)
    parts; each pair of parts meets as matrices. A block first gives the rows that agree with some other row in it, not
    the pairs: of these there may be as many as the square of its rows. Such rows then meet again with their texts, each
    once in a block (2 * block texts at most), and what agrees is confirmed there on full sets. Only links leave.
    """
    kind = members.schema["id"].dataType.simpleString()
    sizes = cut(members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    dealt = members.join(sizes, "bucket").withColumn("p", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    meet = dealt.select("*", other).select("bucket", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "b", "id", "h", "component", "bands", "minima")

    def flag(t: pa.Table) -> pa.Table:
        return t.take(pa.array(np.unique(np.concatenate(_near_in_block(t, least)))))

    def confirm(t: pa.Table) -> pa.Table:
        sets, ids, text = Sets(width, 8 * KEPT), t.column("id").to_pylist(), t.column("text").to_pylist()
        near = zip(*(x.tolist() for x in _near_in_block(t, least)), strict=True)
        good = [(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in near if ids[a] != ids[b] and sets.similar(text[a], text[b], similar)]
        del sets, text
        kind = t.column("id").type
        return pa.table({"u": pa.array([u for u, _ in good], kind), "v": pa.array([v for _, v in good], kind)})

    ends = cut(meet.groupBy("bucket", "i", "j").applyInArrow(flag, meet.schema))
    some = _asked(ends.select("id", "h").distinct(), texts)
    made = cut(ends.join(some, ["id", "h"]).groupBy("bucket", "i", "j").applyInArrow(confirm, f"u {kind}, v {kind}").distinct())
    drop(some, ends, sizes)
    return made


def _offers(rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The heads of buckets, and one pair (``id``, ``h``, ``pid``, ``ph``) for each member that isn't the first of all heads of its buckets.

    At first those come first whose buckets hold the most rows: of near copies of one text it is that text, whose
    minima are the commonest, and which is nearer to all of them than they are to one another. Later the order is by hash.
    Heads are written before they meet their members, so that a join with a bucket of very many rows can be split.
    """
    if turn:
        ranked = rows.select("bucket", "id", "h", F.xxhash64(F.lit(turn), "id").alias("o"))
    else:
        weight = rows.groupBy("id", "h").agg((-F.sum("c")).alias("o"))
        ranked = rows.select("bucket", "id", "h").join(weight, ["id", "h"])
    heads = cut(ranked.groupBy("bucket").agg(F.min(F.struct("o", "id", "h")).alias("p")))
    first = rows.select("bucket", "id", "h").join(heads, "bucket").groupBy("id", "h").agg(F.min("p").alias("p"))
    return heads, first.select("id", "h", F.col("p.id").alias("pid"), F.col("p.h").alias("ph")).where("id <> pid")


def _component_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    own = rows.drop("component")
    return own.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _same_id_links(own: DataFrame, one: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id, by the ids that stand for these sets."""
    sets = own.where("id IS NOT NULL AND n > 0").select("id", "set_hash")
    odd = sets.groupBy("id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("z")).where("a <> z").select("id")
    stand = one.select("set_hash", F.col("id").alias("r"))
    links = sets.distinct().join(odd, "id").join(stand, "set_hash").select(F.greatest("id", "r").alias("u"), F.least("id", "r").alias("v"))
    return cut(links.where("u <> v").distinct())


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similar: int = SIMILAR, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``n_shingles`` and ``component`` of each row of ``df``.

    A text's set holds its distinct shingles of ``width`` words (fewer words: all of them as one; no words: empty, linked
    with nothing). Rows are linked if 100 * |intersection| >= similar * |union| of the full sets; ``component`` is the
    smallest id reachable, the row's own included. Rows with one id are one node, whatever their texts;
    a null id has a null component; ids are of any type with an order. An empty table gives no rows. The result is a table in the shared folder.

    1. Rows with equal sets fall together (a grouped minimum), and the rest goes on with one of each.
    2. Each bucket of a band has a head, by a hash of the ids, and each member is offered the first of the heads of its
       buckets: one pair a member, whatever the sizes. What signatures and then full sets confirm are links.
       This is repeated with other heads for buckets whose members are still in different components.
    3. Where they still are, all members of different components are compared by signature, block against block,
       and confirmed on full sets.
    So a link is lost only if a pair shares no band (5e-6 at the threshold), or its signature is far off (5e-5), and
    no other link joins the two components.
    """
    own = cut(signatures(df, id_col, text_col, width, bands, rows))
    texts = df.select(df[id_col].alias("id"), text_hash(df[text_col]).alias("h"), df[text_col].alias("text"))
    solid = own.where("id IS NOT NULL AND n > 0")
    one = cut(solid.groupBy("set_hash").agg(F.min(F.struct("id", "h", "bands", "minima")).alias("r")).select("set_hash", "r.*"))

    member = one.select(F.posexplode("bands").alias("b", "x"), "id", "h").select(F.xxhash64("b", "x").alias("bucket"), "b", "id", "h")
    several = cut(member.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    shared = cut(member.join(several, "bucket"))
    drop(several)
    sig = one.select("id", "h", "minima")
    theirs = one.select(F.col("id").alias("pid"), F.col("h").alias("ph"), F.col("minima").alias("p_minima"))
    links, found, open_rows = _same_id_links(own, one), None, shared
    for turn in range(OFFERS):
        heads, pairs = _offers(open_rows, turn)
        agreed = cut(_agree(pairs.join(sig, ["id", "h"]).join(theirs, ["pid", "ph"]), SIGNATURE))
        confirmed, before = _confirm(agreed, texts, width, similar), (heads, agreed, links, found)
        links = cut(links.unionAll(confirmed))
        found = components(links)
        drop(*before, confirmed)
        placed = _component_of(shared, found)
        mixed = cut(placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("bucket"))
        still = cut(placed.join(mixed, "bucket"))
        drop(mixed, open_rows if turn else None)
        open_rows = still
        if open_rows.isEmpty():
            break
    if not open_rows.isEmpty():
        more = _block_links(open_rows.join(one.select("id", "h", "bands", "minima"), ["id", "h"]), texts, SIGNATURE, BLOCK, width, similar)
        if not more.isEmpty():
            last, found = found, components(links.unionAll(more))
            drop(last)
        drop(more)
    drop(shared, open_rows, links)

    node = _component_of(one.select("set_hash", "id"), found).select("set_hash", "component")
    out = own.select("id", "h", F.col("n").alias("n_shingles"), "set_hash").join(node, "set_hash", "left")
    out = cut(out.select("id", "h", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")))
    drop(own, one, found)
    return out


def keep_first(df: DataFrame, width: int = 5, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, without all but one row of each component.

    The row of the smallest id stays; of rows that repeat that id, one. Rows with null ids or without words stay,
    once for each row: they are linked with nothing.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    found = near_duplicates(df, id_col, text_col, width, similar)
    kept = found.where("id = component AND n_shingles > 0").groupBy("id").agg(F.min("h").alias("h"))
    bare = F.col(own).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = plain.where(~bare).withColumn("h", text_hash(F.col(text)))
    one = keyed.join(kept.withColumnRenamed("id", own), [own, "h"], "left_semi").dropDuplicates([own, "h"]).drop("h")
    return one.unionByName(plain.where(bare)).toDF(*names)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=WIDTH)
    named = found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
