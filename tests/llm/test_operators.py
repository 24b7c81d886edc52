"""Each operator against a plainer version, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from setweave.llm import arrow_output, bpe, language_id, mixing, near_dedup, quality_pu, quality_rules, token_counts, toxicity, vector_search
from setweave.llm.common import shared_dir
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, component string, h string, k string"


def words(seed, n, kinds=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def texts():
    base = words(1, 300, 5000)
    near = base.split()
    near[10] = "changed"
    return {
        0: None, 1: "", 2: " \n\t", 3: "one two", 4: "one  two", 5: base, 6: base, 7: " ".join(near), 8: base.upper(), 9: words(2, 40) + "\n" + words(2, 40),
        10: "a" * 3000, 11: "the <|endoftext|> x", 12: "naïve 日本語 😀 it's 12345!!  \n\n x", 13: "be " * 500, 14: words(3, 30000), 15: "idiot i d i o t 1d10t",
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 5 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", "y", "z", "h", "k") for i, t in texts().items()]
    rows += [rows[5], (None, "a null id", "en", "s1", 1, "", "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs).collect()
    assert len(got) == len(texts()) + 2
    for r in got:
        text = "a null id" if r.doc_id is None else texts()[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    row = bpe.digests(bpe.encode(docs)).where("doc_id = 3").first()
    assert row.decoded_sha256 == hashlib.sha256(b"one two").hexdigest()


def test_token_counts(docs):
    tokenizer = token_counts.load(P.path(token_counts.VOCABULARY))
    for r in token_counts.count(docs, chunk=500, overlap=8).collect():
        text = "a null id" if r.doc_id is None else texts()[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False)))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "odd"])
def test_token_counts_of_any_file(file, tmp_path):
    """Texts in chunks and as a whole; a file without proven boundaries is never cut."""
    path = P.path("byte_bpe_50k.json" if file == "odd" else file)
    if file == "odd":
        made = json.loads(open(path).read())
        made["pre_tokenizer"]["add_prefix_space"] = True
        path = str(tmp_path / "odd.json")
        (tmp_path / "odd.json").write_text(json.dumps(made))
    tokenizer = token_counts.load(path)
    assert token_counts.cuts_at(tokenizer) == {"word_bpe_49k.json": "space", "byte_bpe_50k.json": "word", "odd": None}[file]
    rng = random.Random(1)
    parts = ["hello", "World", " ", " ", "  ", "\n", "\t", "it's", "12345", "!!", ".", ",", "<|endoftext|>", "e\u0301", "日本", "\u00a0", "😀", " \u0301", "a.b.", "İ", "\r\n"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "hello big world\nand more", "a" * 500, "a " * 300]
    want = [len(tokenizer.encode(x, add_special_tokens=False)) for x in some]
    assert token_counts.Counter(path)(some).tolist() == token_counts.Counter(path, chunk=60, overlap=8)(some).tolist() == want


def test_arrow_output(spark, docs):
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    manifest = arrow_output.write(some, f"{shared_dir(spark)}/arrow-test", length=64, rows=4)
    tokenizer, start = token_counts.load(P.path(arrow_output.VOCABULARY)), 0
    for r in sorted(arrow_output.digests(arrow_output.read(manifest)).collect()):
        ids = [*tokenizer.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ids, mask = arrow_output.sequence(manifest.orderBy("shard").first().path, 0)
    assert len(ids) == len(mask) == 64


def test_segments_of_any_text():
    """Ids of texts of odd characters: white space of all kinds, NULs, contractions, special strings; joined or not."""
    encoder, rng = arrow_output.LibraryEncoder(P.path(arrow_output.VOCABULARY)), random.Random(3)
    tokenizer = token_counts.load(P.path(arrow_output.VOCABULARY))
    parts = ["a", "b", "'s", "'", "s", " ", "  ", "\n", "\t", ".", "!!", "1", "22", "é", "日", "\0", "\x1c", "\x85", "<|endoftext|>", "😀", "'re", "\u00a0", "-", "#"]
    assert encoder.barrier is not None
    for _ in range(20):
        some = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(100)]
        ids, counts = encoder(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_quality_rules(docs):
    for r in quality_rules.rules(docs).collect():
        w = (("a null id" if r.doc_id is None else texts()[r.doc_id] or "")).split()
        if len(w) < 2000:
            n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            assert r.n_words == len(w) and r.n_repeat_words == len({j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
            longest = next(k for k in range(len(w) + 1) if len({tuple(w[i : i + k + 1]) for i in range(len(w) - k)}) == len(w) - k)
            assert r.longest_repeat == longest
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 14}


def test_maximal_repeats():
    """Intervals against all repeated stretches that can't be made longer to either side in all places alike."""
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes, least = rng.integers(1, 25, rng.integers(1, 5)), int(rng.integers(1, 4))
        stops = np.cumsum(sizes)
        ends, tokens = np.repeat(stops, sizes), rng.integers(0, rng.integers(1, 4), stops[-1])
        starts, places, want = np.repeat(stops - sizes, sizes), defaultdict(list), np.zeros(len(ends), int)
        for i in range(len(ends)):
            for j in range(i + least, ends[i] + 1):
                places[ends[i], tuple(tokens[i:j])].append(i)
        for (end, w), at in places.items():
            before = {tokens[p - 1] if p > starts[p] else -1 - p for p in at}
            after = {tokens[p + len(w)] if p + len(w) < end else -1 - p for p in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                want[at] = np.maximum(want[at], len(w))
        assert (quality_rules.repeats(tokens, ends, least) == want).all()


def test_covered_share_decides(spark):
    """Long repeats over a fifth of a text, within the base rule's bound and none over 100 words."""
    once, twice = words(11, 300, 10**6), words(12, 45, 10**6)
    rows = [(1, f"{once} {twice} x {twice}"), (2, f"{once} {words(13, 90, 10**6)}"), (3, once + " ".join(f" {words(k, 9, 10**6)} x {words(k, 9, 10**6)} y{k}" for k in range(20, 25)))]
    got = {r.doc_id: r for r in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].base_failed, got[i].kept) for i in (1, 2, 3)] == [(False, False), (False, True), (False, True)]
    assert got[1].n_long_repeat_words == 90 and got[3].n_repeat_words == 90 and not got[3].n_long_repeat_words


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    tokens, ends = rng.integers(0, 3, 60), np.repeat([25, 40, 60], [25, 15, 20])
    order, _ = quality_rules.suffix_array(tokens, ends)
    assert order.tolist() == sorted(range(60), key=lambda i: (ends[i], tokens[i : ends[i]].tolist()))


def test_near_dedup(docs):
    sets, link = {}, {}
    for i, t in texts().items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        link[i] = min([j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], default=i)
    got = near_dedup.near_duplicates(docs, width=4).collect()
    assert len(got) == len(texts()) + 2
    for r in got:
        assert r.component is None if r.id is None else (r.n_shingles, r.component) == (len(sets[r.id]), link[r.id])
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 9, 10, 11, 12, 13, 14, 15]


def test_near_dedup_of_documents(spark):
    """All components of a table of documents, against pairs that share shingles, of which none is left out."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders, least = {}, defaultdict(list), {}
    for r in df.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        least[r.doc_id] = r.doc_id
        for x in sets[r.doc_id]:
            holders[x].append(r.doc_id)
    common = Counter((a, b) for ids in holders.values() if len(ids) > 1 for a in ids for b in ids if b < a)
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    got = near_dedup.op1_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(links) > 50 and {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def test_near_dedup_of_other_ids(spark):
    rows = [("b", words(1, 50)), ("a", words(1, 50) + " x"), (None, words(1, 50)), ("c", words(2, 50)), ("c", words(3, 50)), ("d", words(3, 50))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.id or "", r.component or "") for r in got) == [("", ""), ("a", "a"), ("b", "a"), ("c", "c"), ("c", "c"), ("d", "c")]


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Walks of small changes: neighbours are links, most pairs of a bucket are close but none."""
    monkeypatch.setattr(near_dedup, "OFFERS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng, rows = random.Random(8), []
    base = words(7, 60, 5000).split()
    for _ in range(12):
        walk = list(base)
        for _ in range(12):
            for _ in range(rng.choice((1, 1, 2, 3))):
                walk[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(walk)))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    links = [(a, b) for a in least for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.id: r.component for r in got} == dict(enumerate(least)) and 12 < len(set(least)) < 130


def test_near_dedup_low_bytes(spark, monkeypatch):
    """Links that share a band, and before it one that is the same in the low bytes of its minima only."""
    offers = near_dedup._offers
    monkeypatch.setattr(near_dedup, "_offers", lambda rows, turn: (None, offers(rows, turn)[1].limit(0)))
    rng, rows, shingle, minima = random.Random(4), [], near_dedup.Shingler(4), near_dedup.Minima(near_dedup.BANDS, near_dedup.ROWS)
    while len(rows) < 8:
        w = [f"v{rng.randrange(10**9)}" for _ in range(60)]
        pair = [" ".join(w), " ".join([*w[:30], "new", *w[31:]])]
        a, b = (minima(s) for s in shingle(pair))
        whole, low = ((x == y).reshape(near_dedup.BANDS, -1).all(axis=1) for x, y in ((a, b), (a & np.uint64(255), b & np.uint64(255))))
        if whole.any() and whole.argmax() != low.argmax():
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.id: r.component for r in got} == {i: i - i % 2 for i in range(len(rows))}


def test_components(spark):
    rng = random.Random(3)
    links = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(70)) if a != b] + [(i + 1, i) for i in range(100, 140)]
    least = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(links, "u long, v long").distinct()).collect()}
    assert {k: got.get(k, k) for k in least} == least


def test_mixing(docs):
    got = mixing.copies(docs).collect()
    total, by = sum(r.size for r in got), defaultdict(int)
    for r in got:
        by[r.source] += r.size
        assert r.target <= 3 * r.source_size + 1e-6 and r.n_copies <= 3
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.n_copies for r in got)


def shared_out(sizes, most=3, weights=(1, 2, 3)):
    """Targets by sharing what is over again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, free = {}, sum(sizes.values()), set(sizes)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else level * weight[s]
        rest -= sum(most * sizes[s] for s in over)
        free = free - over if over else set()
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, "c": 5, None: 7}, {"a": 10, "b": 20, "c": 30, "d": 10}, {"a": 1, "b": 9, "c": 90, "d": 1, "e": 2, "f": 3}, {"a": 100, "b": 1, "c": 1, "d": 100, None: 2}, {"a": 4}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    """Also where sources tie in size for their weight, or have no words."""
    rows = [(s, "w " * n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.copies(spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")).collect()}
    want = shared_out(sizes)
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes) and abs(sum(got.values()) - sum(sizes.values())) < 1e-6 or not any(sizes.values())


def best(rows, k=5, every=50):
    """Every query's best rows, from whole numbers of any size."""
    v = [(i, [min(max(int(np.floor(256 * float(c))), -(2**63)), 2**63) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, x in {i: min(y for j, y in v if j == i) for i, _ in v if i % every == 0}.items():
        scored = [(min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1), c) for c, y in v if c != q and len(x) == len(y)]
        out += [(q, n, c, s) for n, (s, c) in enumerate(sorted(scored, key=lambda t: (-t[0], t[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, seeds, scale", [(4096, 4096, 1.0), (2, 3, 1.0), (2, 10, 3e7), (2, 10, 1e18)])
def test_vector_search(spark, block, seeds, scale):
    """Null, non-finite and repeated ids and vectors, ties, other dimensions; scores beyond 2**53 and beyond 2**63."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) * scale for x in rng.normal(size=12)]) for i in range(300)]
    rows[7], rows[8], rows[9] = (7, None), (8, [float("nan")] * 12), (9, [None] + [1.0] * 11)
    rows[20] = (20, rows[0][1])
    rows += [(50, [0.5] * 12), (33, [2.0] * 12), (33, [2.0] * 12), (None, [9.0] * 12), (400, [1.0, 2.0]), (401, [1.0, 2.0]), (402, [3.0, float("inf")]), (450, []), (451, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(df.withColumn("score", F.lit("x")).withColumn("i", F.lit(1)), k=5, block=block, seeds=seeds)
    assert sorted(map(tuple, got.collect())) == best(rows)


def test_vector_search_prunes():
    """Of random vectors in 64 dimensions, bounds from means and deviations leave under half of the pairs to be computed."""
    rng = np.random.default_rng(2)
    x, ids = np.floor(256 * rng.normal(size=(4000, 64))), np.arange(4000)
    seen = vector_search.Block(ids[:80], x[:80], 5)
    floor = seen.update(seen.start(), ids[::4], x[::4])[0][:, -1]
    made = vector_search.Block(ids[:80], x[:80], 5, floor=floor)
    scores, found = made.update(made.start(), ids, x)
    exact = x[:80] @ x.T
    exact[np.arange(80), np.arange(80)] = -np.inf
    assert (scores == -np.sort(-exact, axis=1)[:, :5]).all() and made.exact < made.pairs / 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(5), [], []
    letters = {"en": "thea nd", "de": "ßä sch", "es": "ñó cio"}
    for i in range(400):
        lang = ("en", "de", "es")[i % 3]
        w = ["".join(rng.choice(letters[lang].replace(" ", "")) for _ in range(rng.randrange(2, 9))) for _ in range(80)]
        good, toxic = i % 5 > 0, i % 7 == 0
        if toxic:
            w[3] = w[30] = "idiot"
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), lang, f"s{i % 2}", 1))
        labels.append((i, int(good), int(toxic)))
    rows.append((None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers(labelled):
    df, labels = labelled
    truth = {r.doc_id: r for r in labels.where("quality IS NOT NULL").collect()}
    made = quality_pu.classify(df, labels).collect()
    held = [r for r in made if r.held_out and r.doc_id in truth]
    assert len(made) == 401 and np.mean([(r.score >= 0.7) == truth[r.doc_id].quality for r in held]) > 0.95
    model = toxicity.fit(df, toxicity.learnable(df, labels))
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert np.mean([(s >= 0.3) == truth[i].toxic for i, s in scores.items() if i is not None]) > 0.98
    assert toxicity.keep_civil(df, labels).columns == df.columns


def risk(p, u, prior, decay):
    """The non-negative risk of weights (the last one is the bias), term by term."""

    def value(w):
        zp, zu = p @ w, u @ w
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, bracket) + decay / 2 * (w[:-1] ** 2).sum()

    return value


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.9])
def test_least_risk(prior):
    """Slopes and curvatures against differences; and no step from the result lowers the non-negative risk."""
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (300, 3))
    one = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p, u = one(good[:150]), one(np.concatenate([good, bad]))
    curves = lambda w: (quality_pu.Curve.of(p, w), quality_pu.Curve.of(u, w))
    w = rng.normal(size=4)
    for side, x in enumerate((p, u)):
        for positive in (True, False):
            _, slope, bend = curves(w)[side].risk(positive)
            for k, e in enumerate(np.eye(4) * 1e-4):
                (a, sa, _), (b, sb, _) = (quality_pu.Curve.of(x, w + d).risk(positive) for d in (e, -e))
                assert abs((a - b) / 2e-4 - slope[k]) < 1e-6 and np.abs((sa - sb) / 2e-4 - bend[k]).max() < 1e-6
    w, bracket = quality_pu.nn_pu(curves, prior, 4)
    value = risk(p, u, prior, quality_pu.DECAY)
    steps = [rng.normal(size=4) * 10 ** rng.uniform(-3, 0) for _ in range(500)]
    assert bracket > -0.01 and min(value(w + d) for d in steps) > value(w) - 2e-3
    both = quality_pu.separate(curves, 4)
    least = lambda w: np.logaddexp(0, -(p @ w)).mean() / 2 + np.logaddexp(0, u @ w).mean() / 2 + quality_pu.DECAY / 2 * (w[:-1] ** 2).sum()
    assert min(least(both + d) for d in steps) > least(both) - 1e-4


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_known_prior(spark, share):
    """Documents of which a known share is good, from word statistics that overlap; the prior comes near to it."""
    rng, n = np.random.default_rng(int(100 * share)), 1500
    good = rng.random(n) < share
    x = rng.normal(0, 1, (n, len(quality_pu.FEATURES))).astype(np.float32)
    x[:, 0] += np.where(good, 2.5, -2.5)
    rows = [(v.tolist(), bool(g and i % 2)) for i, (v, g) in enumerate(zip(x, good, strict=True))]
    model = quality_pu.fit(spark.createDataFrame(rows, "x array<float>, good boolean"))
    assert abs(model.prior - good.mean()) < 0.07 and ((model.scores(x) >= 0.5) == good).mean() > 0.97


def test_fit_takes_all_rows(spark):
    """Sums over the executors' rows are those over all rows at once."""
    rng = np.random.default_rng(8)
    x, good = rng.normal(0, 1, (900, 5)).astype(np.float32), rng.random(900) < 0.4
    df = spark.createDataFrame([(v.tolist(), bool(g)) for v, g in zip(x, good, strict=True)], "x array<float>, good boolean").repartition(7)
    made = quality_pu.summed(df, lambda a, b: np.concatenate([[len(a)], a[b].sum(axis=0)]))
    assert np.allclose(made, np.concatenate([[900], x[good].astype(float).sum(axis=0)]))


def test_only_near_copies_count_once(spark):
    """Long texts of the same common words: their three least word hashes are the same, but they are no copies."""
    rng, rows = random.Random(9), []
    common = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    for i in range(60):
        w = rng.sample(common, 40) + rng.sample(common, 40)
        if i % 4 == 0:
            w[5] = "idiot"
            w[5:5] = common
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    copied = " ".join(rng.sample(common, 40) + ["harmless"])
    rows += [(i, copied + (" x" if i % 2 else ""), 1) for i in range(60, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    assert "idiot=" in model.weights and "harmles=" not in model.weights


def test_language_id(labelled):
    df, _ = labelled
    made = language_id.identify(df, language_id.fit(df.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))).join(df.select("doc_id", "lang"), "doc_id", "left").collect()
    assert np.mean([r.lang_pred == r.lang for r in made if r.doc_id is not None]) > 0.97
    assert [r.lang_pred for r in made if r.doc_id is None] == ["und"]


def test_nearest_centroids(labelled):
    """Predictions against dense cosines of TF-IDF rows, counted n-gram by n-gram."""
    df, _ = labelled
    model = language_id.fit(df)
    rows = df.where("text IS NOT NULL").limit(40).collect()
    for r, got in zip(rows, language_id.identify(df, model).where("doc_id IS NOT NULL").limit(40).collect(), strict=True):
        low = "".join(c if c.isalpha() else " " for c in r.text.lower()) + " "
        x = np.zeros(language_id.BINS)
        for n in (2, 3):
            for g, times in Counter(low[i : i + n] for i in range(len(low) - n + 1)).items():
                x[language_id._bins(language_id._codes(g), language_id.BINS)[n - 2][0]] += times
        x = np.log1p(x) * model.idf
        cosines = model.centroids @ x / np.linalg.norm(x)
        best = [max(cosines[model.owner == k]) for k in range(len(model.languages))]
        assert got.doc_id == r.doc_id and got.lang_pred == model.languages[int(np.argmax(best))] and abs(got.cosine - max(best)) < 1e-5
        assert abs(got.score - 1 / np.exp(language_id.SHARPNESS * (np.array(best) - max(best))).sum()) < 1e-4


def test_n_grams_of_long_texts():
    rng = random.Random(2)
    text = "".join(rng.choice("abc dé\nİΣx") for _ in range(5000))
    for chars in (1, 2, 3, 700, 9000):
        assert (language_id.long_n_grams(text, chars=chars) == language_id.n_grams([text])).all()
    text *= 700
    (_, row), = language_id.counted([text], language_id.BINS)
    assert len(text) > 3 << 20 and (row == language_id.n_grams([text])).all()


def test_decode():
    model = np.zeros(toxicity.SIZE**3)
    assert toxicity.decode("tr4sh", model.tolist()) == "trash" and toxicity.decode("1d10t", model.tolist()).endswith("t")


def test_decode_is_the_best_path():
    """Against all paths through random lattices, under random models."""
    rng, signs = random.Random(3), "ab1$!i..-0oeß4x"
    for trial in range(150):
        token = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 7)))
        model = np.random.default_rng(trial).normal(size=toxicity.SIZE**3) * 2
        paths = []
        for path in itertools.product(*toxicity.lattice(token), [(" ", 0.0)]):
            state, score = 0, 0.0
            for emitted, channel in path:
                score += channel
                for c in emitted:
                    z = toxicity.CODE.get(c, 0)
                    score, state = score + model[state * toxicity.SIZE + z], state % toxicity.SIZE * toxicity.SIZE + z
            paths.append((score, "".join(e for e, _ in path).strip()))
        assert toxicity.decode(token, model.tolist()) in {t for s, t in paths if s > max(paths)[0] - 1e-9}


@pytest.fixture(scope="module")
def restorer(spark):
    plain = ["you are such an idiot and a fool said the man who had no other word for them today", "the ass is an animal"]
    return toxicity.Restorer(toxicity.language_model(spark.createDataFrame([(t,) for t in plain * 50], "text string")))


def test_long_obfuscation(restorer):
    words = "you are such an idiot and a fool said the man who had no other word for them today".split() * 3
    spelled = "  ".join(" ".join(w) for w in words)
    assert len(spelled) > 400 and {"idiot", "fool"} <= restorer.words(f"x y {spelled} .")
    joined = ".".join(w.replace("i", "1").replace("o", "0") for w in words)
    assert len(joined) > 200 and {"idiot", "fool"} <= restorer.words(joined)
    assert len(toxicity.decode("x1" * 50_000, restorer.model)) >= 100_000


def test_obfuscation_with_other_gaps(restorer):
    for text in ("he is an i d i o t now", "he is an i\td\ti\to\tt now", "he is an i. d. i. o. t.", "i  d  i  o  t", "i d i o t", "i-d i-o t", "an id-iot", "an idi.ot"):
        assert "idiot" in restorer.words(text), text
    for text in ("an @$$ it is", "an 455, it is", "(455)", "an '@$$!!' it is", "4-5-5", "@$$$", "*@$$*", "...(@$$).", "_455_"):
        assert {"ass", "asss"} & restorer.words(text), text
    assert not restorer.words("2026 - 27, 1,000 $5 ... --- !!!") & {"ass"}
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1. .-_\t \n~") for _ in range(12))
        assert toxicity._SINGLES.search(text) or not toxicity._SPACED.search(text), text


def test_models_on_odd_rows(spark, labelled):
    """Very long and empty texts, repeated rows, null ids, and columns that are named as the results are."""
    df, labels = labelled
    long = " ".join(r.text for r in df.limit(60).collect() if r.text) * 12
    odd = [(1, long), (1, long), (2, ""), (2, ""), (3, None), (None, long), (4, "x" * 300_000), (5, " \n" * 5000)]
    rows = spark.createDataFrame([(i, t, 0, "s", "l", "h", 9, "x") for i, t in odd], "doc_id long, text string, score int, lang_pred string, copy string, keys string, toxic int, x string")
    model, spoken = toxicity.fit(df, toxicity.learnable(df, labels)), language_id.fit(df)
    for made in (toxicity.score(rows, model), language_id.identify(rows, spoken), quality_pu.classify(rows, labels)):
        got = sorted(made.collect(), key=str)
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
        by = defaultdict(set)
        for r in got:
            by[r.doc_id].add(r.score)
        assert len(by[1]) == len(by[2]) == 1
    both = rows.unionByName(df.select("doc_id", "text"), allowMissingColumns=True)
    assert toxicity.fit(both, labels.unionAll(labels)).weights and quality_pu.classify(both, labels.unionAll(labels)).count() == len(odd) + 401
    assert {r.lang_pred for r in language_id.identify(rows, spoken).where("doc_id IN (2, 3, 5)").collect()} == {"und"}


def test_empty_tables(spark, docs, labelled):
    empty, labels = docs.limit(0), labelled[1].limit(0)
    assert bpe.encode(empty).count() == token_counts.count(empty).count() == quality_rules.rules(empty).count() == mixing.copies(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == quality_pu.classify(empty, labels).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert arrow_output.read(arrow_output.write(empty, f"{shared_dir(spark)}/arrow-empty")).count() == 0
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    for made in (near_dedup.keep_first(empty), quality_rules.keep_good(empty), toxicity.keep_civil(empty, labels), mixing.mix(empty)):
        assert made.columns == docs.columns and made.count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [255, 256, 257, 5000])
def test_bpe_of_long_pieces(n):
    """Pieces around the width of the matrices, of one letter, of few, and of many."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = bpe.Encoder(P.path(bpe.RANKS), P.PATTERN), random.Random(n)
    some = ["a" * n, *["".join(rng.choice(kinds) for _ in range(n)) for kinds in ("ab", "etaoinshr", "日本語é")]]
    ids, counts = encoder(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own.encode_ordinary(t) for t in some]


def test_bpe_by_another_pattern(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=r"\w+\s*|\W", mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode(docs, pattern=r"\w+\s*|\W").collect():
        text = "a null id" if r.doc_id is None else texts()[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text)


def test_arrow_output_of_odd_ids(spark):
    rows = [(None, "b c"), (None, "a"), (3, "x y"), (3, "x"), (3, "x"), (1, None), (-5, "long " * 50_000)]
    made = arrow_output.write(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int"), f"{shared_dir(spark)}/arrow-odd", length=64, rows=4)
    got = sorted(arrow_output.read(made).collect(), key=lambda r: r.start)
    tokenizer = token_counts.load(P.path(arrow_output.VOCABULARY))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in want]


def test_pipeline_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "mixing", "byte_bpe"]


def test_pipeline(spark):
    """Each stage on what its predecessor kept, against a plainer version; then the rows of run()."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{shared_dir(spark)}/pipeline-test/{name}"
        stage(spark, steps[-1], sf).write.mode("overwrite").parquet(path)
        steps.append(spark.read.parquet(path))
    assert [s.columns for s in steps[:-1]] == [columns] * 5
    first, good, civil, alone, mixed, ids = ([tuple(r) for r in s.select("doc_id", *(["text", "source"] if s is not steps[-1] else ["n_tokens", "ids_sha256"])).collect()] for s in steps)

    def split(text):
        return (text or "").encode().split()

    def keeps(text):
        w, grams, seen = split(text), Counter(), set()
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])] += 1
        for k in range(len(w) - 7):
            seen |= set(range(k, k + 8)) if grams[tuple(w[k : k + 8])] > 1 else set()
        deep, far, long = Counter(tuple(w[k : k + 101]) for k in range(len(w) - 100)), Counter(tuple(w[k : k + 16]) for k in range(len(w) - 15)), set()
        for k in range(len(w) - 15):
            long |= set(range(k, k + 16)) if far[tuple(w[k : k + 16])] > 1 else set()
        return len(w) >= 20 and 100 * len(seen) <= 30 * len(w) and 5 * len(long) <= len(w) and max(deep.values(), default=1) == 1

    assert sorted(good) == sorted(r for r in first if keeps(r[1]))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(steps[1], toxicity.fit(steps[1], toxicity.learnable(steps[1], labels))).collect()}
    assert sorted(civil) == sorted(r for r in good if scores[r[0]] < 0.3)

    sets = {}
    for i, t, _ in civil:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted(alone) == sorted(r for r in civil if least[r[0]] == r[0]) and links

    times, goal = Counter(r[0] for r in mixed), {r.doc_id: r.target / r.source_size for r in mixing.copies(steps[3]).collect()}
    assert all(int(goal[i]) <= times[i] <= int(goal[i]) + 1 for i in goal) and set(times) <= set(goal)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = [(i, own.encode_ordinary(t or "")) for i, t, _ in mixed]
    want = sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in made)
    assert sorted(ids) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256").collect()) == want


@pytest.mark.parametrize("links", [[], [(2, 1)], [(i + 1, i) for i in range(60)], [(i, 0) for i in range(1, 30)], [(30, i) for i in range(30)], [(9, 8), (8, 2), (9, 1), (2, 1), (5, 4)]])
def test_components_of_shapes(spark, links):
    """Nothing, a pair, a chain, a star, a star from its greatest end, a ring."""
    least = {x: x for e in links for x in e}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in least.items() if k != v}
