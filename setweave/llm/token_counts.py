"""Token counts of whole texts by a ``tokenizers`` file; huge texts by overlapping, resynchronised chunks."""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import map_texts, table
from setweave.llm.segments import TAIL

VOCABULARY = "word_bpe_49k.json"
#: Characters of the chunks of a huge text, which is any of more than one chunk, and of their overlaps.
CHUNK, OVERLAP = 32_768, 512
LIMIT = 2048
#: Distinct words that a worker keeps counts of; beyond that it starts anew.
CACHED = 1_000_000


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Alternatives of a split pattern of which each matches letters only, digits only, or marks only (or a mark and letters), never white space.
_PARTS = re.compile(r"'[A-Za-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+?")


def cuts_at(tokenizer) -> str | None:
    """Where texts may be cut so that ids on both sides are those of the whole text, as a file's parts prove it.

    ``space``: at any space or line feed. No added token holds white space or takes it in; the normaliser only
    composes (nothing composes with a space before it), lower-cases by character and makes runs of white space one space; the pre-tokeniser keeps only matches of
    alternatives that match no white space, or splits at white space.
    ``word``: before a space that stands before other than white space. There is no normaliser, and the pre-tokeniser is the byte-level one
    with its own pattern and no space put in front: the run of white space before such a space may not take it
    (its lookahead fails), and no other alternative spans one.
    None: neither is proven, and texts are encoded whole.
    """
    file = json.loads(tokenizer.to_str())
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
        return None
    normalizer, pre = _flat(file["normalizer"], "normalizers"), _flat(file["pre_tokenizer"], "pretokenizers")
    if not normalizer and len(pre) == 1 and pre[0]["type"] == "ByteLevel":
        return "word" if pre[0]["use_regex"] and not pre[0]["add_prefix_space"] else None
    runs = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(n != runs and n["type"] not in ("NFC", "Lowercase") for n in normalizer) or not pre:
        return None
    first, rest = pre[0], pre[1:]
    if any(p["type"] != "ByteLevel" or p["use_regex"] or p["add_prefix_space"] for p in rest):
        return None
    if first["type"] in ("Whitespace", "WhitespaceSplit"):
        return "space"
    kept = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex")
    return "space" if kept and all(map(_PARTS.fullmatch, kept.split("|"))) else None


def _flat(part: dict | None, name: str) -> list[dict]:
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


def marks_part(tokenizer) -> bool:
    """Whether marks after a letter or digit, up to white space, are pre-tokens of their own: all parts of a split pattern are of one kind."""
    pre = _flat(json.loads(tokenizer.to_str())["pre_tokenizer"], "pretokenizers")
    return cuts_at(tokenizer) == "space" and pre[0]["type"] == "Split"


def splice_count(text: str, tokenizer, kind: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one huge text, never encoding more than a chunk and its overlap at once, if it has stable boundaries.

    A chunk is encoded with offsets; the next one begins inside it, ``overlap`` characters before its end. Where ``kind`` (see
    ``cuts_at``) allows it, a space or line feed in the overlap is a boundary that no token spans, whatever stands around it. There both
    encodings are spliced, once they agree: tokens of either begin on the same offsets between the boundary and the
    last one in the overlap. If the overlap has no such boundary, or they disagree, it is widened by doubling, in the end to the whole
    chunk; then the chunk itself grows.
    """
    total, start, n = 0, 0, len(text)
    if kind is None:
        return len(tokenizer.encode(text, add_special_tokens=False))
    while True:
        stop, back = min(n, start + chunk), overlap
        made = tokenizer.encode(text[start:stop], add_special_tokens=False)
        while stop < n:
            at = _boundary(text, made, start, max(start + 1, stop - back), stop, tokenizer, kind)
            if at is not None:
                total += at[1]
                start = at[0]
                break
            if stop - back > start:
                back *= 2
                continue
            stop = min(n, start + 2 * (stop - start))
            made, back = tokenizer.encode(text[start:stop], add_special_tokens=False), overlap
        else:
            return total + len(made)


_CUT = {"space": re.compile(r"[ \n]"), "word": re.compile(r" (?=\S)")}


def _starts(made, base: int, low: int, high: int) -> tuple[int, list[int]]:
    """The number of the first token that begins at ``low`` or later, and where those begin that do before ``high``."""
    begin = lambda i: base + made.token_to_chars(i)[0]
    first = bisect_left(range(len(made)), low, key=begin)
    return first, [begin(i) for i in range(first, bisect_left(range(len(made)), high, lo=first, key=begin))]


def _boundary(text: str, made, start: int, low: int, stop: int, tokenizer, kind: str) -> tuple[int, int] | None:
    """The first stable boundary in [low, stop) from which on both encodings agree up to the last one, and the tokens before it."""
    cuts = [m.start() for m in _CUT[kind].finditer(text, low, stop)]
    if len(cuts) < 2:
        return None
    after = tokenizer.encode(text[cuts[0] : stop], add_special_tokens=False)
    first, own = _starts(made, start, cuts[0], cuts[-1])
    return (cuts[0], first) if own == _starts(after, cuts[0], cuts[0], cuts[-1])[1] else None


class Counter:
    """Counts of whole texts. What stands between boundaries is counted once and kept, if the file has such boundaries."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        self.kind, self.parted = cuts_at(self.tokenizer), marks_part(self.tokenizer)
        self.known: dict[str, int] = {"": 0}

    def split(self, text: str) -> list[str]:
        if self.kind is None:
            return [text]
        return text.replace("\n", " ").split(" ") if self.kind == "space" else [" " * (i > 0) + w for i, w in enumerate(_CUT["word"].split(text))]

    def learn(self, new: set[str]) -> None:
        parted = {w: c for w in new if w[-1] in TAIL and (c := w.rstrip(TAIL))[-1:].lower().isalnum()} if self.parted else {}
        tails = {w[len(c) :] for w, c in parted.items()}
        whole = [w for w in (new - parted.keys()) | set(parted.values()) | tails if w not in self.known]
        self.known.update(zip(whole, map(len, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)), strict=True))
        self.known.update({w: self.known[c] + self.known[w[len(c) :]] for w, c in parted.items()})

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known = {"": 0}
        huge = [len(t) > self.chunk for t in texts]
        split = [[] if h else self.split(t) for t, h in zip(texts, huge, strict=True)]
        new = {w for words in split for w in words if w not in self.known}
        if new:
            self.learn(new)
        get, out = self.known.__getitem__, np.zeros(len(texts), dtype=np.int64)
        for i, words in enumerate(split):
            out[i] = splice_count(texts[i], self.tokenizer, self.kind, self.chunk, self.overlap) if huge[i] else sum(map(get, words))
        if self.kind is None:
            self.known = {"": 0}
        return out


def count(
    df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row, without added tokens.

    One row for each input row; a null or empty text has 0 of both, a null id stays, repeated rows
    give repeated results, an empty table none. Texts are counted whole, at any length: those of more than ``chunk``
    characters by overlapping chunks, others as one; any file gives the library's counts (see ``cuts_at``). No shuffle.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def kernel():
        counter = Counter(path, chunk, overlap)

        def work(texts: list[str]) -> dict:
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            return {"n_bytes": np.array(sizes, dtype=np.int64), "n_tokens": counter(texts)}

        return work

    return map_texts(df, kernel, "n_bytes long, n_tokens long", [id_col], text_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
