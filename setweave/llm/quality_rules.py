"""Quality rules on repetition: suffix arrays over words, with longest-common-prefix intervals."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import filter_texts, map_texts, table, words_of

#: Words of a repeat that counts for the base rule.
WINDOW = 8
#: Words of a repeat that counts for the method's verdict, most of a text's words that such repeats may cover, and most words of a repeat.
LEAST, COVERED, LONGEST = 16, 0.2, 100
LEAST_WORDS = 20
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"


def suffix_array(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of many token sequences at once, and each place's longest common prefix with the one before.

    ``tokens`` holds the sequences one after the other; ``ends`` has, for each place, where its sequence ends. Suffixes of
    one sequence stand together and common prefixes never leave a sequence. Prefix doubling over the groups
    that are still tied; the ranks of each doubling then give the common prefixes, longest step first.
    """
    n = len(tokens)
    key = ends * (int(tokens.max()) + 1) + tokens if n else ends
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _heads(key[order])
    levels, step = [rank], 1
    tied = _tied(rank[order])
    while len(tied):
        rank, at = levels[-1].copy(), order[tied]
        after = at + step
        second = np.where(after < ends[at], levels[-1][np.minimum(after, n - 1)], -1)
        key = levels[-1][at] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        levels.append(rank)
        step *= 2
        tied = tied[_tied(rank[order[tied]])]
    common = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if n else np.zeros(0, np.int64)
    left, right, sums = order[at - 1].copy(), order[at].copy(), np.zeros(len(at), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = inside.copy()
        same[inside] = levels[level][left[inside]] == levels[level][right[inside]]
        same[inside] &= ends[left[inside]] == ends[right[inside]]
        for x in (left, right, sums):
            x[same] += 1 << level
    common[at] = sums
    return order, common


def _heads(group: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(group)), 0)) if len(group) else group


def _tied(rank: np.ndarray) -> np.ndarray:
    """Places whose rank a neighbour shares."""
    if not len(rank):
        return np.zeros(0, dtype=np.int64)
    same = rank[1:] == rank[:-1]
    return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))


def intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest-common-prefix intervals of ``least`` tokens or more, by a stack over a suffix array's common prefixes.

    Gives first and last place (in the suffix array), length and parent (-1: none) of each, then the places with a common prefix
    of ``least`` or more and the innermost interval of each. Only those places are visited.
    """
    at = np.flatnonzero(common >= least)
    first, last, length, parent, own, stack, before = [], [], [], [], [], [], -1

    def close(down_to: int, end: int) -> int:
        """Ends what is deeper than ``down_to``; gives the last one ended, whose parent isn't known yet."""
        ended = -1
        while stack and length[stack[-1]] > down_to:
            ended = stack.pop()
            last[ended] = end
            if stack and length[stack[-1]] >= down_to:
                parent[ended], ended = stack[-1], -1 if length[stack[-1]] == down_to else ended
        return ended

    for p, c in zip(at.tolist(), common[at].tolist(), strict=True):
        if p != before + 1:
            close(0, before)
        ended = close(c, p - 1)
        if not stack or length[stack[-1]] < c:
            first.append(p - 1 if ended < 0 else first[ended])
            for x, v in ((last, -1), (length, c), (parent, stack[-1] if stack else -1)):
                x.append(v)
            stack.append(len(first) - 1)
            if ended >= 0:
                parent[ended] = stack[-1]
        own.append(stack[-1])
        before = p
    close(0, before)
    return *(np.array(x, dtype=np.int64) for x in (first, last, length, parent)), at, np.array(own, dtype=np.int64)


def repeats(tokens: np.ndarray, ends: np.ndarray, least: int = 1) -> np.ndarray:
    """At each place, the tokens of the longest maximal repeat of ``least`` tokens or more that begins there, or 0.

    A repeat is maximal if it can't be made longer to either side in all places alike: the intervals hold those that can't to the
    right, and the tokens before an interval's suffixes tell about the left. Spans of others lie inside those of maximal ones.
    """
    order, common = suffix_array(tokens, ends)
    return _longest(tokens, ends, order, common, least)


def _longest(tokens: np.ndarray, ends: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros(len(tokens), dtype=np.int64)
    first, last, length, parent, at, own = intervals(common, least)
    if not len(at):
        return out
    starts = np.concatenate([[True], ends[1:] != ends[:-1]])
    left = np.where(starts[order], -1 - order, tokens[order - 1])
    differ = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    holder = np.where(differ[last] > differ[first], np.arange(len(length)), parent)
    while True:  # to the innermost maximal one around each
        up = np.where(holder >= 0, holder[holder], -1)
        if (up == holder).all():
            break
        holder = up
    deep = np.where(holder >= 0, length[holder], 0)[own]
    by = np.zeros(len(tokens) + 1, dtype=np.int64)
    by[at] = deep
    out[order] = np.maximum(by[:-1], by[1:])
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places in the union of the spans of all repeats of ``least`` tokens or more."""
    ends = np.where(longest >= least, np.arange(len(longest)) + longest, 0)
    return np.maximum.accumulate(ends) > np.arange(len(longest)) if len(ends) else ends.astype(bool)


def measures(texts: list[str], window: int = WINDOW, least: int = LEAST) -> dict:
    """Counts of each text; see ``rules``."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    total = int(sizes.sum())

    class Numbers(dict):
        def __missing__(self, key):
            self[key] = at = len(self)
            return at

    number = Numbers()
    tokens = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=total)
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    order, common = suffix_array(tokens, ends)
    longest = _longest(tokens, ends, order, common, min(window, least))
    inside, deep = (np.concatenate([[0], np.cumsum(covered(longest, n))]) for n in (window, least))
    most, shared = np.zeros(len(texts), dtype=np.int64), np.zeros(total, dtype=np.int64)
    if total:
        some = sizes > 0
        shared[order] = common
        most[some] = np.maximum.reduceat(shared, (stops - sizes)[some])
    lines = []
    for t in texts:
        own = [x for x in t.split("\n") if x.strip(SPACES)] if "\n" in t else ()
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], dtype=np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array(lines, dtype=np.int64),
        "n_repeat_words": inside[stops] - inside[stops - sizes],
        "n_long_repeat_words": deep[stops] - deep[stops - sizes],
        "longest_repeat": most,
    }


def verdicts(m: dict, covered_share: float = COVERED, longest: int = LONGEST, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    good = (m["n_long_repeat_words"] <= covered_share * m["n_words"]) & (m["longest_repeat"] <= longest)
    return failed, ~failed & good


def rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", covered_share: float = COVERED, longest: int = LONGEST, window: int = WINDOW, least: int = LEAST
) -> DataFrame:
    """``id_col``, the measures of each text, ``base_failed`` and ``kept``.

    ``n_repeat_words`` are the words in the union of all maximal repeats of ``window`` words or more (so in windows found
    twice or more), ``n_long_repeat_words`` of those of ``least`` words or more, ``longest_repeat`` the words of the longest repeat. A text
    is kept if it doesn't fail the base rule, its long repeats cover ``covered_share`` of its words at most, and none is longer than
    ``longest`` words. One row
    for each input row: a null or empty text has zeros and isn't kept, null ids stay, repeated rows give repeated results,
    an empty table none. No shuffle; each step works on some whole texts in memory.
    """

    def kernel():
        def work(texts: list[str]) -> dict:
            m = measures(texts, window, least)
            failed, kept = verdicts(m, covered_share, longest)
            return m | {"base_failed": failed, "kept": kept}

        return work

    names = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat"
    schema = ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return map_texts(df, kernel, schema, [id_col], text_col)


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``rules`` keeps, all columns as they are."""
    return filter_texts(df, lambda: lambda texts: verdicts(measures(texts))[1], text_col)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents")).drop("n_long_repeat_words", "longest_repeat")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + {WINDOW - 1}]) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
win2 AS (SELECT doc_id, unnest(range(1, len(w) - {LEAST - 2})) AS i, w FROM d WHERE len(w) >= {LEAST} AND doc_id IN (SELECT doc_id FROM cov)),
rep2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + {LEAST - 1}]) AS n FROM win2),
cov2 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {LEAST})) AS p FROM rep2 WHERE n > 1) GROUP BY doc_id),
far AS (SELECT doc_id, unnest(range(1, len(w) - {LONGEST - 1})) AS i, w FROM d WHERE len(w) > {LONGEST} AND doc_id IN (SELECT doc_id FROM cov)),
deep AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM far GROUP BY doc_id, w[i:i + {LONGEST}] HAVING count(*) > 1)),
lin AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lin WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
 coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(cov2.n, 0) AS n_long, deep.doc_id IS NOT NULL AS too_long
 FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN cov2 USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN deep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words) AND n_long <= {COVERED} * n_words AND NOT too_long AS kept FROM m
"""
