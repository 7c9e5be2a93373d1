"""Evaluation texts leaking into training texts, by suffix arrays of the training side.

Each shard of documents (a batch within a task) gets a suffix array over word codes: the places where the next
``SEED`` words all belong to the vocabulary of the test items, sorted by these words. The order goes no further than
``SEED`` words: every suffix of every test passage is binary-searched for the range of all places that agree for
``SEED`` words or more, whatever follows, and each of them is extended word by word to its longest verbatim match, so
that the order inside a range would be used by nothing. A window of ``LEAST`` item words with a fifth of them changed,
dropped or added leaves at least one verbatim run of ``SEED`` words, so these matches miss nothing; an exact
alignment around them decides.

The test items are a stated query set: they go to all tasks, in blocks of at most ``BLOCK_WORDS`` words, and the
documents are read once for each block. Documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.markup import words

LEAST, SEED, SHARE = 20, 4, 5
#: Words of test items handled in one pass over the documents, and of documents in one suffix array.
BLOCK_WORDS, SHARD_WORDS = 1_000_000, 500_000
#: Items of a block are broadcast up to this many rows of 12 bytes, else shuffled.
BROADCAST_OWNERS = 500_000
_BAND = LEAST // SHARE
_NEVER = 10_000


def _keys(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``SEED`` codes from each place on as one number; codes past the end count as 0."""
    k = np.zeros(len(at), np.uint64)
    for i in range(SEED):
        j = at + i
        k = (k << np.uint64(16)) | np.where(j < len(codes), codes[np.minimum(j, len(codes) - 1)], 0).astype(np.uint64)
    return k


class Tests:
    """Passages as one sequence of codes, each between two zeros. A word that no passage has is coded 0."""

    def __init__(self, passages: list[list[str]]):
        self.code: dict[str, int] = {}
        parts, owner = [[0] * LEAST * 2], [[-1] * LEAST * 2]
        for i, p in enumerate(passages):
            parts.append([self.code.setdefault(w, len(self.code) + 1) for w in p] + [0] * LEAST * 2)
            owner.append([i] * len(p) + [-1] * LEAST * 2)
        if len(self.code) >= 2**16 - 1:
            raise ValueError("too many different words in one block of test items")
        self.codes = np.array(sum(parts, []), np.int32)
        self.owner = np.array(sum(owner, []), np.int32)
        at = np.flatnonzero(self.codes)
        whole = at[np.all([self.codes[at + i] > 0 for i in range(SEED)], axis=0)] if len(at) else at
        self.at, self.keys = whole, _keys(self.codes, whole)


class SuffixArray:
    """The places of a shard's codes from which ``SEED`` known words follow, in the order of these words, then of the places."""

    def __init__(self, codes: np.ndarray):
        at = np.flatnonzero(codes[: len(codes) - SEED + 1])
        at = at[np.all([codes[at + i] > 0 for i in range(1, SEED)], axis=0)] if len(at) else at
        keys = _keys(codes, at)
        order = np.argsort(keys, kind="stable")
        self.codes, self.at, self.keys = codes, at[order], keys[order]

    def matches(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All verbatim matches that can't be extended to the left: place here, place in the tests, length."""
        lo, hi = np.searchsorted(self.keys, tests.keys, "left"), np.searchsorted(self.keys, tests.keys, "right")
        n = hi - lo
        t = np.repeat(tests.at, n)
        p = self.at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        before = (self.codes[p - 1] == tests.codes[t - 1]) & (self.codes[p - 1] > 0)
        p, t = p[~before], t[~before]
        length = np.full(len(p), SEED)
        going = np.arange(len(p))
        while len(going):
            a, b = self.codes[p[going] + length[going]], tests.codes[t[going] + length[going]]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        return p, t, length


def _promising(codes: np.ndarray, tests: Tests, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each match: the most words of a window of ``LEAST`` item words over it that stand near their place, and its start."""
    span = np.arange(-LEAST + SEED, LEAST)
    item = tests.codes[t[:, None] + span]
    there = np.zeros(item.shape, bool)
    for shift in range(-_BAND - 1, _BAND + 2):
        j = np.clip(p[:, None] + span + shift, 0, len(codes) - 1)
        there |= item == codes[j]
    there &= item > 0
    sums = np.cumsum(np.pad(there, ((0, 0), (1, 0))), axis=1)
    wins = sums[:, LEAST:] - sums[:, :-LEAST]
    inside = item[:, : wins.shape[1]] > 0
    inside &= item[:, LEAST - 1 :] > 0
    wins = np.where(inside, wins, -1)
    return wins.max(axis=1), t + span[np.argmax(wins, axis=1)]


def _aligned(codes: np.ndarray, tests: Tests, p: int, t: int, start: int) -> bool:
    """Whether some window of ``LEAST`` item words or more, begun near ``start``, aligns with at most a fifth of edits.

    Its first and last words are in the text, so that words beyond a shorter quotation don't count as dropped from it.
    """
    doc = codes[max(0, p - (t - start) - LEAST - 8) : p - (t - start) + 3 * LEAST + 8]
    owner = tests.owner[start]
    starts = np.arange(start - _BAND, start + _BAND + 1)
    starts = starts[(tests.owner[starts] == owner)]
    n = len(doc)
    ramp = np.arange(n + 1)
    d = np.zeros((len(starts), n + 1), np.int32)
    for k in range(2 * LEAST):
        w = tests.codes[np.minimum(starts + k, len(tests.codes) - 1)]
        alive = tests.owner[np.minimum(starts + k, len(tests.codes) - 1)] == owner
        same = (doc[None, :] == w[:, None]) & (w[:, None] > 0) & alive[:, None]
        if k + 1 >= LEAST and (np.where(same, d[:, :-1], _NEVER).min(axis=1) * SHARE <= k + 1).any():
            return True
        new = np.full_like(d, _NEVER)
        if k:
            new[:, 0] = d[:, 0] + 1
            new[:, 1:] = np.minimum(d[:, :-1] + ~same, d[:, 1:] + 1)
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        else:
            new[:, 1:][same] = 0
        d = new
        d[~alive] = _NEVER
    return False


def _shard(tests: Tests, ids: list[int], texts: list[np.ndarray]) -> list[tuple[int, int, int, int, bool]]:
    """(doc, passage, longest verbatim match, its place in words, whether it leaks) of a shard, for each doc and passage that share a run."""
    gap = np.zeros(2 * LEAST, np.int32)
    codes = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    begins = len(gap) + np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts])[:-1]]).astype(np.int64)
    p, t, length = SuffixArray(codes).matches(tests)
    if not len(p):
        return []
    doc, item = np.searchsorted(begins, p, "right") - 1, tests.owner[t]
    score, start = _promising(codes, tests, p, t)
    score = np.where(length >= LEAST, 1000 + length, score)
    by = np.lexsort((-score, item, doc))
    out = []
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(doc[by]) != 0) | (np.diff(item[by]) != 0)]))
    longest = np.maximum.reduceat(length[by], heads)
    for h, z, best in zip(heads, np.append(heads[1:], len(by)), longest):
        group = by[h:z]
        at = group[np.argmax(length[group])]
        leaks = best >= LEAST
        if not leaks:
            tried: set[tuple[int, int]] = set()
            for m in group:
                if score[m] < LEAST - _BAND - 1:
                    break
                place = (int(start[m]), int((p[m] - t[m]) // 3))
                if place not in tried:
                    tried.add(place)
                    if _aligned(codes, tests, int(p[m]), int(t[m]), int(start[m])):
                        leaks = True
                        break
        out.append((ids[doc[at]], int(item[at]), int(best), int(p[at] - begins[doc[at]]), bool(leaks)))
    return out


def _searcher(tests: Tests):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids: list[int] = []
            texts: list[np.ndarray] = []
            rows: list[tuple] = []
            n = 0
            for i, text in zip(pdf["id"], pdf["text"]):
                w = words(text)
                if len(w) < SEED:
                    continue
                ids.append(i)
                texts.append(np.fromiter((tests.code.get(x, 0) for x in w), np.int32, len(w)))
                n += len(w)
                if n >= SHARD_WORDS:
                    rows += _shard(tests, ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                rows += _shard(tests, ids, texts)
            yield pd.DataFrame(rows, columns=["doc_id", "passage", "longest", "at_word", "leaks"])

    return search


def _owners(spark: SparkSession, owners: list[tuple[int, int]]) -> DataFrame:
    """The items of each passage of a block: broadcast while they are few, as many items may share one passage."""
    df = spark.createDataFrame(owners, "passage int, item_id long")
    return F.broadcast(df) if len(owners) <= BROADCAST_OWNERS else df


def verbatim_matches(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, longest, at_word, leaks): documents and test items that share ``SEED`` words in a row or more.

    ``items`` has item_id and passage; an item whose passage is null or has fewer than ``LEAST`` words can't leak and
    gives no rows, nor do null and empty texts. Words are compared without markup, references, comments, case,
    punctuation and line breaks. ``longest`` is the longest verbatim match in words, ``at_word`` its place in the
    document, ``leaks`` whether ``LEAST`` words in a row of the passage stand in the text with at most one in
    ``SHARE`` changed, dropped or added. Passages shared by items are searched once. Empty tables give no rows;
    documents repeated under one id give a row each time; further columns are ignored.
    """
    spark = documents.sparkSession
    blocks: list[tuple[list[list[str]], list[tuple[int, int]]]] = []
    seen: dict[tuple, tuple[int, int]] = {}
    size, vocabulary = BLOCK_WORDS, set()
    for r in items.select("item_id", "passage").distinct().toLocalIterator():
        w = words(r["passage"])
        if r["item_id"] is None or len(w) < LEAST:
            continue
        if tuple(w) not in seen:
            if size + len(w) > BLOCK_WORDS or len(vocabulary | set(w)) > 60_000:
                blocks.append(([], []))
                size, vocabulary, seen = 0, set(), {}
            size, vocabulary = size + len(w), vocabulary | set(w)
            seen[tuple(w)] = (len(blocks) - 1, len(blocks[-1][0]))
            blocks[-1][0].append(w)
        block, k = seen[tuple(w)]
        blocks[block][1].append((k, r["item_id"]))
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND length(text) > 0")
    found = None
    for passages, owners in blocks:
        hits = docs.mapInPandas(_searcher(Tests(passages)), "doc_id long, passage int, longest int, at_word int, leaks boolean")
        named = hits.join(_owners(spark, owners), "passage").drop("passage")
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], "doc_id long, longest int, at_word int, leaks boolean, item_id long")
    return found


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it holds a passage, once."""
    return verbatim_matches(documents, items).filter("leaks").select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
