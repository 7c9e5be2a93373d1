"""Near-duplicate texts: a Hamming join of fingerprints by a Gray-order hierarchical index, verified by exact similarity.

The similarity of two texts is the number of distinct sequences of ``words`` words in both over the number in either.
A text's minwise hashes give (a) ``BANDS`` keys of ``DEPTH`` hashes each and (b) a fingerprint of ``BITS`` bits, one
bit of each further hash: for texts of similarity s a bit differs with probability (1 - s) / 2.

The index: under each band key, which is the pattern that all below it share exactly, fingerprints are sorted by
their Gray rank, so that neighbours differ in few bits, and packed into nodes of ``FAN``, these into nodes again.
A node's pattern has the bits that all below it share; bits already in the parent's pattern are masked out of it. A
query descends and adds up the differences in each node's own bits; where they exceed ``RADIUS`` the whole group
below is pruned. What arrives at a leaf is within the radius and is compared exactly.

Where a group's index would prune little, as among many texts that share no more than a set phrase, comparing all with
all is cheaper than descending, and is done instead; the pairs are the same.

Bands alone decide where rows meet, so no task sees all fingerprints; a key that holds too many is split by load. A
Python worker holds at most ``HELD`` comparisons at once, however many rows share a key and however long texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import self_join_shards
from loomgraph.runtime import broadcast_if_small, cut, release

#: At similarity 0.7 a pair shares no band with probability (1 - 0.343) ** 20 = 0.0002, at 0.8 with less than a millionth.
BANDS, DEPTH = 20, 3
#: At similarity 0.7, 19.2 of the bits differ, with a standard deviation of 4; of unrelated texts, 64.
BITS, RADIUS = 128, 36
FAN = 8
#: Comparisons of two fingerprints, or of one with a node, that are worked out at once: about 30 MB.
HELD = 250_000
#: A group of more than ``WIDE`` fingerprints is compared whole if its index leaves more than this share of the leaves to ``TRIED`` of its queries.
WIDE, LEFT, TRIED = 64, 0.05, 16
#: Rows that are joined together, pairs that are sent on together, and sequences that are hashed together.
ROWS, PAIRS, SEQUENCES = 100_000, 100_000, 8_000
#: Ids of candidates are broadcast up to this many (of about 60 bytes), to leave all other texts where they are.
BROADCAST_IDS = 200_000
#: By default, all pairs of a class of copies are given if it has at most so many ids, else those of its first id with the others.
EXPANDED = 20


def word_text(c: Column) -> Column:
    """The words of a text, the longest runs of letters and digits in lower case, joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return (r.integers(1, 2**63, count, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), r.integers(0, 2**63, count, dtype=np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """64-bit hashes of the distinct sequences of ``words`` words; of the whole text if it is shorter."""
    w = text.split(" ")
    if len(w) <= words:
        return np.array([hash_text(text)], np.uint64)
    h = np.array([hash_text(x) for x in w], np.uint64)
    n, s = len(w) - words + 1, np.zeros(len(w) - words + 1, np.uint64)
    for i in range(words):
        s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s)


def hash_text(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))


def _lowest(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minwise hashes of each set: one row per set, one column per hash function."""
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    mixed = np.concatenate(sets)[:, None] * a[None, :] + b[None, :]
    mixed ^= mixed >> np.uint64(32)
    return np.minimum.reduceat(mixed * np.uint64(0xD6E8FEB86659FD93), start, axis=0)


def signatures(sets: list[np.ndarray], bands: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed fingerprints of sets of hashes. A large set is worked through in pieces."""
    a, b = _hashes(bands * depth + BITS)
    piece = SEQUENCES
    low = np.concatenate([
        np.min([_lowest([s[i : i + piece]], a, b)[0] for i in range(0, len(s), piece)], axis=0)[None] if len(s) > piece else _lowest([s], a, b) for s in sets
    ]) if max(map(len, sets)) > piece else _lowest(sets, a, b)
    keys = np.zeros((len(sets), bands), np.uint64)
    for j in range(depth):
        keys = (keys ^ low[:, j : bands * depth : depth]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    bits = np.packbits(((low[:, bands * depth :] >> np.uint64(40)) & np.uint64(1)).astype(np.uint8), axis=1)
    return keys.view(np.int64), bits


def _signer(words: int, bands: int, depth: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, prints, sets, held = [], [], [], 0
            for i, t in enumerate(pdf["text"], 1):
                sets.append(shingle_hashes(t, words))
                held += len(sets[-1])
                if held >= SEQUENCES or i == len(pdf):
                    k, f = signatures(sets, bands, depth)
                    keys += k.tolist()
                    prints += [x.tobytes() for x in f]
                    sets, held = [], 0
            yield pdf[["id", "class"]].assign(keys=keys, print=prints)

    return sign


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) & 1


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of 128-bit words in the order of the reflected Gray code: each bit the parity of all from the top to it."""

    def prefix(x: np.ndarray) -> np.ndarray:
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(s))
        return x

    return prefix(hi), prefix(lo) ^ np.where(_parity(hi) == 1, np.uint64(2**64 - 1), np.uint64(0))


def _compared(prints: np.ndarray, asking: np.ndarray, answering: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All of ``asking`` compared with all of ``answering``, block by block."""
    across = 2_000
    for j in range(0, len(answering), across):
        a = answering[j : j + across]
        hi, lo = prints[a, 0], prints[a, 1]
        for i in range(0, len(asking), HELD // across):
            q = asking[i : i + HELD // across]
            far = np.bitwise_count(prints[q, 0][:, None] ^ hi) + np.bitwise_count(prints[q, 1][:, None] ^ lo)
            at = np.flatnonzero(far <= radius)
            x, y = q[at // len(a)], a[at % len(a)]
            yield x[x != y], y[x != y]


def hamming_pairs(group: np.ndarray, prints: np.ndarray, asks: np.ndarray, answers: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``hamming_join``, some pairs at a time: a descent takes up as many nodes as can be held, and comes back for the rest."""
    hi, lo = gray_rank(prints[:, 0], prints[:, 1])
    order = np.lexsort((lo, hi, group))
    order = order[answers[order]]
    if not len(order):
        return
    g, leaf = group[order], prints[order]
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    # levels, from the leaves up: the bits shared below each node, which of them are set, and its first child
    ones, zeros = [leaf], [~leaf]
    firsts: list[np.ndarray] = []
    bounds = heads
    size = np.diff(np.append(heads, len(g)))
    lowest = None
    while True:
        nodes = -(-size // FAN)
        within = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        first = np.repeat(bounds, nodes) + within * FAN
        firsts.append(np.append(first, len(ones[-1])))
        ones.append(np.bitwise_and.reduceat(ones[-1], first, axis=0))
        zeros.append(np.bitwise_and.reduceat(zeros[-1], first, axis=0))
        bounds, size = np.cumsum(nodes) - nodes, nodes
        lowest = lowest or (bounds, nodes)
        if size.max() == 1:
            break
    known = [a | b for a, b in zip(ones, zeros)]
    roots = g[heads]
    asking = np.flatnonzero(asks)
    root = np.searchsorted(roots, group[asking])
    there = (root < len(roots)) & (roots[np.minimum(root, len(roots) - 1)] == group[asking])
    asking, root = asking[there], root[there]
    sizes = np.diff(np.append(heads, len(g)))
    if (wide := np.flatnonzero(sizes > WIDE)).size and len(asking):
        by_root = np.argsort(root, kind="stable")
        starts, ends = (np.searchsorted(root[by_root], wide, side) for side in ("left", "right"))
        whole = np.zeros(len(roots), bool)
        for w, s, e in zip(wide.tolist(), starts.tolist(), ends.tolist()):
            if s == e:
                continue
            q = asking[by_root[s:e]]
            low = slice(lowest[0][w], lowest[0][w] + lowest[1][w])
            # what a descent adds up on its way to the lowest nodes are the differences in all bits that they know
            left = [(np.bitwise_count((prints[x] ^ ones[1][low]) & known[1][low]).sum(axis=1) <= radius).mean() for x in q[:: -(-len(q) // TRIED)]]
            if np.mean(left) > LEFT:
                whole[w] = True
                yield from _compared(prints, q, order[heads[w] : heads[w] + sizes[w]], radius)
        asking, root = asking[~whole[root]], root[~whole[root]]
    step = HELD // FAN
    for i in range(0, len(asking), step):
        q, node = asking[i : i + step], root[i : i + step]
        far = np.bitwise_count((prints[q] ^ ones[-1][node]) & known[-1][node]).sum(axis=1).astype(np.int16)
        near = far <= radius
        todo = [(len(ones) - 2, q[near], node[near], far[near])]
        while todo:
            level, q, node, far = todo.pop()
            a, z = firsts[level][node], firsts[level][node + 1]
            n = z - a
            up = np.repeat(np.arange(len(q)), n)
            child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[up]
            own = known[level][child] & ~known[level + 1][node[up]]
            far = far[up] + np.bitwise_count((prints[q[up]] ^ ones[level][child]) & own).sum(axis=1).astype(np.int16)
            near = far <= radius
            q, node, far = q[up[near]], child[near], far[near]
            if level:
                todo += [(level - 1, q[k : k + step], node[k : k + step], far[k : k + step]) for k in range(0, len(q), step)]
            else:
                other = order[node]
                yield q[q != other], other[q != other]


def hamming_join(group: np.ndarray, prints: np.ndarray, asks: np.ndarray, answers: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (asking, answering) of one group whose fingerprints (n x 2 words) differ in at most ``radius`` bits."""
    found = [(np.zeros(0, np.intp), np.zeros(0, np.intp)), *hamming_pairs(group, prints, asks, answers, radius)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _joiner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the groups of a partition sorted by group, asking rows first; many small groups are joined together.

    Rows of a group that ask and answer are held until all of them have come. Of a group in which rows do one of both,
    those that ask are held, and those that answer are dropped once they were compared.
    """
    held: list[pd.DataFrame] = []
    rows, enough = 0, ROWS

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if pdf.empty:
            return
        group = np.cumsum(((pdf["_h"].diff() != 0) | (pdf["_shard"].diff() != 0)).to_numpy())
        prints = np.frombuffer(b"".join(pdf["print"]), ">u8").astype(np.uint64).reshape(-1, 2)
        c = pdf["c"].to_numpy()
        some: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def sent() -> pd.DataFrame:
            x, y = c[np.concatenate([q for q, _ in some])], c[np.concatenate([a for _, a in some])]
            out = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
            return out[x != y].drop_duplicates()

        for q, a in hamming_pairs(group, prints, pdf["asks"].to_numpy(bool), pdf["answers"].to_numpy(bool), RADIUS):
            some.append((q, a))
            n += len(q)
            if n >= PAIRS:
                yield sent()
                some, n = [], 0
        if n:
            yield sent()

    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < enough:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = pdf.iloc[-1]
        open_ = (pdf["_h"] == last["_h"]) & (pdf["_shard"] == last["_shard"])
        rest = pdf[open_]
        if last["asks"]:
            yield from run(pdf[~open_].reset_index(drop=True))
        else:
            yield from run(pdf)
            rest = rest[rest["asks"]]
        held, rows = [rest], len(rest)
        enough = rows + ROWS
    if held:
        yield from run(pd.concat(held, ignore_index=True))


def _similar(words: int, least: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for a, b in zip(pdf["text_a"], pdf["text_b"]):
                x, y = (_sequences(t, words) for t in (a, b))
                both = len(x & y)
                kept.append(both / (len(x) + len(y) - both))
            s = np.array(kept)
            yield pdf[["a", "b"]].assign(similarity=s)[s >= least - 1e-12]

    return compare


def _sequences(text: str, words: int) -> set[tuple[str, ...]]:
    w = text.split(" ")
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


class NearDuplicates:
    """The classes of equal texts of a table and the pairs of classes whose similarity is at least ``least``.

    Texts of fewer than ``least_words`` words (null and blank ones among them) are left out. Texts whose words are the
    same are one class, named by its smallest id; an id delivered again counts once, with the text that compares
    smallest if they differ. Attributes: ``members`` (class, id), for classes of two ids or more, ``pairs`` (a, b,
    similarity) between class names. Both are empty for an empty table. Further columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int = 5, least: float = 0.8, least_words: int = 5):
        texts = df.select(F.col(id_col).alias("id"), word_text(F.col(text_col)).alias("text")).filter("id IS NOT NULL")
        texts = texts.withColumn("n_words", F.size(F.split("text", " "))).filter(F.col("n_words") >= least_words)
        self.texts = texts
        signed = texts.withColumn("class", F.unhex(F.md5("text"))).mapInPandas(_signer(words, BANDS, DEPTH), "id string, class binary, keys array<long>, print binary")
        signed = cut(signed.groupBy("id").agg(F.min("class").alias("class"), F.min_by("keys", "class").alias("keys"), F.min_by("print", "class").alias("print")))
        # what a step shuffled isn't needed once its result is written: all of it at once would exceed the disk
        spark = df.sparkSession
        release(spark)
        classes = signed.groupBy("class").agg(F.min("id").alias("name"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("print").alias("print"))
        classes = cut(classes)
        release(spark)
        many = classes.filter("n > 1").select("class", "name", "n")
        self.members = signed.select("id", "class").join(broadcast_if_small(many, 50_000), "class").select(F.col("name").alias("class"), "id", "n")
        # classes travel under a hash of eight bytes; should two share one, both are compared, as texts are what decides
        rows = classes.select(F.xxhash64("class").alias("c"), "print", F.posexplode("keys").alias("band", "key"))
        shards = self_join_shards(rows.select("c", "print", F.xxhash64("band", "key").alias("key")), ["key"], ["c"])
        release(spark)
        shards = shards.sortWithinPartitions("_h", "_shard", F.desc("asks"))
        met = shards.select("_h", "_shard", "asks", "answers", "c", "print").mapInPandas(_joiner, "a long, b long").distinct()
        names = classes.select(F.xxhash64("class").alias("class"), "name")
        met = met.join(names.select(F.col("class").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("class").alias("b"), F.col("name").alias("nb")), "b")
        near = cut(met.select(F.col("na").alias("a"), F.col("nb").alias("b")))
        # of all texts, only those of candidates travel
        wanted = broadcast_if_small(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), BROADCAST_IDS)
        release(spark)
        text = texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.md5("text")).alias("text"))
        with_text = near.join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        self.pairs = with_text.select("a", "b", "text_a", "text_b").mapInPandas(_similar(words, least), "a string, b string, similarity double")

    def id_pairs(self, expanded: int | None = EXPANDED) -> DataFrame:
        """(id_a, id_b): the pairs, smaller id first, between ids of the classes.

        Members of a class of at most ``expanded`` ids each appear in all pairs of it. A larger class of copies appears
        as its first id, and that in a pair with each of its copies, so that no link between texts is lost. With None,
        every class is given in full.
        """
        pairs = cut(self.pairs.select("a", "b"))
        in_full = F.lit(True) if expanded is None else F.col("n") <= expanded
        # members are joined one by one, so that no class is gathered in a row
        few = self.members.filter(in_full).select("class", "id")
        wide = pairs
        for c in "ab":
            wide = wide.join(few.select(F.col("class").alias(c), F.col("id").alias(f"id_{c}")), c, "left")
        between = wide.select(F.coalesce("id_a", "a").alias("a"), F.coalesce("id_b", "b").alias("b"))
        inside = few.select("class", F.col("id").alias("a")).join(few.select("class", F.col("id").alias("b")), "class").filter("a < b").select("a", "b")
        star = self.members.filter(~in_full).select(F.col("class").alias("a"), F.col("id").alias("b"))
        every = between.unionByName(inside).unionByName(star).filter("a <> b")
        return every.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
