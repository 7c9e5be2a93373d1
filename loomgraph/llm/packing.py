"""Filling containers of fixed capacity with items: bounded-space online best fit.

Sizes are counted in tokens of a public tokenizer where the texts are read; only ids and sizes move. Items are dealt to
groups of about ``GROUP_CONTAINERS`` containers, and each group is packed by one task in one pass: at most ``OPEN`` bins
are open, known to a bitset by their free space, so that the best fit is the lowest bit set at or above the size.
If nothing fits and all bins are open, the fullest is closed. An item larger than the capacity is cut into pieces of
the capacity and a rest.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut

CAPACITY, OPEN, GROUP_CONTAINERS = 2048, 64, 4000
# Fixed value: how this vocabulary's tokenizer splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, made once in each Python process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(path)
        for pdf in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": n})

    return count


class Bins:
    """Open bins of one group. ``put`` gives the number of the bin that takes an item of a size up to the capacity."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.by_free: dict[int, list[int]] = {}
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - size
        if left or not size:
            self.by_free.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_


def _packer(capacity: int, most_open: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, base = Bins(capacity, most_open), int(pdf["g"].iloc[0]) << 32
        pdf = pdf.sort_values(["k", "begin_token"], kind="stable")
        return pdf.assign(container_id=[base + bins.put(int(n)) for n in pdf["n_tokens"]])[["doc_id", "piece", "begin_token", "n_tokens", "container_id"]]

    return pack


def packed(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, most_open: int = OPEN) -> DataFrame:
    """(doc_id, piece, begin_token, n_tokens, container_id): where each text goes.

    ``vocabulary`` is the path of a rank file that all executors can read. A text of at most ``capacity`` tokens is one
    piece and stays whole; a longer one is cut into pieces of ``capacity`` tokens and a rest. An empty text has no
    tokens and goes into the container at hand; a null text is left out. Repeated rows are packed as often as they
    come; an empty table gives no rows; further columns are ignored. No container holds more than ``capacity``.
    """
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    sizes = cut(texts.mapInPandas(_counter(vocabulary), "id long, n_tokens long"))
    total = sizes.agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c")).first()
    groups = max(1, ceil((total["n"] or 0) / (capacity * GROUP_CONTAINERS)), ceil(total["c"] / (capacity * GROUP_CONTAINERS)))
    # rows are numbered as they lie in the checkpoint, so that even one id on many rows is dealt over groups
    rows = sizes.withColumn("k", F.xxhash64("id", F.monotonically_increasing_id()))
    pieces = rows.select(
        F.col("id").alias("doc_id"), "k", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n_tokens") - 1), F.lit(capacity).cast("long"))).alias("piece", "begin_token")
    )
    pieces = pieces.withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("begin_token"), F.lit(capacity)))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("k", "piece"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(_packer(capacity, most_open), "doc_id long, piece int, begin_token long, n_tokens long, container_id long")


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used (null without containers)."""
    per = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.try_divide(F.sum("used"), F.count("*") * F.lit(float(capacity))).alias("filled"))
