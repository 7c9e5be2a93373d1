"""Chunkers: texts to chunks with paths and offsets. Offsets count bytes of the chunks one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import trim_space

SCHEMA = "content string, path string, start_pos int, end_pos int, chunk_index int"


def sentences(text: Column) -> Column:
    """Pieces of a text after ". ", "! " and "? ", and at every "|", untrimmed; none of a blank text."""
    t = text
    for mark in "!?.":
        t = F.replace(t, F.lit(f"{mark} "), F.lit(f"{mark}|"))
    return F.when(F.coalesce(trim_space(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\|"))


def _placed(df: DataFrame, contents: Column, gap: int, path: Callable[[Column, Column], Column]) -> DataFrame:
    """A row per element of ``contents`` (structs of ordinal and content) with offsets that run on by ``gap``."""
    ends = _running(F.transform(contents, lambda x: F.octet_length(x["content"]) + gap))
    out = df.withColumn("_c", F.explode(F.arrays_zip(contents.alias("c"), ends.alias("e"))))
    keep = [c for c in df.columns if c not in ("content",)]
    k, content, end = F.col("_c.c.k"), F.col("_c.c.content"), F.col("_c.e") - gap
    return out.select(*keep, content.alias("content"), path(F.col("base_path"), k).alias("path"), (end - F.octet_length(content)).alias("start_pos"), end.alias("end_pos"), k.alias("chunk_index"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running(sizes: pd.Series) -> pd.Series:
    """Running sums of each array, so that chunks needn't be counted one behind the other in an expression."""
    return sizes.map(lambda a: None if a is None else np.cumsum(a, dtype=np.int64).astype(np.int32))


def _numbered(contents: Column) -> Column:
    return F.transform(contents, lambda x, i: F.struct(i.alias("k"), x.alias("content")))


def sentence_chunks(df: DataFrame, text: str, per_chunk: int) -> DataFrame:
    """Chunks of ``per_chunk`` sentences joined by blanks, with paths ``base_path.chunk<k>``. ``df`` has base_path."""
    if per_chunk <= 0:
        raise ValueError("per_chunk must be positive")
    n = F.lit(per_chunk)
    with_pieces = df.withColumn("_s", sentences(F.col(text))).filter(F.size("_s") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / n).cast("int")), lambda i: F.array_join(F.slice(F.col("_s"), i * n + 1, n), " "))
    return _placed(with_pieces, _numbered(groups), 0, lambda b, k: F.concat(b, F.lit(".chunk"), k)).drop("_s")


def paragraph_chunks(df: DataFrame, text: str) -> DataFrame:
    """A chunk for each paragraph that isn't blank, trimmed; ``base_path.para<i>`` keeps the place among all, offsets skip two."""
    parts = F.transform(F.split(F.col(text), "\n\n"), lambda x, i: F.struct(i.alias("k"), trim_space(x).alias("content")))
    kept = F.filter(parts, lambda x: x["content"] != "")
    return _placed(df.filter(F.col(text).isNotNull()), kept, 2, lambda b, k: F.concat(b, F.lit(".para"), k))


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence model: unit vectors from hashed words and pairs of words."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            w = t.lower().split()
            for x in [*w, *map(" ".join, zip(w, w[1:]))]:
                h = zlib.crc32(x.encode())
                row[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(row)
            row /= n or 1.0
        return out

    embed.model = f"hashed words, {dim} values"
    return embed


def length_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """The stand-in of tests: value i is ((bytes + i) mod 100) / 100."""

    def embed(texts: list[str]) -> np.ndarray:
        n = np.array([len(t.encode()) for t in texts])[:, None]
        return ((n + np.arange(dim)) % 100 / 100).astype(np.float32)

    return embed


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """``df`` with the embedding of ``text`` in batches by Arrow; a null text has none."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        there = s.notna()
        if there.any():
            out[there] = pd.Series(list(embedder(s[there].tolist())), index=s.index[there], dtype=object)
        return out

    return df.withColumn(name, run(F.col(text)))


def semantic_cuts(lengths: list[int], vectors: np.ndarray, most: int, threshold: float) -> list[tuple[int, int]]:
    """Ranges of sentences: a new one begins where the next is unlike the mean of the current or would exceed ``most`` bytes."""
    out, begin, size, total = [], 0, 0, np.zeros(vectors.shape[1])
    for i, n in enumerate(lengths):
        if i > begin:
            mean, v = total / (i - begin), vectors[i].astype(np.float64)
            norm = np.linalg.norm(mean) * np.linalg.norm(v)
            like = float(mean @ v / norm) if norm else 0.0
            if like < threshold or size + n > most:
                out.append((begin, i))
                begin, size, total = i, 0, np.zeros(vectors.shape[1])
        size, total = size + n, total + vectors[i]
    return [*out, (begin, len(lengths))] if lengths else out


def semantic_chunks(df: DataFrame, key: str, text: str, most: int, threshold: float, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(key, content, path, start_pos, end_pos, chunk_index, metadata): sentences grouped by likeness up to ``most`` bytes.

    ``df`` has ``key``, base_path and ``text``. A text without sentences gives no rows. Metadata name the model of the
    embedder: its attribute ``model``, else its name.
    """
    run = embedder or hashing_embedder()
    model = getattr(run, "model", getattr(run, "__name__", type(run).__name__))
    kind = df.schema[key].dataType.simpleString()

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = []
            for k, base, parts in zip(pdf["key"], pdf["base_path"], pdf["s"]):
                s = [x.strip() for x in parts if x.strip()]
                if not s:
                    continue
                at = 0
                for n, (a, z) in enumerate(semantic_cuts([len(x.encode()) for x in s], np.asarray(run(s)), most, threshold)):
                    c = " ".join(s[a:z])
                    meta = json.dumps({"chunking_method": "semantic", "embedding_model": model, "num_sentences": z - a})
                    rows.append((k, c, f"{base}.chunk{n}", at, at + len(c.encode()), n, meta))
                    at += len(c.encode())
            yield pd.DataFrame(rows, columns=["key", "content", "path", "start_pos", "end_pos", "chunk_index", "metadata"])

    made = df.select(F.col(key).alias("key"), "base_path", sentences(F.col(text)).alias("s")).mapInPandas(chunk, f"key {kind}, {SCHEMA}, metadata string")
    return made.withColumnRenamed("key", key)
