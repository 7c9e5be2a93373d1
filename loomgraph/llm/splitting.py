"""Splitting oversized texts at natural boundaries: content-defined chunking.

A rolling hash over the last ``WINDOW`` bytes marks landmarks, on average every ``EVERY`` bytes. Each piece ends at the
natural boundary nearest to the first landmark between its least and its most size: the end of a paragraph if there
is any in reach, else of a sentence, else of a word, else between two characters. Landmarks and boundaries depend on
nearby text only, so an edit changes the pieces around it and later ones fall into step again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece at most and of its own text (without the repeated part) at least; bytes repeated at most.
MOST, LEAST, OVERLAP = 4000, 1500, 200
WINDOW, EVERY = 32, 512

_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:(?:\r\n|\r|\n)[^\S\r\n]*)+|[ \f]\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？।؟][\"'”’」』）]*\s*|(?:\r\n|\r|\n)")
_WORD = re.compile(r"\s+")
_TABLE = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def landmarks(data: bytes) -> np.ndarray:
    """Ends, in bytes, of the windows whose rolling hash has its upper bits zero."""
    b = _TABLE[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(b), np.uint32)
    for k in range(min(WINDOW, len(b))):
        h[k:] += b[: len(b) - k] << np.uint32(k)
    return np.flatnonzero(h >> np.uint32(32 - EVERY.bit_length() + 1) == 0) + 1


def pieces(text: str, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) in characters of the pieces of ``text``: one if it has at most ``most`` bytes.

    Every piece but the first begins with up to ``overlap`` bytes of the one before, from the start of a word on if
    there is one. Pieces cover the text without gaps and have at most ``most`` bytes each.
    """
    data = text.encode("utf-8", "replace")
    if len(data) <= most:
        return [(0, len(text))]
    # the place in bytes of every character, and of the end
    raw = np.frombuffer(data, np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    ends = [np.unique([at[m.end()] for m in p.finditer(text)] or [0]) for p in (_PARAGRAPH, _SENTENCE, _WORD)]
    marks = landmarks(data)
    out: list[tuple[int, int]] = []
    begin = cut = 0  # of the piece with what it repeats, and of its own text
    while len(raw) - begin > most:
        low, high = cut + least, begin + most
        low = min(low, high - 1)
        i = np.searchsorted(marks, low)
        goal = marks[i] if i < len(marks) and marks[i] <= high else high
        end = -1
        for kind in ends:
            a, z = np.searchsorted(kind, [low, high + 1])
            if a < z:
                end = int(kind[a + np.argmin(np.abs(kind[a:z] - goal))])
                break
        if end < 0:
            # no boundary in reach: the last one before it, else between characters, not before a combining one
            a, z = np.searchsorted(ends[2], [cut + 1, low])
            if a < z:
                end = int(ends[2][z - 1])
            else:
                k = int(np.searchsorted(at, high, "right")) - 1
                first = int(np.searchsorted(at, cut, "right"))
                while k > first and _combining(text[k]):
                    k -= 1
                end = int(at[k])
        out.append((begin, end))
        cut = end
        a, z = np.searchsorted(ends[2], [cut - overlap, cut])
        begin = int(ends[2][a]) if a < z else int(at[np.searchsorted(at, cut - overlap)])
        begin = max(begin, out[-1][0] + 1)
        begin = min(int(at[np.searchsorted(at, begin)]), cut)
    out.append((begin, len(raw)))
    return [(int(np.searchsorted(at, a)), int(np.searchsorted(at, z))) for a, z in out]


def _combining(c: str) -> bool:
    return 0x300 <= ord(c) <= 0x36F or ord(c) in (0x200D, 0xFE0F)


def newest(records: DataFrame) -> DataFrame:
    """(id, rid, content): the row of each id with the newest updated_at; of several, the newest created_at, then content.

    A missing time is older than any other. Null ids are left out.
    """
    row = F.max_by(F.struct("rid", "content"), F.struct("updated_at", "created_at", "content"))
    return records.filter("id IS NOT NULL").groupBy("id").agg(row.alias("r")).select("id", "r.rid", "r.content")


def _splitter(most: int, least: int, overlap: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, rid, text in zip(pdf["id"], pdf["rid"], pdf["content"]):
                for k, (a, z) in enumerate(pieces(text, most, least, overlap)):
                    rows.append((i, f"doc_{rid}.chunk{k}" if rid else f"doc_{i}.chunk{k}", k, a, z, text[a:z]))
            yield pd.DataFrame(rows, columns=["id", "path", "chunk_index", "start_pos", "end_pos", "content"])

    return split


def split_oversized(records: DataFrame, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """(id, path, chunk_index, start_pos, end_pos, content): the pieces of the documents of more than ``most`` bytes.

    Of each id, the newest row counts. ``start_pos`` and ``end_pos`` count characters of its content, of which a piece
    is the part between them. Documents within the limit, null and empty ones give no rows; nor does an empty table.
    Rows repeated under one id count once; further columns are ignored.
    """
    large = newest(records).filter(F.octet_length("content") > most)
    return large.mapInPandas(_splitter(most, least, overlap), "id long, path string, chunk_index int, start_pos int, end_pos int, content string")
